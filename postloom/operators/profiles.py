"""Folding bot events into subscriber profiles, as joins and running maxima.

The dialogue is a state machine, but its effect on the stored filters needs no sequential
replay. Some events (`RESETS`) put the wizard into a state that does not depend on what came
before; they cut a subscriber's history into sessions. Inside a session an answer depends only
on the last event that chose a question. A session changes the filters iff the event closing
it is `save`. "Last event before" is a running maximum, scanned over range partitions, so one
subscriber with very many events does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.parsing import callback_number
from postloom.functions.text import strip_spaces
from postloom.operators.ordered import scan, split_runs
from postloom.schemas import FLAG_DEFAULTS, FLAGS
from postloom.session import cut

KEYS = ["platform", "external_id"]
# Events that decide the wizard state alone, start words, filter order, answers.
RESETS = ["pause", "menu", "settings", "cancel", "save", "reconf_all", "reconf_one"]
START_WORDS = ["/start", "старт"]
QUESTIONS = [
    [{"src_vk": True, "src_tg": True}, {"src_vk": True, "src_tg": False}, {"src_vk": False, "src_tg": True}],
    [{"payment_required": True}, {"payment_required": False}],
    [{"address_required": True}, {"address_required": False}],
    [{"wt_handyman": True}, {"wt_handyman": False}],
    [{"wt_loader": True}, {"wt_loader": False}],
    [{"wt_specialist": True}, {"wt_specialist": False}],
    [{"wt_unknown": True}, {"wt_unknown": False}],
    [{"dur_short_task": True}, {"dur_short_task": False}],
    [{"dur_full_shift": True}, {"dur_full_shift": False}],
    [{"dur_permanent": True}, {"dur_permanent": False}],
    [{"dur_vahta": True}, {"dur_vahta": False}],
    [{"dur_unknown": True}, {"dur_unknown": False}],
]
CONFIRM = len(QUESTIONS)
BEFORE_ALL = -1


def read_events(events: DataFrame) -> DataFrame:
    """Events with their parsed form. `seq` orders a subscriber's events, unique and >= 0.

    `f<N>` beyond the last question fails as a whole in the dialogue and leaves no trace.
    """
    return _parse(_trimmed(events))


def _trimmed(events: DataFrame) -> DataFrame:
    return events.select(*KEYS, "seq", "kind", strip_spaces(F.coalesce(F.col("data"), F.lit(""))).alias("data"))


def _parse(events: DataFrame) -> DataFrame:
    """Parsed events; further columns of `events` are kept."""
    data, called = F.col("data"), F.col("kind") == "callback"
    more = [c for c in events.columns if c not in (*KEYS, "seq", "kind", "data")]
    parsed = events.select(
        *KEYS,
        *more,
        F.col("seq").cast("bigint").alias("seq"),
        called.alias("called"),
        F.when(called, data).otherwise(F.lower(data)).alias("data"),
        F.when(called & data.startswith("f"), callback_number(data, "f")).alias("question"),
        F.when(called & data.startswith("opt"), callback_number(data, "opt")).alias("option"),
    )
    parsed = parsed.where(F.coalesce(F.col("question") < CONFIRM, F.lit(True)))
    is_reset = F.col("called") & F.col("data").isin(RESETS)
    mode = (
        F.when(F.col("data") == "reconf_all", F.lit("all"))
        .when((F.col("data") == "reconf_one") | F.col("question").isNotNull(), F.lit("pick"))
        .otherwise(F.lit(""))
    )
    step = (
        F.when(F.col("data") == "reconf_all", F.lit(0))
        .when(F.col("data") == "reconf_one", F.lit(CONFIRM))
        .otherwise(F.coalesce("question", F.lit(CONFIRM)))
    )
    at_open = is_reset | F.col("question").isNotNull()
    if "stored_mode" in events.columns:
        mode, step = F.coalesce("stored_mode", mode), F.coalesce("stored_step", step)
        at_open = at_open | F.col("stored_mode").isNotNull()
    opened = F.struct(F.col("seq").alias("seq"), mode.alias("mode"), step.alias("step"))
    return parsed.withColumns(
        {
            "reset": F.when(is_reset, F.struct(F.col("seq").alias("seq"), F.col("data").alias("data"))),
            "opened": F.when(at_open, opened),
        }
    )


def _status_set() -> Column:
    """Status an event sets, null for most events."""
    return (
        F.when(F.col("called") & (F.col("data") == "pause"), F.lit("paused"))
        .when(F.col("called") & (F.col("data") == "start"), F.lit("active"))
        .when(~F.col("called") & F.col("data").isin(START_WORDS), F.lit("active"))
    )


def open_events(events: DataFrame) -> DataFrame:
    """Events a later fold still needs: each subscriber's last reset and what follows it.

    Of these only events that can change the wizard or the status are kept.
    """
    parsed = read_events(events)
    last = parsed.groupBy(*KEYS).agg(F.max("reset.seq").alias("_last"))
    useful = F.col("opened").isNotNull() | F.col("option").isNotNull() | _status_set().isNotNull()
    rows = parsed.where(useful).join(last, KEYS).where(F.col("seq") >= F.coalesce("_last", F.lit(BEFORE_ALL)))
    kind = F.when(F.col("called"), F.lit("callback")).otherwise(F.lit("message"))
    return rows.select(*KEYS, "seq", kind.alias("kind"), "data")


def _status(parsed: DataFrame) -> DataFrame:
    status = _status_set()
    at = F.when(status.isNotNull(), F.col("seq"))
    return parsed.groupBy(*KEYS).agg(F.max_by(status, at).alias("status"))


def fold_status(events: DataFrame) -> DataFrame:
    """Last pause or start per subscriber; null for one who never sent either."""
    return _status(read_events(events))


def command_fold(events: DataFrame) -> DataFrame:
    """Effect of text messages alone: known senders and the last start word."""
    return fold_status(events.where("kind = 'message'"))


def fold_direct(writes: DataFrame) -> DataFrame:
    """Last write per (subscriber, flag), from rows (platform, external_id, seq, flag, value)."""
    return writes.groupBy(*KEYS, "flag").agg(F.max_by("value", "seq").alias("value"))


def _answers(rows: DataFrame) -> DataFrame:
    """Answers that count, with the question each one answers.

    Picking one filter takes the first valid answer. Going through all of them takes one
    answer per question: of the three-way first question any of 1..3, then only 1 or 2.
    """
    asked = rows.where(
        F.col("option").between(1, 3) & (F.col("last_open.mode") != "") & (F.col("last_open.step") < CONFIRM)
    ).select(
        *KEYS,
        F.coalesce("last_reset.seq", F.lit(BEFORE_ALL)).alias("session"),
        F.col("last_open.seq").alias("opener"),
        F.col("last_open.mode").alias("mode"),
        F.col("last_open.step").alias("step"),
        "seq",
        "option",
    )
    group = [*KEYS, "session", "opener"]
    columns = [*group, "seq", "step", "option"]
    picks = (
        asked.where((F.col("mode") == "pick") & ((F.col("option") < 3) | (F.col("step") == 0)))
        .groupBy(*group, "step")
        .agg(F.min(F.struct("seq", "option")).alias("a"))
        .select(*group, "a.seq", "step", "a.option")
    )
    passes = asked.where("mode = 'all'")
    # a stored pass may start beyond the first question
    threes = passes.where("step = 0").groupBy(*group).agg(
        F.min(F.when(F.col("option") == 3, F.col("seq"))).alias("three"),
        F.min(F.when(F.col("option") < 3, F.col("seq"))).alias("other"),
    )
    threes = threes.where((F.col("three") < F.col("other")) | (F.col("three").isNotNull() & F.col("other").isNull()))
    opening = threes.select(*group, F.col("three").alias("seq"), F.lit(0).alias("step"), F.lit(3).alias("option"))
    # at most one answer per question: the bound is kept on the map side too
    order = Window.partitionBy(*group).orderBy("seq")
    walked = (
        passes.where("option < 3")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= CONFIRM)
        .join(threes.select(*group, "three"), group, "left")
        .withColumn("step", F.col("step") + F.col("rn") - F.when(F.col("three").isNull(), 1).otherwise(0))
        .where(F.col("step") < CONFIRM)
    )
    return picks.select(columns).unionByName(opening.select(columns)).unionByName(walked.select(columns))


def _assignments() -> Column:
    """Flags set by (step, option), as an array of (flag, value)."""
    table = []
    for step, options in enumerate(QUESTIONS):
        for option, flags in enumerate(options, start=1):
            sets = [F.struct(F.lit(f).alias("flag"), F.lit(v).alias("value")) for f, v in flags.items()]
            table += [F.lit(step * 10 + option), F.array(*sets)]
    return F.element_at(F.create_map(*table), F.col("step") * 10 + F.col("option"))


def _last_per_flag(order: Column) -> list[Column]:
    return [
        F.max_by("value", F.when(F.col("flag") == flag, order)).alias(f"_{flag}") for flag in FLAGS
    ]


def profile_fold(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles after all events, wizard state included.

    A wizard that `profiles` holds open (wizard_step, wizard_mode, wizard_draft) is an opening before all
    events, and its draft are answers given before them.
    """
    # trimmed text is cut and written first: parsing it refers to it many times
    nothing = {"stored_mode": F.lit(None).cast("string"), "stored_step": F.lit(None).cast("int")}
    given, stored_draft = _trimmed(events).withColumns(nothing).withColumn("seq", F.col("seq").cast("bigint")), None
    if {"wizard_step", "wizard_mode", "wizard_draft"} <= set(profiles.columns):
        held = profiles.where("wizard_step IS NOT NULL AND wizard_mode <> ''")
        before = F.lit(BEFORE_ALL).cast("bigint")
        given = given.unionByName(
            held.select(
                *KEYS, before.alias("seq"), F.lit("stored").alias("kind"), F.lit("").alias("data"),
                F.col("wizard_mode").alias("stored_mode"), F.col("wizard_step").cast("int").alias("stored_step"),
            )
        )
        stored_draft = held.select(*KEYS, F.explode("wizard_draft").alias("flag", "value")).where("value IS NOT NULL")
        stored_draft = stored_draft.withColumns({"session": before, "opener": before, "seq": before})
    runs = _parse(split_runs(given, KEYS, ["seq"]))
    rows = scan(
        runs,
        KEYS,
        ["seq"],
        {"last_reset": ("max", F.col("reset")), "last_open": ("max", F.col("opened"))},
        inclusive=False,
    )
    # read several times below; only answers and saves matter from here on
    rows = cut(rows.where(F.col("option").isNotNull() | (F.col("called") & (F.col("data") == "save"))))
    writes = _answers(rows).select("*", F.inline(_assignments()))
    writes = cut(writes if stored_draft is None else writes.unionByName(stored_draft, allowMissingColumns=True))
    saves = rows.where(F.col("called") & (F.col("data") == "save")).select(
        *KEYS, F.coalesce("last_reset.seq", F.lit(BEFORE_ALL)).alias("session"), F.col("seq").alias("saved")
    )
    stored = (
        writes.join(saves, [*KEYS, "session"])
        .groupBy(*KEYS)
        .agg(*_last_per_flag(F.struct("saved", "seq")))
    )
    ends = runs.groupBy(*KEYS).agg(
        F.coalesce(F.max("reset.seq"), F.lit(BEFORE_ALL)).alias("session"),
        F.max("reset")["data"].alias("reset_by"),
        F.max("opened").alias("opened"),
        (F.max("stored_mode").isNotNull() & F.max("reset.seq").isNull()).alias("resumed"),
    )
    drafts = (
        writes.join(ends.select(*KEYS, "session", F.col("opened.seq").alias("current")), [*KEYS, "session"])
        .groupBy(*KEYS)
        .agg(
            F.count_distinct(F.when(F.col("opener") == F.col("current"), F.col("step"))).alias("answered"),
            F.map_from_entries(
                F.array_compact(
                    F.array(
                        *[
                            F.when(
                                F.max_by("value", F.when(F.col("flag") == f, F.col("seq"))).isNotNull(),
                                F.struct(
                                    F.lit(f).alias("flag"),
                                    F.max_by("value", F.when(F.col("flag") == f, F.col("seq"))).alias("value"),
                                ),
                            )
                            for f in FLAGS
                        ]
                    )
                )
            ).alias("draft"),
        )
    )
    out = (
        profiles.select(*KEYS, F.col("status").alias("old_status"), *FLAGS)
        .join(ends, KEYS, "full_outer")
        .join(_status(runs).withColumnRenamed("status", "new_status"), KEYS, "left")
        .join(stored, KEYS, "left")
        .join(drafts, KEYS, "left")
    )
    flags = {f: F.coalesce(f"_{f}", f, F.lit(FLAG_DEFAULTS[f])) for f in FLAGS}
    open_ = F.coalesce(F.col("opened.mode") != "", F.lit(False))
    answered = F.coalesce("answered", F.lit(0))
    step = (
        F.when(F.col("opened.mode") == "all", F.col("opened.step") + answered)
        .when(answered > 0, F.lit(CONFIRM))
        .otherwise(F.col("opened.step"))
    )
    snapshot = F.create_map(*[x for f in FLAGS for x in (F.lit(f), flags[f])])
    answers = F.coalesce("draft", F.create_map().cast("map<string,boolean>"))
    base = F.map_filter(snapshot, lambda k, _: ~F.map_contains_key(answers, k))
    draft = F.when((F.col("reset_by") == "reconf_all") | F.col("resumed"), answers).otherwise(F.map_concat(answers, base))
    return out.select(
        *KEYS,
        F.coalesce("new_status", "old_status", F.lit("active")).alias("status"),
        *[value.alias(f) for f, value in flags.items()],
        F.when(open_, step.cast("int")).alias("wizard_step"),
        F.when(open_, F.col("opened.mode")).alias("wizard_mode"),
        F.when(open_, draft).alias("wizard_draft"),
    )
