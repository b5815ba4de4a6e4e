"""Subscriber profiles kept up to date by a stream of bot events.

`profile_batches` is the default: every micro-batch runs the relational fold, which spreads a
busy subscriber over tasks. `stream_profile_fold` replays events against Spark's state store
instead; there one subscriber's events of a micro-batch meet in one task, so bound the batch
at the source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postloom.operators.profiles import CONFIRM, KEYS, QUESTIONS, RESETS, START_WORDS, open_events, profile_fold
from postloom.schemas import FLAG_DEFAULTS, FLAGS
from postloom.session import cut
from postloom.streaming.changes import ChangeStore
from postloom.streaming.stages import start_batches

WIZARD = ["wizard_step", "wizard_mode", "wizard_draft"]
PROFILE_SCHEMA = (
    "platform STRING, external_id BIGINT, seq BIGINT, status STRING, "
    + ", ".join(f"{f} BOOLEAN" for f in FLAGS)
    + ", wizard_step INT, wizard_mode STRING, wizard_draft MAP<STRING, BOOLEAN>"
)
EVENT_SCHEMA = "platform STRING, external_id BIGINT, seq BIGINT, kind STRING, data STRING"
STATE_SCHEMA = "profile STRING"
_NUMBERED = re.compile(r"(f|opt)([0-9]+)")


def profile_store(spark: SparkSession, profiles: DataFrame, path: str, every: int = 16) -> ChangeStore:
    """The profiles that `profile_batches` keeps below `path`; `current()` gives them all."""
    return ChangeStore(spark, f"{path}/profiles", KEYS, profiles, every)


def profile_batches(
    events: DataFrame, profiles: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: int = 16
) -> StreamingQuery:
    """Keep the profiles in a `profile_store` up to date: a batch folds and writes the subscribers in it only.

    A batch starts from the stored flags and the events since each subscriber's last reset,
    from which the open wizard follows; a wizard open in `profiles` holds until the first reset. What a batch
    wrote is replaced when it is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = profile_store(spark, profiles, path, every)
        nothing = spark.createDataFrame([], EVENT_SCHEMA)
        opened = ChangeStore(spark, f"{path}/open", KEYS, nothing, every)
        new = cut(batch.select(*KEYS, "seq", "kind", "data"))
        touched = cut(new.select(*KEYS).distinct())
        earlier = opened.current(batch_id, touched)
        known = stored.current(batch_id, touched).drop(*WIZARD)
        if set(WIZARD) <= set(profiles.columns):
            begun = earlier.where((F.col("kind") == "callback") & F.col("data").isin(RESETS)).select(*KEYS).distinct()
            known = known.join(profiles.select(*KEYS, *WIZARD).join(begun, KEYS, "left_anti"), KEYS, "left")
        history = new.unionByName(earlier)
        stored.write(batch_id, profile_fold(history, known), touched)
        opened.write(batch_id, open_events(history), touched)
        stored.compact(batch_id)
        opened.compact(batch_id)

    return start_batches(events, write, checkpoint, available_now)


def new_profile() -> dict:
    return {"status": "active", "flags": dict(FLAG_DEFAULTS), "step": None, "mode": None, "draft": None}


def apply_event(profile: dict, kind: str, data: str | None) -> dict:
    """Profile after one event (a new dict; unchanged parts are shared)."""
    data = (data or "").strip()
    closed = {"step": None, "mode": None, "draft": None}
    if kind == "message":
        return {**profile, "status": "active"} if data.lower() in START_WORDS else profile
    if data == "start":
        return {**profile, "status": "active"}
    if data in RESETS:
        flags = profile["flags"]
        opened = {
            "reconf_all": {"step": 0, "mode": "all", "draft": {}},
            "reconf_one": {"step": CONFIRM, "mode": "pick", "draft": dict(flags)},
        }.get(data, closed)
        if data == "save":
            flags = {**flags, **(profile["draft"] or {})}
        status = "paused" if data == "pause" else profile["status"]
        return {**profile, "status": status, "flags": flags, **opened}
    numbered = _NUMBERED.fullmatch(data)
    if not numbered:
        return profile
    number = int(numbered.group(2))
    if numbered.group(1) == "f":
        if number >= CONFIRM:
            return profile
        draft = dict(profile["flags"]) if profile["draft"] is None else profile["draft"]
        return {**profile, "step": number, "mode": "pick", "draft": draft}
    step = profile["step"]
    if step is None or step >= CONFIRM or not 1 <= number <= len(QUESTIONS[step]):
        return profile
    draft = {**(profile["draft"] or {}), **QUESTIONS[step][number - 1]}
    return {**profile, "draft": draft, "step": step + 1 if profile["mode"] == "all" else CONFIRM}


def _creates(kind: str, data: str | None) -> bool:
    """A failing update is rolled back whole and creates no subscriber."""
    numbered = _NUMBERED.fullmatch((data or "").strip()) if kind == "callback" else None
    return not (numbered and numbered.group(1) == "f" and int(numbered.group(2)) >= CONFIRM)


def stream_profile_fold(events: DataFrame) -> DataFrame:
    """One row per subscriber and micro-batch: the profile after the batch's last event.

    A batch is bounded by the source's files per trigger; across batches only the profile is
    kept. Update mode; the newest row per subscriber (by `seq`) is the current profile.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        profile = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        last = None
        for seq, kind, data in zip(rows["seq"], rows["kind"], rows["data"]):
            if _creates(kind, data):
                profile = apply_event(profile or new_profile(), kind, data)
                last = int(seq)
        if last is None:
            return
        state.update((json.dumps(profile),))
        yield pd.DataFrame(
            {
                "platform": [key[0]],
                "external_id": [key[1]],
                "seq": [last],
                "status": [profile["status"]],
                **{f: [profile["flags"][f]] for f in FLAGS},
                "wizard_step": pd.array([profile["step"]], dtype="Int32"),
                "wizard_mode": [profile["mode"]],
                "wizard_draft": [profile["draft"]],
            }
        )

    return events.groupBy(*KEYS).applyInPandasWithState(
        fold, PROFILE_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )
