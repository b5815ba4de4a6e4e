"""Publish policy, message text, subscriber matching, outboxes and send pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.ordered import RUN, scan, split_runs
from postloom.operators.status import active_subscribers
from postloom.schemas import DURATIONS, WORK_TYPES

# Message labels and channel limits.
UNKNOWN_TEXT = "не удалось определить"
SOURCE_LABELS = {"vk": "VK", "tg": "Telegram"}
DURATION_LABELS = {
    "permanent": "Постоянная работа",
    "full_shift": "Разовая заявка на целую смену",
    "short_task": "Разовая быстрая заявка",
    "vahta": "Вахта",
}
WORK_TYPE_LABELS = {"loader": "Грузчик", "handyman": "Разнорабочий", "specialist": "Специалист"}
HEADER = "Новая заявка!"
TEXT_LIMIT = 4096
PHOTO_LIMIT = 10
YES, NO = "да", "нет"
SUMMARY_LABELS = [
    ("Оплата", "payment_required", "только с указанной оплатой", "с оплатой и без"),
    ("Адрес", "address_required", "только с указанным адресом", "с адресом и без"),
    ("Заявки для разнорабочих", "wt_handyman", YES, NO),
    ("Заявки для грузчиков", "wt_loader", YES, NO),
    ("Заявки для узких специалистов", "wt_specialist", YES, NO),
    ("Заявки с неопределённым характером работы", "wt_unknown", YES, NO),
    ("Короткие разовые заявки", "dur_short_task", YES, NO),
    ("Разовые на целую смену", "dur_full_shift", YES, NO),
    ("Постоянная работа", "dur_permanent", YES, NO),
    ("Вахта", "dur_vahta", YES, NO),
    ("Заявки с неопределённой длительностью", "dur_unknown", YES, NO),
]


def _label(value: Column, labels: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
    return F.coalesce(F.element_at(pairs, value), default)


def publish_policy(duration: Column) -> Column:
    """Channels take no permanent and no rotation work; posts without attributes pass."""
    return ~F.coalesce(duration.isin("permanent", "vahta"), F.lit(False))


def format_post(
    source: Column,
    text: Column,
    chat_url: Column,
    post_url: Column,
    attributes: Column,
    header: str = HEADER,
) -> Column:
    """Readable message of one post."""
    unknown = F.lit(UNKNOWN_TEXT)

    def given(name: str) -> Column:
        return F.coalesce(F.nullif(attributes[name], F.lit("")), unknown)

    return F.concat(
        F.lit(f"{header}\n\n🕒 Длительность - "),
        _label(attributes["duration"], DURATION_LABELS, unknown),
        F.lit("\n🔨 Характер работы - "),
        _label(attributes["work_type"], WORK_TYPE_LABELS, unknown),
        F.lit("\n💵 Оплата - "),
        given("payment"),
        F.lit("\n📍 Адрес - "),
        given("address"),
        F.lit("\n\nИсходный текст:\n"),
        text,
        F.lit("\n\nИсточник - "),
        _label(source, SOURCE_LABELS, source),
        F.lit(", "),
        chat_url,
        F.lit("\nИсходная публикация - "),
        post_url,
    )


# The filter categories and the places of their filters.
CATEGORIES = {"Источник заявок": [0], "Оплата и адрес": [1, 2], "Характер работы": [3, 4, 5, 6], "Длительность": [7, 8, 9, 10, 11]}


def _settings() -> list[Column]:
    """`label: value` of every filter of a subscriber row, in order."""
    vk, tg = F.col("src_vk"), F.col("src_tg")
    sources = (
        F.when(vk & tg, F.lit("VK и Telegram"))
        .when(vk, F.lit("только VK"))
        .when(tg, F.lit("только Telegram"))
        .otherwise(F.lit("—"))
    )
    chosen = [F.concat(F.lit("Источники: "), sources)]
    for label, flag, yes, no in SUMMARY_LABELS:
        chosen.append(F.concat(F.lit(f"{label}: "), F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no))))
    return chosen


def _numbered(lines: list[Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{i}) "), line) for i, line in enumerate(lines, start=1)])


def settings_summary() -> Column:
    """Numbered lines describing the filters of a subscriber row."""
    return _numbered(_settings())


def category_summary(category: str) -> Column:
    """The numbered lines of one category of filters, counted from 1."""
    lines = _settings()
    return _numbered([lines[i] for i in CATEGORIES[category]])


def post_class(source: Column, attributes: Column) -> Column:
    """The five facts about a post that any filter can depend on."""
    return F.struct(
        F.when(source.isin("vk", "tg"), source).otherwise(F.lit("other")).alias("source"),
        F.coalesce(attributes["work_type"], F.lit("unknown")).alias("work_type"),
        F.coalesce(attributes["duration"], F.lit("unknown")).alias("duration"),
        F.coalesce(attributes["payment"] != "", F.lit(False)).alias("has_payment"),
        F.coalesce(attributes["address"] != "", F.lit(False)).alias("has_address"),
    )


def _subscriber_classes() -> Column:
    """All post classes the filters of a subscriber row let through (at most 240)."""

    def allowed(flags: dict[str, Column]) -> Column:
        options = F.array(*[F.when(ok, F.lit(value)) for value, ok in flags.items()])
        return F.filter(options, lambda v: v.isNotNull())

    true = F.lit(True)
    sources = allowed({"vk": F.col("src_vk"), "tg": F.col("src_tg"), "other": true})
    works = allowed({w: F.col(f"wt_{w}") for w in WORK_TYPES})
    durations = allowed({d: F.col(f"dur_{d}") for d in DURATIONS})
    both = F.array(F.lit(True), F.lit(False))
    payments = F.when(F.col("payment_required"), F.array(true)).otherwise(both)
    addresses = F.when(F.col("address_required"), F.array(true)).otherwise(both)

    def combine(outer: Column, inner) -> Column:
        return F.flatten(F.transform(outer, inner))

    return combine(
        sources,
        lambda s: combine(
            works,
            lambda w: combine(
                durations,
                lambda d: combine(
                    payments,
                    lambda p: F.transform(
                        addresses,
                        lambda a: F.struct(
                            s.alias("source"),
                            w.alias("work_type"),
                            d.alias("duration"),
                            p.alias("has_payment"),
                            a.alias("has_address"),
                        ),
                    ),
                ),
            ),
        ),
    )


def match_summary(posts: DataFrame, subscribers: DataFrame, post_id: str = "post_id") -> DataFrame:
    """Matched posts per active subscriber: number, first and last id.

    Posts are counted per class first (at most 240 rows), so no pair of a post and a subscriber is made.
    """
    classes = posts.groupBy(post_class(F.col("source"), F.col("attributes")).alias("class")).agg(
        F.count("*").alias("n"), F.min(post_id).alias("low"), F.max(post_id).alias("high")
    )
    wanted = subscribers.where("status = 'active'").select("platform", "external_id", F.explode(_subscriber_classes()).alias("class"))
    return wanted.join(classes, "class").groupBy("platform", "external_id").agg(
        F.sum("n").alias("posts"), F.min("low").alias("first_post"), F.max("high").alias("last_post")
    )


def _class_number(c: Column) -> Column:
    """The number of a post class among the 240, null for one that no filter can want."""
    number, known = F.lit(0), F.lit(True)
    for name, values in (("source", ["vk", "tg", "other"]), ("work_type", WORK_TYPES), ("duration", DURATIONS)):
        place = F.array_position(F.array(*[F.lit(v) for v in values]), c[name])
        number, known = number * len(values) + place - 1, known & (place > 0)
    return F.when(known, number * 4 + c["has_payment"].cast("int") * 2 + c["has_address"].cast("int")).cast("int")


#: Rows of either side that a cell holds at most, on the average.
LISTED = 100_000


def _cuts(posts: dict[int, int], takers: dict[int, int], parts: int, least: int) -> dict[int, tuple[int, int]]:
    """In how many the posts and the subscribers of each class are cut, so that no cell has far more pairs than others.

    A class with k times the pairs of a cell is cut into k cells, in such a way that the fewest rows are copied.
    """
    pairs = {c: n * takers[c] for c, n in posts.items() if c in takers}
    target, cuts = max(sum(pairs.values()) // (4 * parts), least, 1), {}
    for c, size in pairs.items():
        k = -(-size // target)
        b = min(max(round((k * takers[c] / posts[c]) ** 0.5), 1), k)
        cuts[c] = max(-(-k // b), -(-posts[c] // LISTED)), max(b, -(-takers[c] // LISTED))
    return cuts


CELL = ["_class", "_i", "_j"]


def _dealt(posts: DataFrame, subscribers: DataFrame, carried: list[str], posts_per_salt: int) -> tuple[DataFrame, DataFrame]:
    """Posts (`carried`) and active subscribers by CELL: a post meets every subscriber it passes in one cell.

    Filters look at five facts with 240 combinations, so matching is an equality join on the combination; subscribers are
    expanded to the combinations they allow. So few keys would mean few, huge tasks: both sides are counted by class (240
    numbers) and cut, and a cell is a cut of the one with a cut of the other. A row is copied to some cells of its class
    only; small classes, with some `posts_per_salt` squared pairs, are not cut.
    """
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = posts.withColumn("_class", _class_number(post_class(F.col("source"), F.col("attributes")))).where("_class IS NOT NULL")
    wanted = wanted.select("_class", *carried)
    takers = active_subscribers(subscribers).select("platform", "external_id", F.explode(_subscriber_classes()).alias("_class"))
    takers = takers.withColumn("_class", _class_number(F.col("_class")))
    sizes = [dict(df.groupBy("_class").agg(F.count("*")).collect()) for df in (wanted.select("_class"), takers.select("_class"))]
    cuts = _cuts(*sizes, parts, posts_per_salt**2)
    at = [F.element_at(F.array(*[F.lit(cuts.get(c, (0, 0))[i]) for c in range(240)]), F.col("_class") + 1) for i in (0, 1)]

    def dealt(df: DataFrame, key: str, own: int) -> DataFrame:
        """A row in one cut of its own side, by its key, and in all cuts of the other."""
        both = [F.pmod(F.xxhash64(key), at[own]).cast("int"), F.explode(F.sequence(F.lit(0), at[1 - own] - 1))]
        names = ["_i", "_j"] if own == 0 else ["_j", "_i"]
        return df.where(at[own] > 0).select("*", *[c.alias(n) for c, n in zip(both, names)]).repartition(parts, *CELL)

    return dealt(wanted, carried[0], 0), dealt(takers, "external_id", 1)


def match_blocks(posts: DataFrame, subscribers: DataFrame, post_id: str = "post_id", posts_per_salt: int = 4096) -> DataFrame:
    """(posts, platform, takers): every post of a row's list goes to every subscriber of its other list; no pair is spelt out."""
    wanted, takers = _dealt(posts, subscribers, [post_id], posts_per_salt)
    # in structs, as a list leaves out null
    lists = wanted.groupBy(*CELL).agg(F.collect_list(F.struct(post_id)).alias("posts"))
    people = takers.groupBy(*CELL, "platform").agg(F.collect_list(F.struct("external_id")).alias("takers"))
    return lists.join(people.hint("merge"), CELL).select("posts", "platform", "takers")


def match_subscribers(
    posts: DataFrame,
    subscribers: DataFrame,
    post_id: str = "post_id",
    posts_per_salt: int = 4096,
    carried: list[str] | None = None,
) -> DataFrame:
    """(post, platform, external_id) and what posts have `carried`, for every active subscriber whose filters a post passes.

    The expanded rows are many times the table Spark takes its estimate from, so a merge join
    is asked for: a broadcast of them would pass through the driver.
    """
    wanted, takers = _dealt(posts, subscribers, [post_id, *(carried or [])], posts_per_salt)
    return wanted.join(takers.hint("merge"), CELL).select(post_id, "platform", "external_id", *(carried or []))


def _photo_method(photos: Column, text_only: str) -> Column:
    count = F.size(photos)
    return (
        F.when(count == 0, F.lit(text_only))
        .when(count == 1, F.lit("sendPhoto"))
        .otherwise(F.lit("sendMediaGroup"))
    )


def channel_outbox_tg(posts: DataFrame, channel: str) -> DataFrame:
    """Channel deliveries: text cut, photos capped, photos sent as a reply to the text."""
    photos = F.slice("attachments", 1, PHOTO_LIMIT)
    return posts.where(publish_policy(F.col("attributes.duration"))).select(
        "post_id",
        F.lit(channel).alias("destination"),
        F.substring("body", 1, TEXT_LIMIT).alias("text"),
        photos.alias("photos"),
        _photo_method(photos, "sendMessage").alias("method"),
    )


def channel_outbox_vk(posts: DataFrame, group_id: int, can_upload: bool) -> DataFrame:
    """Wall deliveries: whole text, all photos if uploads are enabled, else none."""
    photos = F.col("attachments") if can_upload else F.array().cast("array<string>")
    return posts.where(publish_policy(F.col("attributes.duration"))).select(
        "post_id", F.lit(-group_id).cast("bigint").alias("owner_id"), F.col("body").alias("text"), photos.alias("photos")
    )


def bot_outbox(posts: DataFrame, subscribers: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """Deliveries to matched subscribers; the message, or what is `shown` of it, is made once per post and goes along with it."""
    shown = shown or {"text": F.col("text"), "photos": F.col("photos")}
    messages = bot_messages(posts).select("post_id", *[c.alias(n) for n, c in shown.items()])
    wanted = posts.select("post_id", "source", "attributes").join(messages, "post_id")
    return match_subscribers(wanted, subscribers, carried=list(shown)).select("platform", "external_id", "post_id", *shown)


#: Microseconds between two messages of a bot.
BOT_GAPS_US = {"tg": 50_000, "vk": 100_000}


def bot_deliveries(posts: DataFrame, matches: DataFrame, gaps_us: dict[str, int] = BOT_GAPS_US) -> DataFrame:
    """One row per matched post and subscriber with method, state and planned send time; a bot sends one at a time.

    Posts (post_id, at_us, attachments) go out in order of arrival, each to its subscribers by id. The message itself
    stays in one row per post (`bot_messages`) and is joined when it is sent.
    """
    method = _photo_method(F.slice("attachments", 1, PHOTO_LIMIT), "sendMessage")
    posts = posts.select("post_id", "at_us", method.alias("method"))
    gap = F.create_map(*[F.lit(x) for pair in gaps_us.items() for x in pair])[F.col("platform")].cast("bigint")
    matches = matches.where(F.col("platform").isin(*gaps_us))
    # a post's deliveries of one platform go out in one run; within it only the first can be late for its arrival
    keys, order = ["platform"], ["at_us", "post_id"]
    sizes = matches.groupBy("platform", "post_id").agg(F.count("*").alias("_n"))
    sizes = sizes.join(posts, "post_id").groupBy("platform", "at_us", "post_id").agg(F.sum("_n").alias("_n"))
    heads = scan(split_runs(sizes, keys, order), keys, order, {"_before": ("sum", F.col("_n"))}).withColumn("_before", F.col("_before") - F.col("_n"))
    heads = scan(heads, keys, order, {"_peak": ("max", F.col("at_us") - gap * (F.col("_before") + 1))})
    head = F.struct("_before", "_peak")
    heads = heads.groupBy("post_id", "at_us").agg(*[F.max(F.when(F.col("platform") == p, head)).alias(f"_head_{p}") for p in gaps_us])
    heads = heads.withColumnsRenamed({"post_id": "_post", "at_us": "_at"})
    posts = posts.join(heads, (F.col("post_id") == F.col("_post")) & F.col("at_us").eqNullSafe(F.col("_at")))
    # the pairs move once, by post; a window holds the subscribers of one post
    place = F.row_number().over(Window.partitionBy("post_id", "platform", "at_us").orderBy("external_id", "method"))
    rows = matches.join(posts.hint("merge"), "post_id").withColumn("_place", place)
    head = F.coalesce(*[F.when(F.col("platform") == p, F.col(f"_head_{p}")) for p in gaps_us])
    send = head["_peak"] + gap * (head["_before"] + F.col("_place"))
    return rows.select("platform", "external_id", "post_id", "method", F.lit("pending").alias("state"), send.alias("send_us"))


def bot_messages(posts: DataFrame) -> DataFrame:
    """What a bot sends for each post, once."""
    return posts.select("post_id", F.substring("body", 1, TEXT_LIMIT).alias("text"), F.slice("attachments", 1, PHOTO_LIMIT).alias("photos"))


def pacing(queue: DataFrame, destination: str, at_us: str, item_id: str, gap_us: int) -> DataFrame:
    """Planned send time: in order, at least `gap_us` after the previous send of a destination.

    send(i) = max over j <= i of (t(j) + gap * (i - j)), a row number and a running maximum;
    both are scanned over range partitions, so a single busy channel uses all tasks.
    """
    keys, order = [destination], [at_us, item_id]
    gap = F.lit(gap_us).cast("bigint")
    rows = split_runs(queue.select(destination, at_us, item_id), keys, order)
    rows = scan(rows, keys, order, {"_n": ("sum", F.lit(1).cast("bigint"))})
    rows = scan(rows, keys, order, {"_peak": ("max", F.col(at_us) - gap * F.col("_n"))})
    return rows.withColumn("send_us", F.col("_peak") + gap * F.col("_n")).drop(RUN, "_n", "_peak")
