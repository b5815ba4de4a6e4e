"""The test tables read as posts, walls, chats, registries and subscribers.

Every binding comes twice: as a DataFrame and as the same relation in SQL (`*_SQL`, a CTE).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import text_hash
from postloom.functions.times import epoch_micros
from postloom.schemas import DURATIONS, FLAGS, WORK_TYPES

BASE_US = 1_704_067_200_000_000  # 2024-01-01
MINUTE_US = 60_000_000


@dataclass
class Tables:
    """Lazy access to the Parquet tables of one scale."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def bit(value: str, i: int) -> str:
    return f"(({value} >> {i}) & 1) = 1"


def listed(index: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


# ---- posts and their attributes, from documents -------------------------------------------

HASH_SQL = r"sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'))"

POSTS_SQL = rf"""posts AS (
  SELECT doc_id AS post_id,
    CASE WHEN CAST(substr(source, 4) AS BIGINT) % 2 = 0 THEN 'vk' ELSE 'tg' END AS source,
    CAST(substr(source, 4) AS BIGINT) AS source_id, text,
    {BASE_US} + (doc_id % 120) * {MINUTE_US} AS at_us,
    'https://vk.com/wall' || substr(source, 4) || '_' || doc_id AS source_post_url,
    'https://vk.com/club' || substr(source, 4) AS source_chat_url,
    doc_id % 13 AS n_photos
  FROM documents)"""


def posts(t: Tables) -> DataFrame:
    number = F.substring("source", 4, 10).cast("bigint")
    return t.documents.select(
        F.col("doc_id").alias("post_id"),
        F.when(number % 2 == 0, F.lit("vk")).otherwise(F.lit("tg")).alias("source"),
        number.alias("source_id"),
        "text",
        (F.lit(BASE_US) + F.col("doc_id") % 120 * MINUTE_US).alias("at_us"),
        F.concat(F.lit("https://vk.com/wall"), number, F.lit("_"), F.col("doc_id")).alias("source_post_url"),
        F.concat(F.lit("https://vk.com/club"), number).alias("source_chat_url"),
        (F.col("doc_id") % 13).alias("n_photos"),
    )


def photos() -> Column:
    """n_photos made-up urls per post."""
    none = F.array().cast("array<string>")
    urls = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("n_photos")),
        lambda i: F.concat(F.lit("https://p/"), F.col("post_id"), F.lit("/"), i),
    )
    return F.when(F.col("n_photos") == 0, none).otherwise(urls)


PHOTOS_SQL = "list_transform(range(1, n_photos + 1), lambda i: 'https://p/' || post_id || '/' || i)"


def hashed_posts(t: Tables) -> DataFrame:
    return posts(t).withColumn("text_hash", text_hash(F.col("text")))


HASHED_SQL = POSTS_SQL + f",\nhashed AS (SELECT *, {HASH_SQL} AS text_hash FROM posts)"

ATTRIBUTES_SQL = f"""attributes AS (
  SELECT doc_id AS post_id, {listed('doc_id % 5', DURATIONS)} AS duration,
    {listed('doc_id % 4', WORK_TYPES)} AS work_type,
    CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN '500/2' END AS payment,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'ул. Мира ' || doc_id % 50 END AS address
  FROM documents WHERE doc_id % 11 <> 0)"""


def attributes(t: Tables) -> DataFrame:
    """Attributes of a post from its id; every eleventh post has none."""
    return t.documents.where("doc_id % 11 <> 0").selectExpr(
        "doc_id AS post_id",
        f"{listed('doc_id % 5', DURATIONS)} AS duration",
        f"{listed('doc_id % 4', WORK_TYPES)} AS work_type",
        "CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN '500/2' END AS payment",
        "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('ул. Мира ', doc_id % 50) END AS address",
    )


# ---- subscribers and source registry, from customer ---------------------------------------

SUBSCRIBERS_SQL = f"""subscribers AS (
  SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'vk' ELSE 'tg' END AS platform, c_custkey AS external_id,
    CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'paused' END AS status,
    {", ".join(f"{bit('((c_custkey * 40503) % 8192)', i)} AS {flag}" for i, flag in enumerate(FLAGS))}
  FROM customer)"""


def subscribers(t: Tables) -> DataFrame:
    mask = F.col("c_custkey") * 40503 % 8192
    return t.customer.select(
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("vk")).otherwise(F.lit("tg")).alias("platform"),
        F.col("c_custkey").alias("external_id"),
        F.when(F.col("c_acctbal") > 0, F.lit("active")).otherwise(F.lit("paused")).alias("status"),
        *[(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1).alias(flag) for i, flag in enumerate(FLAGS)],
    )


REGISTRY_SQL = """registry AS (
  SELECT c_custkey AS source_id, c_name AS title, 'https://vk.com/club' || c_custkey AS url,
    c_acctbal > 0 AS is_active,
    CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 7919) % 5000 END AS last_seen_id
  FROM customer)"""


def registry(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey AS source_id",
        "c_name AS title",
        "concat('https://vk.com/club', c_custkey) AS url",
        "c_acctbal > 0 AS is_active",
        "CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 7919) % 5000 END AS last_seen_id",
    )


# ---- wall records, from orders and lineitem -----------------------------------------------

WALL_SQL = """wall AS (
  SELECT o_orderkey AS id, o_custkey AS source_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN -o_custkey END AS owner_id,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + 7 END AS from_id,
    CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS date,
    CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
      ELSE o_orderpriority || ' ' || o_orderstatus || ' order ' || o_custkey END AS text,
    CASE WHEN o_orderkey % 37 = 0 THEN 1 END AS is_pinned,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS marked_as_ads
  FROM orders),
photo_choice AS (
  SELECT l_orderkey AS id, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place,
    l_returnflag <> 'R' AND l_linenumber <> 7 AS usable,
    CAST(l_quantity AS BIGINT) * 10 AS a1,
    CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_partkey % 60 * 10 END AS a2,
    l_suppkey % 60 * 10 AS a3,
    'u/' || l_partkey || '/a' AS u1, 'u/' || l_partkey || '/b' AS u2,
    CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'u/' || l_partkey || '/c' END AS u3
  FROM lineitem),
best AS (
  SELECT id, place, CASE WHEN a1 >= a2 AND a1 >= a3 THEN u1 WHEN a2 >= a3 THEN u2 ELSE u3 END AS url
  FROM photo_choice WHERE usable),
wall_photos AS (
  SELECT id, list(url ORDER BY place) AS urls FROM best WHERE url <> '' GROUP BY id)"""


def wall(t: Tables) -> DataFrame:
    """Wall records with nested attachments, one per order."""
    att = t.lineitem.selectExpr(
        "l_orderkey AS id",
        """struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag <=> 'R' AS doc,
          CAST(l_quantity AS INT) AS width) AS a""",
    )
    # lines of one order: bounded by the order; its renditions are spelt out after the lines have moved
    att = att.groupBy("id").agg(F.collect_list("a").alias("lines"))
    attachments = """transform(array_sort(transform(lines, a -> struct(a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_extendedprice,
        NOT a.doc AS photo, a.width))), a -> struct(IF(a.photo, 'photo', 'doc') AS type, struct(
          CASE WHEN a.l_linenumber = 7 THEN slice(array(
              struct('' AS url, 0 AS width, CAST(0 AS INT) AS height)), 1, 0)
          ELSE array(
            struct(concat('u/', a.l_partkey, '/a') AS url, a.width AS width, 10 AS height),
            struct(concat('u/', a.l_partkey, '/b') AS url, CAST(a.l_partkey % 60 AS INT) AS width,
              IF(a.l_linenumber % 4 = 0, NULL, 10) AS height),
            struct(IF(a.l_suppkey % 10 = 0, '', concat('u/', a.l_partkey, '/c')) AS url,
              CAST(a.l_suppkey % 60 AS INT) AS width, 10 AS height)) END AS sizes) AS photo))"""
    records = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("source_id"),
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN -o_custkey END").alias("owner_id"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + 7 END").alias("from_id"),
        (F.floor(epoch_micros(F.col("o_orderdate")) / 1_000_000) + F.col("o_orderkey") % 86400).cast("bigint").alias("date"),
        F.expr(
            "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' "
            "ELSE concat(o_orderpriority, ' ', o_orderstatus, ' order ', o_custkey) END"
        ).alias("text"),
        F.expr("CASE WHEN o_orderkey % 37 = 0 THEN 1 END").alias("is_pinned"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END").alias("marked_as_ads"),
    )
    found = records.join(att, "id", "left")
    return found.select(*records.columns, F.expr(attachments).alias("attachments"))


# ---- wall items and chat messages, from events --------------------------------------------

EVENTS_SQL = """items AS (
  SELECT event_id AS id, user_id AS source_id, epoch_us(ts) AS at_us, event_type,
    CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS is_pinned, value
  FROM events)"""


def items(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        epoch_micros(F.col("ts")).alias("at_us"),
        "event_type",
        F.expr("CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END").alias("is_pinned"),
        "value",
    )


CHAT_SQL = """chat AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN -(user_id + 5) ELSE -1000000000000 - user_id END AS chat_id,
    event_id AS id, user_id AS source_id,
    CASE WHEN event_id % 8 = 0 THEN chr(160) || ' ' ELSE event_type || ' ' || props END AS raw_text,
    ts AS sent_at, CASE WHEN event_id % 6 <> 0 THEN user_id END AS sender_id,
    CASE user_id % 4 WHEN 0 THEN 'chan' || user_id WHEN 1 THEN '' END AS chat_username,
    event_type = 'signup' AND event_id % 3 = 0 AS has_action, event_id % 17 = 0 AS has_sticker,
    event_id % 5 = 0 AS has_document, event_id % 10 = 0 AS has_video
  FROM events)"""


def chat(t: Tables) -> DataFrame:
    """Chat messages as they arrive: `date` is a zoned ISO string."""
    return t.events.select(
        F.expr("CASE WHEN user_id % 3 = 0 THEN -(user_id + 5) ELSE -1000000000000 - user_id END").alias("chat_id"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        F.when(F.col("event_id") % 8 == 0, F.lit("\u00a0 "))
        .otherwise(F.concat("event_type", F.lit(" "), "props"))
        .alias("raw_text"),
        F.concat(
            F.replace((F.col("ts") + F.expr("INTERVAL '3' HOUR")).cast("string"), F.lit(" "), F.lit("T")),
            F.lit("+03:00"),
        ).alias("date"),
        F.expr("CASE WHEN event_id % 6 <> 0 THEN user_id END").alias("sender_id"),
        F.expr("CASE user_id % 4 WHEN 0 THEN concat('chan', user_id) WHEN 1 THEN '' END").alias("chat_username"),
        F.expr("event_type = 'signup' AND event_id % 3 = 0").alias("has_action"),
        F.expr("event_id % 17 = 0").alias("has_sticker"),
        F.expr("event_id % 5 = 0").alias("has_document"),
        F.expr("event_id % 10 = 0").alias("has_video"),
    )


# ---- bot events, from events ---------------------------------------------------------------

_BOT_DATA = """CASE event_type
      WHEN 'signup' THEN CASE k % 8 WHEN 0 THEN 'reconf_all' WHEN 1 THEN 'reconf_all' WHEN 2 THEN 'reconf_one'
        WHEN 3 THEN 'start' WHEN 4 THEN '/start' WHEN 5 THEN 'hello' ELSE {f} END
      WHEN 'click' THEN {opt5} WHEN 'view' THEN {opt2}
      WHEN 'purchase' THEN CASE k % 6 WHEN 0 THEN 'support' WHEN 1 THEN 'cat2' WHEN 2 THEN 'edit' ELSE 'save' END
      ELSE CASE k % 12 WHEN 0 THEN 'pause' WHEN 1 THEN 'menu' WHEN 2 THEN 'cancel' WHEN 3 THEN 'settings' WHEN 4 THEN 'start'
        ELSE {opt2} END END"""

BOT_SQL = f"""bot AS (
  SELECT platform, external_id, seq, data,
    CASE WHEN data IN ('/start', 'hello') THEN 'message' ELSE 'callback' END AS kind
  FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'vk' ELSE 'tg' END AS platform, user_id AS external_id,
      event_id AS seq, {_BOT_DATA.format(f="'f' || k % 14", opt5="'opt' || k % 5", opt2="'opt' || (1 + k % 2)")} AS data
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""


def bot_events(t: Tables) -> DataFrame:
    data = _BOT_DATA.format(
        f="concat('f', k % 14)", opt5="concat('opt', k % 5)", opt2="concat('opt', 1 + k % 2)"
    )
    return (
        t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        .selectExpr(
            "CASE WHEN user_id % 2 = 0 THEN 'vk' ELSE 'tg' END AS platform",
            "user_id AS external_id",
            "event_id AS seq",
            f"{data} AS data",
        )
        .withColumn("kind", F.when(F.col("data").isin("/start", "hello"), F.lit("message")).otherwise(F.lit("callback")))
    )


# ---- labelled samples and job-ad texts -----------------------------------------------------

SAMPLES_SQL = """samples AS (
  SELECT doc_id AS doc, text, quality AS label FROM documents JOIN labels USING (doc_id))"""


def samples(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("doc"), "text", F.col("quality").alias("label")
    )


_AD = [
    ["Вахта 30 дней", "Вакансия на постоянку", "Смена 10 часов", "На 2 часа, 500/2", "Нужен человек"],
    ["нужен грузчик", "нужен разнорабочий", "ищем электрика, электрик", "грузчик и уборка", "подработка"],
    ["Оплата 3000 руб.", "2 500₽", "оплата по договору", "4500 р"],
    ["ул. Мира 5", "район Юг, дом 3", "адрес в лс"],
]
ADS_SQL = (
    "ads AS (SELECT p_partkey AS post_id, "
    + " || '; ' || ".join(
        listed(f"({key}) % {len(v)}", v)
        for key, v in zip(["p_partkey", "p_size", "p_partkey + p_size", "p_partkey // 7"], _AD)
    )
    + " || '. ' || p_name AS text, (p_partkey) % 5 AS d, p_size % 5 AS w FROM part)"
)


def ads(t: Tables) -> DataFrame:
    """Job-ad texts put together from fragments, one per part."""
    keys = ["p_partkey", "p_size", "p_partkey + p_size", "p_partkey div 7"]
    parts = ", '; ', ".join(listed(f"({key}) % {len(v)}", v) for key, v in zip(keys, _AD))
    return t.part.selectExpr(
        "p_partkey AS post_id", f"concat({parts}, '. ', p_name) AS text", "p_partkey % 5 AS d", "p_size % 5 AS w"
    )


AD_DURATIONS = ["vahta", "permanent", "full_shift", "short_task", "unknown"]
AD_WORK_TYPES = ["loader", "handyman", "specialist", "unknown", "unknown"]
