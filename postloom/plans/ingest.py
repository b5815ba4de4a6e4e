"""Queries on ingest: sources, cursors, mapping, filters, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import records
from postloom.functions.times import aware_to_utc, epoch_micros, epoch_to_utc
from postloom.operators import ingest
from postloom.operators import ingest_job as job
from postloom.operators.suppress import suppress_repeats
from postloom.plans import bindings as b
from postloom.plans.bindings import Tables, sql
from postloom.session import work_path
from postloom.sources.files import clean_samples, scan_chat_json, scan_samples_csv, scan_wall_json

SECOND_SQL = "%Y-%m-%d %H:%M:%S"


def _seconds(ts):
    """A naive time as text; `date_format` would pass through the session time zone."""
    return F.substring(ts.cast("string"), 1, 19)


# ---- scans ---------------------------------------------------------------------------------


def scan_wall(t: Tables):
    path = work_path(t.spark, "wall")
    b.wall(t).write.json(path)
    wall = scan_wall_json(t.spark, path)
    return wall.select(
        "id",
        "source_id",
        "owner_id",
        "from_id",
        "date",
        "text",
        "is_pinned",
        "marked_as_ads",
        F.coalesce(F.size("attachments"), F.lit(0)).cast("bigint").alias("n_attachments"),
    )


SCAN_WALL_SQL = sql(
    b.WALL_SQL,
    body="""SELECT w.id, source_id, owner_id, from_id, date, text, is_pinned, marked_as_ads,
      coalesce(n, 0) AS n_attachments
    FROM wall w LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) USING (id)""",
)


def scan_chat(t: Tables):
    path = work_path(t.spark, "chat")
    b.chat(t).write.json(path)
    return scan_chat_json(t.spark, path).select(
        "id",
        "chat_id",
        "raw_text",
        epoch_micros(F.col("sent_at")).alias("sent_us"),
        "sender_id",
        "chat_username",
        F.col("has_action").cast("int").alias("has_action"),
        F.col("has_video").cast("int").alias("has_video"),
    )


SCAN_CHAT_SQL = sql(
    b.CHAT_SQL,
    body="""SELECT id, chat_id, raw_text, epoch_us(sent_at) AS sent_us, sender_id,
      chat_username, CAST(has_action AS INT) AS has_action, CAST(has_video AS INT) AS has_video FROM chat""",
)

_LABEL = """CASE WHEN doc_id % 7 = 0 THEN ' ' || quality || ' ' WHEN doc_id % 11 = 0 THEN '2'
  WHEN doc_id % 13 = 0 THEN '' ELSE CAST(quality AS {s}) END"""


def scan_samples(t: Tables):
    path = work_path(t.spark, "samples")
    rows = t.documents.join(t.labels, "doc_id").selectExpr(
        "concat(' ', doc_id) AS post_id", "lang AS source_id", "source", "text", f"{_LABEL.format(s='STRING')} AS label"
    )
    (
        rows.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return scan_samples_csv(t.spark, path)


SCAN_SAMPLES_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS source_id, upper(source) AS source, text,
    CAST(trim(l) AS INT) AS label
  FROM (SELECT *, {_LABEL.format(s='VARCHAR')} AS l FROM documents JOIN labels USING (doc_id))
  WHERE trim(l) IN ('0', '1') AND length(text) >= 30"""


def samples_from_tables(t: Tables):
    raw = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("lang").alias("source_id"),
        "source",
        "text",
        F.col("toxic").cast("string").alias("label"),
    )
    return clean_samples(raw)


# ---- cursors -------------------------------------------------------------------------------


def _items(t: Tables):
    return ingest.registry_join(b.items(t), b.registry(t))


_ITEMS_SQL = (
    b.EVENTS_SQL,
    b.REGISTRY_SQL,
    "fetched AS (SELECT i.*, url, last_seen_id FROM items i JOIN registry USING (source_id))",
)


def wall_new(t: Tables):
    return ingest.new_since_cursor_wall(_items(t)).select("source_id", "id", "last_seen_id")


def wall_new_capped(t: Tables):
    return ingest.new_since_cursor_wall(_items(t), page=10, depth=25).select("source_id", "id", "last_seen_id")


def _wall_new_sql(page: int, depth: int | None) -> str:
    reach = "true" if depth is None else f"rn <= {-(-depth // page) * page}"
    return sql(
        *_ITEMS_SQL,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY is_pinned DESC, id DESC) AS rn FROM fetched)",
        body=f"""SELECT source_id, id, last_seen_id FROM ranked
          WHERE (last_seen_id IS NULL AND rn <= {page}) OR (id > last_seen_id AND {reach})""",
    )


def chat_new(t: Tables):
    return ingest.new_since_cursor_chat(_items(t), limit=20).select("source_id", "id", "last_seen_id")


CHAT_NEW_SQL = sql(
    *_ITEMS_SQL,
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS newest,
      row_number() OVER (PARTITION BY source_id, coalesce(id > last_seen_id, false) ORDER BY id) AS oldest FROM fetched)""",
    body="""SELECT source_id, id, last_seen_id FROM ranked
      WHERE (last_seen_id IS NULL AND newest <= 20) OR (id > last_seen_id AND oldest <= 20)""",
)


def active(t: Tables):
    return ingest.active_sources(b.registry(t)).select("source_id", "title", "url")


def lookup(t: Tables):
    keys = t.events.select((F.col("user_id") * 11).alias("source_id")).distinct()
    return ingest.lookup_by_key(keys, b.registry(t), ["source_id"]).select("source_id", "title", "url")


def repeated(t: Tables):
    return ingest.repeated_keys(t.conversations, ["conv_id"])


def page(t: Tables):
    return ingest.page_topk(b.items(t), count=20, offset=5).select("source_id", "id", F.col("rn").cast("bigint"))


def latest(t: Tables):
    return ingest.latest_id_per_source(b.items(t))


def fetched(t: Tables):
    return ingest.fetched_per_source(ingest.new_since_cursor_wall(_items(t)))


def advance(t: Tables):
    return ingest.cursor_advance(b.registry(t), b.items(t)).select("source_id", "last_seen_id")


def seed(t: Tables):
    return ingest.cursor_seed(b.registry(t), b.items(t)).select("source_id", "last_seen_id")


def seed_all(t: Tables):
    return ingest.cursor_seed(b.registry(t), b.items(t), only_null=False).select("source_id", "last_seen_id")


def deactivate(t: Tables):
    closed = b.items(t).where("event_type = 'error' AND value > 20").select("source_id")
    return ingest.deactivate_sources(b.registry(t), closed).select(
        "source_id", F.col("is_active").cast("int").alias("is_active")
    )


_CURSOR_SQL = (b.EVENTS_SQL, b.REGISTRY_SQL, "latest AS (SELECT source_id, max(id) AS latest_id FROM items GROUP BY 1)")


def _cursor(value: str) -> str:
    return sql(
        *_CURSOR_SQL,
        body=f"SELECT source_id, {value} AS last_seen_id FROM registry LEFT JOIN latest USING (source_id)",
    )


def in_id_order(t: Tables):
    """Ascending position of every item within its source, as records are processed."""
    from postloom.operators.ordered import row_numbers

    return row_numbers(b.items(t).select("source_id", "id"), ["source_id"], ["id"], "position")


# ---- mapping -------------------------------------------------------------------------------


def _wall_records(t: Tables):
    return ingest.registry_join(b.wall(t), b.registry(t))


def _chat_records(t: Tables):
    messages = b.chat(t).withColumn("sent_at", aware_to_utc(F.col("date")))
    return ingest.registry_join(messages, b.registry(t))


def _wall_posts(t: Tables):
    return ingest.map_wall_posts(_wall_records(t))


def _chat_posts(t: Tables):
    return ingest.map_chat_messages(_chat_records(t))


def _flat(posts):
    return posts.select(
        "status",
        "source",
        "text",
        _seconds(F.col("post_datetime")).alias("post_datetime"),
        "source_post_url",
        "source_chat_url",
        "text_hash",
        "owner_id",
        "item_id",
        "author_id",
        F.concat_ws(",", "attachments").alias("photos"),
    )


def map_wall(t: Tables):
    return _flat(_wall_posts(t))


def map_chat(t: Tables):
    return _flat(_chat_posts(t))


WALL_POSTS_SQL = rf"""wall_posts AS (
  SELECT 'new' AS status, 'vk' AS source, coalesce(text, '') AS text,
    strftime(make_timestamp(date * 1000000), '{SECOND_SQL}') AS post_datetime,
    'https://vk.com/wall' || coalesce(owner_id, source_id) || '_' || w.id AS source_post_url,
    url AS source_chat_url, {b.HASH_SQL} AS text_hash, coalesce(owner_id, source_id) AS owner_id,
    w.id AS item_id, from_id AS author_id, coalesce(array_to_string(urls, ','), '') AS photos,
    coalesce(urls, []) AS urls
  FROM wall w JOIN registry USING (source_id) LEFT JOIN wall_photos p ON p.id = w.id)"""
CHAT_POSTS_SQL = rf"""chat_posts AS (
  SELECT 'new' AS status, 'tg' AS source, coalesce(raw_text, '') AS text,
    strftime(sent_at, '{SECOND_SQL}') AS post_datetime,
    'https://t.me/' || CASE WHEN length(chat_username) > 0 THEN chat_username
      ELSE 'c/' || replace(replace(CAST(chat_id AS VARCHAR), '-100', ''), '-', '') END || '/' || id AS source_post_url,
    url AS source_chat_url, {b.HASH_SQL.replace('text', 'raw_text')} AS text_hash, chat_id AS owner_id,
    id AS item_id, sender_id AS author_id, '' AS photos, CAST([] AS VARCHAR[]) AS urls
  FROM chat JOIN registry USING (source_id))"""
_WALL = (b.WALL_SQL, b.REGISTRY_SQL, WALL_POSTS_SQL)
_CHAT = (b.CHAT_SQL, b.REGISTRY_SQL, CHAT_POSTS_SQL)
_FLAT_SQL = """SELECT status, source, text, post_datetime, source_post_url, source_chat_url, text_hash,
  owner_id, item_id, author_id, photos FROM """


def both_sources(t: Tables):
    return _flat(ingest.union_sources(_wall_posts(t), _chat_posts(t)))


def owner(t: Tables):
    return b.wall(t).select("id", records.wall_owner(F.col("owner_id"), F.col("source_id")).alias("owner_id"))


def author(t: Tables):
    wall = b.wall(t).select("id", records.nullable_author(F.col("from_id")).alias("author_id"))
    return wall.unionByName(b.chat(t).select("id", records.nullable_author(F.col("sender_id")).alias("author_id")))


def wall_urls(t: Tables):
    owner_id = records.wall_owner(F.col("owner_id"), F.col("source_id"))
    return b.wall(t).select("id", records.wall_url(owner_id, F.col("id")).alias("url"))


def chat_urls(t: Tables):
    return b.chat(t).select("id", records.chat_url(F.col("chat_id"), F.col("chat_username"), F.col("id")).alias("url"))


def epoch_times(t: Tables):
    return b.wall(t).select("id", _seconds(epoch_to_utc(F.col("date"))).alias("at"))


def zoned_times(t: Tables):
    return b.chat(t).select("id", _seconds(aware_to_utc(F.col("date"))).alias("at"))


def best_photos(t: Tables):
    return b.wall(t).select("id", F.concat_ws(",", records.best_photo_urls(F.col("attachments"))).alias("photos"))


def stored_posts(t: Tables):
    """Posts written and read back with their derived key."""
    path = work_path(t.spark, "posts")
    ingest.with_post_id(_wall_posts(t)).write.mode("append").parquet(path)
    ingest.with_post_id(_chat_posts(t)).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("post_id", "status", "source", "text_hash")


_POST_ID_SQL = "sha256(source || ':' || owner_id || ':' || item_id)"
_BOTH = (b.WALL_SQL, b.CHAT_SQL, b.REGISTRY_SQL, WALL_POSTS_SQL, CHAT_POSTS_SQL)
_ALL_SQL = f"""all_posts AS (SELECT *, {_POST_ID_SQL} AS post_id
  FROM (SELECT * FROM wall_posts UNION ALL SELECT * FROM chat_posts))"""


def details(t: Tables):
    both = ingest.union_sources(_wall_posts(t), _chat_posts(t))
    return ingest.source_details(ingest.with_post_id(both))


def attachments(t: Tables):
    rows = ingest.attachment_rows(ingest.with_post_id(_wall_posts(t)))
    return rows.select("post_id", F.col("position").cast("bigint").alias("position"), "url")


ATTACHMENTS_SQL = sql(
    *_BOTH,
    _ALL_SQL,
    body="""SELECT post_id, i - 1 AS position, urls[i] AS url
      FROM (SELECT post_id, urls, unnest(range(1, len(urls) + 1)) AS i FROM all_posts WHERE source = 'vk')""",
)


def last_attachment_position(t: Tables):
    """Photos per post by their 0-based positions: the last one and the sum."""
    rows = attachments(t)
    return rows.groupBy("post_id").agg(
        F.max("position").alias("last_position"), F.sum("position").alias("position_sum")
    )


def domain(t: Tables):
    posts = ingest.domain_posts(ingest.with_post_id(ingest.union_sources(_wall_posts(t), _chat_posts(t))))
    return posts.select(
        "id",
        "source",
        "text",
        "source_post_url",
        "source_chat_url",
        F.concat_ws(",", "attachments").alias("photos"),
        F.col("attributes").isNull().cast("int").alias("no_attributes"),
    )


# ---- filters -------------------------------------------------------------------------------


def text_only(t: Tables):
    return b.wall(t).where(records.has_text(F.col("text"))).select("id", "text")


def no_ads(t: Tables):
    return b.wall(t).where(records.not_ads(F.col("marked_as_ads"))).select("id", "marked_as_ads")


def chat_processable(t: Tables):
    flags = [F.col(c) for c in ("raw_text", "has_action", "has_sticker", "has_document", "has_video")]
    return b.chat(t).where(records.processable_chat(*flags)).select("id", "raw_text")


def coarse(t: Tables):
    return b.posts(t).where(records.long_enough(F.col("text"))).select("post_id", F.length("text").cast("bigint").alias("n"))


# ---- dedup ---------------------------------------------------------------------------------


def dedup_source(t: Tables):
    """Line items as records copied within and across batches: early ships are stored already."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("owner_id"),
        F.col("l_partkey").alias("item_id"),
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_extendedprice").alias("price"),
        "l_shipdate",
    )
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    keys = ["owner_id", "item_id"]
    fresh = ingest.dedup_source_key(
        rows.where(F.col("l_shipdate") >= split).drop("l_shipdate"),
        rows.where(F.col("l_shipdate") < split),
        keys,
        ["l_orderkey", "line", "price"],
    )
    return fresh.select("owner_id", "item_id", "l_orderkey", "line")


DEDUP_SOURCE_SQL = """WITH batch AS (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey
      ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
  SELECT l_suppkey AS owner_id, l_partkey AS item_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM batch b
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_shipdate < TIMESTAMP '1998-01-01'
    AND s.l_suppkey = b.l_suppkey AND s.l_partkey = b.l_partkey)"""


def exists_semi(t: Tables):
    """Existence test: suppliers with at least one returned line."""
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.join(returned, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def dedup_lookback(t: Tables):
    posts = b.hashed_posts(t).select("post_id", "text_hash", "at_us")
    half = b.BASE_US + 60 * b.MINUTE_US
    return ingest.dedup_text_lookback(posts.where(F.col("at_us") >= half), posts.where(F.col("at_us") < half)).select(
        "post_id", "text_hash"
    )


def dedup_lookback_events(t: Tables):
    """History and batch interleaved in time; five keys, each a fifth of all rows."""
    rows = b.items(t).select("id", F.col("event_type").alias("text_hash"), "at_us", "value")
    return ingest.dedup_text_lookback(rows.where("value >= 3"), rows.where("value < 3")).select("id", "text_hash")


_HALF = b.BASE_US + 60 * b.MINUTE_US
DEDUP_LOOKBACK_SQL = sql(
    b.HASHED_SQL,
    body=f"""SELECT post_id, text_hash FROM hashed p WHERE at_us >= {_HALF} AND NOT EXISTS (
      SELECT 1 FROM hashed h WHERE h.text_hash = p.text_hash AND h.at_us < {_HALF}
        AND h.at_us >= p.at_us - 3600000000 AND h.at_us <= p.at_us)""",
)
DEDUP_LOOKBACK_EVENTS_SQL = sql(
    b.EVENTS_SQL,
    body="""SELECT id, event_type AS text_hash FROM items p WHERE value >= 3 AND NOT EXISTS (
      SELECT 1 FROM items h WHERE h.event_type = p.event_type AND h.value < 3
        AND h.at_us >= p.at_us - 3600000000 AND h.at_us <= p.at_us)""",
)


def suppress_posts(t: Tables):
    return suppress_repeats(b.hashed_posts(t), "text_hash", "at_us", "post_id")


def suppress_events(t: Tables):
    return suppress_repeats(b.items(t), "event_type", "at_us", "id")


def suppress_events_hot(t: Tables):
    """The same rows from many small range partitions: every event type is cut into chunks of time."""
    return suppress_repeats(b.items(t), "event_type", "at_us", "id", parts=61)


def suppress_sql(source: tuple[str, ...], table: str, key: str, item: str) -> str:
    head = source[0] if source else ""
    return f"""WITH RECURSIVE {head},
      inst AS (SELECT {key} AS k, at_us AS us, min({item}) AS id FROM {table} GROUP BY 1, 2),
      kept AS (
        SELECT k, min(us) AS us FROM inst GROUP BY k
        UNION ALL
        SELECT i.k, min(i.us) FROM kept JOIN inst i ON i.k = kept.k AND i.us > kept.us + 3600000000 GROUP BY i.k)
      SELECT k AS {key}, us AS at_us, id AS {item} FROM kept JOIN inst USING (k, us)"""


SUPPRESS_EVENTS_SQL = suppress_sql((b.EVENTS_SQL,), "items", "event_type", "id")


def arrival_funnel(t: Tables):
    """Flagship: text present → long enough → repeats dropped, counted per source."""
    text, place = F.col("text"), ["source", "source_id"]
    # the text ends in one flag and one hash where it is read
    posts = b.hashed_posts(t).withColumn("long", records.has_text(text) & records.long_enough(text))
    arrived = posts.groupBy(*place).agg(F.count("*").alias("arrived"), F.sum(F.col("long").cast("int")).alias("long_enough"))
    item = F.struct("post_id", *place).alias("item")
    kept = suppress_repeats(posts.where("long").select("text_hash", "at_us", item), "text_hash", "at_us", "item")
    kept = kept.groupBy("item.source", "item.source_id").agg(F.count("*").alias("kept"))
    return arrived.join(kept, place, "left").select(*place, "arrived", "long_enough", F.coalesce("kept", F.lit(0)).alias("kept"))


FUNNEL_SQL = f"""WITH RECURSIVE {b.HASHED_SQL},
  inst AS (SELECT text_hash AS k, at_us AS us, min(post_id) AS post_id FROM hashed WHERE length(text) >= 30 GROUP BY 1, 2),
  kept AS (
    SELECT k, min(us) AS us FROM inst GROUP BY k
    UNION ALL
    SELECT i.k, min(i.us) FROM kept JOIN inst i ON i.k = kept.k AND i.us > kept.us + 3600000000 GROUP BY i.k),
  ids AS (SELECT post_id FROM kept JOIN inst USING (k, us))
  SELECT source, source_id, count(*) AS arrived, CAST(sum(CAST(length(text) >= 30 AS INT)) AS BIGINT) AS long_enough,
    count(i.post_id) AS kept
  FROM hashed h LEFT JOIN ids i ON i.post_id = h.post_id GROUP BY 1, 2"""


def unpublished(t: Tables):
    """Posts stored but not on the stage stream: here every ninth publish was lost."""
    posts = b.posts(t).select(F.col("post_id").alias("id"), F.when(F.col("post_id") % 4 == 0, "coarse_filter_passed").otherwise("new").alias("status"), "source")
    return ingest.unpublished_posts(posts, posts.where("id % 9 <> 0"))


# ---- the ingest job --------------------------------------------------------------------------


def _run_wall(t: Tables):
    """One poll into an empty store, and the same run repeated: its rows are replaced, not doubled."""
    store = job.PostStore(t.spark, work_path(t.spark, "store"))
    for _ in range(2):
        job.ingest_wall(b.wall(t), b.registry(t), store, 1, None)
    return store


def _run_chat(t: Tables):
    store = job.PostStore(t.spark, work_path(t.spark, "store"))
    messages = b.chat(t).withColumn("sent_at", aware_to_utc(F.col("date")))
    for _ in range(2):
        job.ingest_chat(messages, b.registry(t), store, 1, None, limit=20)
    return store


def _stored(store):
    photos = store.read("attachments").groupBy("post_id").agg(F.count("*").alias("photos"))
    posts = store.read("posts").join(store.read("details").select("post_id"), "post_id").join(photos, "post_id", "left")
    return posts.select("post_id", "source_post_url", "text_hash", "at_us", F.coalesce("photos", F.lit(0)).alias("photos"))


def ingested_wall(t: Tables):
    return _stored(_run_wall(t))


def ingested_chat(t: Tables):
    return _stored(_run_chat(t))


def ingested_cursors(t: Tables):
    return _run_chat(t).read("cursors").select("source_id", "last_seen_id")


def ingested_then_staged(t: Tables):
    """The posts the job has published, decided by the coarse filter of the stage chain, by their own ids."""
    from postloom.operators.status import status_latest
    from postloom.streaming import stages

    root = f"{_run_wall(t).path}/stage"
    stages.run_stage(t.spark, root, "new", "coarse", stages.coarse_decision).awaitTermination()
    return status_latest(stages.status_log(t.spark, root, ["new", "coarse"]))


_KEPT_SQL = """inst AS (SELECT text_hash AS k, at_us AS us, min(post_id) AS post_id FROM candidates GROUP BY 1, 2),
  kept AS (
    SELECT k, min(us) AS us FROM inst GROUP BY k
    UNION ALL
    SELECT i.k, min(i.us) FROM kept JOIN inst i ON i.k = kept.k AND i.us > kept.us + 3600000000 GROUP BY i.k),
  stored AS (SELECT c.* FROM candidates c JOIN inst USING (post_id) JOIN kept ON kept.k = inst.k AND kept.us = inst.us)"""
_STORED_SQL = "SELECT post_id, source_post_url, text_hash, at_us, len(urls) AS photos FROM stored"
_INGEST_WALL_SQL = (
    *_WALL,
    """fetched AS (SELECT w.*, last_seen_id, row_number() OVER (PARTITION BY source_id
        ORDER BY coalesce(is_pinned, 0) <> 0 DESC, w.id DESC) AS rn FROM wall w JOIN registry USING (source_id) WHERE is_active)""",
    """usable AS (SELECT id, date FROM fetched WHERE (id > last_seen_id OR (last_seen_id IS NULL AND rn <= 50))
      AND text <> '' AND coalesce(marked_as_ads, 0) <> 1)""",
    f"""candidates AS (SELECT wall_posts.*, {_POST_ID_SQL} AS post_id, date * 1000000 AS at_us
      FROM wall_posts JOIN usable ON usable.id = item_id)""",
    _KEPT_SQL,
)
_CHAT_FETCHED_SQL = """ranked AS (SELECT c.*, last_seen_id, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS newest,
      row_number() OVER (PARTITION BY source_id, coalesce(id > last_seen_id, false) ORDER BY id) AS oldest
    FROM chat c JOIN registry USING (source_id) WHERE is_active),
  fetched AS (SELECT * FROM ranked WHERE (last_seen_id IS NULL AND newest <= 20) OR (id > last_seen_id AND oldest <= 20))"""
_INGEST_CHAT_SQL = (
    *_CHAT,
    _CHAT_FETCHED_SQL,
    """usable AS (SELECT id, sent_at FROM fetched WHERE trim(raw_text, ' ' || chr(160)) <> ''
      AND NOT has_action AND NOT has_sticker AND (NOT has_document OR has_video))""",
    f"""candidates AS (SELECT chat_posts.*, {_POST_ID_SQL} AS post_id, epoch_us(sent_at) AS at_us
      FROM chat_posts JOIN usable ON usable.id = item_id)""",
    _KEPT_SQL,
)


def recursive(*ctes: str, body: str) -> str:
    return sql(*ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "ingest_wall": (ingested_wall, recursive(*_INGEST_WALL_SQL, body=_STORED_SQL)),
    "ingest_chat": (ingested_chat, recursive(*_INGEST_CHAT_SQL, body=_STORED_SQL)),
    "ingest_cursors": (
        ingested_cursors,
        sql(
            b.CHAT_SQL,
            b.REGISTRY_SQL,
            _CHAT_FETCHED_SQL,
            body="""SELECT source_id, last_seen_id FROM (
              SELECT r.source_id, greatest(any_value(r.last_seen_id), max(f.id)) AS last_seen_id
              FROM registry r LEFT JOIN fetched f ON f.source_id = r.source_id WHERE r.is_active GROUP BY 1)
              WHERE last_seen_id IS NOT NULL""",
        ),
    ),
    "ingest_then_stage": (
        ingested_then_staged,
        recursive(
            *_INGEST_WALL_SQL,
            body="""SELECT post_id, CASE WHEN length(text) < 30 THEN 'coarse_filter_rejected' ELSE 'coarse_filter_passed' END AS status
              FROM stored""",
        ),
    ),
    "scan_wall_json": (scan_wall, SCAN_WALL_SQL),
    "scan_chat_json": (scan_chat, SCAN_CHAT_SQL),
    "scan_samples_csv": (scan_samples, SCAN_SAMPLES_SQL),
    "clean_samples": (
        samples_from_tables,
        """SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS source_id, upper(source) AS source, text, toxic AS label
           FROM documents JOIN labels USING (doc_id) WHERE length(text) >= 30""",
    ),
    "new_since_cursor_wall": (wall_new, _wall_new_sql(50, None)),
    "new_since_cursor_wall_capped": (wall_new_capped, _wall_new_sql(10, 25)),
    "new_since_cursor_chat": (chat_new, CHAT_NEW_SQL),
    "active_sources": (active, sql(b.REGISTRY_SQL, body="SELECT source_id, title, url FROM registry WHERE is_active")),
    "lookup_by_key": (
        lookup,
        sql(
            b.REGISTRY_SQL,
            body="""SELECT k.source_id, title, url FROM (SELECT DISTINCT user_id * 11 AS source_id FROM events) k
              LEFT JOIN registry r ON r.source_id = k.source_id""",
        ),
    ),
    "repeated_keys": (repeated, "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1"),
    "page_topk": (
        page,
        sql(
            b.EVENTS_SQL,
            body="""SELECT source_id, id, rn FROM (SELECT *, row_number() OVER (
              PARTITION BY source_id ORDER BY id DESC) AS rn FROM items) WHERE rn BETWEEN 6 AND 25""",
        ),
    ),
    "latest_id_per_source": (
        latest,
        sql(b.EVENTS_SQL, body="SELECT source_id, max(id) AS latest_id FROM items GROUP BY 1"),
    ),
    "fetched_per_source": (
        fetched,
        f"SELECT source_id, count(*) AS fetched FROM ({_wall_new_sql(50, None)}) GROUP BY 1",
    ),
    "cursor_advance": (advance, _cursor("greatest(last_seen_id, latest_id)")),
    "cursor_seed": (seed, _cursor("CASE WHEN is_active THEN coalesce(last_seen_id, latest_id) ELSE last_seen_id END")),
    "cursor_seed_all": (
        seed_all,
        _cursor("CASE WHEN is_active THEN coalesce(latest_id, last_seen_id) ELSE last_seen_id END"),
    ),
    "deactivate_source": (
        deactivate,
        sql(
            b.EVENTS_SQL,
            b.REGISTRY_SQL,
            body="""SELECT source_id, CAST(is_active AND source_id NOT IN (
              SELECT source_id FROM items WHERE event_type = 'error' AND value > 20) AS INT) AS is_active FROM registry""",
        ),
    ),
    "sort_by_item_id": (
        in_id_order,
        sql(
            b.EVENTS_SQL,
            body="SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS position FROM items",
        ),
    ),
    "registry_join": (
        lambda t: _items(t).select("source_id", "id", "url", "last_seen_id"),
        sql(*_ITEMS_SQL, body="SELECT source_id, id, url, last_seen_id FROM fetched"),
    ),
    "map_wall_post": (map_wall, sql(*_WALL, body=_FLAT_SQL + "wall_posts")),
    "map_chat_message": (map_chat, sql(*_CHAT, body=_FLAT_SQL + "chat_posts")),
    "union_sources": (both_sources, sql(*_BOTH, body=f"{_FLAT_SQL} wall_posts UNION ALL {_FLAT_SQL} chat_posts")),
    "owner_id": (owner, sql(b.WALL_SQL, body="SELECT id, coalesce(owner_id, source_id) AS owner_id FROM wall")),
    "nullable_author": (
        author,
        sql(b.WALL_SQL, b.CHAT_SQL, body="SELECT id, from_id AS author_id FROM wall UNION ALL SELECT id, sender_id FROM chat"),
    ),
    "wall_url": (
        wall_urls,
        sql(b.WALL_SQL, body="SELECT id, 'https://vk.com/wall' || coalesce(owner_id, source_id) || '_' || id AS url FROM wall"),
    ),
    "chat_url": (
        chat_urls,
        sql(
            b.CHAT_SQL,
            body="""SELECT id, 'https://t.me/' || CASE WHEN chat_username <> '' THEN chat_username
              ELSE 'c/' || replace(replace(CAST(chat_id AS VARCHAR), '-100', ''), '-', '') END || '/' || id AS url FROM chat""",
        ),
    ),
    "epoch_to_utc": (
        epoch_times,
        sql(b.WALL_SQL, body=f"SELECT id, strftime(make_timestamp(date * 1000000), '{SECOND_SQL}') AS at FROM wall"),
    ),
    "aware_to_utc": (
        zoned_times,
        sql(b.CHAT_SQL, body=f"SELECT id, strftime(sent_at, '{SECOND_SQL}') AS at FROM chat"),
    ),
    "best_photo_urls": (
        best_photos,
        sql(
            b.WALL_SQL,
            body="""SELECT w.id, coalesce(array_to_string(urls, ','), '') AS photos
              FROM wall w LEFT JOIN wall_photos p ON p.id = w.id""",
        ),
    ),
    "write_posts": (stored_posts, sql(*_BOTH, _ALL_SQL, body="SELECT post_id, status, source, text_hash FROM all_posts")),
    "write_details": (
        details,
        sql(*_BOTH, _ALL_SQL, body="SELECT post_id, source, owner_id, item_id, author_id FROM all_posts"),
    ),
    "write_attachments": (attachments, ATTACHMENTS_SQL),
    "attachment_position": (
        last_attachment_position,
        f"""SELECT post_id, max(position) AS last_position, CAST(sum(position) AS BIGINT) AS position_sum
          FROM ({ATTACHMENTS_SQL}) GROUP BY 1""",
    ),
    "domain_post": (
        domain,
        sql(
            *_BOTH,
            _ALL_SQL,
            body="""SELECT post_id AS id, source, text, source_post_url, source_chat_url, photos, 1 AS no_attributes
              FROM all_posts""",
        ),
    ),
    "has_text_wall": (text_only, sql(b.WALL_SQL, body="SELECT id, text FROM wall WHERE text <> ''")),
    "not_ads": (
        no_ads,
        sql(b.WALL_SQL, body="SELECT id, marked_as_ads FROM wall WHERE coalesce(marked_as_ads, 0) <> 1"),
    ),
    "processable_chat": (
        chat_processable,
        sql(
            b.CHAT_SQL,
            body="""SELECT id, raw_text FROM chat WHERE trim(replace(raw_text, chr(160), '')) <> ''
              AND NOT has_action AND NOT has_sticker AND (NOT has_document OR has_video)""",
        ),
    ),
    "coarse_filter": (coarse, "SELECT doc_id AS post_id, length(text) AS n FROM documents WHERE length(text) >= 30"),
    "dedup_source_key": (dedup_source, DEDUP_SOURCE_SQL),
    "exists_limit_1": (
        exists_semi,
        """SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (
          SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')""",
    ),
    "dedup_text_lookback": (dedup_lookback, DEDUP_LOOKBACK_SQL),
    "dedup_text_lookback_interleaved": (dedup_lookback_events, DEDUP_LOOKBACK_EVENTS_SQL),
    "suppress_1h": (suppress_posts, suppress_sql((b.HASHED_SQL,), "hashed", "text_hash", "post_id")),
    "suppress_1h_events": (suppress_events, SUPPRESS_EVENTS_SQL),
    "suppress_1h_hot_keys": (suppress_events_hot, SUPPRESS_EVENTS_SQL),
    "arrival_funnel": (arrival_funnel, FUNNEL_SQL),
    "unpublished_posts": (
        unpublished,
        sql(b.POSTS_SQL, body="SELECT post_id AS id, 'new' AS status, source FROM posts WHERE post_id % 4 <> 0 AND post_id % 9 = 0"),
    ),
}
