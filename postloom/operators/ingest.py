"""Incremental ingest: cursor reads, flat mapping, dedup by source key and by recent text.

No join here carries a broadcast hint: registries are left to the optimizer, which
broadcasts a side only while its measured size is below the configured threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import records
from postloom.functions.text import text_hash
from postloom.functions.times import HOUR_US, epoch_to_utc

PAGE = 50
WALL_DEPTH = 1000


def active_sources(registry: DataFrame) -> DataFrame:
    return registry.where("is_active")


def lookup_by_key(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows for each asked key, null columns where there is none."""
    return keys.join(table, on, "left")


def repeated_keys(table: DataFrame, on: list[str]) -> DataFrame:
    """Keys held by more than one row; must be empty for a unique key."""
    return table.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def registry_join(records_: DataFrame, registry: DataFrame) -> DataFrame:
    """Records of registered sources with the source's url and cursor."""
    return records_.join(registry.select("source_id", "url", "last_seen_id"), "source_id")


def newest_first(df: DataFrame, top: int, *first: Column) -> DataFrame:
    """The first `top` rows per source in (`first`, id descending) order.

    The literal bound on row_number lets Spark keep at most `top` rows per source and task
    before the shuffle, so one huge source does not fill one task.
    """
    order = Window.partitionBy("source_id").orderBy(*first, F.col("id").desc())
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)


def page_topk(df: DataFrame, count: int = PAGE, offset: int = 0) -> DataFrame:
    """Newest `count` rows from `offset` per source."""
    return newest_first(df, offset + count).where(F.col("rn") > offset)


def new_since_cursor_wall(df: DataFrame, page: int = PAGE, depth: int | None = None) -> DataFrame:
    """Wall rows newer than `last_seen_id`; a source never read gives its first page.

    Pinned rows come first on a wall and count towards the page, but an old pinned row is
    never new. With `depth`, at most that many rows per source are looked at, in whole pages.
    """
    pinned = F.coalesce(F.col("is_pinned"), F.lit(0)) != 0
    newer = F.col("id") > F.col("last_seen_id")
    unread = F.col("last_seen_id").isNull()
    if depth is None:
        # all newer rows of a source that was read are new, so these need no rank and no shuffle
        return newest_first(df.where(unread), page, pinned.desc()).drop("rn").unionByName(df.where(newer))
    reach = -(-depth // page) * page
    # one pass for both kinds of source; old rows other than pinned ones sort last and need no rank
    ranked = newest_first(df.where(unread | newer | pinned), max(page, reach), pinned.desc())
    return ranked.where(F.when(unread, F.col("rn") <= page).otherwise(newer & (F.col("rn") <= reach))).drop("rn")


def new_since_cursor_chat(df: DataFrame, limit: int = PAGE) -> DataFrame:
    """Newest `limit` messages of a chat never read, else the oldest `limit` after the cursor.

    One ranked pass: the order is by id, downwards for chats never read.
    """
    unread = F.col("last_seen_id").isNull()
    order = Window.partitionBy("source_id").orderBy(F.when(unread, -F.col("id")).otherwise(F.col("id")))
    ranked = df.where(unread | (F.col("id") > F.col("last_seen_id"))).withColumn("rn", F.row_number().over(order))
    return ranked.where(F.col("rn") <= limit).drop("rn")


def latest_id_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.max("id").alias("latest_id"))


def fetched_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.count("*").alias("fetched"))


def cursor_advance(registry: DataFrame, handled: DataFrame) -> DataFrame:
    """Cursors after a poll: the newest handled id, dropped rows included, never lower."""
    return (
        registry.join(latest_id_per_source(handled), "source_id", "left")
        .withColumn("last_seen_id", F.greatest("last_seen_id", "latest_id"))
        .drop("latest_id")
    )


def cursor_seed(registry: DataFrame, items: DataFrame, only_null: bool = True) -> DataFrame:
    """Set cursors of active sources to their newest id; sources without items stay as they are."""
    seeded = registry.join(latest_id_per_source(items), "source_id", "left")
    pick = ["last_seen_id", "latest_id"] if only_null else ["latest_id", "last_seen_id"]
    value = F.when(F.col("is_active"), F.coalesce(*pick)).otherwise(F.col("last_seen_id"))
    return seeded.withColumn("last_seen_id", value).drop("latest_id")


def deactivate_sources(registry: DataFrame, closed: DataFrame) -> DataFrame:
    """Closed sources become inactive."""
    gone = closed.select("source_id").distinct().withColumn("_closed", F.lit(True))
    return (
        registry.join(gone, "source_id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_closed").isNull())
        .drop("_closed")
    )


def map_wall_posts(wall: DataFrame, chosen: bool = False) -> DataFrame:
    """Wall records joined to their registry row → post rows with photo urls (`chosen`: attachments are the urls)."""
    owner = records.wall_owner(F.col("owner_id"), F.col("source_id"))
    return wall.select(
        F.lit("new").alias("status"),
        F.lit("vk").alias("source"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        epoch_to_utc(F.col("date")).alias("post_datetime"),
        records.wall_url(owner, F.col("id")).alias("source_post_url"),
        F.col("url").alias("source_chat_url"),
        text_hash(F.col("text")).alias("text_hash"),
        owner.alias("owner_id"),
        F.col("id").alias("item_id"),
        records.nullable_author(F.col("from_id")).alias("author_id"),
        F.col("attachments") if chosen else records.best_photo_urls(F.col("attachments")).alias("attachments"),
    )


def map_chat_messages(messages: DataFrame) -> DataFrame:
    """Chat messages joined to their registry row → post rows; chats carry no photos."""
    return messages.select(
        F.lit("new").alias("status"),
        F.lit("tg").alias("source"),
        F.coalesce(F.col("raw_text"), F.lit("")).alias("text"),
        F.col("sent_at").alias("post_datetime"),
        records.chat_url(F.col("chat_id"), F.col("chat_username"), F.col("id")).alias("source_post_url"),
        F.col("url").alias("source_chat_url"),
        text_hash(F.col("raw_text")).alias("text_hash"),
        F.col("chat_id").alias("owner_id"),
        F.col("id").alias("item_id"),
        records.nullable_author(F.col("sender_id")).alias("author_id"),
        F.array().cast("array<string>").alias("attachments"),
    )


def with_post_id(posts: DataFrame) -> DataFrame:
    """Stable id from the source key; a re-run gives the same id, no sequence needed."""
    return posts.withColumn("post_id", F.sha2(F.concat_ws(":", "source", "owner_id", "item_id"), 256))


def source_details(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", "source", "owner_id", "item_id", "author_id")


def attachment_rows(posts: DataFrame) -> DataFrame:
    """One row per photo with its 0-based position."""
    return posts.select("post_id", F.posexplode("attachments").alias("position", "url"))


def domain_posts(posts: DataFrame, id_column: str = "post_id") -> DataFrame:
    """Stream records of freshly stored posts: attributes still null."""
    nothing = F.lit(None).cast("struct<duration:string,work_type:string,payment:string,address:string>")
    return posts.select(
        F.col(id_column).alias("id"),
        "source",
        "text",
        "source_post_url",
        "source_chat_url",
        "attachments",
        nothing.alias("attributes"),
    )


def union_sources(wall_posts: DataFrame, chat_posts: DataFrame) -> DataFrame:
    return wall_posts.unionByName(chat_posts)


def dedup_source_key(batch: DataFrame, seen: DataFrame, keys: list[str], first_by: list[str]) -> DataFrame:
    """Rows whose source key is not stored yet, one per key (lowest by `first_by`).

    `min_by` combines on the map side, so a key copied very often shuffles one row per task.
    """
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*first_by)).alias("row"))
    return one.select(*keys, "row.*").join(seen.select(*keys), keys, "left_anti")


def _slot(at_us: Column, span_us: int) -> Column:
    """Number of the span-long bucket a time lies in (integer arithmetic, no rounding)."""
    return ((at_us - F.pmod(at_us, F.lit(span_us))) / span_us).cast("bigint")


def recent_repeat_index(history: DataFrame, span_us: int = HOUR_US) -> DataFrame:
    """History reduced to one row per (hash, span-long bucket).

    For a post in bucket b, a stored equal text lies within the span before it iff the
    earliest of bucket b is not later, or the latest of bucket b-1 is at most a span older.
    """
    slot = _slot(F.col("at_us"), span_us)
    shares = F.array(
        F.struct(slot.alias("slot"), F.col("at_us").alias("here"), F.lit(None).cast("bigint").alias("before")),
        F.struct((slot + 1).alias("slot"), F.lit(None).cast("bigint").alias("here"), F.col("at_us").alias("before")),
    )
    return (
        history.select("text_hash", F.inline(shares))
        .groupBy("text_hash", "slot")
        .agg(F.min("here").alias("here_first"), F.max("before").alias("before_last"))
    )


def dedup_text_lookback(batch: DataFrame, history: DataFrame, span_us: int = HOUR_US) -> DataFrame:
    """Drop posts whose text hash was stored within the last hour, bounds included.

    A plain interval join would pair every copy in the batch with every copy in the history;
    the index makes it an equality join against one row per (hash, bucket). Null hashes equal each other.
    """
    at = F.col("at_us")
    probe = batch.withColumn("_slot", _slot(at, span_us))
    index = recent_repeat_index(history, span_us).withColumnRenamed("text_hash", "_hash")
    joined = probe.join(index, F.col("text_hash").eqNullSafe(F.col("_hash")) & (F.col("_slot") == F.col("slot")), "left")
    repeat = F.coalesce(F.col("here_first") <= at, F.lit(False)) | F.coalesce(
        F.col("before_last") >= at - span_us, F.lit(False)
    )
    return joined.where(~repeat).select(*batch.columns)


def unpublished_posts(posts: DataFrame, published: DataFrame) -> DataFrame:
    """Stored posts still `new` that never reached the stage stream."""
    return posts.where("status = 'new'").join(published.select("id"), "id", "left_anti")
