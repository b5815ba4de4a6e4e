"""The ingest job: records of one poll to stored posts, details, photos and cursors.

A run reads only what lies behind the cursors, maps it, drops what is stored already under its source
key or, within an hour, under its text, writes one folder per run and table, and publishes what it stored.
The clock of the hour is arrival, the time of the poll, not that of publication: all rows of a poll arrive at
once, so of equal texts in it one stays, the first published. Without a time of the poll every record arrives when it
was published, as in a job that keeps up with its sources or fills a backlog: a text comes again once an hour has passed. A run that is repeated under its number and time
replaces its folders and sees only the runs before it, so it stores the same rows; it publishes only once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import records as rules
from postloom.functions.parsing import encode_payload
from postloom.functions.times import HOUR_US, epoch_micros, micros_to_utc
from postloom.operators import ingest
from postloom.operators.suppress import suppress_repeats
from postloom.session import forget, written

KEY = ["source", "owner_id", "item_id"]
POST_SCHEMA = (
    "post_id STRING, status STRING, source STRING, text STRING, post_datetime TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, source_post_url STRING, "
    "source_chat_url STRING, text_hash STRING, owner_id BIGINT, item_id BIGINT, author_id BIGINT, attachments ARRAY<STRING>, at_us BIGINT, month DATE"
)


class PostStore:
    """Tables below `path`: posts (by run and month of arrival), details, attachments, cursors (by run); `stage` for published posts."""

    TABLES = {
        "posts": POST_SCHEMA,
        "details": "post_id STRING, source STRING, owner_id BIGINT, item_id BIGINT, author_id BIGINT",
        "attachments": "post_id STRING, position INT, url STRING",
        "cursors": "platform STRING, source_id BIGINT, last_seen_id BIGINT",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """All rows, or those of the runs before one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{self.TABLES[table]}, run INT")
        rows = self.spark.read.schema(f"{self.TABLES[table]}, run INT").parquet(f"{self.path}/{table}")
        return rows if before is None else rows.where(F.col("run") < before)

    def write(self, table: str, rows: DataFrame, run: int, partition: list[str] | None = None) -> None:
        rows.write.mode("overwrite").partitionBy(*(partition or [])).parquet(f"{self.path}/{table}/run={run}")

    def publish(self, posts: DataFrame, run: int) -> None:
        """Payloads of stored posts, to the first stage. What a run has published is left: it may have been read."""
        folder = f"{self.path}/stage/new/run={run}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            post = F.struct(*[F.col(c) for c in ingest.domain_posts(posts).columns])
            rows = ingest.domain_posts(posts).select(encode_payload(post).alias("payload"), F.col("id").alias("post_id"), F.lit("new").alias("status"), F.lit(True).alias("passed"))
            rows.write.mode("overwrite").partitionBy("passed").parquet(folder)

    def registry(self, registry: DataFrame, platform: str, before: int) -> DataFrame:
        """The registry with the cursors that the runs before have left."""
        seen = self.read("cursors", before).where(F.col("platform") == platform)
        seen = seen.groupBy("source_id").agg(F.max("last_seen_id").alias("_stored"))
        joined = registry.join(seen, "source_id", "left")
        return joined.withColumn("last_seen_id", F.greatest("last_seen_id", "_stored")).drop("_stored")


def _ingest(
    fetched: DataFrame, usable, mapped, registry: DataFrame, store: PostStore, run: int, platform: str, span_us: int, now_us: int | None
) -> DataFrame:
    names = [c.split()[0] for c in POST_SCHEMA.split(", ")]
    posts = ingest.with_post_id(mapped(fetched.where(usable)))
    at = epoch_micros(F.col("post_datetime")) if now_us is None else F.lit(now_us).cast("bigint")
    posts = posts.withColumn("at_us", at).withColumn("created_at", micros_to_utc(F.col("at_us")))
    posts = posts.withColumn("month", F.trunc(F.to_date("created_at"), "MM"))
    posts = written(posts.select(*names), "ingest-mapped")
    earliest = now_us if now_us is not None else posts.agg(F.min("at_us")).first()[0]
    # of the stored keys only those of owners in this batch matter
    keys = store.read("details", run).join(posts.select("source", "owner_id").distinct(), ["source", "owner_id"], "left_semi")
    fresh = ingest.dedup_source_key(posts, keys, KEY, ["post_datetime", "post_id"]).select(names)
    history = store.read("posts", run).select("text_hash", "at_us", "month")
    if earliest is not None:
        # only the months that the look-back meets are read
        first = F.trunc(F.to_date(micros_to_utc(F.lit(earliest - span_us).cast("bigint"))), "MM")
        history = history.where((F.col("at_us") >= earliest - span_us) & (F.col("month") >= first))
    unseen = ingest.dedup_text_lookback(fresh, history, span_us)
    if now_us is None:
        unseen = written(unseen.select(names), "ingest-unseen")
        stays = suppress_repeats(unseen, "text_hash", "at_us", "post_id", span_us).select("post_id")
        kept = written(unseen.join(stays, "post_id", "left_semi").select(names), "ingest-kept")
        forget(unseen)
    else:
        # one arrival time: of equal texts the first published stays, combined on the map side
        rest = [c for c in names if c != "text_hash"]
        kept = unseen.groupBy("text_hash").agg(F.min_by(F.struct(*rest), F.struct("post_datetime", "item_id", "post_id")).alias("row"))
        kept = written(kept.select("text_hash", "row.*").select(names), "ingest-kept")
    forget(posts)
    store.write("attachments", ingest.attachment_rows(kept), run)
    store.write("details", ingest.source_details(kept), run)
    store.write("posts", kept, run, ["month"])
    store.publish(kept, run)
    # cursors last: a run that failed before is done again
    moved = ingest.cursor_advance(registry, fetched).where("last_seen_id IS NOT NULL")
    store.write("cursors", moved.select(F.lit(platform).alias("platform"), "source_id", "last_seen_id"), run)
    return kept


def ingest_wall(
    wall: DataFrame, registry: DataFrame, store: PostStore, run: int, now_us: int | None, span_us: int = HOUR_US, depth: int | None = None
) -> DataFrame:
    """One poll, at `now_us` (None: each record arrives when published), of wall records (with source_id); returns the posts it stored."""
    active = ingest.active_sources(store.registry(registry, "vk", run))
    # the photos are chosen where a record lies: their renditions do not move with it
    wall = wall.withColumn("attachments", rules.best_photo_urls(F.col("attachments")))
    fetched = ingest.new_since_cursor_wall(ingest.registry_join(wall, active), depth=depth)
    usable = rules.has_text(F.col("text")) & rules.not_ads(F.col("marked_as_ads"))
    return _ingest(fetched, usable, partial(ingest.map_wall_posts, chosen=True), active, store, run, "vk", span_us, now_us)


def ingest_chat(
    messages: DataFrame, registry: DataFrame, store: PostStore, run: int, now_us: int | None, span_us: int = HOUR_US, limit: int = ingest.PAGE
) -> DataFrame:
    """One poll, at `now_us` (None: as in `ingest_wall`), of chat messages (with source_id and sent_at); returns the posts it stored."""
    active = ingest.active_sources(store.registry(registry, "tg", run))
    fetched = ingest.new_since_cursor_chat(ingest.registry_join(messages, active), limit)
    columns = ("raw_text", "has_action", "has_sticker", "has_document", "has_video")
    usable = rules.processable_chat(*[F.col(c) for c in columns])
    return _ingest(fetched, usable, ingest.map_chat_messages, active, store, run, "tg", span_us, now_us)
