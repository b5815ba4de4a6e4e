"""Repeat suppression on an unbounded stream: one last-kept time per text hash.

`dedup_batches` is the default: every micro-batch runs the batch operator, which splits hot
hashes over tasks. `stream_dedup_1h` keeps the times in Spark's state store instead; there the
rows a hash has in one micro-batch meet in one task, so bound the batch at the source.
Arrival times must not fall between batches; a row not later than the last kept one is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postloom.functions.times import HOUR_US
from postloom.operators.suppress import suppress_repeats
from postloom.session import cut
from postloom.streaming.changes import ChangeStore
from postloom.streaming.stages import start_batches

KEPT_SCHEMA = "text_hash STRING, at_us BIGINT, item_id BIGINT"


def last_kept(spark: SparkSession, path: str, every: int = 16) -> ChangeStore:
    """The last kept time of every text hash that `dedup_batches` holds below `path`."""
    return ChangeStore(spark, f"{path}/state", ["text_hash"], spark.createDataFrame([], "text_hash STRING, at_us BIGINT"), every)


def dedup_batches(
    posts: DataFrame, path: str, checkpoint: str, span_us: int = HOUR_US, available_now: bool = True, lateness_us: int = HOUR_US, every: int = 16
) -> StreamingQuery:
    """Append kept rows of a stream (text_hash, at_us, item_id) to `path/kept`.

    Rows within the span of an earlier batch's last kept row are dropped first; the fold on the
    rest then equals one pass over everything, as dropped rows never lengthen a span. A row that
    arrives late, up to `lateness_us` behind the newest, is a repeat if it is not later than the span
    of the last kept row. A batch writes the times of its own hashes; every `every` batches the times that can
    drop nothing any more are freed. What a batch wrote is replaced when it is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = last_kept(spark, path, every)
        rows = cut(batch.select("text_hash", "at_us", "item_id"))
        touched = cut(rows.select("text_hash").distinct())
        old = cut(state.current(batch_id, touched))
        last = old.select(F.col("text_hash").alias("_hash"), F.col("at_us").alias("_last"))
        joined = rows.join(last, F.col("text_hash").eqNullSafe(F.col("_hash")), "left")
        open_ = F.col("_last").isNull() | (F.col("at_us") > F.col("_last") + span_us)
        kept_path = f"{path}/kept/batch_id={batch_id}"
        kept = suppress_repeats(joined.where(open_).select(rows.columns), "text_hash", "at_us", "item_id", span_us)
        kept.write.mode("overwrite").parquet(kept_path)
        times = spark.read.parquet(kept_path).select("text_hash", "at_us").unionByName(old)
        state.write(batch_id, times.groupBy("text_hash").agg(F.max("at_us").alias("at_us")), touched)

        def live(times: DataFrame) -> DataFrame:
            # a span that ended `lateness_us` before the newest kept row drops nothing any more
            newest = times.agg(F.max("at_us")).first()[0]
            return times if newest is None else times.where(F.col("at_us") + span_us + lateness_us >= newest)

        state.compact(batch_id, live)

    return start_batches(posts, write, checkpoint, available_now)


def stream_dedup_1h(posts: DataFrame, span_us: int = HOUR_US) -> DataFrame:
    """Kept rows of a stream with columns (text_hash, at_us, item_id).

    A watermark would make Spark drop late rows before the fold sees them, so there is none: a late row is
    judged like any other, and one number per text hash stays in the state store for good.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at_us", "item_id"])
        kept = []
        for at_us, item_id in zip(rows["at_us"], rows["item_id"]):
            if last is None or at_us > last + span_us:
                last = int(at_us)
                kept.append((key[0], last, int(item_id)))
        state.update((last,))
        if kept:
            yield pd.DataFrame(kept, columns=["text_hash", "at_us", "item_id"])

    return posts.select("text_hash", "at_us", "item_id").groupBy("text_hash").applyInPandasWithState(
        fold, KEPT_SCHEMA, "last_kept BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def stream_dedup_approximate(posts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Built-in variant: may drop for longer than an hour, as state is freed by the watermark."""
    return posts.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["text_hash"])


def arrival_instant(at_us: str = "at_us"):
    """Event-time column for the watermark from epoch microseconds."""
    return F.timestamp_micros(F.col(at_us)).alias("at")
