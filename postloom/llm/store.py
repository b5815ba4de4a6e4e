"""Tables written to the shared folder, and joins whose broadcast side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import reachable, shared_dir, work_path

#: Rows of a batch that Spark hands to Python at once; whole texts make larger batches costly.
BATCH_ROWS = 1000
#: Most 8-byte ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def small_batches(spark: SparkSession) -> None:
    reachable(spark)
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def saved(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """`df` written once to the shared folder, in files of at most `file_rows` (0: no bound); a lost executor reads it again from there."""
    path = work_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what `saved` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """`rows` joined with distinct, saved `ids` (one long column `key`) without moving `rows` if possible.

    The ids are counted; up to BROADCAST_IDS of them are broadcast (16 MB), more are shuffled and hashed
    against the rows. The result is the same.
    """
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return rows.join(ids, key, how).select(*[F.col(f"`{c}`") for c in rows.columns])
