"""The stage chain as independent streaming queries over Parquet stage tables.

A stage reads the table of the stage before, decides on every post and appends all decisions
to its own table, partitioned by outcome. The next stage reads the `passed` partition only.
The file sink's commit log makes a replayed micro-batch appear once, so a restart neither
loses nor repeats a post, and the decision tables together are the status log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.functions.parsing import decode_payload, encode_payload
from postloom.functions.records import long_enough
from postloom.operators.learn import LinearModel, ml_filter
from postloom.operators.status import status_transition
from postloom.schemas import QUARANTINED

STAGES = ["new", "coarse", "ml", "prepared"]
#: Every stage keeps the payloads it decided on, so texts are stored once a stage.
CODEC = "zstd"
DECISION_SCHEMA = "payload STRING, post_id STRING, status STRING, passed BOOLEAN"


def start_append(df: DataFrame, path: str, checkpoint: str, available_now: bool, partition: str | None) -> StreamingQuery:
    """Append a stream to a Parquet table through the file sink's commit log."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", CODEC)
    if partition:
        writer = writer.partitionBy(partition)
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    return writer.trigger(**trigger).start()


def publish_stage(posts: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of post structs (column `post`) to the `new` stage as JSON payloads."""
    rows = posts.select(
        encode_payload(F.col("post")).alias("payload"),
        F.col("post.id").cast("string").alias("post_id"),
        F.lit("new").alias("status"),
        F.lit(True).alias("passed"),
    )
    return start_append(rows, f"{root}/new", f"{root}/_checkpoints/new", available_now, "passed")


def read_stage(spark: SparkSession, root: str, stage: str, files_per_trigger: int = 10) -> DataFrame:
    """Passed posts of a stage as a stream: (post, error), oldest files first."""
    raw = (
        spark.readStream.schema(DECISION_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root}/{stage}")
        .where("passed")
    )
    return raw.select("payload", decode_payload(F.col("payload")).alias("d")).select("payload", "d.post", "d.error")


def run_stage(
    spark: SparkSession,
    root: str,
    source: str,
    target: str,
    decide: Callable[[DataFrame], DataFrame],
    available_now: bool = True,
    files_per_trigger: int = 10,
) -> StreamingQuery:
    """One stage: `decide` adds `passed` and `status`, and may fill `post.attributes`.

    Payloads that do not decode get the status `quarantined` instead of stopping the stage.
    """
    incoming = read_stage(spark, root, source, files_per_trigger)
    decided = decide(incoming)
    good = F.col("error").isNull()
    rows = decided.select(
        F.when(good, encode_payload(F.col("post"))).otherwise(F.col("payload")).alias("payload"),
        F.when(good, F.col("post.id")).alias("post_id"),
        F.when(good, F.col("status")).otherwise(F.lit(QUARANTINED)).alias("status"),
        (good & F.coalesce("passed", F.lit(False))).alias("passed"),
    )
    return start_append(rows, f"{root}/{target}", f"{root}/_checkpoints/{target}", available_now, "passed")


def coarse_decision(df: DataFrame) -> DataFrame:
    passed = long_enough(F.col("post.text"))
    return df.withColumns({"passed": passed, "status": status_transition(passed, "coarse_filter")})


def ml_decision(relevant: Callable) -> Callable[[DataFrame], DataFrame]:
    """Stage decision from a column function `relevant(text) -> boolean column`."""

    def decide(df: DataFrame) -> DataFrame:
        passed = relevant(F.col("post.text"))
        return df.withColumns({"passed": passed, "status": status_transition(passed, "ml_filter")})

    return decide


def extract_decision(attributes: Callable) -> Callable[[DataFrame], DataFrame]:
    """Stage decision that fills attributes from `attributes(text) -> struct column`."""

    def decide(df: DataFrame) -> DataFrame:
        filled = F.col("post").withField("attributes", attributes(F.col("post.text")))
        return df.withColumns(
            {"post": filled, "passed": F.lit(True), "status": F.lit("attributes_extracted")}
        )

    return decide


def status_log(spark: SparkSession, root: str, stages: list[str] | None = None) -> DataFrame:
    """All decisions of all stages as (post_id, status)."""
    log = None
    for stage in stages or STAGES:
        rows = spark.read.parquet(f"{root}/{stage}").select("post_id", "status")
        log = rows if log is None else log.unionByName(rows)
    return log


def replacing_writer(path: str, transform: Callable[[DataFrame], DataFrame]):
    """foreachBatch function: one folder per batch, written whole again when replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").option("compression", CODEC).parquet(f"{path}/batch_id={batch_id}")

    return write


def start_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, mode: str = "append"
) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def run_scored_stage(
    spark: SparkSession, root: str, source: str, target: str, model: LinearModel, available_now: bool = True
) -> StreamingQuery:
    """The classifier stage. Scoring joins and aggregates, so it runs once per micro-batch.

    A batch folder that is complete is left as it is on a replay: its files may have been read
    by the next stage already.
    """
    path = f"{root}/{target}"

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return
        batch = batch.persist()
        good = batch.where("error IS NULL").select("payload", F.col("post.id").alias("post_id"), F.col("post.text").alias("text"))
        scored = ml_filter(good, model)
        decided = scored.select(
            "payload",
            "post_id",
            status_transition(F.col("relevant"), "ml_filter").alias("status"),
            F.col("relevant").alias("passed"),
        )
        bad = batch.where("error IS NOT NULL").select(
            "payload",
            F.lit(None).cast("string").alias("post_id"),
            F.lit(QUARANTINED).alias("status"),
            F.lit(False).alias("passed"),
        )
        decided.unionByName(bad).write.mode("overwrite").option("compression", CODEC).partitionBy("passed").parquet(folder)
        batch.unpersist()

    return start_batches(read_stage(spark, root, source), write, f"{root}/_checkpoints/{target}", available_now)


def fan_out(
    spark: SparkSession,
    root: str,
    consumers: dict[str, Callable[[DataFrame], DataFrame]],
    source: str = "prepared",
    available_now: bool = True,
) -> dict[str, StreamingQuery]:
    """Independent readers of one stage, each with its own checkpoint and output table.

    Every consumer sees every post; one that fails does not hold up the others. A consumer is
    called per micro-batch, so tables it reads, such as subscribers, are current.
    """
    started = {}
    for name, consume in consumers.items():
        posts = read_stage(spark, root, source).where("error IS NULL").select("post.*")
        started[name] = start_batches(
            posts, replacing_writer(f"{root}/out/{name}", consume), f"{root}/_checkpoints/out-{name}", available_now
        )
    return started


def dispatch_with_current_subscribers(
    posts: DataFrame,
    load_subscribers: Callable[[], DataFrame],
    deliver: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Stream–static join whose static side is read again for every micro-batch."""
    write = replacing_writer(path, lambda batch: deliver(batch, load_subscribers()))
    return start_batches(posts, write, checkpoint, available_now)
