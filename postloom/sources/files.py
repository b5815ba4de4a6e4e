"""File sources: wall and chat JSON, labelled CSV samples, stage tables, as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import strip_spaces
from postloom.functions.times import aware_to_utc
from postloom.schemas import CHAT_SCHEMA, SAMPLES_SCHEMA, WALL_SCHEMA
from postloom.sources.quoted import read_quoted_csv


def scan_wall_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Wall records, one JSON object per line; unknown fields are ignored."""
    return _reader(spark, stream).schema(WALL_SCHEMA).json(path)


def scan_chat_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Chat messages; `date` (with offset) becomes `sent_at` in naive UTC."""
    schema = CHAT_SCHEMA.replace("date TIMESTAMP", "date STRING")
    raw = _reader(spark, stream).schema(schema).json(path)
    return raw.withColumn("sent_at", aware_to_utc(F.col("date"))).drop("date")


def scan_samples_csv(spark: SparkSession, path: str, min_length: int = 30, split: bool = True) -> DataFrame:
    """Labelled samples: labels 0/1 only, texts of at least `min_length` characters.

    Files are split between tasks; with `split=False` one task reads a file, whatever its quoting.
    """
    if split:
        return clean_samples(read_quoted_csv(spark, path, SAMPLES_SCHEMA), min_length)
    raw = (
        spark.read.schema(SAMPLES_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("enforceSchema", True)
        .csv(path)
    )
    return clean_samples(raw, min_length)


def clean_samples(raw: DataFrame, min_length: int = 30) -> DataFrame:
    """Sample rules, on any relation with the CSV's columns."""

    def trimmed(name: str):
        return strip_spaces(F.coalesce(F.col(name), F.lit("")))

    label = trimmed("label")
    text = F.coalesce(F.col("text"), F.lit(""))
    return raw.where(label.isin("0", "1") & (F.length(text) >= min_length)).select(
        trimmed("post_id").alias("post_id"),
        trimmed("source_id").alias("source_id"),
        F.upper(trimmed("source")).alias("source"),
        text.alias("text"),
        label.cast("int").alias("label"),
    )


def read_stage_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 10, **options) -> DataFrame:
    """A stage table as a stream, from its beginning, oldest files first."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).parquet(path)


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read
