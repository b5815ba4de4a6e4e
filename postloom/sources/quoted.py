"""CSV with newlines inside quotes, read by many tasks per file.

Spark's own reader takes such a file whole. Here it is read as lines, split by bytes. Whether a line starts a record
depends on the number of quotes before it, from the start of the file on. A first pass gives each split its parity of
quotes, and how many records start in it if it is entered outside or inside quotes; a prefix over the splits of a file (a
row each) says how each is entered and the number of its first record. The second pass numbers the lines; only lines of
records that span lines are shuffled, by record, and put together again.

Quotes must be those of quoted fields, doubled inside them (RFC 4180); a lone quote inside an unquoted field shifts what
follows, so such files belong to Spark's own reader.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.session import written

#: Splits up to this many (a path and three numbers each) are broadcast; more are joined by a shuffle of splits.
BROADCAST_SPLITS = 200_000
LINE = "file STRING, split BIGINT, line STRING"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _runs(pdf: pd.DataFrame):
    """Parts of a batch that lie in one split, in order."""
    change = (pdf["file"] != pdf["file"].shift()) | (pdf["split"] != pdf["split"].shift())
    for _, part in pdf.groupby(change.cumsum(), sort=False):
        yield part


def _parities(batches):
    """(file, split, quotes, outside, inside) for every part of a split: quotes, and lines met outside or inside them."""
    for pdf in batches:
        out = []
        for part in _runs(pdf):
            quotes = part["line"].str.count('"')
            before = (quotes.cumsum() - quotes) % 2
            out.append((part["file"].iat[0], int(part["split"].iat[0]), int(quotes.sum()), int((before == 0).sum()), int((before == 1).sum())))
        yield pd.DataFrame(out, columns=["file", "split", "quotes", "outside", "inside"])


def _numbered(batches):
    """Lines with the number of their record in the file; `whole` if the record is this line alone."""
    now, parity, record, seq = None, 0, 0, 0
    for pdf in batches:
        for part in _runs(pdf):
            key = part["file"].iat[0], int(part["split"].iat[0])
            if key != now:
                now, parity, record, seq = key, int(part["entered"].iat[0]), int(part["records"].iat[0]), 0
            quotes = part["line"].str.count('"')
            before = (quotes.cumsum() - quotes + parity) % 2
            starts = before == 0
            numbers = starts.cumsum() + record
            yield pd.DataFrame({
                "file": part["file"], "record": numbers, "split": part["split"], "seq": range(seq, seq + len(part)), "line": part["line"],
                "whole": starts & (quotes % 2 == 0),
            })
            seq += len(part)
            parity, record = int((quotes.sum() + parity) % 2), int(numbers.iat[-1])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of the CSV files at `path`, from 1 (the header) on, empty lines included.

    A byte-order mark before the first record, and a carriage return at the end of any, are taken off.
    """
    lines = _lines(spark, path)
    parts = lines.mapInPandas(_parities, "file STRING, split BIGINT, quotes BIGINT, outside BIGINT, inside BIGINT")
    # parts of one split are batches of it: they follow one another, so the entering parity of each depends on those before
    parts = parts.withColumn("part", F.monotonically_increasing_id())
    parts = written(parts, "csv-parts")
    before = Window.partitionBy("file").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, -1)
    entered = parts.withColumn("entered", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    own = F.when(F.col("entered") == 0, F.col("outside")).otherwise(F.col("inside"))
    counted = entered.withColumn("own", own).withColumn("records", F.coalesce(F.sum("own").over(before), F.lit(0)))
    splits = counted.groupBy("file", "split").agg(F.min_by("entered", "part").cast("bigint").alias("entered"), F.min("records").alias("records"))
    splits = written(splits, "csv-splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
        joined = lines.join(splits, ["file", "split"])
    else:  # the lines of a split must stay together and in order
        joined = lines.withColumn("_at", F.monotonically_increasing_id()).join(splits, ["file", "split"]).sortWithinPartitions("file", "split", "_at").drop("_at")
    numbered = joined.mapInPandas(_numbered, "file STRING, record BIGINT, split BIGINT, seq BIGINT, line STRING, whole BOOLEAN")
    whole = numbered.where("whole").select("file", "record", F.col("line").alias("text"))
    pieces = numbered.where("NOT whole").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "line"))).alias("lines"))
    joined = pieces.select("file", "record", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    text = F.regexp_replace(F.col("text"), "\r$", "")
    text = F.when(F.col("record") == 1, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return whole.unionByName(joined).select("file", "record", text.alias("text"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files whose quoted fields may hold newlines, as Spark's reader gives them in `multiLine` mode."""
    records = csv_records(spark, path).where(F.col("text") != "")
    if header:
        records = records.where("record > 1")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return records.select(F.from_csv("text", schema, options).alias("row")).select("row.*")
