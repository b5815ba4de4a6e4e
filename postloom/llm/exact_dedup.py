"""Exact deduplication against a persistent digest index, by DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest, one row per text ever seen, with the smallest id that brought
it. Rows come to it in batches of ascending id. A batch is first reduced to one row per digest (map-side), then anti-joined
with the index: the index side of the sort-merge join needs no shuffle, and what the join lets through is appended to the
same buckets. So the index says of each text which row stays. It has at least as many buckets as the session has shuffle
partitions, and one for each BUCKET_ROWS expected rows; their number is stored beside it, and another one is refused.

Defined cases: a null text is the empty text, and equal to it; rows with a null id are members of
their group but are kept only if no row of the group has an id; rows that repeat an id count as rows
and, with equal texts, share its decision; an empty table appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import partitions, saved, with_ids
from postloom.session import work_path

BUCKET_ROWS, BATCHES = 2_000_000, 4


def normalised(text: Column) -> Column:
    """Each run of white space (space, U+0009 to U+000D) becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """Digests seen so far, below `path`; a table of the session for as long as it is open."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        stored = self._stored()
        if stored is None and buckets is None:
            raise ValueError("a new index needs its number of buckets")
        if stored is not None and buckets not in (None, stored):
            raise ValueError(f"the index has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets
        if stored is None:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(self.path + "-buckets")
        self.name = f"digests_{uuid.uuid4().hex}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, first_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def _stored(self) -> int | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "-buckets")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.parquet(self.path + "-buckets").first()["buckets"]

    def close(self) -> None:
        """Take the table out of the catalogue; the index itself stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> "DigestIndex":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, batch: DataFrame, label: str = "batch") -> DataFrame:
        """Append the digests of `batch` (digest, first_id) that the index lacks, and return them.

        The new rows are written to the shared folder before the append, so that a failed append can be
        repeated from the same rows; `batch` must have distinct digests.
        """
        new = batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = saved(new.select("digest", "first_id", F.lit(label).alias("batch")), "admitted")
        (
            new.repartition(self.buckets, "digest")  # as the writer assigns buckets: one file each
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        )
        return new


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text_col)), 256))


def group_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    keep_id is the id the index holds for the text: the smallest of `docs`, or that of an earlier run. `kept` is
    false for every row whose text the index held before (`seen_before`), else true for the row with the smallest id.
    """
    digests = saved(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _digest(text_col).alias("digest")), "digests")
    cuts = digests.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    # rows without an id come last, so that one with an id is found first
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts or []), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), batches).otherwise(batch)
    run = uuid.uuid4().hex
    for k in range(batches + 1):
        index.admit(digests.where(batch == k).groupBy("digest").agg(F.min("doc_id").alias("first_id")), run)
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    decided = sizes.join(index.rows().hint("merge"), "digest").select("digest", "first_id", "group_size", (F.col("batch") != run).alias("seen_before"))
    # a viral text makes one side skewed: AQE splits it, the other side has one row per text
    return digests.join(saved(decided, "decided"), "digest").select(
        "doc_id",
        F.col("first_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("first_id")) & ~F.col("seen_before")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen_before",
    )


def fresh_index(spark: SparkSession, expected: int = 0) -> DigestIndex:
    """An index of this run's own, in the shared folder, for so many rows."""
    return DigestIndex(spark, work_path(spark, "digest-index"), max(partitions(spark), -(-expected // BUCKET_ROWS)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with fresh_index(spark, docs.count()) as index:
        return group_copies(docs, index).drop("seen_before")


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of those with the smallest id, any one.

    A row whose id is in the table once goes by its id. Rows that share an id, or have none, go by id and digest.
    """
    with fresh_index(spark, docs.count()) as index:
        decided = saved(group_copies(docs, index), "decisions")
    ids = decided.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    shared = saved(ids.where("n > 1").select("doc_id"), "shared-ids")
    dropped = saved(ids.where("n > 1 OR NOT kept").select("doc_id"), "dropped")
    named = with_ids(docs.where("doc_id IS NOT NULL"), dropped, "doc_id", "left_anti")
    odd = with_ids(docs.where("doc_id IS NOT NULL"), shared, "doc_id").union(docs.where("doc_id IS NULL"))
    odd = odd.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lower(F.hex(_digest("text"))).alias("text_sha256"))
    kept = decided.where("kept").select("text_sha256", "keep_id").distinct()
    one = odd.join(kept, "text_sha256").where(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    one = one.groupBy("text_sha256").agg(F.min("row").alias("row")).select("row.*")
    return named.unionByName(one)


ORACLE = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)"""
