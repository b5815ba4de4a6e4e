"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source's extra words (its target less whole passes over it) are the
documents whose hash lies below a threshold. The threshold is found without sorting: sum words per
source and hash bucket, find the bucket in which the budget ends, and refine only that bucket, until
one hash is left in it. Taking documents is then a filter.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; sources
without words get target 0; rows with one id (a null id counts as the empty string) have one hash and
are taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.store import saved

#: Fixed by the mix: weights by rank of the source, total as a share of all words, most passes.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Hex digits of the hash that one refinement reads: 4096 buckets.
DIGITS = 3
HASH_DIGITS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with a target each: weight times one common level, capped at PASSES times the size.

    One row per source is ranked in one task; that table grows with the number of sources only.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("cap", PASSES * F.col("source_size").cast("double"))
    # the sources that reach their cap first come first; the rest share what these leave
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("left", SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
    ranked = ranked.withColumn("of", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    # the level at the first source whose cap is not reached
    free = F.when(F.col("left") / F.col("of") * F.col("weight") < F.col("cap"), F.col("left") / F.col("of"))
    ranked = ranked.withColumn("level", F.max_by(free, F.when(free.isNotNull(), F.col("of"))).over(every))
    return ranked.select(
        "source", "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"),
    )


def _prefix(digits: Column | int) -> Column:
    return F.substring("hash", 1, digits) if isinstance(digits, int) else F.expr("substring(hash, 1, digits)")


def thresholds(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, threshold) for saved rows (source, size, hash).

    `threshold` is a hash prefix: rows whose hash sorts below it are taken once more. The boundary
    document is taken if that comes nearer to the target.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("passes", F.floor(F.try_divide("target", "source_size")))
    plan = plan.withColumn("passes", F.coalesce("passes", F.lit(0)).cast("bigint"))
    # what is still wanted below the open prefix; done: nothing left to refine
    plan = plan.withColumn("wanted", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = saved(plan.withColumn("open", F.lit("")).withColumn("threshold", F.when(F.col("wanted") <= 0, F.lit(""))), "mix")
    for digits in range(DIGITS, HASH_DIGITS + DIGITS, DIGITS):
        if plan.where("threshold IS NULL").isEmpty():
            break
        now = plan.where("threshold IS NULL").select(F.col("source").alias("s"), "open", "wanted")
        inside = sized.join(now, sized["source"].eqNullSafe(now["s"]) & F.col("hash").startswith(F.col("open")))
        buckets = inside.groupBy("source", "wanted", _prefix(digits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        buckets = buckets.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        edge = buckets.where("upto >= wanted").groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "before", "low", "high", "wanted"), "bucket").alias("e")
        ).select(F.col("source").alias("s"), "e.*")
        single = F.col("low") == F.col("high")
        take = F.col("words") - (F.col("e_wanted") - F.col("before")) <= F.col("e_wanted") - F.col("before")
        edge = edge.withColumnRenamed("wanted", "e_wanted").select(
            "s",
            F.col("bucket").alias("e_open"),
            (F.col("e_wanted") - F.col("before")).alias("e_left"),
            F.when(single & take, F.concat("low", F.lit("~"))).when(single, F.col("low")).alias("e_threshold"),
        )
        joined = plan.join(edge, plan["source"].eqNullSafe(edge["s"]), "left")
        unmet = F.col("threshold").isNull()
        plan = saved(joined.select(
            "source", "source_size", "target", "passes",
            F.when(unmet, F.coalesce("e_left", "wanted")).otherwise(F.col("wanted")).alias("wanted"),
            F.when(unmet, F.coalesce("e_open", "open")).otherwise(F.col("open")).alias("open"),
            # rounding can leave a budget just above all words of its bucket: then all of it is below
            F.when(unmet, F.when(F.col("s").isNull(), F.concat("open", F.lit("~"))).otherwise(F.col("e_threshold")))
            .otherwise(F.col("threshold")).alias("threshold"),
        ), "mix")
    return plan.select("source", "source_size", "target", "passes", "threshold")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with columns size and hash (32 hex digits of the id)."""
    return docs.withColumns({
        "size": word_count(F.col(text_col)),
        "hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
    })


def copies() -> Column:
    """How often the mix takes a row of hashed documents joined with the thresholds."""
    return F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs` (doc_id, text, source)."""
    sized = saved(hashed(docs.select("doc_id", "text", "source")).drop("text"), "sized")
    plan = thresholds(sized).withColumnRenamed("source", "s")
    return sized.join(plan, sized["source"].eqNullSafe(plan["s"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    sized = saved(hashed(docs.select("doc_id", "text", "source")).select("source", "size", "hash"), "sized")
    plan = thresholds(sized).select(F.col("source").alias("_s"), "passes", "threshold")
    # whole rows in a struct, so that no column of theirs can clash
    rows = hashed(docs.select(F.struct("*").alias("row"), "doc_id", F.lit("").alias("text"), "source"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_s"]))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies().cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    2.0 * source_size::DOUBLE AS cap FROM sources),
levels AS (
  SELECT a.source, (1.5 * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
    / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level, a.cap / a.weight AS ratio
  FROM weighed a, weighed b GROUP BY a.source, a.cap, a.weight),
plan AS (
  SELECT source, source_size, least(cap, weight * coalesce(
    (SELECT arg_min(level, ratio) FROM levels WHERE level < ratio), 1e300)) AS target FROM weighed),
budget AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS passes,
    target - passes * source_size AS wanted FROM plan),
run AS (
  SELECT s.*, b.source_size, b.target, b.passes, b.wanted,
    sum(size) OVER (PARTITION BY s.source ORDER BY hash) AS upto
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (passes + CASE WHEN wanted <= 0 THEN 0 WHEN upto < wanted THEN 1
    WHEN upto - size < wanted AND upto - wanted <= wanted - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run"""
