"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.store import forget, saved


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (big, small), big > small."""
    low = edges.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
    # the lowest neighbour of a node is below it unless all its neighbours are above it
    large = edges.join(low, edges["small"] == low["node"], "left").select(
        "big", F.coalesce("low", "small").alias("small")
    ).distinct()
    low = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
    both = large.join(low, large["big"] == low["node"]).select("big", "small", "low")
    pairs = F.array(F.struct("big", F.col("low").alias("small")), F.struct(F.col("small").alias("big"), F.col("low").alias("small")))
    return both.select(F.inline(pairs)).where("big <> small").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (a long, b long).

    Self-edges and repeated edges do not matter; nodes without an edge to another node get no row.
    Each round is written to the shared folder; hubs are aggregated before the shuffle, and a hub's
    edges are only ever joined with one row, a skewed join that AQE splits. No edge list is collected.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(),
        "edges",
    )
    seen = last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        # equal marks may be chance: the edges themselves must be those of the round before
        if mark[0] == 0 or (mark == seen and now.join(last, ["big", "small"], "left_anti").isEmpty()):
            return now.select(F.col("big").alias("node"), F.col("small").alias("component")).union(
                now.select("small", "small").distinct()
            )
        if last is not None:
            forget(last)
        seen, last = mark, now
        now = saved(_stars(last), "edges")
