"""Embedding near-duplicates by lattice hashing.

A vector's direction is projected at random to two times eight dimensions per table and each eight are decoded
to the nearest point of the E8 lattice; the two points are the vector's cell. Every vector is filed
under its own cell and also asks at the PROBES neighbouring cells nearest to it. Pairs that meet are
verified by cosine in double precision.

Groups are not expanded: within a cell the vectors are first tried against one pivot. Vectors within half
the linking angle of a pivot form a ball, and by the triangle inequality any two of a ball link. Only
different balls are then compared, balls whose centres are too far apart for any link are dropped, and
members are paired only across the balls that remain.

Recall: a pair at cosine 0.9 meets with probability about 0.94, one at 0.98 practically always; a test
measures it against all pairs. All rows are indexed, nothing is sampled.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
vectors of unlike lengths do not link; equal vectors are one class from the start; rows with a null id
link with nothing and get a null component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.graph import components
from postloom.llm.store import saved, small_batches
from postloom.llm.words import mix

LINK = 0.9
TABLES, PROBES, SCALE = 12, 16, 1.5
#: Neighbours of each half of a cell that are considered for probing.
NEAR = 6
SEED = 8
BLOCKS, DIM = 2, 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a lattice point to its neighbours."""
    found = []
    for i, j in itertools.combinations(range(DIM), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(DIM)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=DIM) if s.count(-0.5) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(x)
    gap = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    f[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even integer points and those shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, DIM + 1, dtype=np.uint64) + np.uint64(salt * 1000))
        return mix((np.rint(points * 2).astype(np.int64).view(np.uint64) * weights).sum(axis=-1))


def cells(units: np.ndarray) -> np.ndarray:
    """Cell keys, shape (rows, TABLES, 1 + PROBES): the own cell first, then the neighbours by distance."""
    rows, dim = units.shape
    rng = np.random.Generator(np.random.PCG64(SEED + dim))
    out = np.empty((rows, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        keys, far = [], []
        for block in range(BLOCKS):
            x = units @ rng.standard_normal((dim, DIM)) / SCALE
            centre = decode_e8(x)
            d = (ROOTS ** 2).sum(axis=1) - 2 * (x - centre) @ ROOTS.T
            order = np.argsort(d, axis=1, kind="stable")[:, :NEAR]
            points = np.concatenate([centre[:, None], centre[:, None] + ROOTS[order]], axis=1)
            keys.append(_hashed(points, 2 * t + block + 1))
            far.append(np.concatenate([np.zeros((rows, 1)), np.take_along_axis(d, order, axis=1)], axis=1))
        both = mix(keys[0][:, :, None] + mix(keys[1])[:, None, :]).reshape(rows, -1)
        total = (far[0][:, :, None] + far[1][:, None, :]).reshape(rows, -1)
        total[:, 0] = -np.inf  # the own cell leads, whatever rounding says
        best = np.argsort(total, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t] = np.take_along_axis(both, best, axis=1)
    return out


def _units(batches):
    for pdf in batches:
        nodes, units = [], []
        for v in pdf["embedding"]:
            x = np.array([], float) if v is None else np.array([np.nan if e is None else e for e in v], np.float64)
            norm = np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max() if len(x) and np.isfinite(x).all() and x.any() else 0.0
            if norm > 0 and np.isfinite(norm):
                x = x / norm + 0.0
                nodes.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                units.append(x)
            else:
                nodes.append(None)
                units.append(None)
        yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "node": pd.array(nodes, "Int64"), "unit": units})


def _encode(batches):
    for pdf in batches:
        lengths = pdf["unit"].map(len)
        for _, part in pdf.groupby(lengths):
            keys = cells(np.stack(part["unit"].to_numpy()))
            n, each = len(part), 1 + PROBES
            home = np.zeros((n, TABLES, each), bool)
            home[:, :, 0] = True
            yield pd.DataFrame({
                "key": keys.reshape(-1).view(np.int64), "node": np.repeat(part["node"].to_numpy(np.int64), TABLES * each), "home": home.reshape(-1),
            })


def _cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _ended(pairs: DataFrame, a: str, b: str, ends: DataFrame, key: str) -> DataFrame:
    """Pairs with the columns of `ends` for either side, suffixed _a and _b."""
    for side, name in ((a, "a"), (b, "b")):
        pairs = pairs.join(ends.select(*[F.col(c).alias(side if c == key else f"{c}_{name}") for c in ends.columns]), side)
    return pairs.where(F.size("unit_a") == F.size("unit_b")).withColumn("cosine", _cosine("unit_a", "unit_b"))


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of `rows`: vec_id, n_links, component_id, kept."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    found = saved(rows.mapInPandas(_units, "vec_id long, node long, unit array<double>"), "units")
    nodes = saved(found.where("node IS NOT NULL AND vec_id IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("size"), F.any_value("unit").alias("unit")), "nodes")
    codes = saved(nodes.select("node", "unit").mapInPandas(_encode, "key long, node long, home boolean"), "cells")
    home = codes.where("home").select("key", "node")
    angle, half = float(np.arccos(LINK)), float(np.arccos(LINK)) / 2
    vectors = nodes.select("node", "unit")

    pivots = home.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    star = home.join(pivots, "key").where("node <> pivot").select("node", "pivot").distinct()
    star = _ended(star, "node", "pivot", vectors, "node").where(F.col("cosine") >= float(np.cos(half)) + 1e-6)
    ball = star.groupBy("node").agg(F.min(F.struct("pivot", "cosine")).alias("to"))
    members = nodes.select("node", "low", "size").join(ball, "node", "left").select(
        "node", "low", "size", F.coalesce("to.pivot", "node").alias("ball"),
        F.coalesce(F.acos(F.least("to.cosine", F.lit(1.0))), F.lit(0.0)).alias("reach"),
    )
    members = saved(members, "members")
    balls = members.groupBy("ball").agg(F.sum("size").alias("total"), F.max("reach").alias("radius"))
    balls = saved(balls, "balls")

    filed = codes.join(members.select("node", "ball"), "node").select("key", "home", "ball").distinct()
    a = filed.where("home").select("key", F.col("ball").alias("ba"))
    b = filed.select("key", F.col("ball").alias("bb"))
    met = a.join(b, "key").where("ba <> bb").select(F.least("ba", "bb").alias("ba"), F.greatest("ba", "bb").alias("bb")).distinct()
    centres = balls.join(vectors.withColumnRenamed("node", "ball"), "ball").select("ball", "radius", "unit")
    met = _ended(met, "ba", "bb", centres, "ball")
    apart = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    met = met.where(apart <= angle + F.col("radius_a") + F.col("radius_b") + 1e-6).select("ba", "bb")
    pairs = met.join(members.select(F.col("ball").alias("ba"), F.col("node").alias("a")), "ba")
    pairs = pairs.join(members.select(F.col("ball").alias("bb"), F.col("node").alias("b")), "bb").select("a", "b")
    ends = nodes.select("node", "size", "unit")
    across = saved(_ended(pairs, "a", "b", ends, "node").where(F.col("cosine") >= LINK).select("a", "b", "size_a", "size_b"), "links")

    other = across.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("size_b").alias("n")), F.struct(F.col("b").alias("node"), F.col("size_a").alias("n")))))
    other = other.groupBy("node").agg(F.sum("n").alias("outside"))
    edges = across.select("a", "b").union(members.select("node", "ball"))
    labels = saved(components(edges), "components")
    linked = members.join(balls, "ball").join(other, "node", "left").join(labels, "node", "left").select(
        "node", "low", F.coalesce("component", "node").alias("component"),
        (F.col("total") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"),
    )
    linked = saved(linked, "linked")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "component").select("node", "n_links", "component_id")
    # a viral vector makes one side skewed; the other has one row per distinct vector
    named = F.col("vec_id").isNotNull()
    out = found.join(linked, "node", "left").select(
        "vec_id",
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        F.when(named, F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links,
  min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id"""
