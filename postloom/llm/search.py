"""Ranked lexical search over hashed max-sketches.

Index. A document's impact for a term, (10^9 * tf) div (1000 * tf + 20 * m), does not depend on the query. Each
document folds the impacts of its terms into a sketch: WIDTH coordinates, a term belongs to the one its hash names,
and a coordinate holds the largest impact of its terms, rounded up to one of 256 levels. The index has a row per batch
of documents: their sketches, and beside them the terms and term frequencies that exact scores need.

Search. Items are taken in blocks of at most BLOCK_ITEMS items and BLOCK_TERMS terms (an item with more is a block of
its own). One map over the index counts the documents of the block's terms, which gives their weights. In a second one
the sketches of a batch times the weights by coordinate are upper bounds of all scores. Each task goes through its
documents by falling bound, scores them exactly, and stops an item at the first bound below its K-th best score so far;
its K best documents of each item go on. A window, first over slices of tasks and then over an item, leaves K.

All arithmetic is exact: integers below 2^53 in doubles where matrices are multiplied. Terms are known by 64-bit hashes.

Defined cases: a null or empty text has no terms, counts in no statistic and is never found; documents that tie are
ordered by id, null ids last; rows that repeat an id are documents of their own; items that share an id (null included)
are one item with the terms of all; an item without terms, or without a document that scores, gives no rows; empty
tables give no rows; other columns are not read. Texts of any length are handled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.store import saved, small_batches
from postloom.llm.words import chunks, released, word_hashes
from postloom.session import work_path

K = 50
BITS = 10
WIDTH = 1 << BITS
BLOCK_ITEMS, BLOCK_TERMS = 256, 8192
#: Numbers of a matrix of impacts that is scored at once, and documents of the first wave.
CELLS, WAVE = 4_000_000, 64
#: Slices of tasks whose best documents are reduced before those of an item meet.
SLICES = 32
#: Characters of the documents of a row of the index (some three bytes each there), rows of a file of it, and rows that Spark
#: hands to Python at once: a reader holds a file's rows and such a batch, whatever the size of the input's row groups.
ROW_CHARS, FILE_ROWS, HANDED_ROWS = 1_000_000, 16, 8

#: A term has digits, letters, or characters beyond ASCII.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

LEVELS = np.unique(np.ceil(np.geomspace(1, 1_000_000, 255)).astype(np.int64))
LEVELS = np.concatenate([[0], LEVELS])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 * n * N) div L), for any size of N."""
    sizes, back = np.unique(n, return_inverse=True)
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in sizes], np.int64)[back]


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def coordinate(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITS)).astype(np.int64)


def fold(coordinates: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
    """Sketches (documents by WIDTH) of levels, from the impacts of the terms of each document."""
    sketch = np.zeros(n_docs * WIDTH, np.uint8)
    np.maximum.at(sketch, docs * WIDTH + coordinates, np.searchsorted(LEVELS, impacts).astype(np.uint8))
    return sketch.reshape(n_docs, WIDTH)


def _count(batches):
    """Documents with a term, and terms, of each batch."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        n = np.concatenate([np.zeros(0, np.int64), *(word_hashes(texts[a:b], GAP)[1] for a, b in chunks(texts))])
        yield pd.DataFrame({"docs": [int((n > 0).sum())], "terms": [int(n.sum())]})


INDEXED = "chunk long, ids array<long>, bare array<boolean>, norms array<long>, sizes array<int>, terms binary, places binary, times binary, sketch binary"


def _index(n_docs: int, n_terms: int):
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for pdf in batches:
            texts, ids, bare = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64), pdf["bare"].to_numpy(bool)
            for start, stop in chunks(texts, ROW_CHARS):
                words, n = word_hashes(texts[start:stop], GAP)
                terms, place = np.unique(words, return_inverse=True)
                doc = np.repeat(np.arange(len(n)), n)
                pairs, times = np.unique(doc * max(1, len(terms)) + place, return_counts=True)
                doc, place = np.divmod(pairs, max(1, len(terms)))
                norms = length_norm(n, n_docs, n_terms)
                sketch = fold(coordinate(terms)[place], doc, impact(times, norms[doc]), len(n))
                yield pd.DataFrame({
                    "chunk": [chunk], "ids": [ids[start:stop]], "bare": [bare[start:stop]], "norms": [norms], "sizes": [np.bincount(doc, minlength=len(n)).astype(np.int32)],
                    "terms": [terms.tobytes()], "places": [place.astype(np.uint32).tobytes()], "times": [times.astype(np.uint32).tobytes()],
                    "sketch": [sketch.tobytes()],
                })
                chunk += 1

    return run


class SketchIndex:
    """The written index of all rows of a table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        small_batches(docs.sparkSession)
        doc_id = F.col(id_col).cast("bigint")
        rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("bare"), F.col(text_col).alias("text"))
        totals = rows.select("text").mapInPandas(released(_count), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        self.n_docs, self.n_terms = totals[0] or 0, totals[1] or 0
        found = rows.mapInPandas(released(_index(self.n_docs, max(1, self.n_terms))), INDEXED)
        self.rows = saved(found, "sketches", FILE_ROWS)


class Block:
    """Some items: their terms, and which item has which."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.names = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([t for _, t in items]))
        self.of = [np.searchsorted(self.terms, t) for _, t in items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """The place of each of a batch's terms in the block, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def by_coordinate(self) -> np.ndarray:
        out, where = np.zeros((WIDTH, len(self.of))), coordinate(self.terms)
        for q, own in enumerate(self.of):
            np.add.at(out[:, q], where[own], self.weights[own])
        return out


def _frequencies(block: Block):
    """Documents of one task that hold each of the block's terms."""

    def run(batches):
        total = np.zeros(len(block.terms), np.int64)
        for pdf in batches:
            for row in pdf.itertuples():
                terms = np.frombuffer(row.terms, np.uint64)
                df, column = np.bincount(np.frombuffer(row.places, np.uint32), minlength=len(terms)), block.columns(terms)
                total[column[column >= 0]] += df[column >= 0]
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held, "df": total[held]})

    return run


class Best:
    """The best documents of one item so far: by score, then by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.bare, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score at least."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, bare: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, bare, ids = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.bare, bare), (self.ids, ids)))
            keep = np.lexsort((ids, bare, -scores))[: self.k]
            self.scores, self.bare, self.ids = scores[keep], bare[keep], ids[keep]


def rank_batch(row, block: Block, by_coordinate: np.ndarray, best: list[Best]) -> int:
    """Offer the documents of one row of the index to every item; returns how many scores were computed."""
    n, scored = len(row.norms), 0
    ids, bare = np.asarray(row.ids, np.int64), np.asarray(row.bare, bool)
    sketch = np.frombuffer(row.sketch, np.uint8).reshape(n, WIDTH)
    column = block.columns(np.frombuffer(row.terms, np.uint64))[np.frombuffer(row.places, np.uint32)]
    doc = np.repeat(np.arange(n), row.sizes)
    known = np.flatnonzero(column >= 0)
    column, doc = column[known], doc[known]
    impacts = impact(np.frombuffer(row.times, np.uint32)[known].astype(np.int64), np.asarray(row.norms, np.int64)[doc])
    here, column = np.unique(column, return_inverse=True)
    place = np.full(len(block.terms), -1)
    place[here] = np.arange(len(here))
    at_once = max(1, min(n, CELLS // max(WIDTH, len(here))))
    for lo in range(0, n, at_once):
        hi = min(n, lo + at_once)
        bounds = LEVELS[sketch[lo:hi]].astype(np.float64) @ by_coordinate
        part = slice(*np.searchsorted(doc, [lo, hi]))
        exact = np.zeros((hi - lo, len(here)))
        exact[doc[part] - lo, column[part]] = impacts[part]
        for q, top in enumerate(best):
            left = np.flatnonzero(bounds[:, q] >= top.least)
            if not len(left):
                continue
            own = block.of[q][place[block.of[q]] >= 0]
            if not len(own):
                continue
            columns, weights = place[own], block.weights[own].astype(np.float64)
            left, wave = left[np.argsort(-bounds[left, q], kind="stable")], WAVE
            while len(left):
                now, left = left[:wave], left[wave:]
                top.offer((exact[now[:, None], columns] @ weights).astype(np.int64), bare[lo + now], ids[lo + now])
                scored += len(now)
                left = left[: int(np.searchsorted(-bounds[left, q], -top.least, side="right"))]
                wave *= 2
    return scored


FOUND = "item int, doc_id long, score long"


def _rank(block: Block, k: int):
    def run(batches):
        best, by_coordinate = [Best(k) for _ in block.of], block.by_coordinate()
        for pdf in batches:
            for row in pdf.itertuples():
                rank_batch(row, block, by_coordinate, best)
        for q, top in enumerate(best):
            doc_ids = pd.array(top.ids, "Int64")
            doc_ids[top.bare] = pd.NA
            yield pd.DataFrame({"item": np.full(len(top.ids), q, np.int32), "doc_id": doc_ids, "score": top.scores})

    return run


def _items(batches):
    """The distinct terms of each item's text."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        words, n = word_hashes(texts, GAP)
        stops = np.cumsum(n)
        terms = [np.unique(words[b - c:b]).view(np.int64) for b, c in zip(stops.tolist(), n.tolist())]
        yield pd.DataFrame({"item_id": pdf["item_id"], "terms": terms})


def _blocks(items: DataFrame):
    """Blocks of items, streamed through the driver one block at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        terms = np.array(row.terms, np.int64).view(np.uint64)
        if held and (len(held) == BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield Block(held)
            held, size = [], 0
        held.append((row.item_id, terms))
        size += len(terms)
    if held:
        yield Block(held)


RANKED = "item_id long, rank int, doc_id long, score long"


def search(index: SketchIndex, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every item with a score above 0: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    terms = rows.mapInPandas(_items, "item_id long, terms array<long>")
    terms = terms.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    path, order = work_path(spark, "ranked"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spark.createDataFrame([], RANKED).write.parquet(path)
    blocks = saved(terms, "items")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HANDED_ROWS))  # rows of the index are large
    try:
        for block in _blocks(blocks):
            counted = index.rows.select("terms", "places").mapInPandas(_frequencies(block), "term int, df long")
            df = np.zeros(len(block.terms), np.int64)
            for term, n in counted.groupBy("term").agg(F.sum("df")).toLocalIterator():  # a row for each of the block's terms
                df[term] = n
            block.weights = weight(index.n_docs, df)
            found = index.rows.mapInPandas(_rank(block, k), FOUND).withColumn("slice", F.spark_partition_id() % SLICES)
            for group in (["item", "slice"], ["item"]):
                found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(enumerate(block.names)), "item int, item_id long")
            found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    finally:
        small_batches(spark)
    return spark.read.schema(RANKED).parquet(path)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = SketchIndex(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
totals AS MATERIALIZED (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms)) AS l FROM d),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
m AS MATERIALIZED (SELECT r, doc_id, 50 + CAST((50 * len(terms) * n) // l AS BIGINT) AS m FROM d, totals WHERE len(terms) > 0),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark)),
s AS (
  SELECT q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN m ON m.r = tf.r GROUP BY q.item_id, m.r, m.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) <= 50"""
