"""TF-IDF features as relations: (doc, block, term, value).

Documents are shuffled once, whole, by id; counting terms then needs no further exchange
of the much larger exploded rows. Term joins are plain equality joins: a
term that occurs in every document makes one skewed partition, which AQE splits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from postloom.functions.text import clean_text, word_tokens


#: Block and term of the constant feature.
CONSTANT = ("constant", "")
#: Term tables up to this many rows (some 60 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_TERMS = 1_000_000
_LISTS = StructType().add("block", StringType()).add("terms", ArrayType(StringType())).add("tf", ArrayType(LongType()))
#: Terms in a list at most, and characters of the longest text whose n-grams are counted at once.
LISTED, LONG = 1 << 17, 1 << 21


def _clean_docs(docs: DataFrame, doc: str, text: str) -> DataFrame:
    # a fixed number of partitions: the exploded rows far outweigh the input, by whose size
    # AQE would merge partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition(parts, "doc")
    return spread.select("doc", clean_text(F.col("text")).alias("clean"))


def word_term_counts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Counts of word 1- and 2-grams per document."""
    return _exploded(term_lists(docs, doc, text, chars=False)).drop("block")


def char_term_counts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Counts of padded character 3- to 5-grams per document."""
    return _exploded(term_lists(docs, doc, text, words=False)).drop("block")


def feature_union(words: DataFrame, chars: DataFrame) -> DataFrame:
    """Both blocks in one relation; a term is identified by (block, term)."""
    return words.withColumn("block", F.lit("word")).unionByName(chars.withColumn("block", F.lit("char")))


def term_counts(docs: DataFrame, doc: str = "doc", text: str = "text", constant: bool = False) -> DataFrame:
    """Counts of both blocks (doc, block, term, tf), from one exchange of the texts.

    With `constant` every document also has the feature CONSTANT once.
    """
    return _exploded(term_lists(docs, doc, text, constant=constant))


@dataclass(frozen=True)
class TextCounts:
    """Term counts of `docs` (doc, text) that whoever learns from them makes, as rows or as packed postings."""

    docs: DataFrame

    def rows(self) -> DataFrame:
        return term_counts(self.docs)


def _exploded(lists: DataFrame) -> DataFrame:
    return lists.select("doc", "block", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf")))


def term_lists(
    docs: DataFrame, doc: str = "doc", text: str = "text", words: bool = True, chars: bool = True, constant: bool = False
) -> DataFrame:
    """(doc, block, terms, tf): the distinct terms of a document and their counts, in lists of at most LISTED.

    A document's terms are counted where it lies, one document at a time: a task keeps no table of the terms of all its
    documents, and spills none. The rows of an id that repeats are counted together.
    """
    whole = whole_docs(docs, doc, text, words, chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, size = [], 0
            for i in range(batch.num_rows):
                counts = counts_of(batch["tokens"][i].as_py(), batch["clean"][i].as_py())
                if constant:
                    counts[CONSTANT[0]] = pa.array([CONSTANT[1]]), np.array([len(batch["clean"][i])])
                for block, (terms, tf) in counts.items():
                    for start in range(0, len(tf), LISTED):
                        ready.append((i, block, terms[start : start + LISTED], tf[start : start + LISTED]))
                        size += len(ready[-1][3])
                        if size >= LISTED:
                            yield _lists(batch["doc"], ready)
                            ready, size = [], 0
            if ready:
                yield _lists(batch["doc"], ready)

    kinds = StructType([whole.schema["doc"], *_LISTS.fields])
    return whole.mapInArrow(count, kinds)


def whole_docs(docs: DataFrame, doc: str = "doc", text: str = "text", words: bool = True, chars: bool = True) -> DataFrame:
    """(doc, tokens, clean): a row for each id, with the tokens and the cleaned texts of its rows."""
    cleaned = _clean_docs(docs, doc, text)
    # tokens hold no space
    tokens = F.concat_ws(" ", word_tokens(F.col("clean")))
    parts = {"tokens": tokens if words else F.lit(""), "clean": F.col("clean") if chars else F.lit("")}
    return cleaned.select("doc", *[c.alias(n) for n, c in parts.items()]).groupBy("doc").agg(*[F.collect_list(n).alias(n) for n in parts])


def counted_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, tuple[pa.Array, np.ndarray]]]]:
    """Each id of `whole_docs` with its distinct terms and their counts, by block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["doc"][i].as_py(), counts_of(batch["tokens"][i].as_py(), batch["clean"][i].as_py())


def counts_of(tokens: list[str], clean: list[str]) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Distinct terms and their counts by block, of one document of `whole_docs`."""
    return {"word": _word_counts(tokens), "char": _gram_counts(clean)}


def _lists(docs: pa.Array, ready: list[tuple[int, str, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    at, blocks, terms, tf = zip(*ready)
    starts = pa.array(np.cumsum([0, *map(len, tf)]), pa.int32())
    lists = [pa.ListArray.from_arrays(starts, values) for values in (pa.concat_arrays(terms), pa.array(np.concatenate(tf), pa.int64()))]
    return pa.RecordBatch.from_arrays([docs.take(pa.array(at)), pa.array(blocks), *lists], ["doc", *_LISTS.names])


def _counted(terms: Counter) -> tuple[pa.Array, np.ndarray]:
    return pa.array(list(terms), pa.string()), np.array(list(terms.values()), np.int64)


def _word_counts(rows: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words and pairs of neighbours, with their counts; a pair does not span two rows."""
    counts = Counter()
    for row in rows:
        tokens = row.split(" ") if row else []
        counts.update(tokens)
        counts.update(f"{a} {b}" for a, b in pairwise(tokens))
    return _counted(counts)


def _gram_counts(rows: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Character 3- to 5-grams of the words of cleaned texts, each word padded by a space on both sides, with their counts.

    In the text they are the strings with no space inside but at the ends. Each is one number, as characters are
    numbered; texts too long or with too many characters for that are counted word by word.
    """
    # two spaces: no string spans two rows
    text = f" {'  '.join(rows)} "
    if len(text) > LONG:
        return _counted(Counter(g for row in rows for word in row.split(" ") for g in _grams(word)))
    points, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    bits = len(points).bit_length()
    if 5 * bits > 63:
        return _counted(Counter(g for row in rows for word in row.split(" ") for g in _grams(word)))
    gap, codes = points[codes] == ord(" "), codes.astype(np.int64) + 1
    grams, whole, found = (codes[:-1] << bits) | codes[1:], np.ones(len(codes) - 1, bool), []
    for n in range(3, 6):
        grams, whole = (grams[:-1] << bits) | codes[n - 1 :], whole[:-1] & ~gap[n - 2 : -1]
        found.append(grams[whole])
    grams, tf = np.unique(np.concatenate(found), return_counts=True)
    letters = [b"", *(chr(p).encode() for p in points)]
    widths = np.array([len(x) for x in letters])
    table = np.array([list(x.ljust(widths.max(), b"\0")) for x in letters], np.uint8)
    spelt = (grams[:, None] >> (bits * np.arange(4, -1, -1))) & ((1 << bits) - 1)
    data = table[spelt][np.arange(widths.max()) < widths[spelt][:, :, None]]
    ends = np.concatenate([[0], np.cumsum(widths[spelt].sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(ends), pa.py_buffer(data)), tf


def _grams(word: str) -> Iterator[str]:
    padded = f" {word} " if word else ""
    # a word no longer than n gives itself once, and no longer n is tried
    return (padded[i : i + n] for n in range(3, 6) for i in range(len(padded) - n + 1))


def doc_frequency(counts: DataFrame, n_docs: DataFrame | int, min_df: int = 2) -> DataFrame:
    """Vocabulary with document frequency and smoothed idf, per group column present.

    `n_docs` is a number or a one-row frame (column `n`).
    """
    keys = [c for c in ("block", "term") if c in counts.columns]
    terms = counts.groupBy(*keys).agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs.scalar()
    return terms.withColumn("idf", F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1)


def _weighted(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of the vocabulary's terms with `raw`, sublinear tf x idf."""
    keys = [c for c in ("block", "term") if c in counts.columns]
    return counts.join(vocabulary.select(*keys, "idf"), keys).withColumn("raw", (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf"))


def tfidf(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sublinear tf x idf, scaled to unit length per document and block."""
    groups = [c for c in ("doc", "block") if c in counts.columns]
    raw = _weighted(counts, vocabulary)
    # a window over one document: bounded by its length
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*groups)))
    return raw.select(*groups, "term", (F.col("raw") / norm).alias("value"))


def tfidf_totals(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Number of terms, largest and summed value of `tfidf` per document and block.

    The length divides the sums, so the weighted terms are only added up, where the join has them.
    """
    groups = [c for c in ("doc", "block") if c in counts.columns]
    raw = F.col("raw")
    sums = _weighted(counts, vocabulary).groupBy(*groups).agg(
        F.count("*").alias("terms"), F.max(raw).alias("largest"), F.sum(raw).alias("total"), F.sqrt(F.sum(raw * raw)).alias("_norm")
    )
    return sums.select(*groups, "terms", *[(F.col(c) / F.col("_norm")).alias(c) for c in ("largest", "total")])
