"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its letter n-grams (two and three letters, words
separated by one space), hashed to FEATURES buckets. Every language has a few centroids, found by
clustering its vectors on the sphere; a text gets the language of the centroid with the largest cosine.
A text that lies farther from that centroid than nearly all texts it was made of is rejected.

Document frequencies cover all training rows. Centroids are fitted on about SAMPLE rows of each language,
chosen by a hash of the id; each language is clustered in a task of its own.

Defined cases: a null or empty text, or one without a letter, is `und` with score 0 and rejected; rows
with a null language or id are not learned from, but predicted; repeated rows get equal predictions;
ties go to the language that sorts first; without any training row every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import saved, small_batches
from postloom.llm.words import chunks, mix, release, released

FEATURES = 4096
#: Bound of the labelled rows that centroids are fitted on, for each language.
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 8
#: Characters that are counted at once.
CHUNK = 1_000_000
#: A text is rejected below this share of the cosine that all but QUANTILE of a centroid's texts reach;
#: texts of few distinct n-grams lie farther from any centroid, so their limit shrinks (half the square at FEW).
MARGIN, QUANTILE, FEW = 0.5, 0.005, 200
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text; a row of zeros if the text has no letter."""
    parts = [(t or "").lower() for t in texts]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    codes = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    row = np.repeat(np.arange(len(parts)), lengths)[keep]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    with np.errstate(over="ignore"):
        weighted = [codes * p for p in _P]
        two = weighted[0][:-1] + weighted[1][1:]
        three = two[:-1] + weighted[2][2:]
    found = []
    for grams, n in ((two, 2), (three, 3)):
        if len(grams):
            same = row[: len(grams)] == row[n - 1:]
            found.append((row[: len(grams)] * FEATURES + (mix(grams + np.uint64(n)) % np.uint64(FEATURES)).astype(np.int64))[same])
    if not found:
        return np.zeros((len(parts), FEATURES), np.float32)
    counts = np.bincount(np.concatenate(found), minlength=len(parts) * FEATURES)
    return counts.reshape(len(parts), FEATURES).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _frequencies(batches):
    total, rows = np.zeros(FEATURES, np.int64), 0
    for pdf in batches:
        texts = pdf["text"].tolist()
        for start, stop in chunks(texts, CHUNK):
            counts = gram_counts(texts[start:stop])
            total += (counts > 0).sum(axis=0)
            rows += stop - start
    used = np.flatnonzero(total)
    yield pd.DataFrame({"feature": np.append(used, -1), "docs": np.append(total[used], rows)})


def _vectorise(idf):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, stop in chunks(texts, CHUNK):
                x = vectors(gram_counts(texts[start:stop]), idf)
                part = pdf.iloc[start:stop]
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "key": part["key"].to_numpy(), "vector": list(x)})

    return run


def cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: (centroids, index of each row's centroid)."""
    centres = [x.sum(axis=0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(CENTROIDS, len(x)):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                total = x[near == k].sum(axis=0)
                c[k] = total / max(np.linalg.norm(total), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def _centroids(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", kind="stable")
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return pd.DataFrame(columns=["lang", "centroid", "radius"])
    c, near = cluster(x)
    close = np.einsum("ij,ij->i", x, c[near])
    keep = np.unique(near)
    radius = [MARGIN * float(np.quantile(close[near == k], QUANTILE)) for k in keep]
    return pd.DataFrame({"lang": pdf["lang"].iat[0], "centroid": list(c[keep]), "radius": radius})


class Centroids:
    """A fitted classifier: languages × CENTROIDS vectors of FEATURES numbers, so its size is bounded."""

    def __init__(self, langs: list[str], centres: np.ndarray, radius: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.radius, self.idf = langs, centres, radius, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        counts = gram_counts(texts)
        blank = counts.sum(axis=1) == 0
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        close = vectors(counts, self.idf) @ self.centres.T
        best = close.argmax(axis=1)
        cosine = np.clip(close[np.arange(len(best)), best].astype(np.float64), 0, 1)
        grams = (counts > 0).sum(axis=1)
        rejected = blank | (cosine < self.radius[best] * np.sqrt(grams / (grams + FEW)))
        langs = [UNKNOWN if b else self.langs[k] for b, k in zip(blank, best)]
        return langs, np.where(blank, 0.0, cosine), rejected


def learn(rows: DataFrame) -> Centroids:
    """Fit on labelled rows (doc_id, text, lang)."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    table = rows.select("text").mapInPandas(released(_frequencies), "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
    counts = {r[0]: r[1] for r in table.collect()}  # at most FEATURES + 1 rows
    idf = np.full(FEATURES, np.log(1.0 + counts.get(-1, 0)), np.float32) + 1
    for feature, docs in counts.items():
        if feature >= 0:
            idf[feature] = np.log((1.0 + counts[-1]) / (1.0 + docs)) + 1
    per_lang = rows.groupBy("lang").count().select("lang", (F.lit(SAMPLE) / F.col("count")).alias("share"))
    chance = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(F.broadcast(per_lang), "lang").where(chance < F.col("share"))  # one row per language
    sample = sample.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = sample.mapInPandas(released(_vectorise(idf)), "lang string, key long, vector array<float>")
    found = found.groupBy("lang").applyInPandas(_centroids, "lang string, centroid array<float>, radius double")
    found = sorted(found.collect(), key=lambda r: (r[0], -r[2]))
    centres = np.array([r[1] for r in found], np.float32).reshape(len(found), FEATURES)
    return Centroids([r[0] for r in found], centres, np.array([r[2] for r in found]), idf)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """`docs` (doc_id, text) with lang_pred, score, rejected instead of the text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, stop in chunks(texts, CHUNK):
                lang, score, rejected = model.predict(texts[start:stop])
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[start:stop].astype("Int64").to_numpy(), "lang_pred": lang, "score": score, "rejected": rejected,
                })

    return docs.select("doc_id", "text").mapInPandas(released(run), "doc_id long, lang_pred string, score double, rejected boolean")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(remainder(4) != 2))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; learned from the labelled rows of `docs`.

    The classifier runs as a filter on the text column, so that no join is needed.
    """
    model = learn(docs.select("doc_id", "text", "lang"))

    def kept(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        found = [~model.predict(texts[start:stop])[2] for start, stop in chunks(texts, CHUNK)]
        release()
        return pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(F.pandas_udf(kept, "boolean")(F.col("text")))
