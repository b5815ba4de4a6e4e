"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if a string of WINDOW bytes that covers it starts anywhere else too. Such strings are suffixes
that tie for WINDOW bytes, found as in blockwise suffix-array construction:

1. Cover sample. COVER is a perfect difference set modulo PERIOD: for any two places of any texts there is an
   offset below PERIOD that puts both on the sample. Two suffixes that tie for WINDOW bytes so have, at the same
   offset, two sample suffixes that tie for SAMPLE_DEPTH = WINDOW - PERIOD + 1 bytes. One sixteenth of all places
   are sample places; they are sorted by hash range, one bucket at a time, and those that tie are told so.
2. Suffix buckets. Only a suffix with a tied sample place within PERIOD bytes can tie for long. These are dealt to
   buckets by the fingerprint of their WINDOW bytes; each bucket is sorted alone, and neighbours that are equal tie.

Sorting order is that of fingerprints, not of the alphabet: ties are what is wanted, not ranks. A whole suffix array
would move every place of the corpus; so about a sixth of them moves. Fingerprints of suffixes have 80 bits; those of
samples have fewer, as a chance tie of samples only lets more suffixes through.

Texts lie in parts of about PART_BYTES, written once to a table bucketed by part, so that the replies of the buckets
go to the texts and the texts do not move. A part sends each fingerprint once, however often it has it, so a string
that is everywhere counts once a part. Equal texts are one text there; of equal texts with WINDOW bytes all bytes go.

Defined cases: a null text is empty; texts shorter than WINDOW lose nothing; rows that repeat (equal or no id
included) are copies of each other and so lose everything from WINDOW bytes on; an empty table gives no rows; other
columns are not read, whatever their names. A text of any length is handled, hashed SEGMENT bytes at a time.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import partitions, saved, small_batches, with_ids
from postloom.llm.words import mix, released, released_group
from postloom.session import work_path

WINDOW = 400
#: A perfect difference set, every residue but 0 is one difference of two of its numbers.
PERIOD = 273
COVER = [0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255]
SAMPLE_DEPTH = WINDOW - PERIOD + 1
PART_BYTES = 16_000_000
SEGMENT = 1_000_000

_RANDOM = np.random.Generator(np.random.PCG64(4111))
_BYTES = _RANDOM.integers(1, 2**64, (2, 256), dtype=np.uint64)
_STEPS = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if which not in _POWERS:
        found = []
        for step in (_STEPS[which], pow(_STEPS[which], -1, 1 << 64)):
            steps = np.full(SEGMENT + WINDOW + 1, step, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _POWERS[which] = tuple(found)
    return _POWERS[which]


def fingerprints(body: np.ndarray, at: np.ndarray, depth: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the `depth` bytes that start at each of the ascending places `at`."""
    up, down = _powers(which)
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(body) + SEGMENT, SEGMENT))
    total = np.zeros(SEGMENT + WINDOW + 1, np.uint64)
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if lo == hi:
            continue
        start = k * SEGMENT
        raw = body[start:start + SEGMENT + WINDOW]
        np.cumsum(_BYTES[which][raw] * up[: len(raw)], out=total[1:len(raw) + 1])
        inside = at[lo:hi] - start
        out[lo:hi] = (total[inside + depth] - total[inside]) * down[inside]
    return mix(out)


class Part:
    """The texts of one part, one after another."""

    def __init__(self, body: bytes, sizes: np.ndarray):
        self.body, self.sizes = np.frombuffer(body, np.uint8), np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def _left(self) -> np.ndarray:
        """Whether WINDOW bytes of the text are left at each place."""
        change = np.zeros(len(self.body) + 1, np.int8)
        change[self.starts] += 1
        change[self.ends - WINDOW + 1] -= 1
        return np.cumsum(change[:-1], dtype=np.int8) > 0

    def samples(self) -> np.ndarray:
        """Places of the cover sample; a place counts from the start of its text."""
        parts = []
        for start, size in zip(self.starts.tolist(), self.sizes.tolist()):
            last = size - SAMPLE_DEPTH
            grid = (np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
            parts.append(start + grid[grid <= last])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def suffixes(self, tied: np.ndarray) -> np.ndarray:
        """Places with WINDOW bytes ahead and one of the sample places `tied` within PERIOD bytes."""
        change = np.zeros(len(self.body) + 1, np.int32)
        np.add.at(change, np.maximum(tied - PERIOD + 1, 0), 1)
        np.add.at(change, tied + 1, -1)
        return np.flatnonzero((np.cumsum(change[:-1]) > 0) & self._left())


class Asked:
    """Distinct fingerprints of a part in ascending order, and how its places map to them."""

    def __init__(self, lead: np.ndarray, more: np.ndarray | None = None):
        self.order = np.argsort(lead, kind="stable") if more is None else np.lexsort((more, lead))
        ordered = lead[self.order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if more is not None:
            also = more[self.order]
            new[1:] |= also[1:] != also[:-1]
            self.more = also[new]
        self.lead = ordered[new]
        self.place = np.cumsum(new) - 1
        self.multiple = np.bincount(self.place, minlength=len(self.lead)) > 1 if len(new) else np.zeros(0, bool)

    def cuts(self, buckets: int) -> np.ndarray:
        top = ((self.lead >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))

    def answered(self, replies: pd.DataFrame) -> np.ndarray:
        """Which of the places that were asked for tie, in their order."""
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(replies["bits"], replies["n"])]
        tied = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool) | self.multiple
        out = np.zeros(len(self.order), bool)
        out[self.order] = tied[self.place]
        return out


PARTS = "part long, sizes array<long>, body binary"


def _parts(batches):
    """Texts joined to parts; each task numbers its own."""
    part, held, size = TaskContext.get().partitionId() << 24, [], 0
    for pdf in batches:
        for body in pdf["body"]:
            if held and size + len(body) > PART_BYTES:
                yield pd.DataFrame({"part": [part], "sizes": [[len(b) for b in held]], "body": [b"".join(held)]})
                part, held, size = part + 1, [], 0
            held.append(body)
            size += len(body)
    if held:
        yield pd.DataFrame({"part": [part], "sizes": [[len(b) for b in held]], "body": [b"".join(held)]})


ASKED = "part long, bucket int, n int, lead binary, more binary"


def _ask(part: int, asked: Asked, buckets: int) -> pd.DataFrame:
    """What a part asks of each bucket; fingerprints as planes of bytes, which compress as they are sorted."""
    cuts = asked.cuts(buckets)
    full = np.flatnonzero(np.diff(cuts)).tolist()
    pieces = [slice(cuts[b], cuts[b + 1]) for b in full]

    def planes(x):
        return np.ascontiguousarray(x[:, None].view(np.uint8).T).tobytes()

    if hasattr(asked, "more"):
        lead, more = [planes(asked.lead[p]) for p in pieces], [asked.more[p].tobytes() for p in pieces]
    else:
        # what the bucket's number leaves open of the first half: 32 bits tell samples of one bucket apart
        lead, more = [planes((asked.lead[p] >> np.uint64(8)).astype(np.uint32)) for p in pieces], None
    return pd.DataFrame({"part": part, "bucket": full, "n": [p.stop - p.start for p in pieces], "lead": lead, "more": more})


def _ask_samples(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            part = Part(row.body, row.sizes)
            out.append(_ask(row.part, Asked(fingerprints(part.body, part.samples(), SAMPLE_DEPTH)), buckets))
        return pd.concat(out)

    return run


REPLIES = "part long, kind int, bucket int, n int, bits binary"


def _sort_bucket(kind: int):
    """Sorts one bucket and tells each part which of its fingerprints another part has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["n"].to_numpy(np.int64)
        width = 8 if kind else 4
        lead = np.concatenate([
            np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel() for b, n in zip(pdf["lead"], sizes)
        ])
        more = np.frombuffer(b"".join(pdf["more"]), np.uint16) if kind else None
        order = np.lexsort((more, lead)) if kind else np.argsort(lead, kind="stable")
        ordered = lead[order]
        same = ordered[1:] == ordered[:-1]
        if kind:
            also = more[order]
            same &= also[1:] == also[:-1]
        ties = np.zeros(len(order), bool)
        ties[1:] |= same
        ties[:-1] |= same
        tied = np.empty(len(order), bool)
        tied[order] = ties
        stops = np.cumsum(sizes)
        bits = [np.packbits(tied[b - n:b]).tobytes() for b, n in zip(stops.tolist(), sizes.tolist())]
        return pd.DataFrame({"part": pdf["part"], "kind": kind, "bucket": pdf["bucket"], "n": pdf["n"], "bits": bits})

    return run


def _of(replies: pd.DataFrame, part: int, kind: int) -> pd.DataFrame:
    return replies[(replies["part"] == part) & (replies["kind"] == kind)].sort_values("bucket")


def _long_suffixes(row, replies: pd.DataFrame) -> tuple[Part, np.ndarray, Asked]:
    part = Part(row.body, row.sizes)
    samples = part.samples()
    asked = Asked(fingerprints(part.body, samples, SAMPLE_DEPTH))
    at = part.suffixes(samples[asked.answered(_of(replies, row.part, 0))])
    more = (fingerprints(part.body, at, WINDOW, 1) >> np.uint64(48)).astype(np.uint16)
    return part, at, Asked(fingerprints(part.body, at, WINDOW), more)


def _ask_suffixes(buckets: int):
    def run(parts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in ASKED.split(", ")})]
        for row in parts.itertuples():
            out.append(_ask(row.part, _long_suffixes(row, replies)[2], buckets))
        return pd.concat(out)

    return run


REMOVED = "digest binary, n_removed long, n_spans long, kept_sha256 string"


def _remove(parts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The texts of a part that lose bytes."""
    out = []
    for row in parts.itertuples():
        part, at, asked = _long_suffixes(row, replies)
        starts = at[asked.answered(_of(replies, row.part, 1))]
        change = np.zeros(len(part.body) + 1, np.int32)
        change[starts] += 1
        change[starts + WINDOW] -= 1
        gone = np.cumsum(change[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[part.starts] = gone[part.starts]
        lost, spans = (np.add.reduceat(x.astype(np.int64), part.starts) for x in (gone, first))
        for i in np.flatnonzero(lost).tolist():
            text = slice(part.starts[i], part.ends[i])
            whole = part.body[text]
            kept = hashlib.sha256(whole[~gone[text]].tobytes()).hexdigest()
            out.append((hashlib.sha256(whole.tobytes()).digest(), int(lost[i]), int(spans[i]), kept))
    return pd.DataFrame(out, columns=[c.split()[0] for c in REMOVED.split(", ")])


def _by_part(texts: DataFrame, name: str) -> DataFrame:
    """Parts of `texts` (body), in a table bucketed by part: joins by part do not move them."""
    spark = texts.sparkSession
    buckets = partitions(spark)
    parts = texts.mapInPandas(released(_parts), PARTS)
    (
        parts.write.format("parquet").option("compression", "zstd").option("path", work_path(spark, "parts"))
        .bucketBy(buckets, "part").sortBy("part").saveAsTable(name)
    )
    return spark.table(name)


def repeated_passages(texts: DataFrame) -> DataFrame:
    """One row for each of the texts (a column body, binary, WINDOW bytes at least) that loses bytes, as REMOVED."""
    spark = texts.sparkSession
    small_batches(spark)
    buckets = 2 * partitions(spark)
    name = f"parts_{uuid.uuid4().hex}"
    parts = _by_part(texts, name)
    samples = parts.groupBy("part").applyInPandas(released_group(_ask_samples(buckets)), ASKED)
    tied = saved(samples.groupBy("bucket").applyInPandas(released_group(_sort_bucket(0)), REPLIES), "tied-samples")
    suffixes = parts.groupBy("part").cogroup(tied.groupBy("part")).applyInPandas(released_group(_ask_suffixes(buckets)), ASKED)
    equal = saved(suffixes.groupBy("bucket").applyInPandas(released_group(_sort_bucket(1)), REPLIES), "tied-suffixes")
    replies = tied.union(equal)
    removed = parts.groupBy("part").cogroup(replies.groupBy("part")).applyInPandas(released_group(_remove), REMOVED)
    removed = saved(removed, "removed")
    spark.sql(f"DROP TABLE {name}")
    return removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), body.alias("body"))
    rows = saved(docs.select("doc_id", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").cast("bigint").alias("n_bytes")), "digests")
    groups = saved(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes")), "copies")
    # one row of equal texts is enough; rows without an id all go on, as copies that are copies anyway
    first = saved(groups.where(f"n_bytes >= {WINDOW} AND doc_id IS NOT NULL").select("doc_id").distinct(), "first")
    long = docs.where(F.octet_length("body") >= WINDOW)
    removed = repeated_passages(with_ids(long, first, "doc_id").union(long.where("doc_id IS NULL")).select("body"))
    found = removed.groupBy("digest").agg(F.max(F.struct("n_removed", "n_spans", "kept_sha256")).alias("r"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    decided = groups.drop("doc_id", "n_bytes").join(found, "digest", "left")
    return rows.join(decided, "digest").select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("r.n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("r.n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("r.kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH h AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS MATERIALIZED (SELECT r, doc_id, h, len(h) // 2 AS n FROM h),
w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(n - 399)) AS i FROM n WHERE n >= 400)),
e AS MATERIALIZED (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, TRUE) AS fresh FROM e),
s AS (SELECT r, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
spans AS MATERIALIZED (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY r, k),
edges AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT edges.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h
  FROM edges JOIN n ON n.r = edges.r GROUP BY edges.r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept.r IS NULL THEN n.h ELSE kept.h || substr(n.h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN kept ON kept.r = n.r"""
