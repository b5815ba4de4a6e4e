"""Secret scans with multipart credential linking.

Strong spans stand alone: keyword assignments, access keys, long hexadecimal runs. Weak candidates
(identifiers of a user or client, high-entropy strings, endpoints) are common in clean text and are
reported only where complementary parts co-occur: an identifier or a string needs the other of the two
within its scope, an endpoint needs both. A scope is the candidate with SCOPE code points on either side;
parts and scopes are interval-joined within a document over position bins.

Defined cases: a null text is empty; a document without spans has counts 0 and empty strings; rows
that repeat an id and a text give equal rows; rows with one id and unlike texts are scanned apart; an
empty table gives no rows. Texts of any length are scanned whole; a bin holds a bounded stretch of text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import saved, small_batches

# The base patterns, their least lengths and their order.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]

WEAK_ID = re.compile(
    r"""(?ai:\b(?:(?:client|user|account|access|key)_?(?:id|name)|login|user))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(
    r"""(?a)(?:\b[a-z][a-z0-9+.-]*://[^\s"'<>]{4,}|(?i:\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?))"""
)
SCOPE, BIN = 300, 1024
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_RUN = b"h" * LEAST_HEX


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strong spans; the cheap tests only skip texts that cannot match."""
    found = []
    if any(k in (low := text.lower()) for k in _KEYWORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _RUN in low.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [(2, *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return found


def weak_parts(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of weak candidates that no strong span covers."""
    found = []
    if ":" in text or "=" in text:
        found += [(3, *m.span()) for m in WEAK_ID.finditer(text)]
        found += [(5, *m.span()) for m in ENDPOINT.finditer(text)]
    for m in WEAK_SECRET.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and s.lower() != s and s.upper() != s:
            found.append((4, *m.span()))
    if not found:
        return found
    taken, kept, at = sorted((a, b) for _, a, b in taken), [], 0
    ends = 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], x[0])):
        while at < len(taken) and taken[at][0] < b:
            ends = max(ends, taken[at][1])
            at += 1
        if ends <= a:
            kept.append((kind, a, b))
    return kept


SPAN = "array<struct<kind: int, start: long, end: long>>"


def _scan(batches):
    for pdf in batches:
        base = [base_spans(t or "") for t in pdf["text"]]
        weak = [weak_parts(t or "", b) for t, b in zip(pdf["text"], base)]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "text_key": pdf["text_key"],
            "base": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in base],
            "weak": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in weak],
        })


def linked_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The weak parts (keys, kind, start, end) whose complementary parts lie in their scope.

    `parts` has all parts, strong ones too. Interval join on (keys, bin): a part lies in the bin of its
    start; a scope is sent to the bins it meets, and a part longer than a bin to all of its own.
    """
    role = F.when(F.col("kind").isin(1, 3), "id").when(F.col("kind").isin(0, 2, 4), "secret")
    others = parts.where(role.isNotNull()).select(
        *[F.col(k).alias(f"o_{k}") for k in keys], role.alias("role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("o_bin"),
    )
    scopes = parts.where("kind >= 3").select(*keys, "kind", "start", "end").distinct().withColumn(
        "bin", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - SCOPE, F.lit(0)) / BIN), F.floor((F.col("end") + SCOPE) / BIN)))
    )
    met = F.col("bin") == F.col("o_bin")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"o_{k}"))
    near = (F.col("o_start") < F.col("end") + SCOPE) & (F.col("o_end") > F.col("start") - SCOPE)
    pairs = scopes.join(others, met & near)
    sides = pairs.groupBy(*keys, "kind", "start", "end").agg(F.bool_or(F.col("role") == "id").alias("ids"), F.bool_or(F.col("role") == "secret").alias("secrets"))
    complete = F.when(F.col("kind") == 3, F.col("secrets")).when(F.col("kind") == 4, F.col("ids")).otherwise(F.col("ids") & F.col("secrets"))
    return sides.where(complete).select(*keys, "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, base and linked spans as arrays of (kind number, start, end)."""
    small_batches(docs.sparkSession)
    # ids pass pandas as strings: a batch of longs with a null among them would turn into doubles
    docs = docs.select(F.col(id_col).cast("bigint").cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    scanned = docs.mapInPandas(_scan, f"doc_id string, text_key long, base {SPAN}, weak {SPAN}")
    scanned = saved(scanned.withColumn("doc_id", F.col("doc_id").cast("bigint")), "scanned")
    keys = ["doc_id", "text_key"]
    parts = scanned.where(F.size("weak") > 0).select(*keys, F.inline(F.concat("base", "weak")))
    linked = linked_parts(parts, keys).groupBy(*keys).agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"))
    linked = linked.select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "linked")
    none = F.expr(f"cast(array() as {SPAN})")
    both = scanned.join(linked, scanned["doc_id"].eqNullSafe(linked["l_id"]) & (scanned["text_key"] == linked["l_key"]), "left")
    return both.select("doc_id", "base", F.coalesce("linked", none).alias("linked"))


def as_string(spans) -> "F.Column":
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans, kind: int) -> "F.Column":
    """Number of spans of one kind. The lambda takes one argument: a second one would be given the index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count_of("base", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(as_string(F.col("base")), 256).alias("base_sha256"),
        as_string(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("bigint").alias("n_linked"),
    )
