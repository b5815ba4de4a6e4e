"""N-gram Jaccard join by filtering under several global token orders.

Documents are sets of 5-word shingles (64-bit hashes); two sets link when 100 * |A and B| >= 75 * |A or B|.
A set of n tokens has at most n // 4 tokens outside any set it links with, so under every global
order of tokens its first n // 4 + 1 tokens, its prefix, hold one that the other set's prefix holds too.
All orders used here put rare tokens first (by document frequency, then by a hash of the token that
differs from order to order), and a pair is verified only if its prefixes meet under each of them.

1. A fixed share of the token space is counted: tokens of each batch are packed by range and shuffled
   once, each token once per batch. A set with more than n // 4 tokens that no other set has cannot link
   and goes no further. Most documents end here, and their other tokens are never shuffled.
2. The others are counted in full, which gives each its prefixes. Tokens of a single set lead every
   order and need no posting; only the shared tokens of a prefix are posted.
3. Postings that meet under the first order are first tried against one pivot per set: each group's
   pivot is its member with the fewest tokens of its own, and a set tries the pivot it meets most often.
   Sets linked so far are one class, and only pairs of different classes within a group are tried next,
   if enough tokens are left from the common token on in both. So a group of near copies is never
   expanded into its pairs.
4. Pairs must meet under the other orders too and are then verified exactly; linked sets are joined
   into components.

Defined cases: a null or empty text has the empty set and links with nothing; a text of fewer than
five words is one shingle; equal sets are one class from the start; rows with a null id take part in
no link and get a null component; rows that repeat an id are one document whose sets all count; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.graph import components
from postloom.llm.store import forget, partitions, saved, small_batches, with_ids
from postloom.llm.words import chunks, mix, released, released_group, shingle_sets

#: Similarity in hundredths.
SIMILAR = 75
#: Global token orders; each breaks ties of document frequency by its own hash.
ORDERS = 3
#: Share of the token space counted in step 1, in eighths.
EIGHTHS = 3
_MANY = 0xFFFF
_SALTS = mix(np.arange(1, ORDERS + 1, dtype=np.uint64))


def spare(n):
    """Most tokens that a set of n tokens can have outside a set it links with."""
    return n * (100 - SIMILAR) // 100


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cuts(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Positions at which the bucket of sorted tokens changes."""
    return np.searchsorted(((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _chunk_ids():
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


FIRST = "chunk long, bucket int, tokens binary, docs binary, ids array<long>, sizes array<long>, nodes array<long>"


def _first_emit(buckets: int):
    def emit(batches):
        number = _chunk_ids()
        for pdf in batches:
            pdf = pdf.sort_values("doc_id", kind="stable")
            texts, all_ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            for start, stop in chunks(texts):
                chunk, sets, ids = next(number), shingle_sets(texts[start:stop]), all_ids[start:stop]
                sizes = np.array([len(s) for s in sets], np.int64)
                nodes = np.array([_node(s) for s in sets], np.int64)
                _, lead = np.unique(nodes, return_index=True)
                lead.sort()
                tokens = np.concatenate([sets[i] for i in lead] or [np.zeros(0, np.uint64)])
                owner = np.repeat(lead.astype(np.uint16), sizes[lead])
                use = (tokens >> np.uint64(3)) & np.uint64(7) < EIGHTHS
                tokens, owner = tokens[use], owner[use]
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                first = np.ones(len(tokens), bool)
                first[1:] = tokens[1:] != tokens[:-1]
                # a token of several sets of the batch goes once, marked
                again = np.zeros(len(tokens), bool)
                again[:-1] = ~first[1:]
                owner = np.where(again, _MANY, owner)[first].astype(np.uint16)
                tokens = tokens[first]
                cuts = _cuts(tokens, buckets)
                low, rows = tokens.astype(np.uint32), []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[b], cuts[b + 1])
                    rows.append((chunk, b, low[part].tobytes(), owner[part].tobytes(), None, None, None))
                rows.append((chunk, chunk % buckets, b"", b"", ids, sizes, nodes))
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "tokens", "docs", "ids", "sizes", "nodes"])

    return emit


COUNTED = "chunk long, counts binary, ids array<long>, sizes array<long>, nodes array<long>"


def _count_single(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per batch and document, how many tokens of this range no other document has."""
    tokens = np.frombuffer(b"".join(pdf["tokens"]), np.uint32)
    owner = np.frombuffer(b"".join(pdf["docs"]), np.uint16)
    lengths = np.array([len(t) // 4 for t in pdf["tokens"]], np.int64)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    edge = np.ones(len(ordered) + 1, bool)
    edge[1:-1] = ordered[1:] != ordered[:-1]
    single = np.zeros(len(tokens), bool)
    single[order] = edge[1:] & edge[:-1]
    single &= owner != _MANY
    stops, rows = np.cumsum(lengths), []
    for i, (stop, n) in enumerate(zip(stops.tolist(), lengths.tolist())):
        part = slice(stop - n, stop)
        counts = np.bincount(owner[part][single[part]]).astype(np.uint32)
        rows.append((pdf["chunk"].iat[i], counts.tobytes(), pdf["ids"].iat[i], pdf["sizes"].iat[i], pdf["nodes"].iat[i]))
    return pd.DataFrame(rows, columns=["chunk", "counts", "ids", "sizes", "nodes"])


SETTLED = "doc_id long, n long, node long, alive boolean"


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = pdf[pdf["ids"].notna()].iloc[0]
    ids, sizes, nodes = (np.asarray(whole[c], np.int64) for c in ("ids", "sizes", "nodes"))
    single = np.zeros(len(ids), np.int64)
    for counts in pdf["counts"]:
        counts = np.frombuffer(counts, np.uint32)
        single[: len(counts)] += counts
    _, lead, back = np.unique(nodes, return_index=True, return_inverse=True)
    alive = (single <= spare(sizes)) & (sizes > 0)
    return pd.DataFrame({"doc_id": ids, "n": sizes, "node": nodes, "alive": alive[lead][back]})


SETS = "chunk long, nodes array<long>, sizes array<long>, tokens binary"


def _pack_sets(batches):
    number = _chunk_ids()
    for pdf in batches:
        texts = pdf["text"].tolist()
        for start, stop in chunks(texts):
            sets = {_node(s): s for s in shingle_sets(texts[start:stop]) if len(s)}
            if sets:
                yield pd.DataFrame({
                    "chunk": [next(number)],
                    "nodes": [np.fromiter(sets, np.int64, len(sets))],
                    "sizes": [np.array([len(s) for s in sets.values()], np.int64)],
                    "tokens": [np.concatenate(list(sets.values())).tobytes()],
                })


def _second_emit(buckets: int):
    def emit(batches):
        for pdf in batches:
            for chunk, packed in zip(pdf["chunk"], pdf["tokens"]):
                tokens = np.sort(np.frombuffer(packed, np.uint64))
                cuts, low = _cuts(tokens, buckets), tokens.astype(np.uint32)
                full = np.flatnonzero(np.diff(cuts)).tolist()
                yield pd.DataFrame({
                    "chunk": chunk, "bucket": full, "tokens": [low[cuts[b]:cuts[b + 1]].tobytes() for b in full],
                })

    return emit


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    tokens = np.frombuffer(b"".join(pdf["tokens"]), np.uint32)
    _, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
    df = times[back].astype(np.uint32)
    stops = np.cumsum([len(t) // 4 for t in pdf["tokens"]])
    starts = np.concatenate([[0], stops[:-1]])
    found = [df[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "df": found})


PREFIXED = "node long, n long, tokens array<long>, " + ", ".join(f"p{k} array<long>" for k in range(1, ORDERS + 1))


def _prefixes(sets: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """For every set that can still link: its shared tokens, and those of its prefix under each order."""
    names, rows = [x.split()[0] for x in PREFIXED.split(", ")], []
    if len(sets):
        tokens = np.frombuffer(sets["tokens"].iat[0], np.uint64)
        df = np.empty(len(tokens), np.int64)
        df[np.argsort(tokens, kind="stable")] = np.frombuffer(b"".join(counts.sort_values("bucket")["df"]), np.uint32)
        stop = 0
        for node, n in zip(sets["nodes"].iat[0].tolist(), sets["sizes"].iat[0].tolist()):
            own, often = tokens[stop:stop + n], df[stop:stop + n]
            stop += n
            shared = often > 1
            wanted = spare(n) + 1 - (n - int(shared.sum()))
            if wanted <= 0:
                continue
            own, often = own[shared], often[shared]
            prefixes = [own[np.lexsort((mix(own ^ salt), often))[:wanted]].view(np.int64) for salt in _SALTS]
            rows.append((node, n, own.view(np.int64), *prefixes))
    return pd.DataFrame(rows, columns=names)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the orders after the first and whose sets link."""
    sides = [
        sets.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in sets.columns if c not in ("node", "p1")])
        for s in ("a", "b")
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    for k in range(2, ORDERS + 1):
        both = both.where(F.arrays_overlap(f"p{k}_a", f"p{k}_b"))
    both = both.withColumn("inter", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return both.where(100 * F.col("inter") >= SIMILAR * (F.col("n_a") + F.col("n_b") - F.col("inter"))).select("a", "b")


def _links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that give the components of all links."""
    shared = F.size("tokens")
    postings = sets.select("node", "n", (F.col("n") - shared).alias("alone"), shared.alias("m"), F.posexplode("p1").alias("rank", "token"))
    # of a token on, in the first order: a set has this many tokens
    postings = postings.withColumn("left", F.col("m") - F.col("rank")).drop("m", "rank")
    groups = postings.groupBy("token").agg(F.min(F.struct("alone", "node"))["node"].alias("pivot"), F.count("*").alias("held"))
    met = postings.join(groups.where("held > 1"), "token").where("node <> pivot")
    met = met.groupBy("node", "pivot").agg(F.count("*").alias("times"))
    pairs = met.groupBy(F.col("node").alias("a")).agg(F.max_by("pivot", F.struct("times", "pivot")).alias("b"))
    near = saved(_verified(pairs, sets), "links")
    labels = saved(components(near), "labels")
    labelled = postings.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component", "alone")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_ = saved(labelled.join(mixed.select("token"), "token", "left_semi"), "open")
    a = open_.select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("left").alias("ar"), F.col("label").alias("al"))
    b = open_.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("left").alias("br"), F.col("label").alias("bl"))
    # at the first token that two sets share, neither has fewer tokens left than they must share
    fits = (100 + SIMILAR) * F.least("ar", "br") >= SIMILAR * (F.col("an") + F.col("bn"))
    fits &= (100 * F.least("an", "bn") >= SIMILAR * F.greatest("an", "bn")) & (F.col("al") < F.col("bl"))
    rest = a.join(b, "token").where(fits).select("a", "b").distinct()
    return near.union(_verified(rest, sets))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = _linked(docs.where("doc_id IS NOT NULL")).select("doc_id", "n", "component_id")
    unnamed = docs.where("doc_id IS NULL").select("text").mapInPandas(_sizes, "n long")
    unnamed = unnamed.select(F.lit(None).cast("bigint").alias("doc_id"), "n", F.lit(None).cast("bigint").alias("component_id"))
    return out.union(unnamed).withColumnRenamed("n", "n_shingles")


def _linked(known: DataFrame) -> DataFrame:
    """One row per row of `known` (doc_id, text): doc_id, n, node (the set, whatever the row), component_id."""
    spark = known.sparkSession
    small_batches(spark)
    buckets = 2 * partitions(spark)
    first = known.mapInPandas(released(_first_emit(buckets)), FIRST).groupBy("bucket").applyInPandas(released_group(_count_single), COUNTED)
    settled = saved(first.groupBy("chunk").applyInPandas(released_group(_settle), SETTLED), "settled")
    classes = saved(settled.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.bool_and("alive").alias("alive")), "classes")
    alive = saved(classes.where("alive").select(F.col("first_id").alias("doc_id")).distinct(), "alive")
    packed = saved(with_ids(known, alive, "doc_id").mapInPandas(released(_pack_sets), SETS), "sets")
    counts = packed.mapInPandas(released(_second_emit(buckets)), "chunk long, bucket int, tokens binary")
    counts = counts.groupBy("bucket").applyInPandas(released_group(_frequencies), "chunk long, bucket int, df binary")
    sets = packed.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(released_group(_prefixes), PREFIXED)
    sets = saved(sets, "prefixes")
    forget(packed)
    labels = saved(components(_links(sets)), "components")
    lowest = labels.join(classes, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    lowest = labels.join(lowest, "component").select("node", "component_id")
    classes = classes.join(lowest, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    # copies of one text make one side skewed; the other has one row per set
    linked = settled.where("n > 0").join(classes, "node")
    bare = settled.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n", "node", "component_id").union(bare.select("doc_id", "n", "node", "component_id"))


def _sizes(batches):
    for pdf in batches:
        yield pd.DataFrame({"n": np.array([len(s) for s in shingle_sets(pdf["text"].tolist())], np.int64)})


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose id is its component; rows without id stay.

    A row whose id is in the table once goes by its id. Rows that share an id go by their own sets: each stays if its
    id is its component, but one of them only where several are in one component; those without words all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    linked = saved(_linked(named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), "linked")
    ids = linked.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("component_id").alias("component_id"))
    shared = saved(ids.where("times > 1").select("doc_id"), "shared-ids")
    dropped = saved(ids.where("times > 1 OR doc_id <> component_id").select("doc_id"), "dropped")
    kept = with_ids(named, dropped, "doc_id", "left_anti").unionByName(docs.where("doc_id IS NULL"))
    if shared.isEmpty():
        return kept
    odd = with_ids(named, shared, "doc_id").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.pandas_udf(_set_node, "long")("text").alias("node")
    )
    own = linked.join(shared, "doc_id").where("doc_id = component_id AND n > 0").groupBy("doc_id", "component_id").agg(F.min("node").alias("node"))
    one = odd.join(own.select("doc_id", "node"), ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min("row").alias("row"))
    return kept.unionByName(one.select("row.*")).unionByName(odd.where("node IS NULL").select("row.*"))


def _set_node(text: pd.Series) -> pd.Series:
    """The node of each text's set; none without words."""
    return pd.Series([_node(s) if len(s) else None for s in shingle_sets(text.tolist())], dtype="Int64")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * met >= 75 * (na.n + nb.n - met)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""
