"""Conversation structure repair by an auction shortest-path algorithm.

A conversation's rows, in order of turn (nulls first, then role and text), are to read (s?(ua)+)? by the first letters
of their roles. The lattice has a node for each number of rows passed and each of four states: nothing yet, after the
system row, after a user, after an assistant. Its arcs are the edits with their integer costs: Keep 0, Rerole 2, Delete 3
(the only way past a blank or duplicate row), Insert 2; a truncated row that is not deleted adds 1.

Every node has a price. The auction holds a path from the start: if the last node's price is below the least cost plus
price among its arcs, it is raised to that and the path contracts; else the path is extended along such an arc, the first
in the order D, I, K, R. At the end the prices are dual feasible and exact on the cheapest paths, whose arcs are tight;
the trace follows the ASCII-least tight arc from the start, and no arc before it is on any cheapest path.

Long lattices are cut into blocks of BLOCK rows, solved from the last to the first, each with the prices of the next one's
start as its terminal costs; equal blocks are solved once a worker.

Rows are range-partitioned by conversation and turn, so a long conversation spans tasks. A conversation that lies inside a
task is repaired there. Any other (one that may cross a task's edge, or has more than SEGMENT rows or SEGMENT_CHARS
characters) is cut into segments: a segment's four start prices for each of four unit end prices make a matrix, the matrices
of a conversation give every segment its end prices, segments are traced for each of the four states they can start in,
and the traces are linked. Only these small rows of a conversation meet; its text is hashed in order, as a stream.

Defined cases: a null role or text is one space; null ids are one conversation, null turns come first; rows that tie on
turn are ordered by role and text; an empty role has no first letter and cannot be kept; a conversation without rows gives
zeros, an empty audit and the hash of nothing; repeated rows are duplicates; an empty table gives no rows; other columns
are not read. Texts of any length are handled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import BROADCAST_IDS, partitions, saved, small_batches

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLOCK, SEGMENT, SEGMENT_CHARS = 32, 4096, 4_000_000
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What it costs, and takes, to end in each state.
FINAL, FINISH = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: More than end prices of two states can differ by.
FAR = 16
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
OTHER = 4
#: A row's code: the state of its letter (OTHER for none), plus 8 if truncated, 16 if it must be deleted.
TRUNCATED, BAD = 8, 16
SPACE = " \t\n\x0b\x0c\r"


def letter_state(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def next_state(state: int) -> int:
    """What an inserted or rewritten row becomes."""
    return ASSISTANT if state == USER else USER


def arcs(state: int, code: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows passed, next state) of a node before a row of this code, in the order of the letters."""
    to = next_state(state)
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, to)]
    if not code & BAD:
        extra, own = (CUT if code & TRUNCATED else 0), code & 7
        if own == to or (own == SYSTEM and state == NOTHING):
            found.append(("K", KEEP + extra, 1, own))
        found.append(("R", REROLE + extra, 1, to))
    return found


@lru_cache(maxsize=1 << 16)
def solve(codes: bytes, end: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Prices of the four states before a block whose end has the prices `end`, and the (letters, last state) from each."""
    n = len(codes)
    # what every path must pay from a row on is a feasible first price
    least, price = [min(end)], [0] * (4 * n) + list(end)
    for i in range(n - 1, -1, -1):
        least.append(least[-1] + (DELETE if codes[i] & BAD else CUT if codes[i] & TRUNCATED else 0))
        price[4 * i:4 * i + 4] = [least[-1]] * 4
    ways = [[(cost, 4 * (i + step) + to, letter) for letter, cost, step, to in arcs(q, codes[i])] for i in range(n) for q in range(4)]
    for entry in range(4):
        path = [entry]
        while path[-1] < 4 * n:
            node = path[-1]
            cost, to = min(((c + price[t], k) for k, (c, t, _) in enumerate(ways[node])))
            if price[node] < cost:
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(ways[node][to][1])
    traces = []
    for entry in range(4):
        node, letters = entry, []
        while node < 4 * n:
            letter, node = next((x, t) for c, t, x in ways[node] if c + price[t] == price[node])
            letters.append(letter)
        traces.append(("".join(letters), node - 4 * n))
    return tuple(price[:4]), tuple(traces)


def backward(codes: bytes, end: tuple[int, ...]):
    """Prices before the rows, and the traces of every block in order."""
    blocks = []
    for start in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        low = min(end)
        prices, traces = solve(codes[start:start + BLOCK], tuple(e - low for e in end))
        end = tuple(p + low for p in prices)
        blocks.append(traces)
    return end, blocks[::-1]


def follow(blocks, state: int) -> tuple[str, int]:
    letters = []
    for traces in blocks:
        part, state = traces[state]
        letters.append(part)
    return "".join(letters), state


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    prices, blocks = backward(codes, FINAL)
    letters, state = follow(blocks, NOTHING)
    return prices[NOTHING], letters + FINISH[state]


def code_of(role: str, text: str, seen: bool) -> tuple[int, int]:
    """(code, first fault): 0 none, 1 blank, 2 duplicate, 3 truncated."""
    own, rest = letter_state(role), text.rstrip(SPACE)
    if not rest:
        return own | BAD, 1
    if seen:
        return own | BAD, 2
    return (own, 0) if rest[-1] in ".!?" else (own | TRUNCATED, 3)


class Lines:
    """The repaired conversation, edit by edit, hashed as it grows."""

    def __init__(self):
        self.state, self.hash, self.first = NOTHING, hashlib.sha256(), True

    def line(self, text: str) -> None:
        self.hash.update((text if self.first else "\n" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        self.state = next_state(self.state)
        self.line("assistant:" if self.state == ASSISTANT else "user:")

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.state = letter_state(role)
            self.line(f"{role}:{text}")
        elif letter == "R":
            self.state = next_state(self.state)
            self.line(("assistant:" if self.state == ASSISTANT else "user:") + text)


def replay(audit: str, rows) -> str:
    """Hash of the rows (role, text) after the edits."""
    lines, at = Lines(), iter(rows)
    for letter in audit:
        if letter == "I":
            lines.insert()
        else:
            lines.row(letter, *next(at))
    return lines.hash.hexdigest()


class Facts:
    """Counts over consecutive rows."""

    def __init__(self):
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.turns, self.distinct = [], 0  # the first and the last turn, and how many there are

    def add(self, turn: int | None, code: int, fault: int) -> None:
        self.faults[fault] += 1
        own = code & 7
        self.illegal += self.last is not None and (self.last, own) not in LEGAL
        self.last = own
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            if len(self.turns) == 2:
                self.turns[1] = turn
            else:
                self.turns.append(turn)
            self.distinct += 1

    def gaps(self) -> int:
        return self.turns[-1] - self.turns[0] + 1 - self.distinct if self.turns else 0


KEY = ["conv", "bare"]
ORDER = [*KEY, "placed", "turn", "role", "text"]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NOTHING_LEFT = hashlib.sha256(b"").hexdigest()


def _report(conv, bare, rows) -> tuple:
    """A whole conversation: its rows are (turn, role, text) in order."""
    facts, codes, seen = Facts(), bytearray(), set()
    for turn, role, text in rows:
        code, fault = code_of(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(code)
        facts.add(turn, code, fault)
    cost, audit = repair(bytes(codes))
    _, blank, duplicate, truncated = facts.faults
    return conv, bare, False, facts.gaps(), blank, duplicate, truncated, facts.illegal, cost, audit, replay(audit, [r[1:] for r in rows])


def _stream(batches):
    """(conv, bare, rows of one batch) of consecutive rows of a conversation; rows are (present, turn, role, text, rest)."""
    for pdf in batches:
        rest = pdf["seen"] if "seen" in pdf else [False] * len(pdf)
        rows = zip(pdf["conv"].tolist(), pdf["bare"].tolist(), pdf["present"].tolist(), pdf["placed"].tolist(), pdf["turn"].tolist(), pdf["role"], pdf["text"], rest)
        for (conv, bare), group in groupby(rows, key=lambda r: r[:2]):
            yield conv, bare, [(r[2], r[4] if r[3] else None, r[5], r[6], r[7]) for r in group]


def _whole(batches):
    """Reports of the conversations inside a task, and the ids of those that may not be."""
    columns = [*KEY, "open", *(c.split()[0] for c in REPORT.split(", ")), "repaired_sha256"]

    def closed(key, rows):
        return [(*key, True, *[None] * 8)] if rows is None else [_report(*key, rows)]

    now, rows, chars, first, out = None, [], 0, True, []
    for conv, bare, part in _stream(batches):
        if (conv, bare) != now:
            if now is not None:
                out += closed(now, None if first else rows)
                first = False
            now, rows, chars = (conv, bare), [], 0
        if rows is not None:
            rows += [(t, role, text) for present, t, role, text, _ in part if present]
            chars += sum(len(r[3]) for r in part)
            if len(rows) > SEGMENT or chars > SEGMENT_CHARS:
                rows = None
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if now is not None:
        out += closed(now, None)
    yield pd.DataFrame(out, columns=columns)


SEGMENTS = (
    "conv long, bare boolean, part int, number int, codes binary, matrix array<long>, faults array<long>, illegal long, "
    "letters array<long>, turns array<long>, distinct long"
)


def _segments(batches):
    """Consecutive rows of a conversation in one task, up to SEGMENT of them, as one row without text."""
    part, number, now, codes, facts, heads = TaskContext.get().partitionId(), 0, None, bytearray(), Facts(), []

    def segment():
        matrix = [p for q in range(4) for p in backward(bytes(codes), tuple(0 if x == q else FAR for x in range(4)))[0]]
        return pd.DataFrame([(
            *now, part, number, bytes(codes), matrix, facts.faults, facts.illegal, [heads[0], facts.last], facts.turns, facts.distinct
        )], columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    for conv, bare, rows in _stream(batches):
        for _, turn, role, text, seen in rows:
            if codes and ((conv, bare) != now or len(codes) == SEGMENT):
                yield segment()
                number, codes, facts, heads = number + 1, bytearray(), Facts(), []
            now = conv, bare
            code, fault = code_of(role, text, seen)
            codes.append(code)
            heads = heads or [code & 7]
            facts.add(turn, code, fault)
    if codes:
        yield segment()


ENDS = SEGMENTS + ", ends array<long>, cost long"


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The end prices of every segment of a conversation."""
    pdf = pdf.sort_values(["part", "number"])
    end, ends = np.array(FINAL, np.int64), []
    for matrix in pdf["matrix"].iloc[::-1]:
        ends.append(end)
        end = (np.asarray(matrix, np.int64).reshape(4, 4) + (end - end.min())[:, None]).min(axis=0) + end.min()
    return pdf.assign(ends=ends[::-1], cost=int(end[NOTHING]))


TRACED = ENDS + ", traces array<string>, exits array<long>"


def _traces(batches):
    for pdf in batches:
        found = []
        for row in pdf.itertuples():
            blocks = backward(bytes(row.codes), tuple(int(e) for e in row.ends))[1]
            found.append([follow(blocks, q) for q in range(4)])
        yield pdf.assign(traces=[[t for t, _ in f] for f in found], exits=[[q for _, q in f] for f in found])


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The report of a conversation from its segments."""
    state, audit, faults, illegal, distinct, turns, last = NOTHING, [], np.zeros(4, np.int64), 0, 0, [], None
    for row in pdf.sort_values(["part", "number"]).itertuples():
        audit.append(row.traces[state])
        state = int(row.exits[state])
        faults += np.asarray(row.faults, np.int64)
        illegal += row.illegal + (last is not None and (last, int(row.letters[0])) not in LEGAL)
        last, own = int(row.letters[1]), [int(t) for t in row.turns]
        distinct += row.distinct - bool(own and turns and own[0] == turns[-1])
        turns += own
    gaps = turns[-1] - turns[0] + 1 - distinct if turns else 0
    first = pdf.iloc[0]
    report = (first["conv"], first["bare"], gaps, *faults[1:].tolist(), illegal, int(first["cost"]), "".join(audit) + FINISH[state])
    return pd.DataFrame([report], columns=[*KEY, *(c.split()[0] for c in REPORT.split(", "))])


def _hashes(batches):
    """Hashes of the repaired conversations of a task: an audit first, then its rows."""
    now, audit, lines, out = None, "", None, []

    def ended():
        for _ in audit[at:]:
            lines.insert()
        return (*now, lines.hash.hexdigest())

    at = 0
    for pdf in batches:
        for conv, bare, kind, role, text in zip(pdf["conv"].tolist(), pdf["bare"].tolist(), pdf["kind"].tolist(), pdf["role"], pdf["text"]):
            if not kind:
                if now is not None:
                    out.append(ended())
                now, audit, lines, at = (conv, bare), text, Lines(), 0
                continue
            while audit[at] == "I":
                lines.insert()
                at += 1
            lines.row(audit[at], role, text)
            at += 1
    if now is not None:
        out.append(ended())
    yield pd.DataFrame(out, columns=[*KEY, "repaired_sha256"])


def _repair_split(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Reports of the conversations `open_`, each of which may span many tasks."""
    n = partitions(rows.sparkSession)
    few = open_.count() <= BROADCAST_IDS
    rows = rows.where("present").join(F.broadcast(open_) if few else open_, KEY)
    rows = saved(rows.withColumn("row_no", F.monotonically_increasing_id()), "open-rows")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = rows.select(*KEY, digest.alias("digest"), F.struct("placed", "turn", "row_no").alias("at"))
    first = first.groupBy(*KEY, "digest").agg(F.min("at").alias("at")).select(F.col("at.row_no").alias("row_no"), F.lit(False).alias("again"))
    marked = rows.join(first, "row_no", "left").withColumn("seen", F.coalesce("again", F.lit(True))).drop("again")
    # equal rows of one turn: the first of them by number is the one not seen before
    order = [*ORDER, "row_no"]
    ranged = marked.repartitionByRange(n, *order).sortWithinPartitions(*order)
    segments = saved(ranged.mapInPandas(_segments, SEGMENTS), "segments")
    ended = segments.groupBy(*KEY).applyInPandas(_ends, ENDS).mapInPandas(_traces, TRACED)
    linked = saved(ended.groupBy(*KEY).applyInPandas(_linked, f"conv long, bare boolean, {REPORT}"), "linked")
    texts = rows.select(*KEY, F.lit(1).alias("kind"), "placed", "turn", "role", "text").union(
        linked.select(*KEY, F.lit(0), F.lit(False), F.lit(0), F.lit(""), "audit")
    )
    order = [*KEY, "kind", "placed", "turn", "role", "text"]
    hashes = texts.repartition(n, *KEY).sortWithinPartitions(*order).mapInPandas(_hashes, "conv long, bare boolean, repaired_sha256 string")
    found = open_.join(linked, KEY, "left").join(hashes, KEY, "left")
    zeros = [F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in (x.split()[0] for x in REPORT.split(", "))]
    return found.select(*KEY, *zeros, F.coalesce("repaired_sha256", F.lit(NOTHING_LEFT)).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, present=None) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): conv_id, the columns of REPORT, repaired_sha256.

    Rows for which `present` is false only name their conversation.
    """
    spark = rows.sparkSession
    small_batches(spark)
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    rows = rows.select(
        F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("bare"), (F.lit(True) if present is None else present).alias("present"),
        turn.isNotNull().alias("placed"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    ranged = rows.repartitionByRange(partitions(spark), *ORDER).sortWithinPartitions(*ORDER)
    report = f"conv long, bare boolean, open boolean, {REPORT}, repaired_sha256 string"
    whole = saved(ranged.mapInPandas(_whole, report), "whole")
    open_ = saved(whole.where("open").select(*KEY).distinct(), "open")
    # a conversation cut at the edge of two tasks is named by both; one that a task took for whole is in no other
    found = whole.where("NOT open").drop("open").union(_repair_split(rows, open_))
    return found.select(F.when(~F.col("bare"), F.col("conv")).alias("conv_id"), *[c for c in found.columns if c not in KEY])


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` with a fault chosen by a checksum of id and turn; dropped ones have `present` false."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat_ws(":", *blank[:2])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank[3], "[.!?]", "")).otherwise(blank[3])
    rows = rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(blank[2]).alias("role"), text.alias("text"), (fault != 0).alias("present"),
        F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows, F.col("present"))


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
    flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM conversations),
faulty AS MATERIALIZED (
  SELECT conv_id, turn, role, text, c, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), steps),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * CAST(3988292384 AS BIGINT)) END)) % 20 AS f
  FROM keyed),
names AS MATERIALIZED (SELECT DISTINCT c, conv_id FROM faulty),
copies AS (
  SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE f <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM copies),
judged AS (
  SELECT *, substr(role, 1, 1) AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    substr(lag(role) OVER (PARTITION BY c ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair
  FROM ordered),
r AS MATERIALIZED (
  SELECT c, i, turn, role, text, x, blank OR again AS bad, blank, again AND NOT blank AS dup, cut AND NOT blank AND NOT again AS trunc, pair,
    CASE WHEN cut THEN 1 ELSE 0 END AS t
  FROM judged),
facts AS MATERIALIZED (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c),
back AS (
  SELECT c, n AS i, CAST(0 AS BIGINT) AS s0, CAST(4 AS BIGINT) AS s1, CAST(2 AS BIGINT) AS s2, CAST(0 AS BIGINT) AS s3 FROM facts
  UNION ALL
  SELECT c, i, least(b0, 2 + b2, 4 + b3), least(b1, 2 + b2, 4 + b3), least(b2, 2 + b3), least(b3, 2 + b2) FROM (
    SELECT c, i, least(3 + s0, u, s) AS b0, least(3 + s1, u) AS b1, least(3 + s2, a) AS b2, least(3 + s3, u) AS b3 FROM (
      SELECT back.c, back.i - 1 AS i, s0, s1, s2, s3,
        CASE WHEN bad THEN 1000000000 ELSE t + s2 + CASE WHEN x = 'u' THEN 0 ELSE 2 END END AS u,
        CASE WHEN bad THEN 1000000000 ELSE t + s3 + CASE WHEN x = 'a' THEN 0 ELSE 2 END END AS a,
        CASE WHEN bad OR x <> 's' THEN 1000000000 ELSE t + s1 END AS s
      FROM back JOIN r ON r.c = back.c AND r.i = back.i))),
prices AS MATERIALIZED (SELECT c, i, [s0, s1, s2, s3] AS p FROM back),
walk AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM facts
  UNION ALL
  SELECT c, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE q2 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, name || ':') WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, name || ':' || text) END
  FROM (
    SELECT *, CASE WHEN q2 = 3 THEN 'assistant' ELSE 'user' END AS name, CASE
      WHEN i < n AND 3 + nx[q + 1] = own THEN 'D'
      WHEN 2 + p[q2 + 1] = own THEN 'I'
      WHEN NOT bad AND ((x = 's' AND q = 0 AND t + nx[2] = own) OR (x = 'u' AND q2 = 2 AND t + nx[3] = own) OR (x = 'a' AND q2 = 3 AND t + nx[4] = own)) THEN 'K'
      ELSE 'R' END AS e
    FROM (
      SELECT walk.*, n, bad, x, t, role, text, a.p AS p, b.p AS nx, a.p[q + 1] AS own, CASE WHEN q = 2 THEN 3 ELSE 2 END AS q2
      FROM walk JOIN facts ON facts.c = walk.c JOIN prices a ON a.c = walk.c AND a.i = walk.i
      LEFT JOIN prices b ON b.c = walk.c AND b.i = walk.i + 1 LEFT JOIN r ON r.c = walk.c AND r.i = walk.i + 1
      WHERE NOT (walk.i = n AND q IN (0, 3))))),
done AS (
  SELECT walk.c, audit, array_to_string(lines, chr(10)) AS repaired FROM walk JOIN facts ON facts.c = walk.c WHERE walk.i = n AND q IN (0, 3))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(prices.p[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM names LEFT JOIN facts ON facts.c = names.c LEFT JOIN prices ON prices.c = names.c AND prices.i = 0 LEFT JOIN done ON done.c = names.c"""
