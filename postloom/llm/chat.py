"""Chat formatting by event sourcing, with DataFrame operations only.

An event log has rows (conv_id, seq, kind, msg, role, text). `msg` numbers the messages of a
conversation. Kinds: `open` starts a message and names its role; `delta` appends text to it; `edit`
replaces all its text so far; `regenerate` discards its text so far. Events of a conversation are
folded in order of seq.

Template: every turn is `<|role|>text</s>`, a conversation is `<s>` and its turns. In roles and texts
`\\`, `<`, `[`, `|` become `\\b`, `\\l`, `\\s`, `\\p`: no control string can stand inside a text, and the
rewriting is undone exactly. The loss mask covers the texts of assistant turns.

Defined cases: null role or text is empty; null conv_id is one conversation; events that tie on seq
are ordered by kind and text; messages follow the order of their first event; a message without text
events is an empty turn; deltas of a message without `open` give a turn with an empty role; events
whose message number is null belong to one message. A conversation is one row, so it must fit in one
row; its events are reduced per message before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPES = {"\\": "\\b", "<": "\\l", "[": "\\s", "|": "\\p"}
TURN_END = "</s>"
DELTA = 256


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>): the final messages of every conversation."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    opened = F.when(F.col("kind") == "open", F.coalesce("role", F.lit("")))
    messages = log.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.min("seq").alias("first"),
        F.min(opened).alias("role"),
    )
    resets = F.expr("coalesce(array_max(transform(filter(sequence(1, size(events)), i -> element_at(events, i).kind IN ('edit', 'regenerate')), i -> i)), 1)")
    messages = messages.withColumn("at", resets)
    text = F.expr(
        "array_join(transform(filter(slice(events, at, size(events)), e -> e.kind IN ('delta', 'edit')), e -> e.text), '')"
    )
    turn = F.struct("first", "msg", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.expr("transform(turns, t -> struct(t.role AS role, t.text AS text))").alias("turns"))


def render(turns: Column) -> Column:
    """The formatted conversation."""
    def one(t: Column) -> Column:
        return F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>"), escaped(t["text"]), F.lit(TURN_END))

    return F.concat(F.lit("<s>"), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted conversation."""
    pieces = F.filter(F.split(F.substr(formatted, F.lit(4)), TURN_END, -1), lambda p: p != "")

    def one(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(3)), "|>", 1)
        text = F.substr(p, F.length(role) + 5)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, one)


def loss_spans(formatted: Column) -> Column:
    """The masked spans: array of (start, length) in code points of the formatted text."""
    pieces = F.filter(F.split(F.substr(formatted, F.lit(4)), TURN_END, -1), lambda p: p != "")
    empty = F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(3)), "|>", 1)
        head = F.length(role) + 4
        span = F.struct((acc["at"] + head).alias("start"), (F.length(p) - head).alias("length"))
        spans = F.when(role == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(p) + len(TURN_END)).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["spans"])


def format_log(log: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for every conversation of an event log."""
    folded = fold_events(log).select("conv_id", render(F.col("turns")).alias("formatted"))
    return folded.withColumn("loss_spans", loss_spans(F.col("formatted")))


def turns_as_log(turns: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the event log that streams them: a message is
    opened and its text arrives in deltas of DELTA code points. Rows that tie on (conv_id, turn)
    become messages of their own, ordered by role and text."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    tied = turns.groupBy("conv_id", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("text", "times"))).alias("tied"))
    turns = tied.select("conv_id", "turn", "role", F.posexplode("tied").alias("rank", "t")).select("conv_id", "turn", "role", "rank", "t.*")
    turns = turns.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    # a message number that sorts as the turns do
    msg = F.struct(F.col("turn"), F.col("role"), F.col("rank"), F.col("copy"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / DELTA).cast("int")),
        lambda i: F.struct((i + 1).alias("part"), F.lit("delta").alias("kind"), F.substr(F.col("text"), i * DELTA + 1, F.lit(DELTA)).alias("text")),
    )
    start = F.array(F.struct(F.lit(0).alias("part"), F.lit("open").alias("kind"), F.lit("").alias("text")))
    log = turns.select("conv_id", msg.alias("msg"), "role", F.explode(F.concat(start, parts)).alias("e"))
    return log.select("conv_id", F.struct("msg", "e.part").alias("seq"), "e.kind", "msg", "role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract columns, read back from conv_id, formatted, loss_spans."""
    spoken = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("spoken", F.array_join(spoken, ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("spoken").cast("bigint").alias("loss_chars"),
        F.sha2("spoken", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return digests(format_log(turns_as_log(turns.unionByName(probe))))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
long AS (
  SELECT *, length(role) + length(text) + 8
    + length(regexp_replace(role || text, '[^\\<\[|]', '', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id"""
