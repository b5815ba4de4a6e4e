"""Queries on text, tokens, payloads, replies and callbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import parsing, text
from postloom.operators.extract import extract_attributes, extract_rules, extract_stub, normalise_replies
from postloom.operators.evaluate import evaluate_extraction
from postloom.operators.features import char_term_counts, feature_union, term_lists, word_term_counts
from postloom.plans import bindings as b
from postloom.plans.bindings import Tables, sql

# RE2 has no Unicode \s: the same class, spelled out.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NULLS = ", ".join(f"'{v}'" for v in parsing.NULL_STRINGS)


def strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{_WS}+|{_WS}+$', '', 'g')"


def clean_sql(value: str) -> str:
    zero = " || ".join(f"chr({c})" for c in (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF))
    visible = f"translate(coalesce({value}, ''), chr(160) || {zero}, ' ')"
    return f"trim(regexp_replace(lower({visible}), '{_WS}+', ' ', 'g'))"


def _decorated(t: Tables):
    """Documents with spaces, zero-width marks and capitals sprinkled in."""
    changed = F.translate("text", "aeo", "A\u2003O")
    return t.documents.withColumn("text", F.concat(F.lit("\u00a0\u200b"), changed, F.lit("_\t\ufeff")))


_DECORATED = "translate(text, 'aeo', 'A' || chr(8195) || 'O')"
_DECORATED = f"chr(160) || chr(8203) || {_DECORATED} || '_' || chr(9) || chr(65279)"
_DOCS_SQL = f"docs AS (SELECT doc_id, {_DECORATED} AS text FROM documents)"


def normal(t: Tables):
    return _decorated(t).select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


def hashed(t: Tables):
    return _decorated(t).select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


def cleaned(t: Tables):
    return _decorated(t).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def tokens(t: Tables):
    words = t.documents.select("doc_id", text.word_tokens(text.clean_text(F.col("text"))).alias("w"))
    grams = words.select(
        "doc_id", F.concat_ws(" ", "w").alias("words"), F.concat_ws("|", text.word_bigrams(F.col("w"))).alias("bigrams")
    )
    return grams


TOKENS_SQL = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({clean_sql('text')}, '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents)
  SELECT doc_id, array_to_string(w, ' ') AS words,
    array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS bigrams FROM w"""


def word_terms_sql(source: str, doc: str) -> str:
    """CTE `word_counts` (doc, term, tf)."""
    return rf"""word_tok AS (
      SELECT {doc} AS doc, regexp_extract_all({clean_sql('text')}, '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM {source}),
    word_counts AS (
      SELECT doc, term, count(*) AS tf FROM (
        SELECT doc, unnest(w) AS term FROM word_tok
        UNION ALL
        SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM word_tok)
      GROUP BY 1, 2)"""


def char_terms_sql(source: str, doc: str) -> str:
    """CTE `char_counts` (doc, term, tf)."""
    return f"""char_words AS (
      SELECT doc, ' ' || word || ' ' AS w, count(*) AS times FROM (
        SELECT {doc} AS doc, unnest(string_split({clean_sql('text')}, ' ')) AS word FROM {source})
      WHERE word <> '' GROUP BY 1, 2),
    char_counts AS (
      SELECT doc, term, CAST(sum(times) AS BIGINT) AS tf FROM (
        SELECT doc, times, unnest(list_transform(range(1, greatest(1, length(w) - n + 1) + 1), lambda i: substr(w, i, n))) AS term
        FROM char_words, (VALUES (3), (4), (5)) sizes(n) WHERE n <= greatest(3, length(w)))
      GROUP BY 1, 2)"""


def word_counts(t: Tables):
    return word_term_counts(t.conversations.withColumn("doc", F.concat_ws("-", "conv_id", "turn")))


def char_ngrams(t: Tables):
    lists = term_lists(t.documents, "doc_id", words=False)  # a long document may have several
    each = lists.select(
        "doc",
        F.size("terms").alias("terms"),
        F.aggregate("tf", F.lit(0).cast("bigint"), lambda total, n: total + n).alias("total"),
        F.array_max("tf").alias("most"),
        F.array_max("terms").alias("last_term"),
    )
    return each.groupBy("doc").agg(
        F.sum("terms").alias("terms"),
        F.sum("total").alias("total"),
        F.max("most").alias("most"),
        F.max("last_term").alias("last_term"),
    )


def both_blocks(t: Tables):
    docs = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("doc"), "text")
    united = feature_union(word_term_counts(docs), char_term_counts(docs))
    return united.groupBy("doc", "block").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"))


# ---- enums, optional strings, payloads, replies --------------------------------------------

_RAW_ENUM = """CASE {k} % 6 WHEN 0 THEN ' FULL_SHIFT ' WHEN 1 THEN 'vahta' WHEN 2 THEN 'Short_Task'
  WHEN 3 THEN 'nonsense' WHEN 4 THEN NULL ELSE 'permanent' END"""
_RAW_OPTIONAL = """CASE {k} % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Не указано ' WHEN 3 THEN 'None' WHEN 4 THEN '-'
  WHEN 5 THEN ' 500/2 ' ELSE 'null and void' END"""


def enums(t: Tables):
    raw = t.part.withColumn("raw", F.expr(_RAW_ENUM.format(k="p_partkey")))
    return raw.select("p_partkey", parsing.parse_enum(F.col("raw"), parsing.DURATIONS).alias("duration"))


def optionals(t: Tables):
    raw = t.part.withColumn("raw", F.expr(_RAW_OPTIONAL.format(k="p_partkey")))
    return raw.select("p_partkey", parsing.clean_optional(F.col("raw")).alias("payment"))


def enum_sql(raw: str) -> str:
    key = f"lower({strip_sql(raw)})"
    domain = ", ".join(f"'{d}'" for d in parsing.DURATIONS)
    return f"CASE WHEN {key} IN ({domain}) THEN {key} ELSE 'unknown' END"


def optional_sql(raw: str) -> str:
    return f"CASE WHEN {strip_sql(raw)} = '' OR lower({strip_sql(raw)}) IN ({_NULLS}) THEN NULL ELSE {strip_sql(raw)} END"


def _with_attributes(t: Tables):
    from postloom.operators.status import attach_attributes

    return attach_attributes(b.posts(t), b.attributes(t))


def _payloads(t: Tables):
    posts = _with_attributes(t).select(
        F.col("post_id").alias("id"),
        "source",
        "text",
        "source_post_url",
        "source_chat_url",
        b.photos().alias("attachments"),
        "attributes",
    )
    return posts.select("id", parsing.encode_payload(F.struct(*posts.columns)).alias("payload"))


def encoded(t: Tables):
    """Payload fields read back by JSON path, nulls kept as keys."""
    return _payloads(t).select(
        "id",
        F.size(F.json_object_keys("payload")).cast("bigint").alias("keys"),
        F.get_json_object("payload", "$.source").alias("source"),
        F.get_json_object("payload", "$.text").alias("text"),
        F.get_json_object("payload", "$.attributes.duration").alias("duration"),
        F.get_json_object("payload", "$.attributes.payment").alias("payment"),
        F.coalesce(F.json_array_length(F.get_json_object("payload", "$.attachments")), F.lit(0)).cast("bigint").alias("photos"),
    )


_POSTS_ATTRIBUTES = (b.POSTS_SQL, b.ATTRIBUTES_SQL)


def decoded(t: Tables):
    """Good payloads next to broken ones: unknown values, missing keys, no JSON."""
    kind = F.col("id") % 6
    broken = (
        F.when(kind == 1, F.replace("payload", F.lit('"source":"'), F.lit('"source":"x')))
        .when(kind == 2, F.replace("payload", F.lit('"source_chat_url":'), F.lit('"other":')))
        .when(kind == 3, F.substring("payload", 1, 40))
        .otherwise(F.col("payload"))
    )
    rows = _payloads(t).select("id", parsing.decode_payload(broken).alias("d"))
    good = F.col("d.error").isNull()
    return rows.select(
        "id",
        F.col("d.error").alias("error"),
        F.when(good, F.col("d.post.id")).cast("bigint").alias("post_id"),
        F.when(good, F.col("d.post.text")).alias("text"),
        F.when(good, F.col("d.post.attributes.work_type")).alias("work_type"),
        F.when(good, F.size("d.post.attachments")).cast("bigint").alias("photos"),
    )


DECODED_SQL = sql(
    *_POSTS_ATTRIBUTES,
    body="""SELECT post_id AS id,
      CASE post_id % 6 WHEN 1 THEN 'unknown source' WHEN 2 THEN 'missing key' WHEN 3 THEN 'not a JSON object' END AS error,
      CASE WHEN post_id % 6 NOT IN (1, 2, 3) THEN post_id END AS post_id,
      CASE WHEN post_id % 6 NOT IN (1, 2, 3) THEN text END AS text,
      CASE WHEN post_id % 6 NOT IN (1, 2, 3) THEN work_type END AS work_type,
      CASE WHEN post_id % 6 NOT IN (1, 2, 3) THEN n_photos END AS photos
    FROM posts LEFT JOIN attributes USING (post_id)""",
)


def _replies(t: Tables):
    """Model replies for every part: odd values, missing keys, numbers, broken JSON."""
    return t.part.select(
        F.col("p_partkey").alias("post_id"),
        F.expr(f"""CASE WHEN p_partkey % 11 = 0 THEN 'no json' WHEN p_partkey % 13 = 0 THEN '{{"duration": '
          WHEN p_partkey % 5 = 0 THEN concat('{{"payment": ', p_size, '}}')
          ELSE to_json(named_struct('duration', {_RAW_ENUM.format(k='p_partkey')}, 'work_type', 'loader',
            'payment', {_RAW_OPTIONAL.format(k='p_partkey')}, 'address', p_name)) END""").alias("reply"),
    )


def replies(t: Tables):
    return normalise_replies(_replies(t)).withColumn("valid", F.col("valid").cast("int"))


REPLIES_SQL = f"""SELECT p_partkey AS post_id, CAST(ok AS INT) AS valid,
    CASE WHEN ok THEN CASE WHEN short THEN 'unknown' ELSE {enum_sql('e')} END END AS duration,
    CASE WHEN ok THEN CASE WHEN short THEN 'unknown' ELSE 'loader' END END AS work_type,
    CASE WHEN ok THEN CASE WHEN short THEN CAST(p_size AS VARCHAR) ELSE {optional_sql('o')} END END AS payment,
    CASE WHEN ok AND NOT short THEN p_name END AS address
  FROM (SELECT *, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS ok, p_partkey % 5 = 0 AS short,
    {_RAW_ENUM.format(k='p_partkey')} AS e, {_RAW_OPTIONAL.format(k='p_partkey')} AS o FROM part)"""


def callbacks(t: Tables):
    rows = b.bot_events(t).withColumn("payload", F.concat(F.lit('{"d": "'), "data", F.lit('"}')))
    data = parsing.callback_data(F.col("payload"))
    return rows.select(
        "seq",
        data.alias("data"),
        *[parsing.callback_number(data, p).cast("bigint").alias(p) for p in ("cat", "f", "opt")],
    )


CALLBACKS_SQL = sql(
    b.BOT_SQL,
    body="SELECT seq, data, "
    + ", ".join(f"TRY_CAST(nullif(regexp_extract(data, '^{p}([0-9]+)$', 1), '') AS BIGINT) AS {p}" for p in ("cat", "f", "opt"))
    + " FROM bot",
)


def start_payloads(t: Tables):
    payload = F.expr(
        """CASE event_id % 5 WHEN 0 THEN '{"command": "start"}' WHEN 1 THEN '{"command": "stop"}' WHEN 2 THEN 'broken'
           WHEN 3 THEN props ELSE NULL END"""
    )
    return t.events.select("event_id", parsing.is_start_payload(payload).cast("int").alias("is_start"))


# ---- extraction ----------------------------------------------------------------------------


def _answer(texts: list[str]) -> list[str]:
    """Stand-in for a model: its reply depends on the text length only."""
    kinds = ["full_shift", "VAHTA", " short_task ", "other"]
    return [
        "oops" if len(s) % 10 == 9 else '{"duration": "%s", "payment": %d, "address": "-"}' % (kinds[len(s) % 4], len(s))
        for s in texts
    ]


def extracted(t: Tables):
    rows = extract_attributes(t.documents, _answer, "doc_id")
    return rows.withColumn("valid", F.col("valid").cast("int"))


EXTRACTED_SQL = """SELECT CAST(doc_id AS VARCHAR) AS post_id, CAST(ok AS INT) AS valid,
    CASE WHEN ok THEN CASE n % 4 WHEN 0 THEN 'full_shift' WHEN 1 THEN 'vahta' WHEN 2 THEN 'short_task' ELSE 'unknown' END END AS duration,
    CASE WHEN ok THEN 'unknown' END AS work_type, CASE WHEN ok THEN CAST(n AS VARCHAR) END AS payment,
    CAST(NULL AS VARCHAR) AS address
  FROM (SELECT doc_id, length(text) AS n, length(text) % 10 <> 9 AS ok FROM documents)"""


def stub(t: Tables):
    return extract_stub(b.posts(t))


def rules(t: Tables):
    return extract_rules(b.ads(t))


RULES_SQL = sql(
    b.ADS_SQL,
    body="""SELECT post_id,
      CASE WHEN low LIKE '%вахт%' THEN 'vahta' WHEN regexp_matches(low, 'постоян|вакансия') THEN 'permanent'
        WHEN TRY_CAST(regexp_extract(low, '([0-9]+) час', 1) AS INT) >= 6 THEN 'full_shift'
        WHEN regexp_matches(low, '[0-9] час|[0-9]{3}/[0-5]($|[^0-9])') THEN 'short_task' ELSE 'unknown' END AS duration,
      CASE WHEN low LIKE '%электрик%' THEN 'specialist'
        WHEN regexp_matches(low, 'грузчик') AND NOT regexp_matches(low, 'уборка') THEN 'loader'
        WHEN regexp_matches(low, 'разнорабоч') THEN 'handyman' ELSE 'unknown' END AS work_type,
      nullif(trim(regexp_extract(text, '([0-9][0-9 .]*[0-9]{2} ?(₽|руб[а-я]*|р([^а-я]|$))[.]?|[0-9]{3,4}/[0-9]+)', 1)), '') AS payment,
      nullif(trim(regexp_extract(text, '((ул[.]|район) ?[А-ЯЁA-Z][^,;]*)', 1)), '') AS address
    FROM (SELECT *, lower(text) AS low FROM ads)""",
)


def extraction_quality(t: Tables):
    """Confusion counts of the rules against the fragments each ad was built from."""
    ads = b.ads(t)
    expected = ads.select(
        "post_id",
        F.expr(b.listed("d", b.AD_DURATIONS)).alias("duration"),
        F.expr(b.listed("w", b.AD_WORK_TYPES)).alias("work_type"),
    )
    return evaluate_extraction(extract_rules(ads), expected, ["duration", "work_type"])


QUALITY_SQL = f"""WITH r AS ({RULES_SQL}),
  e AS (SELECT p_partkey AS post_id, {b.listed('p_partkey % 5', b.AD_DURATIONS)} AS duration,
    {b.listed('p_size % 5', b.AD_WORK_TYPES)} AS work_type FROM part)
  SELECT 'duration' AS attribute, e.duration AS expected, r.duration AS predicted, count(*) AS n
    FROM r JOIN e USING (post_id) GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'work_type', e.work_type, r.work_type, count(*) FROM r JOIN e USING (post_id) GROUP BY 1, 2, 3"""

_CONV_SQL = "conv AS (SELECT conv_id || '-' || turn AS doc, text FROM conversations)"

QUERIES = {
    "normalize_text": (
        normal,
        sql(_DOCS_SQL, body=r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS normal FROM docs"),
    ),
    "text_hash": (hashed, sql(_DOCS_SQL, body=f"SELECT doc_id, {b.HASH_SQL} AS text_hash FROM docs")),
    "clean_text": (cleaned, sql(_DOCS_SQL, body=f"SELECT doc_id, {clean_sql('text')} AS clean FROM docs")),
    "word_tokens": (tokens, TOKENS_SQL),
    "word_term_counts": (
        word_counts,
        sql(_CONV_SQL, word_terms_sql("conv", "doc"), body="SELECT doc, term, tf FROM word_counts"),
    ),
    "char_wb_ngrams": (
        char_ngrams,
        sql(
            char_terms_sql("documents", "doc_id"),
            body="""SELECT doc, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most, max(term) AS last_term
              FROM char_counts GROUP BY 1""",
        ),
    ),
    "feature_union": (
        both_blocks,
        sql(
            _CONV_SQL,
            word_terms_sql("conv", "doc"),
            char_terms_sql("conv", "doc"),
            body="""SELECT doc, 'word' AS block, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total FROM word_counts GROUP BY 1
              UNION ALL SELECT doc, 'char', count(*), CAST(sum(tf) AS BIGINT) FROM char_counts GROUP BY 1""",
        ),
    ),
    "parse_enum": (
        enums,
        f"SELECT p_partkey, {enum_sql('raw')} AS duration FROM (SELECT p_partkey, {_RAW_ENUM.format(k='p_partkey')} AS raw FROM part)",
    ),
    "clean_optional": (
        optionals,
        f"SELECT p_partkey, {optional_sql('raw')} AS payment FROM (SELECT p_partkey, {_RAW_OPTIONAL.format(k='p_partkey')} AS raw FROM part)",
    ),
    "payload_encode": (
        encoded,
        sql(
            *_POSTS_ATTRIBUTES,
            body="""SELECT post_id AS id, 7 AS keys, source, text, duration, payment, n_photos AS photos
              FROM posts LEFT JOIN attributes USING (post_id)""",
        ),
    ),
    "payload_decode": (decoded, DECODED_SQL),
    "model_json_parse": (replies, REPLIES_SQL),
    "callback_parse": (callbacks, CALLBACKS_SQL),
    "start_payload": (start_payloads, "SELECT event_id, CAST(event_id % 5 = 0 AS INT) AS is_start FROM events"),
    "extract_attributes": (extracted, EXTRACTED_SQL),
    "extract_stub": (
        stub,
        """SELECT doc_id AS post_id, 'unknown' AS duration, 'unknown' AS work_type,
           CAST(NULL AS VARCHAR) AS payment, CAST(NULL AS VARCHAR) AS address FROM documents""",
    ),
    "extract_rules": (rules, RULES_SQL),
    "evaluate_extraction": (extraction_quality, QUALITY_SQL),
}
