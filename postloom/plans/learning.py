"""Queries on features, classifiers, reports and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import evaluate as ev
from postloom.operators import features as fe
from postloom.operators import learn
from postloom.plans import bindings as b
from postloom.plans.bindings import Tables, sql
from postloom.plans.text import char_terms_sql, word_terms_sql
from postloom.session import cut, work_path, written

COUNTS_SQL = f"""{word_terms_sql('samples', 'doc')},
  {char_terms_sql('samples', 'doc')},
  counts AS MATERIALIZED (SELECT doc, 'word' AS block, term, tf FROM word_counts
    UNION ALL SELECT doc, 'char' AS block, term, tf FROM char_counts)"""
VOCABULARY_SQL = """vocabulary AS MATERIALIZED (
  SELECT block, term, count(*) AS df, ln((1 + (SELECT count(*) FROM samples)) / (1 + count(*))) + 1 AS idf
  FROM counts GROUP BY 1, 2 HAVING count(*) >= 2)"""
TFIDF_SQL = """raw AS MATERIALIZED (
  SELECT doc, block, term, (1 + ln(tf)) * idf AS raw FROM counts JOIN vocabulary USING (block, term)),
norms AS (SELECT doc, block, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2),
tfidf AS MATERIALIZED (SELECT doc, block, term, raw / norm AS value FROM raw JOIN norms USING (doc, block))"""
NB_SQL = """sums AS MATERIALIZED (
  SELECT block, term, sum(CASE WHEN label = 1 THEN value ELSE 0 END) AS s1, sum(CASE WHEN label = 0 THEN value ELSE 0 END) AS s0
  FROM tfidf JOIN samples USING (doc) GROUP BY 1, 2),
totals AS (SELECT sum(s1) + count(*) AS t1, sum(s0) + count(*) AS t0 FROM sums),
nb AS (SELECT block, term, ln((s1 + 1) / t1) - ln((s0 + 1) / t0) AS coef FROM sums, totals),
prior AS (SELECT ln(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0)) AS bias FROM samples)"""
_TRAIN = (b.SAMPLES_SQL, COUNTS_SQL, VOCABULARY_SQL)
SCORES_SQL = f"""{word_terms_sql('documents', 'doc_id').replace('word_tok', 'all_tok').replace('word_counts', 'all_words')},
  {char_terms_sql('documents', 'doc_id').replace('char_words', 'all_split').replace('char_counts', 'all_chars')},
  all_counts AS (SELECT doc, 'word' AS block, term, tf FROM all_words
    UNION ALL SELECT doc, 'char' AS block, term, tf FROM all_chars),
  parts AS (SELECT doc, block, sum((1 + ln(tf)) * idf * coef) / sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS z
    FROM all_counts JOIN vocabulary USING (block, term) JOIN nb USING (block, term) GROUP BY 1, 2),
  scores AS (SELECT doc_id AS post_id, 1 / (1 + exp(-(coalesce(z, 0) + bias))) AS score
    FROM documents LEFT JOIN (SELECT doc, sum(z) AS z FROM parts GROUP BY 1) ON doc = doc_id, prior)"""


def counts_of_classes(t: Tables):
    return ev.class_counts(b.samples(t))


def weights(t: Tables):
    return ev.balanced_weights(b.samples(t)).select("doc", "label", F.round("weight", 6).alias("weight"))


def frequencies(t: Tables):
    samples = b.samples(t)
    n = samples.agg(F.count("*").alias("n"))
    out = fe.doc_frequency(fe.word_term_counts(samples), n)
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


FREQUENCIES_SQL = sql(
    *_TRAIN, body="SELECT term, df, round(idf, 6) AS idf FROM vocabulary WHERE block = 'word'"
)


def _vocabulary(samples, counts):
    return fe.doc_frequency(counts, samples.agg(F.count("*").alias("n")))


def tfidf_word(t: Tables):
    samples = b.samples(t)
    counts = fe.word_term_counts(samples)  # counted twice: that is less than to write and read the counts
    return fe.tfidf(counts, _vocabulary(samples, counts)).select("doc", "term", F.round("value", 6).alias("value"))


def tfidf_char(t: Tables):
    """Per document: terms, largest and summed weight (one row per term would be millions)."""
    samples = b.samples(t)
    counts = fe.char_term_counts(samples)
    rows = fe.tfidf_totals(counts, _vocabulary(samples, counts))
    return rows.select("doc", "terms", F.round("largest", 6).alias("largest"), F.round("total", 5).alias("total"))


TFIDF_CHAR_SQL = sql(
    *_TRAIN,
    TFIDF_SQL,
    body="""SELECT doc, count(*) AS terms, round(max(value), 6) AS largest, round(sum(value), 5) AS total
      FROM tfidf WHERE block = 'char' GROUP BY 1""",
)


def folds(t: Tables):
    return ev.cv_folds(b.samples(t))


FOLDS_SQL = """folds AS (
  SELECT doc, label, (row_number() OVER (PARTITION BY label ORDER BY md5(doc || '42'), doc) - 1) % 5 AS fold FROM samples)"""


def _fit_nb(t: Tables):
    samples = b.samples(t)
    return learn.train("nb", fe.TextCounts(samples), samples.select("doc", "label"))


def nb_weights(t: Tables):
    return _fit_nb(t).terms.select("block", "term", F.round("idf", 6).alias("idf"), F.round(F.col("coef")[0], 6).alias("coef"))


def nb_scores(t: Tables):
    posts = t.documents.select(F.col("doc_id").alias("post_id"), "text")
    return learn.score_posts(posts, _fit_nb(t)).select("post_id", F.round("score", 6).alias("score"))


def nb_filter(t: Tables):
    model = _fit_nb(t)
    model.threshold = 0.875
    posts = t.documents.select(F.col("doc_id").alias("post_id"), "text", "lang")
    kept = learn.ml_filter(posts, model).where("relevant")
    return kept.select("post_id", "lang", F.round("score", 6).alias("score"))


CV_SQL = sql(
    b.SAMPLES_SQL,
    COUNTS_SQL,
    FOLDS_SQL,
    "models AS (SELECT unnest(range(0, 5)) AS model)",
    "sizes AS (SELECT model, count(*) AS n FROM models JOIN folds ON fold <> model GROUP BY 1)",
    """vocabulary AS (
      SELECT model, block, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
      FROM counts JOIN folds USING (doc) JOIN sizes ON fold <> model GROUP BY 1, 2, 3 HAVING count(*) >= 2)""",
    """raw AS (SELECT model, doc, label, fold, block, term, (1 + ln(tf)) * idf AS raw
      FROM counts JOIN folds USING (doc) JOIN vocabulary USING (block, term))""",
    "norms AS (SELECT model, doc, block, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2, 3)",
    "tfidf AS (SELECT raw.*, raw / norm AS value FROM raw JOIN norms USING (model, doc, block))",
    """sums AS (SELECT model, block, term, sum(CASE WHEN label = 1 THEN value ELSE 0 END) AS s1,
      sum(CASE WHEN label = 0 THEN value ELSE 0 END) AS s0 FROM tfidf WHERE fold <> model GROUP BY 1, 2, 3)""",
    "totals AS (SELECT model, sum(s1) + count(*) AS t1, sum(s0) + count(*) AS t0 FROM sums GROUP BY 1)",
    "nb AS (SELECT model, block, term, ln((s1 + 1) / t1) - ln((s0 + 1) / t0) AS coef FROM sums JOIN totals USING (model))",
    """prior AS (SELECT model, ln(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0)) AS bias
      FROM models JOIN folds ON fold <> model GROUP BY 1)""",
    """logits AS (SELECT doc, model, sum(value * coef) AS z FROM tfidf JOIN nb USING (model, block, term)
      WHERE fold = model GROUP BY 1, 2)""",
    body="""SELECT f.doc, f.label, round(1 / (1 + exp(-(coalesce(z, 0) + bias))), 6) AS score
      FROM folds f JOIN prior p ON p.model = f.fold LEFT JOIN logits l ON l.doc = f.doc AND l.model = f.fold""",
)


def nb_out_of_fold(t: Tables):
    samples = b.samples(t)
    folded = cut(ev.cv_folds(samples, "doc", 5))
    scored = learn.cv_out_of_fold("nb", samples, fe.TextCounts(samples), folded)
    return scored.select("doc", "label", F.round("score", 6).alias("score"))


# ---- reports and thresholds on a cheap score: events ---------------------------------------

_SCORED_SQL = """scored AS (SELECT value / (value + 10) AS score,
    CASE WHEN value * 6 + CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 1 ELSE 0 END AS label FROM events)"""


def _scored(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        (F.col("value") / (F.col("value") + 10)).alias("score"),
        F.when(F.col("value") * 6 + k > 90, 1).otherwise(0).alias("label"),
    )


def report(t: Tables):
    return ev.classification_report(_scored(t).withColumn("prediction", (F.col("score") >= 0.5).cast("int")))


REPORT_SQL = sql(
    _SCORED_SQL,
    """c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (label = 0 AND score >= 0.5)::DOUBLE AS fp,
      count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE AS fn, count(*) FILTER (label = 0 AND score < 0.5)::DOUBLE AS tn FROM scored)""",
    """m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
      tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, tp + fn AS s1,
      (tp + tn) / (tp + tn + fp + fn) AS acc FROM c)""",
    """r AS (SELECT '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
      UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
      UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM m
      UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
      UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
        (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)""",
    body="""SELECT row, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1,
      CAST(support AS BIGINT) AS support FROM r""",
)


def best_f1(t: Tables):
    return ev.threshold_macro_f1(_scored(t)).select(
        F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1")
    )


_F1_GRID = """grid AS (SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS t FROM range(0, 91) g(i)),
  cells_f1 AS (SELECT t, count(*) FILTER (label = 1 AND score >= t)::DOUBLE AS tp, count(*) FILTER (label = 0 AND score >= t)::DOUBLE AS fp,
      count(*) FILTER (label = 1 AND score < t)::DOUBLE AS fn, count(*) FILTER (label = 0 AND score < t)::DOUBLE AS tn
      FROM scored, grid GROUP BY 1),
  f AS (SELECT t, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1 FROM cells_f1)"""
BEST_F1_SQL = sql(
    _SCORED_SQL,
    _F1_GRID,
    body="SELECT round(t, 6) AS threshold, round(f1, 6) AS macro_f1 FROM f ORDER BY round(f1, 12) DESC, t LIMIT 1",
)


def best_precision(t: Tables):
    return ev.threshold_target_precision(_scored(t), 0.8).select(
        F.round("threshold", 6).alias("threshold"), F.round("recall", 6).alias("recall")
    )


BEST_PRECISION_SQL = sql(
    _SCORED_SQL,
    "s AS (SELECT score, count(*) AS n, count(*) FILTER (label = 1) AS pos FROM scored GROUP BY 1)",
    """c AS (SELECT score, sum(n) OVER w AS called, sum(pos) OVER w AS tp FROM s
      WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
    body="""SELECT round(score, 6) AS threshold, round(tp / (SELECT sum(pos) FROM s), 6) AS recall
      FROM c WHERE tp / called >= 0.8 ORDER BY score LIMIT 1""",
)

# ---- logistic regression and the calibrated SVM ---------------------------------------------
#
# The statements find the same optimum another way: with weights written as sums over documents, only products of
# documents are needed, and accelerated gradient steps on one number per document and model end where the solver does.


#: What gradients must shrink by where results are compared digit by digit.
CLOSE = 1e-8


def _fitted_scores(t: Tables, name: str):
    samples = b.samples(t)
    counts = written(fe.term_counts(samples), "term-counts")
    model = learn.train(name, counts, samples.select("doc", "label"), tol=CLOSE)
    scored = learn.score_counts(samples, counts, model)
    return samples.select("doc", "label").join(scored, "doc").select("doc", "label", F.round("score", 4).alias("score"))


def logreg_out_of_fold(t: Tables):
    samples = b.samples(t)
    counts, folded = learn.prepare(samples)
    scored = learn.cv_out_of_fold("logreg", samples, counts, folded, tol=CLOSE)
    return scored.select("doc", "label", F.round("score", 4).alias("score"))


def benchmark(t: Tables):
    return learn.benchmark_models(b.samples(t))


def tuned(t: Tables):
    model = learn.fit_and_tune(b.samples(t), "logreg", tol=CLOSE)
    coef = F.round(F.col("coef")[0], 4).alias("coef")
    return model.terms.select("block", "term", coef).withColumn("threshold", F.round(F.lit(model.threshold), 6))


def _products_sql(source: str, constant: int) -> str:
    """Products of documents within a model's space; `constant` adds one to all, a weight shared by all documents."""
    return f"""numbered AS MATERIALIZED (SELECT doc, row_number() OVER (ORDER BY doc) AS i FROM samples),
  placed AS MATERIALIZED (SELECT space, i, block, term, value FROM {source} JOIN numbered USING (doc)),
  shared AS MATERIALIZED (
    SELECT a.space, a.i, b.i AS j, sum(a.value * b.value) AS k FROM placed a JOIN placed b USING (space, block, term) GROUP BY 1, 2, 3),
  cells AS (SELECT s.space, x.i, y.i AS j FROM (SELECT DISTINCT space FROM placed) s, numbered x, numbered y),
  k AS MATERIALIZED (SELECT space, i, j, {constant} + coalesce(k, 0) AS k FROM cells LEFT JOIN shared USING (space, i, j))"""


def _weighted_sql(learns: str) -> str:
    """Balanced weights of the documents each model (m, space) learns from; needs `models` and `folds`."""
    return f"""weighted AS MATERIALIZED (
    SELECT m, space, i, y, CASE WHEN learns THEN sum(CAST(learns AS INT)) OVER (PARTITION BY m) / (2.0 * sum(CAST(learns AS INT)) OVER (PARTITION BY m, label)) ELSE 0 END AS c
    FROM (SELECT m, space, i, label, CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END AS y, {learns} AS learns FROM folds JOIN numbered USING (doc), models))"""


def _descent_sql(loss: str, steps: int) -> str:
    """Accelerated gradient steps on lists, a row per model: beta by document, b the intercept; `z` has the margins at the end."""
    free = int(loss == "logistic")  # the intercept is a number of its own
    curve, slope = (0.25, "-c[i] * y[i] / (1 + exp(y[i] * (z[i] + vb)))") if free else (2.0, "-2 * c[i] * y[i] * greatest(0, 1 - y[i] * z[i])")
    return f"""matrices AS MATERIALIZED (
    SELECT space, list(line ORDER BY i) AS k FROM (SELECT space, i, list(k ORDER BY j) AS line FROM k GROUP BY 1, 2) GROUP BY 1),
  bound AS (
    SELECT m, 1 + {curve} * sum(c * (k + {free})) AS l FROM weighted w JOIN k ON k.space = w.space AND k.i = w.i AND k.j = w.i GROUP BY 1),
  models_at AS MATERIALIZED (
    SELECT m, any_value(space) AS space, list(c ORDER BY i) AS c, list(y ORDER BY i) AS y, range(1, count(*) + 1) AS every FROM weighted GROUP BY m),
  setup AS MATERIALIZED (SELECT models_at.*, k, l, (sqrt(l) - 1) / (sqrt(l) + 1) AS q FROM models_at JOIN matrices USING (space) JOIN bound USING (m)),
  steps AS (
    SELECT 0 AS step, m, list_transform(every, lambda i: 0.0::DOUBLE) AS beta, list_transform(every, lambda i: 0.0::DOUBLE) AS last,
      0.0::DOUBLE AS b, 0.0::DOUBLE AS last_b FROM setup
    UNION ALL
    SELECT step + 1, m, list_transform(every, lambda i: v[i] - (v[i] + r[i]) / l), beta, {'vb - list_sum(r) / l' if free else '0.0::DOUBLE'}, b FROM (
      SELECT *, list_transform(every, lambda i: {slope}) AS r FROM (
        SELECT *, list_transform(k, lambda line: list_dot_product(line, v)) AS z FROM (
          SELECT steps.*, every, k, c, y, l, list_transform(every, lambda i: beta[i] + q * (beta[i] - last[i])) AS v, b + q * (b - last_b) AS vb
          FROM steps JOIN setup USING (m) WHERE step < {steps})))),
  ended AS MATERIALIZED (SELECT m, beta, b, k FROM steps JOIN setup USING (m) WHERE step = {steps}),
  solved AS MATERIALIZED (SELECT m, unnest(range(1, len(beta) + 1)) AS i, unnest(beta) AS beta, b FROM ended),
  z AS MATERIALIZED (
    SELECT m, unnest(range(1, len(beta) + 1)) AS i, unnest(list_transform(k, lambda line: list_dot_product(line, beta))) + b AS z FROM ended)"""


_ONE_SPACE = "one_space AS (SELECT 0 AS space, doc, block, term, value FROM tfidf)"
LOGREG_SQL = sql(
    *_TRAIN,
    TFIDF_SQL,
    _ONE_SPACE,
    _products_sql("one_space", 0),
    "models AS (SELECT 0 AS m, 0 AS space)",
    "folds AS (SELECT doc, label FROM samples)",
    _weighted_sql("TRUE"),
    _descent_sql("logistic", 700),
    body="SELECT doc, label, round(1 / (1 + exp(-z)), 4) AS score FROM z JOIN numbered USING (i) JOIN samples USING (doc)",
).replace("WITH ", "WITH RECURSIVE ", 1)
SVM_SQL = sql(
    *_TRAIN,
    TFIDF_SQL,
    _ONE_SPACE,
    _products_sql("one_space", 1),
    "models AS (SELECT m, 0 AS space FROM range(0, 5) r(m))",
    "folds AS (SELECT doc, label, (row_number() OVER (PARTITION BY label ORDER BY md5(doc || '7'), doc) - 1) % 5 AS inn FROM samples)",
    _weighted_sql("inn <> m"),
    _descent_sql("squared_hinge", 1500),
    """held AS MATERIALIZED (
    SELECT m, z, CASE WHEN label = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS want, n1, n0 FROM (
      SELECT m, z, label, (count(*) FILTER (WHERE label = 1) OVER (PARTITION BY m))::DOUBLE AS n1, (count(*) FILTER (WHERE label = 0) OVER (PARTITION BY m))::DOUBLE AS n0
      FROM z JOIN numbered USING (i) JOIN folds USING (doc) WHERE inn = m))""",
    """platt AS (
    SELECT 0 AS step, m, 0.0::DOUBLE AS a, ln((any_value(n1) + 1) / (any_value(n0) + 1)) AS o FROM held GROUP BY m
    UNION ALL
    SELECT step + 1, m, a - (hoo * ga - hao * go) / (haa * hoo - hao * hao), o - (haa * go - hao * ga) / (haa * hoo - hao * hao) FROM (
      SELECT any_value(step) AS step, m, any_value(a) AS a, any_value(o) AS o, sum((p - want) * z) AS ga, sum(p - want) AS go,
        sum(p * (1 - p) * z * z) AS haa, sum(p * (1 - p) * z) AS hao, sum(p * (1 - p)) AS hoo
      FROM (SELECT step, platt.m, a, o, z, want, 1 / (1 + exp(-(a * z + o))) AS p FROM platt JOIN held ON held.m = platt.m WHERE step < 40) GROUP BY m))""",
    body="""SELECT doc, any_value(label) AS label, round(avg(1 / (1 + exp(-(a * z + o)))), 4) AS score
      FROM z JOIN platt ON platt.m = z.m AND step = 40 JOIN numbered USING (i) JOIN samples USING (doc) GROUP BY doc""",
).replace("WITH ", "WITH RECURSIVE ", 1)

def _spaces_sql(last: int) -> list[str]:
    """tf-idf of all documents in each space: without fold 0 … 4, and with all documents where last is 6."""
    return [
        FOLDS_SQL.replace("folds AS (", "folds AS MATERIALIZED ("),
        f"spaces AS (SELECT unnest(range(0, {last})) AS space)",
        "sizes AS (SELECT space, count(*) AS n FROM spaces JOIN folds ON fold <> space GROUP BY 1)",
        """space_terms AS MATERIALIZED (
      SELECT space, block, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
      FROM counts JOIN folds USING (doc) JOIN sizes ON fold <> space GROUP BY 1, 2, 3 HAVING count(*) >= 2)""",
        "space_raw AS MATERIALIZED (SELECT space, doc, block, term, (1 + ln(tf)) * idf AS raw FROM counts JOIN space_terms USING (block, term))",
        "space_norms AS (SELECT space, doc, block, sqrt(sum(raw * raw)) AS norm FROM space_raw GROUP BY 1, 2, 3)",
        "space_values AS MATERIALIZED (SELECT space, doc, block, term, raw / norm AS value FROM space_raw JOIN space_norms USING (space, doc, block))",
        _products_sql("space_values", 0),
        "models AS (SELECT space AS m, space FROM spaces)",
        _weighted_sql("fold <> m"),
        _descent_sql("logistic", 700),
    ]


CV_LOGREG_SQL = sql(
    b.SAMPLES_SQL,
    COUNTS_SQL,
    *_spaces_sql(5),
    body="""SELECT doc, label, round(1 / (1 + exp(-z)), 4) AS score FROM z JOIN numbered USING (i) JOIN folds USING (doc) WHERE fold = m""",
).replace("WITH ", "WITH RECURSIVE ", 1)
TUNED_SQL = sql(
    b.SAMPLES_SQL,
    COUNTS_SQL,
    *_spaces_sql(6),
    "scored AS MATERIALIZED (SELECT label, 1 / (1 + exp(-z)) AS score FROM z JOIN numbered USING (i) JOIN folds USING (doc) WHERE fold = m)",
    _F1_GRID,
    """chosen AS (SELECT round(t, 6) AS threshold FROM f ORDER BY round(f1, 12) DESC, t LIMIT 1)""",
    body="""SELECT block, term, round(sum(beta * value), 4) AS coef, any_value(threshold) AS threshold
      FROM solved JOIN numbered USING (i) JOIN space_values v ON v.doc = numbered.doc AND v.space = 5, chosen WHERE m = 5 GROUP BY block, term""",
).replace("WITH ", "WITH RECURSIVE ", 1)


def bundle(t: Tables):
    """A classifier saved, loaded again and applied with its own threshold."""
    path = work_path(t.spark, "bundle")
    model = _fit_nb(t)
    model.threshold, model.metadata = 0.875, {"model": "nb"}
    learn.save_bundle(model, path)
    loaded = learn.load_bundle(t.spark, path)
    posts = t.documents.select(F.col("doc_id").alias("post_id"), "text")
    return learn.ml_filter(posts, loaded).groupBy("relevant").agg(F.count("*").alias("n")).select(
        F.col("relevant").cast("int").alias("relevant"), F.lit(loaded.metadata["model"]).alias("model"), "n"
    )


QUERIES = {
    "class_counts": (
        counts_of_classes,
        "SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM documents JOIN labels USING (doc_id)",
    ),
    "balanced_weights": (
        weights,
        sql(
            b.SAMPLES_SQL,
            body="""SELECT doc, label, round((SELECT count(*) FROM samples) / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight
              FROM samples""",
        ),
    ),
    "doc_frequency": (frequencies, FREQUENCIES_SQL),
    "tfidf_word": (
        tfidf_word,
        sql(*_TRAIN, TFIDF_SQL, body="SELECT doc, term, round(value, 6) AS value FROM tfidf WHERE block = 'word'"),
    ),
    "tfidf_char": (tfidf_char, TFIDF_CHAR_SQL),
    "cv_folds": (folds, sql(b.SAMPLES_SQL, FOLDS_SQL, body="SELECT doc, label, fold FROM folds")),
    "cv_out_of_fold": (nb_out_of_fold, CV_SQL),
    "train_nb": (
        nb_weights,
        sql(
            *_TRAIN,
            TFIDF_SQL,
            NB_SQL,
            body="SELECT block, term, round(idf, 6) AS idf, round(coef, 6) AS coef FROM nb JOIN vocabulary USING (block, term)",
        ),
    ),
    "score_posts": (
        nb_scores,
        sql(*_TRAIN, TFIDF_SQL, NB_SQL, SCORES_SQL, body="SELECT post_id, round(score, 6) AS score FROM scores"),
    ),
    "ml_filter": (
        nb_filter,
        sql(
            *_TRAIN,
            TFIDF_SQL,
            NB_SQL,
            SCORES_SQL,
            body="""SELECT post_id, lang, round(score, 6) AS score FROM scores JOIN documents ON doc_id = post_id
              WHERE score >= 0.875""",
        ),
    ),
    "model_bundle": (
        bundle,
        sql(
            *_TRAIN,
            TFIDF_SQL,
            NB_SQL,
            SCORES_SQL,
            body="SELECT CAST(score >= 0.875 AS INT) AS relevant, 'nb' AS model, count(*) AS n FROM scores GROUP BY 1",
        ),
    ),
    "classification_report": (report, REPORT_SQL),
    "threshold_macro_f1": (best_f1, BEST_F1_SQL),
    "threshold_target_precision": (best_precision, BEST_PRECISION_SQL),
    "train_logreg": (lambda t: _fitted_scores(t, "logreg"), LOGREG_SQL),
    "train_svm": (lambda t: _fitted_scores(t, "svm"), SVM_SQL),
    "cv_logreg": (logreg_out_of_fold, CV_LOGREG_SQL),
    "benchmark_models": (benchmark, None),
    "fit_and_tune": (tuned, TUNED_SQL),
}
