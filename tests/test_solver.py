"""The distributed solver against MLlib, against dense algebra, and folds fitted together against folds fitted alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postloom.operators import learn, solver
from postloom.operators.features import term_counts

SCHEMA = "doc long, block string, term string, tf long"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    labels = [(i, int(rng.random() < 0.35)) for i in range(90)]
    counts = []
    for i, y in labels:
        for block in ("word", "char"):
            for t in set(rng.integers(0, 30, 7).tolist() + [30 + 2 * int(rng.integers(0, 4)) + (y if rng.random() < 0.8 else 1 - y)]):
                counts.append((i, block, f"t{t}", int(rng.integers(1, 4))))
    counts.append((3, "word", "once", 1))
    return spark.createDataFrame(counts, SCHEMA).cache(), spark.createDataFrame(labels, "doc long, label int").cache()


def _folds(labels, k=3):
    return labels.select("doc", "label", (F.col("doc") % k).cast("int").alias("fold"), (F.col("doc") / k % 4).cast("int").alias("inner"))


def _dense(laid, space=0):
    terms = {r.tid: j for j, r in enumerate(laid.terms.select("tid").orderBy("tid").collect())}
    docs = {r.doc: i for i, r in enumerate(laid.docs.orderBy("doc").collect())}
    x = np.zeros((len(docs), len(terms)))
    for r in laid.by_doc.collect():
        x[docs[r.doc], terms[r.tid]] = r[f"v_{space}"]
    y = np.array([1.0 if r.label == 1 else -1.0 for r in laid.docs.orderBy("doc").collect()])
    return x, y, terms


def test_logistic_regression_is_that_of_mllib(spark, data):
    counts, labels = data
    docs = labels.select("doc", "label", F.lit(0).alias("fold"), F.lit(0).alias("inner"))
    with solver.design(counts, docs, [None]) as laid:
        solved = solver.solve(laid, [solver.Fit()], solver.LOGISTIC, c=2.0, tol=1e-8)
        x, y, terms = _dense(laid)
        got = np.zeros(len(terms))
        for r in solved.weights.collect():
            got[terms[r.tid]] = r.w_0
        margins = np.array([r.z_0 for r in solved.docs.orderBy("doc").collect()])
    n, ones = len(y), (y > 0).sum()
    weight = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones)))
    rows = [(float(y[i] > 0), float(weight[i]), Vectors.dense(x[i])) for i in range(n)]
    mllib = LogisticRegression(weightCol="weight", regParam=1 / (2.0 * n), standardization=False, maxIter=1000, tol=1e-12)
    fitted = mllib.fit(spark.createDataFrame(rows, ["label", "weight", "features"]))
    assert got == pytest.approx(fitted.coefficients.toArray(), abs=1e-4)
    assert float(solved.intercepts[0]) == pytest.approx(fitted.intercept, abs=1e-4)
    assert margins == pytest.approx(x @ got + solved.intercepts[0], abs=1e-9)
    residual = -2.0 * weight * y / (1 + np.exp(y * margins))
    gradient = np.append(got + x.T @ residual, residual.sum())
    assert np.linalg.norm(gradient) <= 1e-6 * solved.first_gradient[0] and solved.gradient[0] <= 1e-8 * solved.first_gradient[0]


@pytest.mark.parametrize("loss", [solver.LOGISTIC, solver.SQUARED_HINGE])
def test_passes_over_relations_make_the_steps_of_one_task(data, loss):
    counts, labels = data
    fits = [solver.Fit(0, 0), solver.Fit(1, 1, 2)]
    with solver.design(counts, _folds(labels), [0, 1]) as laid:
        ways = [solver.solve(laid, fits, loss, tol=1e-2, most=3, in_task=n) for n in (0, 10**9)]
        found = [
            (w.intercepts, w.gradient, [list(r) for r in w.weights.orderBy("tid").collect()], [list(r) for r in w.docs.orderBy("doc").collect()]) for w in ways
        ]
    for a, b in zip(*found):
        assert np.array(a, float) == pytest.approx(np.array(b, float), abs=1e-9)


def test_squared_hinge_gradient_vanishes_for_every_fit(data):
    counts, labels = data
    fits = [solver.Fit(s, s, j) for s in range(3) for j in range(4)]
    with solver.design(counts, _folds(labels), [0, 1, 2]) as laid:
        solved = solver.solve(laid, fits, solver.SQUARED_HINGE, tol=1e-7)
        rows = laid.docs.orderBy("doc").collect()
        weights = {r.tid: r for r in solved.weights.collect()}
        for m, fit in enumerate(fits):
            x, y, terms = _dense(laid, fit.space)
            w = np.array([weights[t][f"w_{m}"] for t in terms])
            own = np.array([r.fold != fit.out and r.inner != fit.inn for r in rows])
            size = {s: (y[own] == s).sum() for s in (1, -1)}
            c = np.array([own.sum() / (2 * size[s]) for s in y]) * own
            z = x @ w + solved.intercepts[m]
            residual = -2 * c * y * np.maximum(0, 1 - y * z)
            gradient = np.append(w + x.T @ residual, solved.intercepts[m] + residual.sum())
            assert np.linalg.norm(gradient) <= 1e-5 * solved.first_gradient[m]


def test_sigmoids_are_the_minimum(spark):
    rng = np.random.default_rng(1)
    rows = [(int(z + rng.normal() > 0.3), int(i % 2), 0, float(z), float(2 * z - 1)) for i, z in enumerate(rng.normal(size=200))]
    docs = spark.createDataFrame(rows, "label int, inner int, fold int, z_0 double, z_1 double")
    fits = [solver.Fit(0, None, 0), solver.Fit(0, None, 1)]
    for m, (a, b) in enumerate(solver.sigmoids(docs, fits)):
        held = [r for r in rows if r[1] == m]
        n1 = sum(r[0] for r in held)
        want = np.array([(n1 + 1) / (n1 + 2) if r[0] else 1 / (len(held) - n1 + 2) for r in held])
        x = np.array([r[3 + m] for r in held])
        p = 1 / (1 + np.exp(-(a * x + b)))
        assert abs(((p - want) * x).sum()) < 1e-6 and abs((p - want).sum()) < 1e-6


@pytest.mark.parametrize("name", ["nb", "logreg"])
def test_folds_fitted_together_equal_folds_fitted_alone(data, name):
    counts, labels = data
    folds = _folds(labels).drop("inner")
    together = {r.doc: r.score for r in learn.cv_out_of_fold(name, labels, counts, folds, k=3, tol=1e-8).collect()}
    assert len(together) == 90
    for i in range(3):
        alone = learn.train(name, counts, folds.where(F.col("fold") != i), tol=1e-8)
        held = folds.where(F.col("fold") == i)
        for r in learn.score_counts(held, counts.join(held.select("doc"), "doc", "left_semi"), alone).collect():
            assert together[r.doc] == pytest.approx(r.score, abs=1e-6)


def test_calibrated_svm_is_a_mean_of_five(data):
    counts, labels = data
    model = learn.train("svm", counts, labels)
    assert len(model.bias) == learn.CALIBRATION_FOLDS and {len(r.coef) for r in model.terms.collect()} == {5}
    scores = {r.doc: r.score for r in learn.score_counts(labels, counts, model).collect()}
    truth = {r.doc: r.label for r in labels.collect()}
    assert sum((scores[d] >= 0.5) == truth[d] for d in truth) >= 80


@pytest.mark.parametrize("name", ["nb", "logreg", "svm"])
def test_one_class_is_certain_and_nothing_is_no_error(spark, data, name):
    counts, labels = data
    ones = labels.where("label = 1")
    model = learn.train(name, counts, ones)
    assert all(r.score > 0.999 for r in learn.score_counts(ones, counts, model).collect())
    assert all(r.score < 0.001 for r in learn.score_counts(ones, counts, learn.train(name, counts, labels.where("label = 0"))).collect())
    assert learn.train(name, counts, labels.limit(0)).terms.count() == 0


def _texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["груз", "смена", "диван", "оплата", "x1", "y22", "ночь"], rng.integers(1, 12))), int(rng.integers(0, 2))) for i in range(60)]
    rows += [(3, "груз груз ночь", 1), (3, "смена", 0), (4, rows[4][1], rows[4][2]), (70, None, 1), (71, "", 0)]
    return spark.createDataFrame(rows, "doc long, text string, label int")


def _rounded(frame):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else [round(y, 9) for y in x] if isinstance(x, list) else x for x in r) for r in frame.collect())


def test_packed_postings_equal_rows_of_counts(spark, monkeypatch):
    from postloom.operators import features, postings

    # batches and slices of a few entries; documents with several rows, a null and an empty text
    for name in ("PACKED", "SLICED"):
        monkeypatch.setattr(postings, name, 40)
    samples = _texts(spark)
    labels, lazy = samples.select("doc", "label"), features.TextCounts(samples)
    rows = lazy.rows().localCheckpoint()
    packed, plain = learn.train("nb", lazy, labels), learn.train("nb", rows, labels)
    columns = ["block", "term", "idf", "coef"]
    assert _rounded(packed.terms.select(columns)) == _rounded(plain.terms.select(columns)) and packed.bias == plain.bias
    folds = labels.withColumn("fold", (F.col("doc") % 3).cast("int"))
    scores = [learn.cv_out_of_fold("nb", samples, c, folds, k=3) for c in (lazy, rows)]
    assert _rounded(scores[0]) == _rounded(scores[1])
    none = learn.train("nb", features.TextCounts(samples.limit(0)), labels.limit(0))
    assert none.terms.count() == 0


def test_scores_without_moving_a_term_equal_the_join(spark, monkeypatch):
    samples = _texts(spark)
    model = learn.train("nb", term_counts(samples), samples.select("doc", "label"))
    posts = samples.select(F.col("doc").cast("string").alias("post_id"), "text").unionByName(spark.createDataFrame([(None, "груз")], "post_id string, text string"))

    def scores():
        return {r.post_id: r.score if r.score is None else round(r.score, 9) for r in learn.score_posts(posts, model).collect()}

    told = scores()
    model._told = None
    monkeypatch.setattr(learn, "TOLD_NUMBERS", 0)
    # null and empty texts get the prior; a null id is a row of its own
    assert told == scores() and told["70"] == told["71"] and None in told
    found = learn.score_posts(posts, model)._jdf.queryExecution().executedPlan().toString()
    model._told = None
    monkeypatch.setattr(learn, "TOLD_NUMBERS", 10**6)
    assert "Join" in found and "Join" not in learn.score_posts(posts, model)._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_slices_of_an_array():
    from postloom.operators.postings import hashes

    terms = pa.array(["", "a", "b", "ab", "ba", "жук", "a a"])
    found = hashes(terms)
    assert len(set(found.tolist())) == 7 and hashes(terms[3:6]).tolist() == found[3:6].tolist() and len(hashes(terms[:0])) == 0
