"""Relevance classifiers: three candidates, out-of-fold scores, tuning, bundle, scoring.

Every candidate ends as a few linear rules, p = mean of sigmoid(bias + sum(coef * feature)), stored as a
relation (block, term, idf, coef) with one coefficient per rule: one rule for logistic regression and naive
Bayes, five for the calibrated SVM, whose fold models are averaged. Scoring is a join on terms and a sum per
document, so neither vocabulary nor documents pass through the driver. All models of a cross-validation are
fitted together, on one scan of the counts (`solver.design`).
"""

from __future__ import annotations

import platform
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.evaluate import (
    class_counts,
    classification_report,
    cv_folds,
    threshold_macro_f1,
    threshold_target_precision,
)
from postloom.operators.features import BROADCAST_TERMS, CONSTANT, TextCounts, term_counts, whole_docs
from postloom.operators.postings import TOLD_NUMBERS, Postings, ToldTerms
from postloom.operators.solver import LOGISTIC, SQUARED_HINGE, Design, Fit, class_sizes, design, sigmoids, solve
from postloom.session import cut, forget, written

# The candidates and the shortest text of a sample.
CANDIDATES = ["logreg", "svm", "nb"]
MIN_TEXT_LENGTH = 30
CALIBRATION_FOLDS = 5
CERTAIN = 30.0
#: A fit ends when its gradient has shrunk by this.
TOLERANCE = 1e-6


@dataclass
class LinearModel:
    """Term weights plus biases, one of each per rule; `threshold` and `metadata` travel with them in a bundle."""

    terms: DataFrame
    bias: list[float]
    threshold: float = 0.5
    metadata: dict[str, str] = field(default_factory=dict)
    _told: ToldTerms | None = field(default=None, repr=False, compare=False)

    def told(self) -> ToldTerms | None:
        """The term table for every worker, made once, or None if it is too large for that."""
        if self._told is None and self.terms.count() * (2 + len(self.bias)) <= TOLD_NUMBERS:
            self._told = ToldTerms(self.terms, len(self.bias))
        return self._told


def _sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_scores(counts: DataFrame, terms: DataFrame, rules: int) -> DataFrame:
    """(doc, z_0, …) for documents with a known term: weighted sums of unit-length features, one per rule.

    The term table is measured. While it fits, the terms of a document meet it where the document lies, so no
    n-gram moves; beyond that both sides are shuffled by term. The sums are the same.
    """
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    raw = (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf")
    dots = [F.sum(raw * F.col("coef")[i]).alias(f"dot_{i}") for i in range(rules)]
    parts = counts.join(terms, ["block", "term"]).groupBy("doc", "block").agg(*dots, F.sum(raw * raw).alias("square"))
    return parts.groupBy("doc").agg(*[F.sum(F.col(f"dot_{i}") / F.sqrt("square")).alias(f"z_{i}") for i in range(rules)])


def _mean_probability(columns) -> Column:
    return sum((_sigmoid(c) for c in columns[1:]), _sigmoid(columns[0])) / F.lit(float(len(columns)))


def score_counts(docs: DataFrame, counts: DataFrame, model: LinearModel) -> DataFrame:
    """(doc, score) for every document; one without known terms gets the prior."""
    z = docs.select("doc").join(linear_scores(counts, model.terms, len(model.bias)), "doc", "left")
    return z.select("doc", _mean_probability([F.coalesce(f"z_{i}", F.lit(0.0)) + F.lit(x) for i, x in enumerate(model.bias)]).alias("score"))


def score_posts(posts: DataFrame, model: LinearModel, doc: str = "post_id", text: str = "text") -> DataFrame:
    """Probability of class 1 per post.

    The term table is measured. While every worker can hold it, a post is counted and scored where it lies, and no n-gram
    moves; beyond that both are joined by term. Then every post has the constant feature, whose weights are the biases: no
    post is lost by the join. The scores are the same.
    """
    docs = posts.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    if (told := model.told()) is not None:
        return told.scores(whole_docs(docs), list(model.bias)).withColumnRenamed("doc", doc)
    bias = posts.sparkSession.createDataFrame([(*CONSTANT, 1.0, list(model.bias))], "block string, term string, idf double, coef array<double>")
    terms = model.terms.select("block", "term", "idf", "coef").union(bias)
    z = linear_scores(term_counts(docs, constant=True), terms, len(model.bias))
    return z.select(F.col("doc").alias(doc), _mean_probability([F.col(f"z_{i}") for i in range(len(model.bias))]).alias("score"))


def ml_filter(posts: DataFrame, model: LinearModel, doc: str = "post_id", text: str = "text") -> DataFrame:
    """Posts with `score` and `relevant` (score >= threshold)."""
    scored = posts.join(score_posts(posts, model, doc, text), doc)
    return scored.withColumn("relevant", F.col("score") >= F.lit(model.threshold))


def _naive_bayes(data: Design, fits: list[Fit], margins: bool) -> tuple[DataFrame, list[float], DataFrame | None]:
    """Multinomial naive Bayes with add-one smoothing for every fit: weights, intercepts, documents with `margins` if asked."""
    models, spaces = range(len(fits)), [f.space for f in fits]
    members = [F.when(f.learns() & (F.col("label") == y), 1.0).otherwise(0.0).alias(f"s{y}_{m}") for m, f in enumerate(fits) for y in (0, 1)]
    names = [f"s{y}_{m}" for m in models for y in (0, 1)]
    sums = data.gradients(data.docs.select("doc", *members), names, [s for s in spaces for _ in (0, 1)])
    filled = [F.coalesce(n, F.lit(0.0)).alias(n) for n in names]
    idfs = sorted({f"idf_{s}" for s in spaces})
    sums = written(data.terms.select("tid", *idfs).join(sums, "tid", "left").select("tid", *idfs, *filled), "class-sums")
    known = {m: F.col(f"idf_{fits[m].space}").isNotNull() for m in models}
    totals = sums.agg(*[F.sum(F.when(known[m], F.col(f"s{y}_{m}") + 1)) for m in models for y in (0, 1)]).first()

    def coef(m: int):
        share = [F.log((F.col(f"s{y}_{m}") + 1) / F.lit(float(totals[2 * m + y] or 1.0))) for y in (0, 1)]
        return F.when(known[m], share[1] - share[0]).otherwise(0.0).alias(f"w_{m}")

    weights = written(sums.select("tid", *[coef(m) for m in models]), "weights")
    bias = _priors(data.docs, fits)
    if not margins:
        return weights, bias, None
    return weights, bias, written(_with_margins(data.docs, data.margins(weights, [f"w_{m}" for m in models], spaces), bias), "margins")


def _priors(docs: DataFrame, fits: list[Fit]) -> list[float]:
    """Intercepts of naive Bayes; with one class absent the other is certain."""
    return [CERTAIN if not s[0] else -CERTAIN if not s[1] else float(np.log(s[1] / s[0])) for s in class_sizes(docs, fits)]


def _with_margins(docs: DataFrame, sums: DataFrame, bias: list[float]) -> DataFrame:
    """`docs` with the margins z_0, …: `sums` (doc, w_0, …), 0 where there is no row, and the intercepts."""
    z = [(F.coalesce(f"w_{m}", F.lit(0.0)) + F.lit(x)).alias(f"z_{m}") for m, x in enumerate(bias)]
    return docs.join(sums, "doc", "left").select(*docs.columns, *z)


def _numbered(docs: DataFrame) -> bool:
    """Whether documents have numbers for ids, as postings need."""
    return dict(docs.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint")


@dataclass
class Rule:
    """One term of a model's mean: sigmoid(slope * margin of the fit + offset)."""

    fit: int
    slope: float = 1.0
    offset: float = 0.0


@dataclass
class Fitted:
    """The fits of some models, laid out by term and by document, and the rules of each model."""

    weights: DataFrame
    intercepts: list[float]
    docs: DataFrame | None
    rules: list[list[Rule]]

    def score(self, model: int):
        """Probability of a document by one model, from its margins."""
        return _mean_probability([F.lit(r.slope) * F.col(f"z_{r.fit}") + F.lit(r.offset) for r in self.rules[model]])

    def model(self, data: Design, model: int, space: int) -> LinearModel:
        coef = F.array(*[F.lit(r.slope) * F.col(f"w_{r.fit}") for r in self.rules[model]]).alias("coef")
        idf = F.col(f"idf_{space}")
        terms = data.terms.where(idf.isNotNull()).join(self.weights, "tid").select("block", "term", idf.alias("idf"), coef)
        bias = [r.slope * float(self.intercepts[r.fit]) + r.offset for r in self.rules[model]]
        return LinearModel(written(terms, "terms"), bias)


def _fit_all(name: str, data: Design, c: float, tol: float, margins: bool = True) -> Fitted:
    """One model for each space of the design, which learns from the documents outside the space's fold."""
    if name not in CANDIDATES:
        raise ValueError(f"unknown model: {name}")
    outer = list(enumerate(data.spaces))
    if name == "nb":
        fits = [Fit(i, s) for i, s in outer]
        weights, bias, docs = _naive_bayes(data, fits, margins)
        return Fitted(weights, bias, docs, [[Rule(i)] for i, _ in outer])
    if name == "logreg":
        fits, loss = [Fit(i, s) for i, s in outer], LOGISTIC
    else:
        fits, loss = [Fit(i, s, j) for i, s in outer for j in range(CALIBRATION_FOLDS)], SQUARED_HINGE
    solved = solve(data, fits, loss, c, tol)
    curves = [(1.0, 0.0)] * len(fits) if name == "logreg" else sigmoids(solved.docs, fits)
    rules = [[] for _ in outer]
    for m, (fit, sizes) in enumerate(zip(fits, class_sizes(data.docs, fits))):
        certain = not sizes[0] or not sizes[1]
        rules[fit.space].append(Rule(m, 0.0, -CERTAIN if not sizes[1] else CERTAIN) if certain else Rule(m, *curves[m]))
    return Fitted(solved.weights, solved.intercepts.tolist(), solved.docs, rules)


def _with_inner(folds: DataFrame) -> DataFrame:
    """Folds for the calibration, dealt once over all documents."""
    inner = cv_folds(folds, "doc", CALIBRATION_FOLDS, seed=7).select("doc", F.col("fold").alias("inner"))
    return folds.select("doc", "label", "fold").join(inner, "doc")


def train(
    name: str, counts: DataFrame | TextCounts, labels: DataFrame, c: float = 1.0, min_df: int = 2, tol: float = TOLERANCE
) -> LinearModel:
    """Fit one candidate on term counts (doc, block, term, tf), or the texts that have them, and labels (doc, label)."""
    docs = _with_inner(labels.select("doc", "label", F.lit(0).alias("fold")))
    if isinstance(counts, TextCounts):
        if name == "nb" and _numbered(counts.docs):
            data = Postings(counts.docs, docs, [None], [Fit()], min_df)
            bias = _priors(data.docs, data.fits)
            terms = written(data.terms(data.totals(), 0), "terms")
            data.close()
            return LinearModel(terms, bias)
        laid = written(counts.rows(), "term-counts")
        model = train(name, laid, labels, c, min_df, tol)
        forget(laid)
        return model
    with design(counts, docs, [None], min_df) as data:
        return _fit_all(name, data, c, tol, margins=False).model(data, 0, 0)


def _out_of_fold(fitted: Fitted, k: int) -> DataFrame:
    scores = F.coalesce(*[F.when(F.col("fold") == i, fitted.score(i)) for i in range(k)])
    return fitted.docs.select("doc", "label", scores.alias("score"))


def cv_out_of_fold(
    name: str, docs: DataFrame, counts: DataFrame | TextCounts, folds: DataFrame, k: int = 5, c: float = 1.0, min_df: int = 2, tol: float = TOLERANCE
) -> DataFrame:
    """(doc, label, score) scored by a model that never saw the document.

    Vocabulary and idf leave out the held-out fold: totals less the fold's share, for all folds at once.
    """
    if isinstance(counts, TextCounts):
        if name == "nb" and _numbered(counts.docs):
            data = Postings(counts.docs, _with_inner(folds), list(range(k)), [Fit(i, i) for i in range(k)], min_df)
            bias = _priors(data.docs, data.fits)
            fitted = Fitted(None, bias, _with_margins(data.docs, data.margins(data.totals()), bias), [[Rule(i)] for i in range(k)])
            scored = written(_out_of_fold(fitted, k), "out-of-fold")
            data.close()
            return scored
        laid = written(counts.rows(), "term-counts")
        scored = cv_out_of_fold(name, docs, laid, folds, k, c, min_df, tol)
        forget(laid)
        return scored
    with design(counts, _with_inner(folds), list(range(k)), min_df) as data:
        return written(_out_of_fold(_fit_all(name, data, c, tol), k), "out-of-fold")


def prepare(samples: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Shared inputs of training: token counts and fold numbers, each computed once."""
    return written(term_counts(samples), "term-counts"), cut(cv_folds(samples, "doc", k))


def benchmark_models(samples: DataFrame, names: list[str] | None = None, k: int = 5, c: float = 1.0, tol: float = TOLERANCE) -> DataFrame:
    """Cross-validated report of each candidate, all on one design; class 1 is called from 0.5."""
    counts, folds = prepare(samples, k)
    reports = None
    with design(counts, _with_inner(folds), list(range(k))) as data:
        for name in names or CANDIDATES:
            scored = written(_out_of_fold(_fit_all(name, data, c, tol), k), "out-of-fold")
            called = scored.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
            report = classification_report(called).withColumn("model", F.lit(name))
            reports = report if reports is None else reports.unionByName(report)
    return reports


def fit_and_tune(
    samples: DataFrame, name: str = "logreg", c: float = 1.0, k: int = 5, target_precision: float | None = None, tol: float = TOLERANCE
) -> LinearModel:
    """Choose the threshold on out-of-fold scores; the model itself learns from all rows. Both come from one design."""
    counts, folds = prepare(samples, k)
    with design(counts, _with_inner(folds), [*range(k), None]) as data:
        fitted = _fit_all(name, data, c, tol)
        scored = written(_out_of_fold(fitted, k), "out-of-fold")
        model = fitted.model(data, k, k)
    chosen = (
        threshold_macro_f1(scored)
        if target_precision is None
        else threshold_target_precision(scored, target_precision)
    ).first()
    sizes = class_counts(folds).first()
    model.threshold = float(chosen["threshold"])
    model.metadata = {
        "trained_at": datetime.now().isoformat(timespec="seconds"),
        "n_train": str(sizes["positives"] + sizes["negatives"]),
        "relevant": str(sizes["positives"]),
        "irrelevant": str(sizes["negatives"]),
        "model": name,
        "C": str(c),
        "threshold": str(model.threshold),
        "min_text_length": str(MIN_TEXT_LENGTH),
        "spark_version": samples.sparkSession.version,
        "python_version": platform.python_version(),
    }
    return model


def save_bundle(model: LinearModel, path: str) -> None:
    """Term weights and one head row (biases, threshold, metadata), as Parquet."""
    spark = model.terms.sparkSession
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    head = spark.createDataFrame(
        [([float(x) for x in model.bias], float(model.threshold), dict(model.metadata))],
        "bias array<double>, threshold double, metadata map<string,string>",
    )
    head.write.mode("overwrite").parquet(f"{path}/head")


def load_bundle(spark, path: str) -> LinearModel:
    head = spark.read.parquet(f"{path}/head").first()
    return LinearModel(
        spark.read.parquet(f"{path}/terms"), list(head["bias"]), head["threshold"], dict(head["metadata"] or {})
    )
