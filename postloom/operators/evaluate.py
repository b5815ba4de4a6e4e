"""Class counts, stratified folds, reports and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.ordered import RUN, row_numbers, scan, split_runs

DEFAULT_THRESHOLD = 0.5
# 91 thresholds from 0.05 in steps of 0.01.
THRESHOLDS = 91
METRICS = ["precision", "recall", "f1"]


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )


def balanced_weights(labelled: DataFrame) -> DataFrame:
    """Weight n / (2 n_class) per row. The joined side has one row per class."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("_size"))
    total = labelled.agg(F.count("*")).scalar()
    return (
        labelled.join(sizes, "label")
        .withColumn("weight", total / (F.lit(2.0) * F.col("_size")))
        .drop("_size")
    )


def cv_folds(labelled: DataFrame, doc: str = "doc", k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: rows of a class in hashed order are dealt out in turn.

    A window per class would put each class into one task; the ranks are scanned instead.
    """
    keyed = labelled.select(
        doc, "label", F.md5(F.concat(F.col(doc).cast("string"), F.lit(str(seed)))).alias("_shuffle")
    )
    ranked = row_numbers(keyed, ["label"], ["_shuffle", doc])
    return ranked.select(doc, "label", ((F.col("rn") - 1) % k).alias("fold"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    One pass counts the four cells; everything after works on that one row.
    """
    y, p = F.col("label"), F.col("prediction")
    cells = scored.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    # step by step, so that no ratio is written out more than once
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per_class = cells.select(
        *_class_metrics("0", hit=tn, false=fn, missed=fp),
        *_class_metrics("1", hit=tp, false=fp, missed=fn),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        (tp + fp + fn + tn).alias("total"),
    )
    averages = per_class.select(
        "*",
        *[((F.col(f"{m}_0") + F.col(f"{m}_1")) / 2).alias(f"macro_{m}") for m in METRICS],
        *[
            _ratio(
                F.col(f"{m}_0") * F.col("support_0") + F.col(f"{m}_1") * F.col("support_1"), F.col("total")
            ).alias(f"weighted_{m}")
            for m in METRICS
        ],
    )
    names = {
        "0": [f"{m}_0" for m in METRICS] + ["support_0"],
        "1": [f"{m}_1" for m in METRICS] + ["support_1"],
        "accuracy": ["accuracy"] * 3 + ["total"],
        "macro avg": [f"macro_{m}" for m in METRICS] + ["total"],
        "weighted avg": [f"weighted_{m}" for m in METRICS] + ["total"],
    }
    rows = [
        F.struct(
            F.lit(row).alias("row"),
            *[F.round(c, 3).alias(m) for c, m in zip(columns, METRICS)],
            F.col(columns[3]).cast("bigint").alias("support"),
        )
        for row, columns in names.items()
    ]
    return averages.select(F.inline(F.array(*rows)))


def _class_metrics(name: str, hit: Column, false: Column, missed: Column) -> list[Column]:
    return [
        _ratio(hit, hit + false).alias(f"precision_{name}"),
        _ratio(hit, hit + missed).alias(f"recall_{name}"),
        _ratio(2 * hit, 2 * hit + false + missed).alias(f"f1_{name}"),
        (hit + missed).alias(f"support_{name}"),
    ]


def threshold_macro_f1(scored: DataFrame) -> DataFrame:
    """Best of 91 thresholds by macro-F1, the lowest on ties; 0.5 without any row.

    Scores are reduced to counts per (passed thresholds, label): at most 184 rows. Only those
    are accumulated.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1)), lambda i: F.lit(0.05) + i * F.lit(0.01))
    passed = F.size(F.filter(grid, lambda t: t <= F.col("score")))
    counted = scored.groupBy("score", "label").agg(F.count("*").alias("n"))
    counted = counted.groupBy(passed.alias("passed")).agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"),
    )
    every = scored.sparkSession.range(THRESHOLDS + 1).select(F.col("id").cast("int").alias("passed"))
    counted = every.join(counted, "passed", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = counted.select(
        "passed",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(totals).alias("all_pos"),
        F.sum("neg").over(totals).alias("all_neg"),
    ).where("passed > 0")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    f1 = (_ratio(2 * tp, 2 * tp + fp + fn) + _ratio(2 * tn, 2 * tn + fp + fn)) / 2
    index = F.col("passed") - 1
    best = cells.where(F.col("all_pos") + F.col("all_neg") > 0).agg(
        F.max_by(F.struct(index.alias("i"), f1.alias("f1")), F.struct(F.round(f1, 12), -index)).alias("best")
    )
    return best.select(
        F.coalesce(F.lit(0.05) + F.col("best.i") * F.lit(0.01), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("best.f1"), F.lit(-1.0)).alias("macro_f1"),
    )


def threshold_target_precision(scored: DataFrame, target: float) -> DataFrame:
    """Among the scores as thresholds: most recall with precision >= target, 0.5 if none.

    Recall never grows with the threshold, so that is the lowest score reaching the target.
    The cumulative counts run over range partitions, as scores may be as many as rows.
    """
    counts = scored.groupBy("score").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos")
    )
    order = [F.col("score").desc()]
    runs = split_runs(counts, [], order)
    sums = scan(runs, [], order, {"called": ("sum", F.col("n")), "tp": ("sum", F.col("pos"))}).drop(RUN)
    positives = scored.agg(F.count_if(F.col("label") == 1)).scalar()
    reached = sums.where(F.col("tp") / F.col("called") >= target)
    best = reached.agg(F.min_by(F.struct("score", "tp"), "score").alias("best"))
    return best.select(
        F.coalesce(F.col("best.score"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce(_ratio(F.col("best.tp"), positives), F.lit(-1.0)).alias("recall"),
    )


def evaluate_extraction(predicted: DataFrame, expected: DataFrame, attributes: list[str]) -> DataFrame:
    """Confusion counts (attribute, expected, predicted, n) over posts in both relations."""
    pairs = predicted.alias("p").join(expected.alias("e"), "post_id")
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("attribute"),
                    F.coalesce(F.col(f"e.{a}"), F.lit("")).alias("expected"),
                    F.coalesce(F.col(f"p.{a}"), F.lit("")).alias("predicted"),
                )
                for a in attributes
            ]
        )
    )
    return pairs.select(cells).groupBy("attribute", "expected", "predicted").agg(F.count("*").alias("n"))
