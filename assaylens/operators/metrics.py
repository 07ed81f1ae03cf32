"""Curves and classification metrics from score value counts.

Inputs are ``(keys, score, pos, neg)`` with one row for each distinct score: the size of both
classes at that score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.config import METRICS
from assaylens.functions.ordered import largest_group, running
from assaylens.session import lookup, materialise


def score_counts(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", n: str | None = None) -> DataFrame:
    """Collapse scored rows to distinct scores, materialised."""
    size = F.lit(1) if n is None else F.col(n)
    return materialise(
        scored.groupBy(*keys, F.col(score).alias("score")).agg(
            F.sum(size * F.col(label)).cast("double").alias("pos"),
            F.sum(size * (1 - F.col(label))).cast("double").alias("neg"),
        ),
        "scores",
    )


def _cumulative(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    largest = largest_group(counts, keys)
    totals = lookup(
        counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")), "totals", largest
    )
    sums = {"tp": ("sum", "pos"), "fp": ("sum", "neg")}
    return running(counts, keys, "score", sums, descending=True, largest=largest).join(totals, keys)


def roc_points(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All points of the ROC curve from (0, 0) on; the first has no threshold."""
    keys = list(keys)
    inner = _cumulative(counts, keys).select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "all_neg").alias("fpr"),
        F.try_divide("tp", "all_pos").alias("tpr"),
    )
    start = counts.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return inner.withColumn("threshold", F.col("threshold").cast("double")).unionByName(start)


def roc_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve; missing when a group has one class only.

    Every distinct score adds the trapezoid neg x (tp before + tp after) / 2.
    """
    keys = list(keys)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return (
        _cumulative(counts, keys)
        .groupBy(*keys)
        .agg(
            F.max("all_pos").cast("bigint").alias("n_pos"),
            F.max("all_neg").cast("bigint").alias("n_neg"),
            F.try_divide(area, F.max("all_pos") * F.max("all_neg")).alias("auc"),
        )
    )


def _precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)


def pr_points(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall at every score, plus the end point (recall 0, precision 1)."""
    keys = list(keys)
    inner = _cumulative(counts, keys).select(
        *keys,
        F.col("score").cast("double").alias("threshold"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.try_divide("tp", "all_pos").alias("recall"),
    )
    end = counts.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return inner.unionByName(end)


def pr_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under the precision-recall points."""
    keys = list(keys)
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    height = (_precision(F.col("tp"), F.col("fp")) + _precision(before_tp, before_fp)) / 2
    return (
        _cumulative(counts, keys)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum(F.col("pos") * height), F.max("all_pos")).alias("pr_auc_trapezoid"))
    )


def prevalence(scored: DataFrame, label: str = "label", n: str | None = None) -> DataFrame:
    """Mean label over all rows of all models, each model's rows counted."""
    size = F.lit(1) if n is None else F.col(n)
    return scored.agg(F.sum(size).cast("bigint").alias("n"), (F.sum(size * F.col(label)) / F.sum(size)).alias("prevalence"))


def confusion(scored: DataFrame, keys: Sequence[str], actual: str = "label", predicted: str = "predicted", n: str | None = None) -> DataFrame:
    """The four cells for each group, empty ones included, from one aggregation."""
    size = F.lit(1) if n is None else F.col(n)
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    wide = scored.groupBy(*keys).agg(
        *[
            F.sum(F.when((F.col(actual) == a) & (F.col(predicted) == p), size).otherwise(0)).cast("bigint").alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    stacked = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n"))
                for a, p in cells
            ]
        )
    )
    return wide.select(*keys, stacked.alias("c")).select(*keys, "c.actual", "c.predicted", "c.n")


def classification_metrics(scored: DataFrame, keys: Sequence[str], n: str | None = None) -> DataFrame:
    """AUC, accuracy, precision, recall and F1 of ``(keys, label, prob)`` rows.

    A prediction is positive above 0.5. Undefined ratios are 0, and a group with one class
    only has AUC 0.5.
    """
    keys = list(keys)
    size = F.lit(1) if n is None else F.col(n)
    hit = F.when(F.col("score") > 0.5, 1).otherwise(0)
    counts = score_counts(scored, keys, "prob", n=n)
    cells = counts.groupBy(*keys).agg(
        F.sum(F.col("pos") * hit).alias("tp"),
        F.sum(F.col("neg") * hit).alias("fp"),
        F.sum(F.col("pos") * (1 - hit)).alias("fn"),
        F.sum(F.col("neg") * (1 - hit)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return (
        cells.join(roc_auc(counts, keys), keys)
        .select(
            *keys,
            F.coalesce("auc", F.lit(0.5)).alias("auc"),
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        )
    )


def mean_metrics(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of each metric over the folds."""
    return fold_metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def compare_models(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Comparison table: mean metrics rounded half to even at four digits."""
    return mean_metrics(fold_metrics, keys).select(*keys, *[F.bround(m, 4).alias(m) for m in METRICS])


def comparison_long(comparison: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The comparison as (keys, metric, value), known metrics only."""
    known = [m for m in METRICS if m in comparison.columns]
    return comparison.unpivot(list(keys), known, "metric", "value")


def best_model(comparison: DataFrame, order: dict[str, int]) -> DataFrame:
    """The model with the highest AUC of each response; ties go to the lower order number."""
    place = F.create_map(*[x for name, i in order.items() for x in (F.lit(name), F.lit(i))])[F.col("model")]
    pick = Window.partitionBy("response").orderBy(F.col("auc").desc(), place, "model")
    return comparison.withColumn("_rank", F.row_number().over(pick)).filter("_rank = 1").drop("_rank")


def auc_summary(fold_auc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of the fold AUCs."""
    return fold_auc.groupBy(*keys).agg(
        F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std")
    )
