"""Two-class tests of every (response, feature) pair from one aggregated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.functions.ordered import (
    average_rank,
    largest_group,
    mid_ranks,
    null_safe_join,
    quantiles,
    running,
)
from assaylens.functions.tails import correlation_p_value, rank_sum_p_value
from assaylens.operators.labels import drop_missing
from assaylens.session import lookup, materialise, materialise_counted

PAIR = ["response", "feature"]


def contrast_counts(labelled: DataFrame, features: DataFrame, panel: Sequence[str] | None = None) -> DataFrame:
    """Class sizes ``n1`` and ``n0`` of every (response, feature, value), materialised.

    The entity x response x feature product is folded into counts straight after the join, by
    a map-side combine, and never sorted. With *panel*, *features* are the non-zero rows only
    and the zero row of each panel feature follows from the class totals.
    """
    sized = [
        F.sum("label").cast("double").alias("n1"),
        F.sum(1 - F.col("label")).cast("double").alias("n0"),
    ]
    slim = labelled.select("entity_id", "response", "label")
    stored = (
        slim.join(features.select("entity_id", "feature", F.col("v").cast("double").alias("v")), "entity_id")
        .groupBy(*PAIR, "v")
        .agg(*sized)
    )
    if panel is None:
        return materialise(stored, "contrast")
    stored = stored.filter(F.col("feature").isin(list(panel)) & (F.col("v") != 0))
    seen = stored.groupBy(*PAIR).agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    grid = slim.groupBy("response").agg(*sized).withColumn(
        "feature", F.explode(F.array(*[F.lit(name) for name in panel]))
    )
    zeros = (
        grid.join(seen, PAIR, "left")
        .select(
            *PAIR,
            F.lit(0.0).alias("v"),
            (F.col("n1") - F.coalesce("s1", F.lit(0.0))).alias("n1"),
            (F.col("n0") - F.coalesce("s0", F.lit(0.0))).alias("n0"),
        )
        .filter("n1 + n0 > 0")
    )
    return materialise(stored.unionByName(zeros), "contrast")


def counts_from_patterns(patterns: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same counts from collapsed ``(response, label, n, x)`` rows; materialised."""
    names = F.array(*[F.lit(f) for f in features])
    cells = patterns.select(
        "response", "label", "n", F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("v"))).alias("e")
    )
    return materialise(
        cells.groupBy("response", F.col("e.feature").alias("feature"), F.col("e.v").alias("v")).agg(
            F.sum(F.col("n") * F.col("label")).cast("double").alias("n1"),
            F.sum(F.col("n") * (1 - F.col("label"))).cast("double").alias("n0"),
        ),
        "contrast",
    )


def rank_sum(counts: DataFrame, keys: Sequence[str], value: str = "v", largest: int | None = None) -> DataFrame:
    """Two-sided Mann-Whitney test of class 1 against class 0 for each group of *keys*.

    *counts* is materialised with one row for each (keys, value) and the class sizes ``n1``
    and ``n0``. Groups whose classes are both constant, or with an empty class, get U 0, p 1.
    """
    keys = list(keys)
    sized = counts.withColumn("t", F.col("n1") + F.col("n0"))
    ranked = mid_ranks(sized, keys, value, "t", "rank", largest=largest)
    sums = ranked.groupBy(*keys).agg(
        F.sum("n1").alias("size1"),
        F.sum("n0").alias("size0"),
        F.sum(F.col("n1") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
        F.count_if(F.col("n1") > 0).alias("levels1"),
        F.count_if(F.col("n0") > 0).alias("levels0"),
    )
    flat = (
        (F.col("size1") == 0)
        | (F.col("size0") == 0)
        | ((F.col("levels1") <= 1) & (F.col("levels0") <= 1))
    )
    u = F.col("rank_sum") - F.col("size1") * (F.col("size1") + 1) / 2
    tested = sums.withColumn("u_open", F.when(~flat, u))
    p = rank_sum_p_value("u_open", "size1", "size0", "ties")
    return tested.select(
        *keys,
        F.coalesce("u_open", F.lit(0.0)).alias("u_statistic"),
        F.coalesce(p, F.lit(1.0)).alias("p_value"),
    )


def adjust_fdr(
    tests: DataFrame, family: Sequence[str] = ("response",), p: str = "p_value", largest: int | None = None
) -> DataFrame:
    """Benjamini-Hochberg ``p_adjusted`` within each family of the materialised *tests*.

    Equal p-values share one adjusted value, so the ordering runs over distinct p-values; a
    family too large for one window is cut into ranges by :func:`running`. A test without a p stays,
    without an adjusted one, and is no member of its family; a missing family is one of its own.
    """
    family = list(family)
    having = tests.where(F.col(p).isNotNull())
    counts = materialise(having.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")), "p-values")
    if largest is None:
        largest = largest_group(counts, family)
    sizes = lookup(counts.groupBy(*family).agg(F.sum("_n").alias("_size")), "families", largest)
    upto = running(counts, family, p, {"_cum": ("sum", "_n")}, largest=largest)
    raw = null_safe_join(upto, sizes, family).withColumn(
        "_raw", F.least(F.lit(1.0), F.col(p) * F.col("_size") / F.col("_cum"))
    )
    adjusted = running(raw, family, p, {"p_adjusted": ("min", "_raw")}, descending=True, largest=largest)
    return null_safe_join(tests, adjusted.select(*family, p, "p_adjusted"), [*family, p], "left")


def tests_from_counts(counts: DataFrame) -> DataFrame:
    tests, rows = materialise_counted(rank_sum(counts, PAIR), "tests")
    return adjust_fdr(tests, largest=rows).select(*PAIR, "u_statistic", "p_value", "p_adjusted")


def significant_counts(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many features pass the adjusted threshold, for each response."""
    return tests.groupBy("response").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("p_adjusted") < alpha).alias("n_significant"),
    )


def bonferroni(tests: DataFrame, alpha: float = 0.05, n_tests: int | None = None) -> DataFrame:
    """Flag the tests whose p times the number of tests stays within alpha."""
    size = tests.count() if n_tests is None else n_tests
    return tests.withColumns(
        {
            "n_tests": F.lit(size).cast("bigint"),
            "significant": (F.col("p_value") * size <= alpha).cast("int"),
        }
    )


def effect_sizes(counts: DataFrame) -> DataFrame:
    """Cohen's d with class means, from the value counts of :func:`contrast_counts`.

    Means first, then squared deviations from them, so large values do not cancel.
    """
    v = F.col("v")
    means = counts.groupBy(*PAIR).agg(
        F.sum("n1").alias("size1"),
        F.sum("n0").alias("size0"),
        (F.sum(F.col("n1") * v)).alias("total1"),
        (F.sum(F.col("n0") * v)).alias("total0"),
    ).withColumns(
        {
            "mean1": F.try_divide("total1", "size1"),
            "mean0": F.try_divide("total0", "size0"),
        }
    )
    means = materialise(means, "means")
    spread = (
        counts.join(means, PAIR)
        .groupBy(*PAIR, "size1", "size0", "mean1", "mean0")
        .agg(
            F.sum(F.col("n1") * (v - F.coalesce("mean1", F.lit(0.0))) ** 2).alias("square1"),
            F.sum(F.col("n0") * (v - F.coalesce("mean0", F.lit(0.0))) ** 2).alias("square0"),
        )
    )
    free = F.col("size1") + F.col("size0") - 2
    square = F.col("square1") + F.col("square0")
    pooled = F.sqrt(F.when((free > 0) & (square > 0), square / free))
    d = F.when(pooled.isNotNull(), (F.col("mean1") - F.col("mean0")) / pooled).otherwise(0.0)
    return spread.select(
        *PAIR,
        d.alias("cohens_d"),
        F.abs(d).alias("abs_cohens_d"),
        F.col("mean1").alias("mean_sensitive"),
        F.col("mean0").alias("mean_resistant"),
    )


def _centred(ranked: DataFrame, sizes: DataFrame, out: str) -> DataFrame:
    """Ranks less the middle one of their response, so that products of large ranks don't cancel."""
    return ranked.join(sizes, "response").withColumn(out, F.col("rank") - F.col("middle")).drop("rank", "middle")


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of ``score`` with ``y`` for each response of ``(response, score, y)``.

    Both margins are ranked as value counts. The score ranks are summed into the y counts, so
    the pairs are never joined back to their y rank.
    """
    counts = materialise(
        pairs.groupBy("response", "score", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "pairs"
    )
    margin, levels = materialise_counted(
        counts.groupBy("response", "score").agg(F.sum("n").alias("n")), "score-counts"
    )
    sizes = lookup(margin.groupBy("response").agg(((F.sum("n") + 1) / 2).alias("middle")), "sizes", levels)
    scores = materialise(
        _centred(mid_ranks(margin, ["response"], "score", "n", "rank", largest=levels), sizes, "score_rank"), "score-ranks"
    )
    by_y, values = materialise_counted(
        counts.join(scores.select("response", "score", "score_rank"), ["response", "score"])
        .groupBy("response", "y")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score_rank")).alias("score_ranks")),
        "y-ranks",
    )
    ranked = _centred(mid_ranks(by_y, ["response"], "y", "n", "rank", largest=values), sizes, "y_rank")
    sides = (
        ranked.groupBy("response")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("y_levels"),
            F.sum(F.col("score_ranks") * F.col("y_rank")).alias("xy"),
            F.sum(F.col("n") * F.col("y_rank") * F.col("y_rank")).alias("yy"),
        )
        .join(
            scores.groupBy("response").agg(
                F.count(F.lit(1)).alias("score_levels"),
                F.sum(F.col("n") * F.col("score_rank") * F.col("score_rank")).alias("xx"),
            ),
            "response",
        )
    )
    varied = (F.col("y_levels") > 1) & (F.col("score_levels") > 1)
    quotient = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    rho = F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), quotient)))
    return (
        sides.select("response", F.col("n").cast("bigint").alias("n"), rho.alias("spearman_rho"))
        .withColumn("p_value", correlation_p_value("spearman_rho", F.col("n").cast("double")))
    )


def planned_spearman(responses: DataFrame, scores: DataFrame, plan: DataFrame) -> DataFrame:
    """Spearman rows for every planned response, with a note where there is nothing to rank."""
    pairs = drop_missing(responses).join(scores.select("entity_id", "score"), "entity_id")
    listed = responses.select("response").distinct().withColumn("listed", F.lit(True))
    note = (
        F.when(F.col("listed").isNull(), "response absent")
        .when(F.col("n").isNull(), "no joined rows")
        .otherwise("")
    )
    return (
        plan.join(listed, "response", "left")
        .join(spearman(pairs.select("response", "score", "y")), "response", "left")
        .select(
            "response_id",
            "response_name",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
            "spearman_rho",
            "p_value",
            note.alias("note"),
        )
    )


def subgroup_sensitivity(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """Compare the response between members (flag 1) and the others, for each response.

    *groups* is ``(entity_id, flag)``. Gives both sizes, both medians and the rank-sum p.
    """
    counts, rows = materialise_counted(
        drop_missing(responses)
        .join(groups.select("entity_id", "flag"), "entity_id")
        .groupBy("response", "y")
        .agg(
            F.sum("flag").cast("double").alias("n1"),
            F.sum(1 - F.col("flag")).cast("double").alias("n0"),
        ),
        "subgroups",
    )
    sides = materialise(
        counts.unpivot(["response", "y"], ["n1", "n0"], "side", "n").filter("n > 0"), "sides"
    )
    medians = quantiles(sides, ["response", "side"], "y", "n", {"median": 0.5}, rows)
    sizes = sides.groupBy("response", "side").agg(F.sum("n").alias("n"))
    wide = (
        medians.join(sizes, ["response", "side"])
        .groupBy("response")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n_{name}")
                for side, name in (("n1", "member"), ("n0", "other"))
            ],
            *[
                F.max(F.when(F.col("side") == side, F.col("median"))).alias(f"median_{name}")
                for side, name in (("n1", "member"), ("n0", "other"))
            ],
        )
    )
    tests = rank_sum(counts, ["response"], "y", rows).select("response", "u_statistic", "p_value")
    return wide.join(tests, "response")


def biomarker_summary(attribution: DataFrame, tests: DataFrame, effects: DataFrame) -> DataFrame:
    """Outer-join the three kinds of evidence and rank the features of each response."""
    merged = (
        attribution.select(*PAIR, "mean_abs_shap")
        .join(tests.select(*PAIR, "u_statistic", "p_value", "p_adjusted"), PAIR, "full_outer")
        .join(effects.select(*PAIR, "cohens_d", "abs_cohens_d"), PAIR, "full_outer")
        .fillna({"mean_abs_shap": 0.0, "p_adjusted": 1.0, "abs_cohens_d": 0.0})
    )
    evidence, largest = materialise_counted(merged, "evidence")
    ranked = average_rank(evidence, ["response"], "mean_abs_shap", "shap_rank", True, largest)
    ranked = average_rank(ranked, ["response"], "p_adjusted", "pval_rank", False, largest)
    ranked = average_rank(ranked, ["response"], "abs_cohens_d", "effect_rank", True, largest)
    return ranked.withColumn(
        "composite_rank", F.col("shap_rank") + F.col("pval_rank") + F.col("effect_rank")
    ).select(
        *PAIR,
        "mean_abs_shap",
        "u_statistic",
        "p_value",
        "p_adjusted",
        "cohens_d",
        "abs_cohens_d",
        "shap_rank",
        "pval_rank",
        "effect_rank",
        "composite_rank",
    )


def association_matrix(effects: DataFrame, responses: Sequence[str], value: str = "cohens_d") -> DataFrame:
    """Features as rows, one column for each response."""
    return effects.groupBy("feature").pivot("response", list(responses)).agg(F.first(value))
