"""Feature attributions for linear and boosted models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylens.operators.boosting import VECTORS, boosted_margin, deal
from assaylens.operators.logistic import ALL_ROWS
from assaylens.session import lookup, materialise

PAIR = ["response", "feature"]


def closed_form_logit(counts: DataFrame) -> DataFrame:
    """Unpenalised one-feature logistic fit on a 0/1 feature: the log odds ratio.

    Missing where a cell of the 2x2 table is empty, since no finite fit exists.
    """

    def cell(column: str, v: int):
        return F.sum(F.when(F.col("v") == v, F.col(column)).otherwise(0.0))

    cells = counts.groupBy(*PAIR).agg(
        cell("n1", 1).alias("hit1"), cell("n0", 1).alias("hit0"), cell("n1", 0).alias("none1"), cell("n0", 0).alias("none0")
    )
    full = (F.col("hit1") > 0) & (F.col("hit0") > 0) & (F.col("none1") > 0) & (F.col("none0") > 0)
    return cells.select(
        *PAIR,
        F.when(full, F.ln(F.col("none1") / F.col("none0"))).alias("intercept"),
        F.when(full, F.ln(F.col("hit1") * F.col("none0") / (F.col("hit0") * F.col("none1")))).alias("coefficient"),
    )


def long_coefficients(models: DataFrame, features: Sequence[str], column: str = "coefficients") -> DataFrame:
    """Coefficients of the whole-data models as (response, feature, coefficient)."""
    names = F.array(*[F.lit(f) for f in features])
    return (
        models.filter((F.col("held_out") == ALL_ROWS) & (F.col("note") == ""))
        .select("response", F.explode(F.arrays_zip(names.alias("feature"), F.col(column).alias("coefficient"))).alias("e"))
        .select("response", "e.feature", "e.coefficient")
    )


def linear_attribution(counts: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Mean absolute and mean signed attribution b * (x - mean x), from value counts."""
    size = F.col("n1") + F.col("n0")
    means = counts.groupBy(*PAIR).agg((F.sum(size * F.col("v")) / F.sum(size)).alias("mean_v"))
    phi = F.col("coefficient") * (F.col("v") - F.col("mean_v"))
    return (
        counts.join(materialise(means, "means"), PAIR)
        .join(coefficients.select(*PAIR, "coefficient"), PAIR)
        .filter("coefficient IS NOT NULL")
        .groupBy(*PAIR)
        .agg(
            (F.sum(size * F.abs(phi)) / F.sum(size)).alias("mean_abs_shap"),
            (F.sum(size * phi) / F.sum(size)).alias("mean_signed_shap"),
        )
    )


def attribution_rows(labelled: DataFrame, dense: DataFrame, counts: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Attribution of every (response, entity, feature) before it is averaged."""
    size = F.col("n1") + F.col("n0")
    means = counts.groupBy(*PAIR).agg((F.sum(size * F.col("v")) / F.sum(size)).alias("mean_v"))
    # its size decides the join with the whole product
    centred = materialise(means.join(coefficients.select(*PAIR, "coefficient"), PAIR), "centred")
    return (
        labelled.select("response", "entity_id")
        .join(dense, "entity_id")
        .join(centred, PAIR)
        .select(
            "response",
            "entity_id",
            "feature",
            F.col("v").alias("value"),
            (F.col("coefficient") * (F.col("v") - F.col("mean_v"))).alias("phi"),
        )
    )


def coefficient_importance(coefficients: DataFrame) -> DataFrame:
    """Fallback evidence of a linear model: size and sign of each coefficient."""
    return coefficients.select(
        *PAIR,
        F.abs("coefficient").alias("mean_abs_shap"),
        F.signum("coefficient").alias("direction"),
        F.lit("coef fallback").alias("note"),
    )


def tree_importance(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fallback evidence of a boosted model: its impurity importances, which add up to 1.

    A tree counts the gains of its splits over the rows at its root.
    """
    names = F.array(*[F.lit(f) for f in features])
    whole = models.filter((F.col("held_out") == ALL_ROWS) & (F.col("note") == ""))
    root = F.get("cover", (F.col("i") - F.col("i") % F.col("nodes")).cast("int"))
    splits = whole.select("response", "nodes", "cover", F.posexplode(F.arrays_zip("feature", "gain")).alias("i", "s"))
    share = F.when(F.col("s.feature") >= 0, F.col("s.gain") / root).otherwise(0.0)
    sums = splits.select("response", F.col("s.feature").alias("pos"), share.alias("share")).groupBy("response", "pos").agg(F.sum("share").alias("share"))
    total = F.sum("share").over(Window.partitionBy("response"))
    sums = sums.where("pos >= 0").withColumn("share", F.col("share") / total)
    every = whole.select("response", F.posexplode(names).alias("pos", "feature"))
    return every.join(sums, ["response", "pos"], "left").select("response", "feature", F.coalesce("share", F.lit(0.0)).alias("mean_abs_shap"))


def with_fallback(attribution: DataFrame, importance: DataFrame) -> DataFrame:
    """*attribution* with the responses that lack one filled from *importance*, and a ``note``.

    A response fails as a whole: where it has no attribution, or one that is missing or not finite,
    all of its rows are the importances, with note 'importance fallback' unless *importance* has notes of
    its own, and without a signed value. The others keep their rows, with an empty note.
    """
    fine = F.coalesce(F.abs("mean_abs_shap") < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan("mean_abs_shap"), F.lit(True))
    status = lookup(attribution.groupBy("response").agg(F.min(fine.cast("int")).alias("fine")), "status")
    ok = status.filter("fine = 1").select("response")
    note = F.col("note") if "note" in importance.columns else F.lit("importance fallback")
    kept = attribution.join(ok, "response", "left_semi").select(*PAIR, "mean_abs_shap", "mean_signed_shap", F.lit("").alias("note"))
    filled = importance.join(ok, "response", "left_anti").select(*PAIR, "mean_abs_shap", F.lit(None).cast("double").alias("mean_signed_shap"), note.alias("note"))
    return kept.unionByName(filled)


def leaf_paths(nodes: int, feature: Sequence[int], cut: Sequence[float], value: Sequence[float], cover: Sequence[float]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves of all trees of a model as (value, [(feature, above, up to, share of rows)]).

    Splits on one feature along a path merge into one interval; the share is the product of
    child rows / parent rows over those splits.
    """
    leaves = []
    for start in range(0, len(feature), nodes):
        stack = [(0, {})]
        while stack:
            i, path = stack.pop()
            f = feature[start + i]
            if f < 0:
                leaves.append((value[start + i], [(g, *limits) for g, limits in path.items()]))
                continue
            c = cut[start + i]
            above, upto, share = path.get(f, (-math.inf, math.inf, 1.0))
            for child, limits in ((2 * i + 1, (above, min(upto, c))), (2 * i + 2, (max(above, c), upto))):
                stack.append((child, {**path, f: (*limits, share * cover[start + child] / cover[start + i])}))
    return leaves


def shapley_values(x: np.ndarray, leaves: Sequence) -> np.ndarray:
    """Exact path-dependent Shapley values of the rows of *x*, summed over all leaves."""
    phi = np.zeros_like(x, dtype=float)
    for value, path in leaves:
        k = len(path)
        inside = [(x[:, f] > above) & (x[:, f] <= upto) for f, above, upto, _ in path]
        for j, (feature, _, _, share) in enumerate(path):
            others = [i for i in range(k) if i != j]
            total = np.zeros(len(x))
            for size in range(k):
                weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                for known in combinations(others, size):
                    product = np.full(len(x), weight)
                    for i in others:
                        product = product * (inside[i] if i in known else path[i][3])
                    total += product
            phi[:, feature] += value * total * (inside[j] - share)
    return phi


def tree_attribution_vectors(patterns: DataFrame, models: DataFrame, rows: int = VECTORS) -> DataFrame:
    """Shapley values in log-odds for each distinct feature vector of each response.

    *patterns* is ``(response, x, n)``. The vectors of a response are dealt into parts of about *rows*;
    its whole-data model goes before each part, and the vectors stream past it. ``base`` is what
    the model says on average, so ``base`` and the values of ``phi`` add up to the margin. A response
    whose model was not fitted, or has trees that can't be attributed, has no rows.
    """
    arrays = ["nodes", "prior", "feature", "cut", "value", "cover"]
    whole = models.filter((F.col("held_out") == ALL_ROWS) & (F.col("note") == "")).select("response", *arrays)
    vectors = materialise(patterns.groupBy("response", "x").agg(F.sum("n").alias("n")), "vectors")
    met = deal(vectors, whole, ["response"], rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = leaves = base = None
        for pdf in batches:
            for key, group in pdf.groupby(["response", "part"], sort=False):
                if key != known:
                    model, known = group["model"].iloc[0], key
                    leaves = None
                    if pd.isna(group["n"].iloc[0]):
                        try:
                            leaves = leaf_paths(int(model["nodes"]), *([*model[c]] for c in ("feature", "cut", "value", "cover")))
                        except (ArithmeticError, LookupError):
                            leaves = None  # shares of an empty node, a node that isn't there
                        else:
                            base = model["prior"] + sum(v * math.prod(p[3] for p in path) for v, path in leaves)
                        group = group.iloc[1:]
                if leaves is None or not len(group):
                    continue
                x = np.array(group["x"].tolist(), dtype=float)
                yield pd.DataFrame({"response": key[0], "n": group["n"].astype("int64").to_numpy(), "x": list(x), "base": base, "phi": list(shapley_values(x, leaves))})

    return met.mapInPandas(run, "response string, n long, x array<double>, base double, phi array<double>")


def tree_local_accuracy(patterns: DataFrame, models: DataFrame, depth: int, tolerance: float = 1e-9, rows: int = VECTORS) -> DataFrame:
    """How many feature vectors of each response have attributions that miss the margin.

    Returns ``response, n_vectors, n_off``: the margin is walked through the trees, the attributions
    come from the paths to their leaves.
    """
    vectors = tree_attribution_vectors(patterns, models, rows)
    whole = models.filter(F.col("held_out") == ALL_ROWS).select("response", "prior", "feature", "cut", "value")
    told = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda total, part: total + part)
    off = F.abs(told - boosted_margin(F.col("x"), depth)) > tolerance
    return vectors.join(whole, "response").groupBy("response").agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(off).alias("n_off"))


def tree_attribution(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute and mean signed tree attribution of each feature."""
    names = F.array(*[F.lit(f) for f in features])
    long = vectors.select(
        "response", "n", F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("phi"))).alias("e")
    ).select("response", "n", "e.feature", "e.phi")
    return long.groupBy(*PAIR).agg(
        (F.sum(F.col("n") * F.abs("phi")) / F.sum("n")).alias("mean_abs_shap"),
        (F.sum(F.col("n") * F.col("phi")) / F.sum("n")).alias("mean_signed_shap"),
    )


def attribution_on_best(cv: DataFrame, attribution: DataFrame) -> DataFrame:
    """Attributions of the response with the highest mean AUC; empty when none has one.

    *cv* is ``(response_id, response, response_name, cv_auc_mean)``; ties go to the lower id.
    """
    best = (
        cv.filter("cv_auc_mean IS NOT NULL")
        .orderBy(F.col("cv_auc_mean").desc(), "response_id")
        .limit(1)
        .select("response", "response_name")
    )
    return attribution.join(best, "response").select(
        "response_name", "feature", "mean_abs_shap", "mean_signed_shap"
    )
