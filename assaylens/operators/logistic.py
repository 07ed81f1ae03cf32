"""L2 logistic regression with balanced classes, many models in each pass.

A screen needs (grid + folds + 1) fits for each response; one Spark job sequence per fit would
be all overhead. Here rows are first collapsed to distinct (response, folds, label, feature
vector) patterns with counts. The fits are planned as a table. Each Newton pass reads the patterns once
and sums gradient and curvature of all models; the small systems are solved on the executors, too.
Models are fitted in groups, so that what a pass sends stays bounded, and appended to a written table.
Objective: 1/2 |beta|^2 + C * sum(weight * log-loss), the intercept not penalised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.operators.metrics import roc_auc, score_counts
from assaylens.session import materialise, new_path

# the state of a group of models travels to the tasks and back in each pass: bounds its total size
STATE_DOUBLES = 4_000_000
PASSES = 60
# Newton steps converge quadratically: after a step this small the error is its square
TOLERANCE = 1e-6
ALL_ROWS = -1
#: Fitted models; ``held`` is the fold left out of each split, ``note`` says why a fit has no coefficients.
MODELS = "response string, held array<int>, held_out int, c double, note string, intercept double, coefficients array<double>, scaled array<double>"


def training_patterns(design: DataFrame, features: Sequence[str], splits: Sequence[str] = ("fold",)) -> DataFrame:
    """Distinct (response, folds, label, x) with counts ``n``, materialised."""
    names = list(features)
    return materialise(
        design.groupBy("response", *splits, "label", *[F.col(f"`{f}`").cast("double").alias(f) for f in names])
        .agg(F.count(F.lit(1)).alias("n"))
        .select("response", *splits, "label", "n", F.array(*[F.col(f"`{f}`") for f in names]).alias("x")),
        "patterns",
    )


def plan_fits(
    patterns: DataFrame, splits: Sequence[str], width: int, cs: Sequence[float] | DataFrame, whole: bool = False, scaled: bool = False
) -> DataFrame:
    """Written table of the fits: one for each response, C and set of held-out folds.

    With one split a fold is left out at a time, with two a pair of folds; *whole* adds a fit on all
    rows. *cs* is the grid, or a table of the chosen ``c`` by response, or by response and held_out.
    With *scaled* the features are divided by their standard deviation over the training rows.
    ``weights`` balance the classes; a fit without both classes has the note 'one class'.
    """
    cells = patterns.groupBy("response", *splits).agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).cast("double").alias(f"n{c}") for c in (0, 1)])
    cells = materialise(cells, "cells")
    # as many as pairs of folds
    held = [list(r) for r in cells.select(*splits).distinct().orderBy(*splits).collect()] + ([[ALL_ROWS] * len(splits)] if whole else [])
    each = F.explode(F.array(*[F.array(*[F.lit(int(h)) for h in hs]) for hs in held])) if held else F.lit(None).cast("array<int>")

    def training(rows: DataFrame) -> DataFrame:
        """Each cell with the sets of held-out folds it is not in."""
        out = rows.withColumn("held", each)
        for i, split in enumerate(splits):
            out = out.where((F.col("held")[i] == ALL_ROWS) | (F.col("held")[i] != F.col(split)))
        return out

    key = ["response", "held"]
    sizes = training(cells).groupBy(*key).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scale = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.lit(1.0))
    if scaled:
        # squares are taken from the least value of each feature, so that an offset doesn't cancel
        long = patterns.select("response", *splits, "n", F.posexplode("x").alias("pos", "v"))
        least = long.groupBy("pos").agg(F.min("v").alias("least"))
        moved = long.join(materialise(least, "least"), "pos").withColumn("v", F.col("v") - F.col("least"))
        moments = moved.groupBy("response", *splits, "pos").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") ** 2).alias("q"))
        variance = F.sum("q") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2
        scales = training(moments).groupBy(*key, "pos").agg(F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("scale"))
        scales = scales.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "scale"))).alias("scales"))
        sizes = sizes.join(scales, key)
        scale = F.concat(F.array(F.lit(1.0)), F.col("scales.scale"))
    total = F.col("n0") + F.col("n1")
    lone = (F.col("n0") == 0) | (F.col("n1") == 0)
    weights = F.array(*[F.try_divide(total, 2 * F.col(c)) for c in ("n0", "n1")])
    fits = sizes.select(*key, F.col("held")[0].alias("held_out"), F.when(lone, "one class").otherwise("").alias("note"), weights.alias("weights"), scale.alias("scale"))
    if isinstance(cs, DataFrame):
        fits = fits.join(cs.select(*[c for c in ("response", "held_out", "c") if c in cs.columns]), [c for c in ("response", "held_out") if c in cs.columns])
    else:
        fits = fits.withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in cs])))
    return materialise(fits.withColumn("model", F.monotonically_increasing_id()), "fits")


def fit_many(patterns: DataFrame, splits: Sequence[str], fits: DataFrame, width: int) -> DataFrame:
    """Table of MODELS of all planned fits, in groups of responses whose state stays near ``STATE_DOUBLES``.

    ``coefficients`` are for the features as they are, so predictions need no scaling step;
    ``scaled`` are for the features divided by their scale. A fit that fails keeps a row with the
    reason as its note and without coefficients; the others go on.
    """
    spark = patterns.sparkSession
    groups = -(-fits.count() * (width * width + width + 1) // STATE_DOUBLES) or 1
    path = new_path(spark, "models")

    def group(rows: DataFrame, g: int) -> DataFrame:
        return rows if groups == 1 else rows.filter(F.pmod(F.xxhash64("response"), F.lit(groups)) == g)

    for g in range(groups):
        _newton(group(patterns, g), list(splits), group(fits, g), width).write.mode("append").parquet(path)
    return spark.read.schema(MODELS).parquet(path)


def _newton(patterns: DataFrame, splits: list[str], fits: DataFrame, width: int) -> DataFrame:
    """MODELS of one group; its state, and nothing of the other groups, is in the driver."""
    spark = patterns.sparkSession
    rows = {r["model"]: r.asDict() for r in fits.collect()}
    for r in rows.values():
        r |= {"beta": np.zeros(width), "previous": None, "loss": float("inf"), "scale": np.array(r["scale"]), "open": not r["note"]}
    for _ in range(PASSES):
        by_response: dict[str, list] = {}
        for m, r in rows.items():
            if r["open"]:
                by_response.setdefault(r["response"], []).append({"model": m} | {k: r[k] for k in ("held", "c", "weights", "scale", "beta", "previous", "loss")})
        if not by_response:
            break
        state = spark.sparkContext.broadcast(by_response)
        parts = patterns.mapInPandas(_pass_over(state, splits, width), "response string, model long, j int, s double")
        sums = parts.groupBy("response", "model", "j").agg(F.sum("s").alias("s"))
        sums = sums.groupBy("response", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda e: e["s"]).alias("sums"))
        moved = sums.mapInPandas(_step(state, width), "model long, beta array<double>, previous array<double>, loss double, open boolean, note string")
        for r in moved.collect():
            told = {"beta": np.array(r["beta"]), "previous": None if r["previous"] is None else np.array(r["previous"])}
            rows[r["model"]] |= told | {k: r[k] for k in ("loss", "open", "note")}
        state.destroy()
    out = []
    for r in rows.values():
        note = f"no convergence in {PASSES} passes" if r["open"] else r["note"]
        fitted = (None, None, None) if note else (float(r["beta"][0]), (r["beta"][1:] / r["scale"][1:]).tolist(), r["beta"][1:].tolist())
        out.append((r["response"], r["held"], r["held_out"], r["c"], note, *fitted))
    return spark.createDataFrame(out, MODELS)


def _pass_over(state, splits: list[str], width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for response, rows in pdf.groupby("response", sort=False):
                raw = np.column_stack([np.ones(len(rows)), np.array(rows["x"].tolist(), dtype=float)])
                label = rows["label"].to_numpy(dtype=float)
                n = rows["n"].to_numpy(dtype=float)
                parts = [rows[s].to_numpy() for s in splits]
                for fit in state.value.get(response, ()):
                    x = raw / fit["scale"]
                    w = fit["c"] * n * np.where(label == 1, fit["weights"][1], fit["weights"][0])
                    for part, held in zip(parts, fit["held"], strict=True):
                        if held != ALL_ROWS:
                            w = w * (part != held)
                    z = x @ fit["beta"]
                    prob = 1.0 / (1.0 + np.exp(-z))
                    curve = (x * (w * prob * (1 - prob))[:, None]).T @ x
                    slope = x.T @ (w * (prob - label))
                    loss = np.sum(w * (np.logaddexp(0.0, z) - label * z))
                    both = np.concatenate([curve.ravel(), slope, [loss]])
                    key = response, fit["model"]
                    sums[key] = sums[key] + both if key in sums else both
        for (response, model), s in sums.items():
            yield pd.DataFrame({"response": response, "model": model, "j": np.arange(len(s), dtype=np.int32), "s": s})

    return run


def _step(state, width: int):
    """The Newton step of each model from its sums; half a step back where the loss rose."""
    penalty = np.ones(width)
    penalty[0] = 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {f["model"]: f for fits in state.value.values() for f in fits}
        for pdf in batches:
            out = []
            for model, sums in zip(pdf["model"], pdf["sums"], strict=True):
                f, sums = known[model], np.array(sums, float)
                beta, previous = f["beta"], f["previous"]
                curve = sums[: width * width].reshape(width, width) + np.diag(penalty)
                slope = sums[width * width : -1] + penalty * beta
                loss = sums[-1] + 0.5 * float(np.sum(penalty * beta**2))
                if not np.isfinite(sums).all():
                    out.append((model, beta, previous, f["loss"], False, "sums are not finite"))
                elif previous is not None and loss > f["loss"] + 1e-9 * abs(f["loss"]):
                    out.append((model, (beta + previous) / 2, previous, f["loss"], True, ""))
                else:
                    move = np.linalg.lstsq(curve, slope, rcond=None)[0]
                    out.append((model, beta - move, beta, loss, bool(np.max(np.abs(move)) >= TOLERANCE), ""))
            yield pd.DataFrame(out, columns=["model", "beta", "previous", "loss", "open", "note"])

    return run


def _probability(x: str) -> Column:
    margin = F.col("intercept") + F.aggregate(
        F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda total, part: total + part
    )
    return 1.0 / (1.0 + F.exp(-margin))


def predict(rows: DataFrame, models: DataFrame, split: str | None, x: str = "x") -> DataFrame:
    """Add ``prob`` by the model that left the row's fold out, or by the whole-data model.

    Rows whose model was not fitted are left out.
    """
    fitted = models.filter("note = ''").drop("note", "held", "scaled")
    if split is None:
        paired = rows.join(fitted.filter(F.col("held_out") == ALL_ROWS), "response")
    else:
        paired = rows.join(fitted.withColumnRenamed("held_out", split), ["response", split])
    return paired.withColumn("prob", _probability(x)).drop("intercept", "coefficients")


def fit_errors(models: DataFrame) -> DataFrame:
    """``response, error`` of the responses with a fit that failed; the first reason in alphabetical order."""
    return models.filter("note <> ''").groupBy("response").agg(F.min("note").alias("error"))


def _mean_auc(scored: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Mean AUC over the folds of *split*, rounded so that the order of a sum can't decide between equal ones."""
    per_fold = roc_auc(score_counts(scored, [*keys, split], "prob", n="n"), [*keys, split])
    return per_fold.groupBy(*keys).agg(F.round(F.coalesce(F.avg("auc"), F.lit(0.0)), 12).alias("auc"))


def inner_cv(patterns: DataFrame, split: str, width: int, cs: Sequence[float]) -> DataFrame:
    """Mean held-out AUC of each C on the inner folds, for each response.

    Folds with one class only are left out; without any valid fold the mean is 0.
    """
    models = fit_many(patterns, [split], plan_fits(patterns, [split], width, cs), width)
    return _mean_auc(predict(patterns, models, split), ["response", "c"], split)


def nested_cv(patterns: DataFrame, outer: str, inner: str, width: int, cs: Sequence[float]) -> DataFrame:
    """Mean AUC of each C for each response and outer fold, which takes no part in it.

    Every pair of an outer and an inner fold is held out together, all pairs and C in the same passes;
    a model is scored on the rows of its inner fold outside its outer one.
    """
    models = fit_many(patterns, [outer, inner], plan_fits(patterns, [outer, inner], width, cs), width)
    fitted = models.filter("note = ''").select("response", "held_out", F.col("held")[1].alias(inner), "c", "intercept", "coefficients")
    scored = patterns.join(fitted, ["response", inner]).filter(F.col(outer) != F.col("held_out")).withColumn("prob", _probability("x"))
    return _mean_auc(scored, ["response", "held_out", "c"], inner)


def select_c(grid_auc: DataFrame) -> DataFrame:
    """The C with the highest mean AUC of each response (and held_out); ties go to the smaller C."""
    keys = [c for c in ("response", "held_out") if c in grid_auc.columns]
    return grid_auc.groupBy(*keys).agg(F.max_by("c", F.struct("auc", -F.col("c"))).alias("c"), F.max("auc").alias("auc"))


def cross_validate(
    patterns: DataFrame, width: int, cs: Sequence[float] | DataFrame, scaled: bool = False, whole: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Fit all held-out folds and, with *whole*, the whole data.

    Returns the held-out predictions on the patterns and the models.
    """
    models = fit_many(patterns, ["fold"], plan_fits(patterns, ["fold"], width, cs, whole, scaled), width)
    return predict(patterns, models, "fold"), models


def cross_validate_selected(patterns: DataFrame, width: int, cs: Sequence[float], nested: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cross-validation with C chosen by inner folds: over all rows, or *nested* inside each outer fold.

    Nested, the held-out rows of a fold have no say in its C, and there is no fit on all rows.
    """
    if nested:
        chosen = select_c(nested_cv(patterns, "fold", "inner_fold", width, cs))
        return cross_validate(patterns, width, materialise(chosen, "chosen"), whole=False)
    chosen = select_c(inner_cv(patterns, "inner_fold", width, cs))
    return cross_validate(patterns, width, materialise(chosen, "chosen"))
