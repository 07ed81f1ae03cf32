"""Stratified folds, balanced class weights and per-fold feature scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylens.functions.ordered import group_rows


def stratified_folds(labelled: DataFrame, splits: dict[str, int], seed: int) -> DataFrame:
    """Deal the rows of every (response, label) to folds in the order of a seeded hash.

    *splits* maps an output column to its number of folds; all share one ordering. Numbering a
    class in one window would put it into one task. The hash is uniform, so its first digits
    make equal ranges, as many digits as the rows need; rows are numbered inside a range, and the
    sizes of the ranges before it are added. *labelled* is read twice and should be a materialised table.
    """
    group = ["response", "label", "_range"]
    rows, limit, digits = labelled.count(), group_rows(labelled.sparkSession), 1
    while rows > limit * 16**digits:
        digits += 1
    hashed = labelled.withColumn(
        "_hash", F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("entity_id").cast("string")).cast("binary"))
    ).withColumn("_range", F.substring("_hash", 1, digits))
    earlier = (
        Window.partitionBy("response", "label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        hashed.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group).orderBy("_hash", "entity_id")
    place = F.col("_before") + F.col("_place") - 1
    return (
        hashed.withColumn("_place", F.row_number().over(inside))
        .join(before, group)
        .withColumns({out: (place % k).cast("int") for out, k in splits.items()})
        .drop("_hash", "_range", "_place", "_before")
    )


def class_counts(folded: DataFrame, fold: str = "fold") -> DataFrame:
    """Training-set class sizes for every held-out fold, from one small aggregation."""
    cells = folded.groupBy("response", fold).agg(
        *[F.count_if(F.col("label") == c).alias(f"c{c}") for c in (0, 1)], F.count(F.lit(1)).alias("c")
    )
    whole = Window.partitionBy("response")
    return cells.select(
        "response",
        F.col(fold).alias("fold"),
        *[(F.sum(c).over(whole) - F.col(c)).alias(t) for c, t in (("c", "n"), ("c0", "n0"), ("c1", "n1"))],
    )


def balanced_weights(folded: DataFrame) -> DataFrame:
    """Weight n / (2 n_class) of each class when a fold is held out."""
    sizes = class_counts(folded)
    return (
        sizes.withColumn(
            "_class",
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("label"), F.col("n0").alias("n_class")),
                    F.struct(F.lit(1).alias("label"), F.col("n1").alias("n_class")),
                )
            ),
        )
        .select("response", "fold", "_class.label", "n", "_class.n_class")
        .withColumn("weight", F.try_divide(F.col("n").cast("double"), 2.0 * F.col("n_class")))
    )


def fold_scales(design: DataFrame, features: Sequence[str]) -> DataFrame:
    """Population standard deviation of each feature over the training rows of each fold.

    Values are taken from the least of their feature, so that a large offset doesn't cancel. Means
    and centred squares are kept for each held-out part and combined over the others; a constant
    feature gets scale 1.
    """
    wide = design.select("response", "fold", *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    least = wide.agg(*[F.coalesce(F.min(f"`{f}`"), F.lit(0.0)) for f in features]).first()
    moved = wide.select("response", "fold", *[(F.col(f"`{f}`") - F.lit(v)).alias(f) for f, v in zip(features, least, strict=True)])
    long = moved.unpivot(["response", "fold"], list(features), "feature", "v")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in zip(features, least, strict=True) for x in pair]), F.col("feature"))
    cells = long.groupBy("response", "fold", "feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("square")
    )
    # one entry for each fold
    others = F.filter(
        F.collect_list(F.struct("fold", "n", "mean", "square")).over(Window.partitionBy("response", "feature")),
        lambda c: (c["fold"] != F.col("fold")) & (c["n"] > 0),
    )

    def total(parts, of):
        return F.aggregate(parts, F.lit(0.0), lambda acc, c: acc + of(c))

    rest = cells.withColumn("_rest", others)
    rest = rest.withColumn("_n", total(F.col("_rest"), lambda c: c["n"]))
    rest = rest.withColumn("_mean", total(F.col("_rest"), lambda c: c["n"] * c["mean"]) / F.col("_n"))
    # squares about the cell means, and those of the cell means about the common one
    variance = total(F.col("_rest"), lambda c: c["square"] + c["n"] * (c["mean"] - F.col("_mean")) ** 2) / F.col("_n")
    scale = F.when(variance > 0, F.sqrt(variance)).otherwise(1.0)
    return rest.select(
        "response",
        "fold",
        "feature",
        scale.alias("scale"),
        ((F.col("mean") + start) / scale).alias("mean_scaled_held_out"),
    )
