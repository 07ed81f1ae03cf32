"""Feature panels: selection, composite scores, interactions, panel checks.

Features are long and sparse: ``(entity_id, feature, v)`` with the non-zero rows only, so the
work grows with the hits and not with entities x features.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.session import dimension, materialise

Panels = dict[str, Sequence[str]]
#: Most rows of entity, panel and feature, on average, that one task folds into scores.
TASK_ROWS = 500_000


def select_panel(features: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Long rows of the panel's features; names the data lacks are ignored."""
    return features.filter(F.col("feature").isin(list(panel)))


def panel_table(spark: SparkSession, panels: Panels) -> DataFrame:
    """The panels as rows ``(panel, feature)``, each member once."""
    rows = [(name, feature) for name, panel in panels.items() for feature in dict.fromkeys(panel)]
    return dimension(spark, rows, "panel string, feature string")


def panel_rows(features: DataFrame, members: DataFrame) -> DataFrame:
    """Long rows of every panel of ``members(panel, feature)`` at once; features in no panel are left out."""
    return features.join(members, "feature")


def panel_score_rows(hits: DataFrame, members: DataFrame) -> DataFrame:
    """``entity_id, panel, score, hit`` for each entity and panel with a stored feature.

    score is the sum, hit whether any value is not 0. Panels and features are rows of *members*, so
    the plan is the same for any number of them; pairs without a row score 0. A hit makes a row for
    each of its panels: entities are dealt before that, into as many tasks as these rows need.
    """
    hits, members = materialise(hits, "hits"), materialise(members.select("panel", "feature").distinct(), "members")
    made = hits.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(members, "feature").agg(F.sum("n")).first()[0] or 0
    tasks = max(-(-made // TASK_ROWS), hits.sparkSession.sparkContext.defaultParallelism)
    rows = panel_rows(hits.repartition(tasks, "entity_id"), members)
    return rows.groupBy("entity_id", "panel").agg(
        F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("score"),
        F.coalesce(F.bool_or(F.col("v") != 0), F.lit(False)).alias("hit"),
    )


def panel_summary(hits: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each panel: its members, the entities it is hit in, their summed and largest score."""
    scored = panel_score_rows(hits, members).groupBy("panel").agg(
        F.count_if("hit").alias("entities"), F.sum("score").alias("total"), F.max("score").alias("most")
    )
    sizes = members.groupBy("panel").agg(F.count_distinct("feature").alias("features"))
    return sizes.join(scored, "panel", "left").fillna(0, ["entities", "total", "most"])


def select_panel_columns(wide: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Wide columns of the panel's features, in panel order; absent names are ignored."""
    return wide.select("entity_id", *[name for name in panel if name in wide.columns])


def composite_scores(entities: DataFrame, hits: DataFrame, panels: Panels, flags: Sequence[str] = ()) -> DataFrame:
    """One column for each panel: the sum of its features, or any-non-zero for *flags*.

    All panels come from a single aggregation by entity; entities without a hit score 0.
    """
    sums = hits.groupBy("entity_id").agg(
        *[
            F.sum(F.when(F.col("feature").isin(list(panel)), F.col("v"))).alias(name)
            for name, panel in panels.items()
        ]
    )
    columns: list[Column] = []
    for name in panels:
        score = F.coalesce(F.col(name), F.lit(0))
        if name in flags:
            score = score != 0
        columns.append(score.cast("int").alias(name))
    return entities.select("entity_id").join(sums, "entity_id", "left").select("entity_id", *columns)


def add_scores(wide: DataFrame, panels: Panels, flags: Sequence[str] = ()) -> DataFrame:
    """The same scores on a wide flag matrix: plain column arithmetic, no shuffle."""
    added: dict[str, Column] = {}
    for name, panel in panels.items():
        present = [F.coalesce(F.col(f), F.lit(0)) for f in panel if f in wide.columns]
        score = reduce(lambda a, b: a + b, present, F.lit(0))
        if name in flags:
            score = F.coalesce(reduce(lambda a, b: a | b, [p != 0 for p in present], F.lit(False)), F.lit(False))
        added[name] = score.cast("int")
    return wide.withColumns(added)


def sparse_features(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """The non-zero cells of a wide matrix as long rows."""
    cells = wide.select("entity_id", *[F.col(f"`{name}`").cast("double").alias(name) for name in names])
    return cells.unpivot("entity_id", list(names), "feature", "v").filter("v <> 0")


def flag_matrix(entities: DataFrame, hits: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Wide integer matrix of long hits: one column for each panel feature, 0 where none is stored."""
    wide = hits.filter(F.col("feature").isin(list(panel))).groupBy("entity_id").agg(
        *[F.max(F.when(F.col("feature") == name, F.col("v"))).alias(name) for name in panel]
    )
    filled = [F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("int").alias(name) for name in panel]
    return entities.join(wide, "entity_id", "left").select(*[entities[c] for c in entities.columns], *filled)


def interactions(hits: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Sparse long interaction features ``<a>_x_<b>`` for the listed pairs.

    Each hit looks up the pairs it opens and then the partner hit of the same entity, so only
    listed pairs are ever formed. Pairs with an unknown feature yield nothing.
    """
    wanted = dimension(hits.sparkSession, list(pairs), "feature string, partner string")
    left = hits.join(wanted, "feature").select("entity_id", "feature", "partner", "v")
    right = hits.select("entity_id", F.col("feature").alias("partner"), F.col("v").alias("v_partner"))
    return left.join(right, ["entity_id", "partner"]).select(
        "entity_id",
        F.concat_ws("_x_", "feature", "partner").alias("feature"),
        (F.col("v") * F.col("v_partner")).alias("v"),
    )


def add_interaction_columns(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product columns on a wide matrix for the pairs whose two columns exist."""
    known = [(a, b) for a, b in pairs if a in wide.columns and b in wide.columns]
    return wide.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in known})


def missing_features(spark: SparkSession, available: Sequence[str], requested: Sequence[str]) -> DataFrame:
    """Requested features that the matrix has no column of; an all-zero column is there."""
    known = set(available)
    return dimension(spark, [(name,) for name in requested if name not in known], "feature string")


def absent_features(available: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested features that ``available(feature)`` has no row of."""
    asked = dimension(available.sparkSession, [(name,) for name in requested], "feature string")
    return asked.join(available.select("feature").distinct(), "feature", "left_anti")


def panel_violations(panels: DataFrame, whole: str) -> DataFrame:
    """Members of the other panels that are missing from the panel called *whole*."""
    allowed = panels.filter(F.col("panel") == whole).select("feature")
    return panels.filter(F.col("panel") != whole).join(allowed, "feature", "left_anti").select("panel", "feature")
