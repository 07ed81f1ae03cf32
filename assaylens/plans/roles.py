"""The study's roles filled from the given star-schema tables.

entity = customer; response = log mean order price by order priority, less an offset, missing
without such orders; feature = a brand the customer bought in at least four line items;
context = market segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.config import StudyConfig
from assaylens.operators import folds, labels, panels, report
from assaylens.session import dimension, materialise, materialise_counted
from assaylens.sources import matrices

OFFSET = 12.4
LINES_FOR_HIT = 4
RESPONSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CONTEXTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FULL = tuple(f"Brand#{i}" for i in range(1, 14))
HR = FULL[:6]
MMR = FULL[6:9]
NARROW = FULL[:3]
SCORES = ("hrd_score", "msi_status", "ddr_burden")
PANELS = {"hrd_score": HR, "msi_status": MMR, "ddr_burden": FULL}
FEATURES = (*FULL, *SCORES)
PAIRS = (
    ("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#7", "Brand#8"), ("Brand#1", "Brand#5"),
)
CONFIG = StudyConfig(
    full_panel=FULL, hr_panel=HR, mmr_panel=MMR, responses=RESPONSES, interaction_pairs=PAIRS
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("context")
    )


def present_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Long responses of the (entity, response) pairs that have one."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("response"))
        .agg((F.ln(F.avg("o_totalprice")) - OFFSET).alias("y"))
    )


def response_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Wide responses of all entities, NULL where there is none."""
    prices = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("entity_id"))
        .agg(
            *[
                (F.ln(F.avg(F.when(F.col("o_orderpriority") == r, F.col("o_totalprice")))) - OFFSET).alias(r)
                for r in RESPONSES
            ]
        )
    )
    return entities(spark, folder).select("entity_id").join(prices, "entity_id", "left")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Long responses of all entities, missing ones as NULL rows."""
    return matrices.to_long(response_matrix(spark, folder), "response", "y", RESPONSES)


def brand_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Wide flags of the entities with at least one line item of a panel brand.

    One aggregation by entity: its partial counts collapse hot entities before the shuffle.
    """
    part = (
        table(spark, folder, "part")
        .filter(F.col("p_brand").isin(list(FULL)))
        .select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        lines.join(orders, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("entity_id"))
        .agg(
            *[
                (F.count_if(F.col("p_brand") == brand) >= LINES_FOR_HIT).cast("int").alias(brand)
                for brand in FULL
            ]
        )
    )


def all_brand_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse long features over every brand of the data, not only the panel's."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    counted = (
        lines.join(orders, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("entity_id"), F.col("p_brand").alias("feature"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    return counted.filter(F.col("lines") >= LINES_FOR_HIT).select("entity_id", "feature", F.lit(1).alias("v"))


def size_panels(spark: SparkSession, folder: str) -> DataFrame:
    """One panel for each size of part: the brands made in it."""
    return table(spark, folder, "part").select(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("panel"), F.col("p_brand").alias("feature")).distinct()


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse long features: one row for each (entity, brand) hit."""
    cells = matrices.to_long(brand_matrix(spark, folder), "feature", "v", FULL)
    return cells.filter("v <> 0")


def flags(spark: SparkSession, folder: str) -> DataFrame:
    """Dense wide flag matrix of the full panel."""
    everyone = entities(spark, folder).select("entity_id")
    return everyone.join(brand_matrix(spark, folder), "entity_id", "left").fillna(0, list(FULL))


def scored_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags and composite scores of all entities."""
    return panels.add_scores(flags(spark, folder), PANELS, flags=("msi_status",))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse long features of the model: flags and composite scores, from one aggregation."""
    scored = panels.add_scores(brand_matrix(spark, folder), PANELS, flags=("msi_status",))
    return panels.sparse_features(scored, FEATURES)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """All (entity, response) rows with the fixed-threshold label, gated by class size; materialised."""
    rows = labels.threshold_labels(responses(spark, folder), CONFIG.threshold)
    rows, size = materialise_counted(rows.select("response", "entity_id", "label"), "labels")
    return labels.gate(rows, CONFIG.min_class, size)


def folded(spark: SparkSession, folder: str, splits: dict[str, int] | None = None) -> DataFrame:
    """Labelled rows with their folds."""
    return folds.stratified_folds(labelled(spark, folder), splits or {"fold": CONFIG.folds}, CONFIG.seed)


def design(spark: SparkSession, folder: str) -> DataFrame:
    """Wide modelling table: labels, outer and inner folds, flags and composite scores."""
    rows = folded(spark, folder, {"fold": CONFIG.folds, "inner_fold": CONFIG.inner_folds})
    return rows.join(scored_flags(spark, folder), "entity_id")


def quartile_design(spark: SparkSession, folder: str, extreme: bool = False) -> DataFrame:
    """Quantile labels with folds, flags, scores and the context one-hots; materialised.

    With *extreme* the middle half of each response is left out.
    """
    present = materialise(labels.drop_missing(responses(spark, folder)), "responses")
    label = labels.extreme_labels if extreme else labels.quantile_labels
    rows = materialise(label(present).select("response", "entity_id", "label"), "labels")
    rows = folds.stratified_folds(rows, {"fold": CONFIG.folds}, CONFIG.seed)
    context = report.context_onehot(entities(spark, folder), CONTEXTS)
    return materialise(rows.join(scored_flags(spark, folder), "entity_id").join(context, "entity_id"), "design")


def plan(spark: SparkSession) -> DataFrame:
    """The planned responses: the five of the data and one that the data lacks."""
    rows = [(i, name, name[2:].title()) for i, name in enumerate(RESPONSES, 1)]
    rows.append((6, "6-ABSENT", "Absent"))
    return dimension(spark, rows, "response_id int, response string, response_name string")
