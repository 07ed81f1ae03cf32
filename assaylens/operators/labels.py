"""From continuous responses to labels, class counts and status rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.functions.ordered import quantiles
from assaylens.session import dimension, lookup, materialise, materialise_counted

ENOUGH_ROWS = 40
ENOUGH_OF_CLASS = 5


def drop_missing(responses: DataFrame) -> DataFrame:
    """Rows with an entity and a usable response."""
    return responses.filter("entity_id IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")


def threshold_labels(responses: DataFrame, threshold: float) -> DataFrame:
    """1 strictly below the threshold; a missing response counts as 0."""
    return responses.withColumn("label", F.coalesce((F.col("y") < threshold).cast("int"), F.lit(0)))


def response_quantiles(responses: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles of each response's present values."""
    present = drop_missing(responses)
    counts, rows = materialise_counted(
        present.groupBy("response", "y").agg(F.count(F.lit(1)).alias("n")), "y-counts"
    )
    return lookup(quantiles(counts, ["response"], "y", "n", fractions, rows), "cuts", rows)


def quantile_labels(responses: DataFrame, fraction: float = 0.25) -> DataFrame:
    """1 at or below the response's quantile; missing responses are dropped.

    *responses* is read twice and should be a materialised table.
    """
    cut = response_quantiles(responses, {"cut": fraction})
    return (
        drop_missing(responses)
        .join(cut, "response")
        .withColumn("label", (F.col("y") <= F.col("cut")).cast("int"))
    )


def extreme_labels(responses: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """1 at or below the low quantile, 0 at or above the high one, the middle dropped.

    *responses* is read twice and should be a materialised table.
    """
    cuts = response_quantiles(responses, {"low": low, "high": high})
    label = F.when(F.col("y") <= F.col("low"), 1).when(F.col("y") >= F.col("high"), 0)
    return (
        drop_missing(responses)
        .join(cuts, "response")
        .withColumn("label", label)
        .filter("label IS NOT NULL")
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    """Class sizes and percentages for each response."""
    sizes = labelled.groupBy("response").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_sensitive")
    )
    rest = F.col("n") - F.col("n_sensitive")
    return sizes.select(
        "response",
        "n",
        "n_sensitive",
        rest.alias("n_resistant"),
        (100.0 * F.col("n_sensitive") / F.col("n")).alias("pct_sensitive"),
        (100.0 * rest / F.col("n")).alias("pct_resistant"),
    )


def gate(labelled: DataFrame, min_class: int, rows: int | None = None) -> DataFrame:
    """Keep the responses whose two classes both reach *min_class*.

    *labelled* is read twice and should be materialised; *rows* is its size when known.
    """
    passed = class_balance(labelled).filter(
        (F.col("n_sensitive") >= min_class) & (F.col("n_resistant") >= min_class)
    )
    return labelled.join(lookup(passed.select("response"), "passed", rows), "response", "left_semi")


def require_responses(responses: DataFrame, names: Sequence[str]) -> None:
    """Raise ValueError when a requested response is not in the data."""
    wanted = dimension(responses.sparkSession, [(n,) for n in names], "response string")
    absent = wanted.join(responses.select("response").distinct(), "response", "left_anti")
    unknown = sorted(row.response for row in absent.collect())
    if unknown:
        raise ValueError(f"responses not found: {', '.join(unknown)}")


def joined_responses(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """Present responses of the entities that the features know; materialised."""
    known = entities.select("entity_id")
    return materialise(drop_missing(responses).join(known, "entity_id", "left_semi"), "joined")


def response_status(responses: DataFrame, labelled: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for every planned response, with the reason why it cannot be analysed.

    *plan* is ``(response_id, response, response_name)`` and *labelled* the quantile labels of
    the joined responses. The note follows the order: not in the table, nothing joined, too
    few rows, too few of one class, usable (empty note).
    """
    listed = responses.select("response").distinct().withColumn("listed", F.lit(True))
    sizes = labelled.groupBy("response").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_low")
    )
    n, low = F.coalesce("n", F.lit(0)), F.coalesce("n_low", F.lit(0))
    enough = n >= ENOUGH_ROWS
    note = (
        F.when(F.col("listed").isNull(), "response absent")
        .when(n == 0, "no joined rows")
        .when(~enough, "insufficient samples")
        .when((low < ENOUGH_OF_CLASS) | (n - low < ENOUGH_OF_CLASS), "class imbalance")
        .otherwise("")
    )
    return (
        plan.join(listed, "response", "left")
        .join(sizes, "response", "left")
        .select(
            "response_id",
            "response",
            "response_name",
            n.cast("bigint").alias("n"),
            F.when(enough, low).otherwise(F.lit(0)).cast("bigint").alias("n_sensitive"),
            note.alias("note"),
        )
    )
