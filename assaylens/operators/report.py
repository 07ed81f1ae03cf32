"""Feature-set ablation, context one-hots and text reports as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_onehot(entities: DataFrame, values: Sequence[str], column: str = "context") -> DataFrame:
    """One 0/1 column for each context value, none dropped."""
    return entities.select(
        "entity_id", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    )


def ablation(cv: DataFrame, keys: Sequence[str], base: str, full: str) -> DataFrame:
    """Mean and spread of two feature sets side by side, with the difference.

    *cv* is ``(keys, feature_set, cv_auc_mean, cv_auc_std)``; repeated rows are averaged.
    """
    keys = list(keys)
    wide = (
        cv.groupBy(*keys)
        .pivot("feature_set", [base, full])
        .agg(F.avg("cv_auc_mean").alias("mean"), F.avg("cv_auc_std").alias("std"))
    )
    return wide.select(
        *keys,
        F.col(f"`{base}_mean`").alias("auc_base"),
        F.col(f"`{base}_std`").alias("std_base"),
        F.col(f"`{full}_mean`").alias("auc_full"),
        F.col(f"`{full}_std`").alias("std_full"),
        (F.col(f"`{full}_mean`") - F.col(f"`{base}_mean`")).alias("delta"),
    )


def ablation_means(table: DataFrame) -> DataFrame:
    """Mean AUC of both feature sets over the responses, and the mean difference."""
    return table.agg(
        F.avg("auc_base").alias("mean_base"),
        F.avg("auc_full").alias("mean_full"),
        (F.avg("auc_full") - F.avg("auc_base")).alias("mean_delta"),
    )


def benchmark_lines(table: DataFrame, base: str, full: str) -> DataFrame:
    """Markdown table of an ablation as ``(section, key, line)``, in this order.

    *table* is the ablation with ``response_id, response_name, n, n_sensitive``: section 0 is the
    head, 1 one row per response, by response_id, and 2 the means.
    """
    rows = table.select(
        F.lit(1).alias("section"),
        F.col("response_id").cast("bigint").alias("key"),
        F.format_string(
            "| %s | %d | %d | %.3f ± %.3f | %.3f ± %.3f | %+.3f |",
            "response_name", "n", "n_sensitive", "auc_base", "std_base", "auc_full", "std_full", "delta",
        ).alias("line"),
    )
    ends = [
        (0, F.lit(f"| Response | n | n_sens | AUC ({base}) | AUC ({full}) | Δ AUC |")),
        (0, F.lit("| --- | ---: | ---: | ---: | ---: | ---: |")),
        (2, F.format_string(f"**Mean AUC ({base}): %.3f**", "mean_base")),
        (2, F.format_string(f"**Mean AUC ({full}): %.3f**", "mean_full")),
        (2, F.format_string("**Mean Δ: %+.3f AUC**", "mean_delta")),
    ]
    means = ablation_means(table).select(
        F.explode(
            F.array(*[F.struct(F.lit(part).alias("section"), F.lit(i).cast("bigint").alias("key"), line.alias("line")) for i, (part, line) in enumerate(ends)])
        ).alias("e")
    ).select("e.*")
    return rows.unionByName(means)


def score_histogram(scores: DataFrame) -> DataFrame:
    """Entities for each score."""
    return scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Mean, sample deviation, maximum and number of distinct entities."""
    return scores.agg(
        F.avg("score").alias("mean_score"),
        F.stddev_samp("score").alias("std_score"),
        F.max("score").alias("max_score"),
        F.count_distinct("entity_id").alias("n_entities"),
    )


def significant(value: Column) -> Column:
    """Three significant digits: plain from 0.0001 up to 999, else with an exponent; no idle zeros."""
    parts = F.split(F.format_string("%.2e", value), "e")
    power = parts[1].cast("int")
    plain = F.coalesce(*[F.when(power == e, F.format_string(f"%.{2 - e}f", value)) for e in range(-4, 3)])
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    written = F.concat(F.regexp_replace(parts[0], r"\.?0+$", ""), F.lit("e"), parts[1])
    return F.when(value == 0, F.lit("0")).when(value.isNull(), F.lit("nan")).otherwise(F.coalesce(short, written))


def _signed(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("+nan")).otherwise(F.format_string("%+.3f", value))


def score_lines(
    scores: DataFrame,
    correlations: DataFrame,
    available: Sequence[str] = (),
    missing: Sequence[str] = (),
    cv: DataFrame | None = None,
    best: DataFrame | None = None,
) -> DataFrame:
    """Summary report lines ``(section, key, line)``, in this order.

    Entities, panel columns that are there and that are missing (0), score distribution (1),
    moments (2), one correlation row for each planned response, with its note (3), then, where
    given, the cross-validation rows (4) and the response picked for attribution (5).
    """
    stats = score_stats(scores)
    head = [
        F.format_string("Entities analysed (N): %d", "n_entities"),
        F.lit(f"  available: {', '.join(available)}"),
        F.lit(f"  missing: {', '.join(missing)}"),
    ]
    opening = stats.select(F.posexplode(F.array(*head)).alias("key", "line")).select(
        F.lit(0).alias("section"), F.col("key").cast("bigint").alias("key"), "line"
    )
    histogram = score_histogram(scores).select(
        F.lit(1).alias("section"),
        F.col("score").cast("bigint").alias("key"),
        F.format_string("  score=%d: n=%d", F.col("score").cast("bigint"), "n").alias("line"),
    )
    moments = stats.select(
        F.lit(2).alias("section"),
        F.lit(0).cast("bigint").alias("key"),
        F.format_string("  mean=%.3f  std=%.3f  max=%d", "mean_score", "std_score", F.col("max_score").cast("bigint")).alias("line"),
    )
    name = F.format_string("  %-12s (Drug %d): n=%4d", "response_name", F.col("response_id").cast("bigint"), "n")
    drugs = correlations.select(
        F.lit(3).alias("section"),
        F.col("response_id").cast("bigint").alias("key"),
        F.concat(name, F.lit("  rho="), _signed(F.col("spearman_rho")), F.lit("  p="), significant(F.col("p_value")), F.lit("  "), "note").alias("line"),
    )
    lines = opening.unionByName(histogram).unionByName(moments).unionByName(drugs)
    if cv is not None:
        auc = [F.when(F.col(c).isNull(), F.lit("nan")).otherwise(F.format_string("%.3f", c)) for c in ("cv_auc_mean", "cv_auc_std")]
        rows = F.concat(name, F.format_string("  n_sens=%4d  AUC=", "n_sensitive"), auc[0], F.lit("+/-"), auc[1], F.lit("  "), "note")
        lines = lines.unionByName(cv.select(F.lit(4).alias("section"), F.col("response_id").cast("bigint").alias("key"), rows.alias("line")))
    if best is not None:
        picked = F.concat(F.lit("Attribution run on best-AUC response: "), F.coalesce(F.max("response_name"), F.lit("N/A")))
        lines = lines.unionByName(best.agg(picked.alias("line")).select(F.lit(5).alias("section"), F.lit(0).cast("bigint").alias("key"), "line"))
    return lines
