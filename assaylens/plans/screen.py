"""End-to-end flows over any response and feature tables.

Every step answers all responses at once; nothing loops over responses.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.config import StudyConfig
from assaylens.operators import association as assoc
from assaylens.operators import attribution, boosting, folds, labels, logistic, metrics, panels, report
from assaylens.session import lookup, materialise, materialise_counted
from assaylens.sources import matrices, results

LR, GBM = "LR", "GBM"


@dataclass(frozen=True)
class Screen:
    """Results of a run, one table for each kind, keyed by response."""

    oof: DataFrame
    fold_metrics: DataFrame
    comparison: DataFrame
    best: DataFrame
    attribution: DataFrame
    tests: DataFrame
    effects: DataFrame
    summary: DataFrame
    confusion: DataFrame
    models: DataFrame | None = None
    boosted: DataFrame | None = None


def modelling_table(
    responses: DataFrame, flags: DataFrame, config: StudyConfig, threshold: float | None = None
) -> tuple[DataFrame, list[str]]:
    """Labels, folds, flags and composite scores of every usable response; materialised.

    *responses* is long ``(entity_id, response, y)``; *flags* is the wide 0/1 matrix. Panel
    features that the matrix lacks are ignored.
    """
    scores = {"hrd_score": config.hr_panel, "msi_status": config.mmr_panel, "ddr_burden": config.full_panel}
    wide = panels.add_scores(flags, scores, flags=("msi_status",))
    features = [f for f in (*config.full_panel, *scores) if f in wide.columns]
    cut = config.threshold if threshold is None else threshold
    rows = labels.threshold_labels(responses.filter(F.col("response").isin(list(config.responses))), cut)
    shared = rows.join(flags.select("entity_id"), "entity_id", "left_semi")
    rows, size = materialise_counted(shared.select("response", "entity_id", "label"), "labels")
    splits = {"fold": config.folds, "inner_fold": min(config.inner_folds, config.folds)}
    rows = folds.stratified_folds(labels.gate(rows, config.min_class, size), splits, config.seed)
    return materialise(rows.join(wide.select("entity_id", *features), "entity_id"), "design"), features


def run_screen(
    responses: DataFrame, flags: DataFrame, config: StudyConfig, models: Sequence[str] = (LR, GBM)
) -> Screen:
    """Cross-validate the models, pick the better one, and rank the biomarkers of each response.

    With ``models=("GBM",)`` this is the biomarker analysis by the boosted model alone. Raises
    ValueError for a configured response that the data lacks, and when no entity is in both tables.
    """
    config.validate()
    labels.require_responses(responses, config.responses)
    matrices.require_overlap(labels.drop_missing(responses), flags)
    design, features = modelling_table(responses, flags, config)
    spark = design.sparkSession
    patterns = logistic.training_patterns(design, features, ("fold", "inner_fold"))
    width = len(features) + 1
    held_out, attributions, refit = [], [], []
    keep = ["response", "model", "entity_id", "fold", "label", "prob"]
    counts = assoc.counts_from_patterns(patterns, features)
    x = design.select("response", "entity_id", "fold", "label", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))

    if LR in models:
        _, fitted = logistic.cross_validate_selected(patterns, width, config.c_values)
        held_out.append(logistic.predict(x, fitted, "fold").withColumn("model", F.lit(LR)).select(*keep))
        refit.append(logistic.predict(x, fitted, None).withColumn("model", F.lit(LR)).select(*keep))
        linear = attribution.linear_attribution(counts, attribution.long_coefficients(fitted, features))
        linear = attribution.with_fallback(linear, attribution.coefficient_importance(attribution.long_coefficients(fitted, features, "scaled")))
        attributions.append(linear.withColumn("model", F.lit(LR)))
    if GBM in models:
        rows = boosting.boosting_patterns(design, features, config.seed)
        trees = boosting.fit_boosting(rows, config.boosting, [*range(config.folds), logistic.ALL_ROWS])
        held_out.append(boosting.predict_boosting(x, trees, config.boosting.depth, "fold").withColumn("model", F.lit(GBM)).select(*keep))
        refit.append(boosting.predict_boosting(x, trees, config.boosting.depth, None).withColumn("model", F.lit(GBM)).select(*keep))
        tree = attribution.tree_attribution(attribution.tree_attribution_vectors(rows, trees), features)
        tree = attribution.with_fallback(materialise(tree, "tree-attribution"), attribution.tree_importance(trees, features))
        attributions.append(tree.withColumn("model", F.lit(GBM)))

    def stacked(parts: list[DataFrame]) -> DataFrame:
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    oof = materialise(stacked(held_out), "oof")
    fold_metrics = materialise(metrics.classification_metrics(oof, ["response", "model", "fold"]), "fold-metrics")
    comparison = metrics.compare_models(fold_metrics, ["response", "model"])
    best = materialise(
        metrics.best_model(metrics.mean_metrics(fold_metrics, ["response", "model"]), {LR: 0, GBM: 1}), "best"
    )
    picked = stacked(attributions).join(best.select("response", "model"), ["response", "model"])
    picked = materialise(picked, "attribution")
    tests, effects = assoc.tests_from_counts(counts), assoc.effect_sizes(counts)
    again = (
        stacked(refit)
        .join(best.select("response", "model"), ["response", "model"])
        .withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
    )
    return Screen(
        oof=oof,
        fold_metrics=fold_metrics,
        comparison=comparison,
        best=best,
        attribution=picked,
        tests=tests,
        effects=effects,
        summary=assoc.biomarker_summary(picked, tests, effects),
        confusion=metrics.confusion(again, ["response", "model"]),
        models=fitted.withColumn("features", F.array(*[F.lit(f) for f in features])) if LR in models else None,
        boosted=trees.withColumn("features", F.array(*[F.lit(f) for f in features])) if GBM in models else None,
    )


def write_screen(screen: Screen, folder: str) -> str:
    """Persist a run: summaries as CSV by response, comparison as CSV, predictions as parquet."""
    results.write_table(screen.summary, f"{folder}/biomarkers", "csv", partition="response")
    results.write_table(screen.comparison, f"{folder}/model_comparison", "csv")
    results.write_table(screen.confusion, f"{folder}/confusion", "csv")
    fitted = {k: v for k, v in (("models", screen.models), ("boosted", screen.boosted)) if v is not None}
    return results.write_results(folder, oof=screen.oof, fold_metrics=screen.fold_metrics, **fitted)


def evaluate_results(spark, folder: str) -> dict[str, DataFrame]:
    """Curves and comparison of an earlier run, from its persisted predictions."""
    oof = results.read_results(spark, folder, "oof")
    keys = ["response", "model"]
    counts = metrics.score_counts(oof, keys, "prob")
    comparison = metrics.compare_models(results.read_results(spark, folder, "fold_metrics"), keys)
    return {
        "roc_points": metrics.roc_points(counts, keys),
        "roc_auc": metrics.roc_auc(counts, keys),
        "pr_points": metrics.pr_points(counts, keys),
        "pr_auc": metrics.pr_auc(counts, keys),
        "prevalence": metrics.prevalence(oof),
        "comparison": metrics.comparison_long(comparison, keys),
    }


@dataclass(frozen=True)
class PanelCv:
    """Quartile-label cross-validation of a flag panel."""

    cv: DataFrame
    patterns: DataFrame
    models: DataFrame


def cross_validate_panel(
    responses: DataFrame, flags: DataFrame, plan: DataFrame, panel: Sequence[str], seed: int = 42, k: int = 5
) -> PanelCv:
    """Fold AUCs of the scaled regression on the panel for every planned response.

    Responses without enough rows or classes keep a status row and are not modelled; a response with a
    fit that fails gets a note 'cv error: ...' and no AUC, the others go on.
    *responses* and *flags* are materialised.
    """
    joined = labels.joined_responses(responses, flags)
    rows, size = materialise_counted(
        labels.quantile_labels(joined).select("response", "entity_id", "label"), "labels"
    )
    status = lookup(labels.response_status(responses, rows, plan), "status", size)
    usable = rows.join(status.filter("note = ''").select("response"), "response", "left_semi")
    folded = folds.stratified_folds(usable, {"fold": k}, seed)
    fold_auc, patterns, models = scaled_cv(folded.join(flags.select("entity_id", *panel), "entity_id"), panel)
    summary = status.join(metrics.auc_summary(fold_auc, ["response"]), "response", "left").join(logistic.fit_errors(models), "response", "left")
    failed = F.col("error").isNotNull()
    cv = summary.select(
        "response_id", "response", "response_name", "n", "n_sensitive",
        *[F.when(~failed, F.col(c)).alias(c) for c in ("cv_auc_mean", "cv_auc_std")],
        F.when(failed, F.concat(F.lit("cv error: "), F.col("error"))).otherwise(F.col("note")).alias("note"),
    )
    return PanelCv(cv, patterns, models)


def scaled_cv(design: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold AUCs, patterns and models of the C=1 regression, features scaled in each training fold."""
    patterns = logistic.training_patterns(design, features)
    oof, models = logistic.cross_validate(patterns, len(features) + 1, [1.0], scaled=True)
    keys = ["response", "fold"]
    return metrics.roc_auc(metrics.score_counts(oof, keys, "prob", n="n"), keys), patterns, models


def attribute_best(study: PanelCv, panel: Sequence[str]) -> DataFrame:
    """Linear attributions of the response with the highest mean AUC."""
    counts = assoc.counts_from_patterns(study.patterns, panel)
    linear = attribution.linear_attribution(counts, attribution.long_coefficients(study.models, panel))
    return attribution.attribution_on_best(study.cv, linear)


@dataclass(frozen=True)
class ScoreStudy:
    """Results of the panel-score study."""

    missing: DataFrame
    correlations: DataFrame
    scatter: DataFrame
    cv: DataFrame
    attribution: DataFrame
    lines: DataFrame


def run_score_study(
    responses: DataFrame, flags: DataFrame, plan: DataFrame, panel: Sequence[str], seed: int = 42, k: int = 5
) -> ScoreStudy:
    """Panel score against response: correlations, quartile-label CV and attribution on the best.

    *plan* is ``(response_id, response, response_name)``. Panel features that the flag matrix
    lacks are listed and left out.
    """
    present = [f for f in panel if f in flags.columns]
    flags = materialise(panels.select_panel_columns(flags, present), "flags")
    responses = materialise(responses, "responses")
    scores = panels.add_scores(flags, {"score": present}).select("entity_id", "score")
    correlations = materialise(assoc.planned_spearman(responses, scores, plan), "correlations")
    study = cross_validate_panel(responses, flags, plan, present, seed, k)
    return ScoreStudy(
        missing=panels.missing_features(flags.sparkSession, flags.columns, panel),
        correlations=correlations,
        scatter=labels.drop_missing(responses).join(scores, "entity_id").select("response", "entity_id", "score", "y"),
        cv=study.cv,
        attribution=attribute_best(study, present),
        lines=report.score_lines(
            scores, correlations, present, [f for f in panel if f not in present], study.cv, study.cv.orderBy(F.col("cv_auc_mean").desc_nulls_last(), "response_id").limit(1).filter("cv_auc_mean IS NOT NULL")
        ),
    )
