"""All queries by name: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylens.operators import association as assoc
from assaylens.operators import attribution, boosting, folds, labels, logistic, metrics, panels, report
from assaylens.plans import roles, screen
from assaylens.session import materialise, materialise_counted, new_path
from assaylens.sources import matrices, results

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- sources and merges


@query
def response_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roles.responses(spark, d), 9, "y")


@query
def feature_long(spark: SparkSession, d: str) -> DataFrame:
    wide = roles.flags(spark, d)
    suffixed = wide.withColumnsRenamed({f: f"{f}_mut" for f in roles.FULL})
    return matrices.strip_suffix(matrices.to_long(suffixed, "feature", "v"), "feature", "_mut")


@query
def dirty_numeric_flags(spark: SparkSession, d: str) -> DataFrame:
    # raw JSON, and numbers as they come in dirty files
    forms = ["", "d", "F", "000000000", ".75", "e2", " ", "x", "."]
    number = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.when(F.col("event_id") % 4 == 0, "-").otherwise(""), F.col("event_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("event_id") % len(forms) + 1).cast("int")))
    )
    events = roles.table(spark, d, "events").select("event_id", number.alias("raw"))
    return events.select("event_id", "raw", matrices.to_flag("raw").alias("k"))


@query
def response_keys(spark: SparkSession, d: str) -> DataFrame:
    wide = roles.response_matrix(spark, d).withColumnsRenamed(
        {r: f"Drug_{i}_IC50" for i, r in enumerate(roles.RESPONSES, 1)}
    )
    long = matrices.response_key(labels.drop_missing(matrices.to_long(wide, "response", "y")))
    return long.groupBy("response_id").agg(F.count(F.lit(1)).alias("n"))


@query
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    wide = roles.response_matrix(spark, d).withColumnsRenamed(dict(zip(roles.RESPONSES, "abcde", strict=True)))
    path = results.write_table(wide, new_path(spark, "matrix"), "csv", compression="gzip")
    schema = "entity_id bigint, a double, b double, c double, d double, e double"
    splits = spark.sparkContext.defaultParallelism
    return rounded(matrices.read_matrix(spark, path, schema, splits=splits), 9, *"abcde")


@query
def missing_source_default(spark: SparkSession, d: str) -> DataFrame:
    fallback = roles.entities(spark, d)
    return matrices.read_matrix(spark, new_path(spark, "absent"), "entity_id bigint, context string", fallback)


@query
def merged_matrix(spark: SparkSession, d: str) -> DataFrame:
    order = {r: f"r{i}" for i, r in enumerate(roles.RESPONSES, 1)}
    left = roles.response_matrix(spark, d).withColumnsRenamed(order)
    right = roles.flags(spark, d).select("entity_id", *[F.col(f"`{b}`").alias(f"r{i}") for i, b in enumerate(roles.HR[:5], 1)])
    context = roles.entities(spark, d).select("entity_id", "context", F.lit(1).alias("r1_mut"))
    merged = matrices.merge_matrices(left, right, context)
    return rounded(merged, 9, *order.values())


@query
def shared_entities(spark: SparkSession, d: str) -> DataFrame:
    return matrices.require_overlap(roles.present_responses(spark, d), roles.flags(spark, d))


# ---------------------------------------------------------------- panels


@query
def panel_scores(spark: SparkSession, d: str) -> DataFrame:
    chosen = {**roles.PANELS, "narrow": roles.NARROW, "broad": roles.FULL[:11]}
    return panels.composite_scores(roles.entities(spark, d), roles.hits(spark, d), chosen, flags=("msi_status",))


@query
def panel_score_rows(spark: SparkSession, d: str) -> DataFrame:
    chosen = panels.panel_table(spark, {**roles.PANELS, "narrow": roles.NARROW, "broad": roles.FULL[:11]})
    return panels.panel_score_rows(roles.hits(spark, d), chosen)


@query
def size_panel_summary(spark: SparkSession, d: str) -> DataFrame:
    return panels.panel_summary(roles.all_brand_hits(spark, d), roles.size_panels(spark, d))


@query
def panel_scores_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = roles.scored_flags(spark, d)
    return panels.select_panel_columns(wide, ["Brand#1", "Brand#99", *roles.SCORES])


def _absent(spark: SparkSession, d: str, requested: list[str]) -> DataFrame:
    """Requested brands that no part has; one that nobody bought is there."""
    brands = roles.table(spark, d, "part").select(F.col("p_brand").alias("feature"))
    return panels.absent_features(brands, requested)


@query
def panel_missing(spark: SparkSession, d: str) -> DataFrame:
    return _absent(spark, d, [*roles.HR, "Brand#98", "Brand#99"])


@query
def panel_subset_violations(spark: SparkSession, d: str) -> DataFrame:
    part = roles.table(spark, d, "part")
    members = part.select(
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("panel"), F.col("p_brand").alias("feature")
    )
    allowed = part.filter(F.col("p_brand").isin(list(roles.FULL))).select(F.lit("full").alias("panel"), F.col("p_brand").alias("feature"))
    return panels.panel_violations(members.unionByName(allowed).distinct(), "full")


@query
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    wide = panels.add_interaction_columns(roles.flags(spark, d), [*roles.PAIRS, ("Brand#1", "Brand#99")])
    return wide.select("entity_id", *[f"{a}_x_{b}" for a, b in roles.PAIRS])


@query
def interaction_hits(spark: SparkSession, d: str) -> DataFrame:
    made = panels.interactions(panels.select_panel(roles.hits(spark, d), roles.FULL), [*roles.PAIRS, ("Brand#1", "Brand#99")])
    return made.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- labels


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses written once, for the operators that read them more than once."""
    return materialise(roles.responses(spark, d), "responses")


@query
def label_threshold(spark: SparkSession, d: str) -> DataFrame:
    return labels.threshold_labels(roles.responses(spark, d), roles.CONFIG.threshold).select("response", "entity_id", "label")


@query
def label_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.quantile_labels(_responses(spark, d)).select("response", "entity_id", "cut", "label"), 9, "cut")


@query
def label_extreme_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return labels.extreme_labels(_responses(spark, d)).select("response", "entity_id", "label")


@query
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.threshold_labels(roles.responses(spark, d), roles.CONFIG.threshold)
    return rounded(labels.class_balance(rows), 6, "pct_sensitive", "pct_resistant")


@query
def class_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.threshold_labels(roles.responses(spark, d), -1.2).join(roles.entities(spark, d), "entity_id")
    rows = rows.select("entity_id", F.concat_ws("/", "response", "context").alias("response"), "label")
    rows, size = materialise_counted(rows, "labels")
    return labels.gate(rows, roles.CONFIG.min_class, size).groupBy("response").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_sensitive")
    )


@query
def response_status(spark: SparkSession, d: str) -> DataFrame:
    present = materialise(roles.present_responses(spark, d), "responses")
    joined = labels.joined_responses(present, roles.flags(spark, d))
    rows = labels.quantile_labels(joined)
    return labels.response_status(present, rows, roles.plan(spark)).drop("response")


# ---------------------------------------------------------------- scores


def _hrd(spark: SparkSession, d: str) -> DataFrame:
    return roles.scored_flags(spark, d).select("entity_id", F.col("hrd_score").alias("score"))


@query
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.score_histogram(_hrd(spark, d))


@query
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.score_stats(_hrd(spark, d)), 9, "mean_score", "std_score")


# ---------------------------------------------------------------- tests and effects


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return assoc.contrast_counts(roles.labelled(spark, d), roles.features(spark, d), roles.FEATURES)


@query
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assoc.rank_sum(_counts(spark, d), assoc.PAIR), 9, "p_value")


def _line_counts(spark: SparkSession, d: str) -> DataFrame:
    measures = ["l_quantity", "l_discount", "l_tax"]
    lines = roles.table(spark, d, "lineitem").select("l_returnflag", *measures)
    returned = (F.col("l_returnflag") == "R").cast("int")
    long = lines.withColumn("label", returned).unpivot(["label"], measures, "feature", "v")
    return materialise(
        long.groupBy("feature", "v").agg(
            F.sum("label").cast("double").alias("n1"), F.sum(1 - F.col("label")).cast("double").alias("n0")
        ),
        "lines",
    )


@query
def mann_whitney_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assoc.rank_sum(_line_counts(spark, d), ["feature"]), 9, "p_value")


@query
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assoc.tests_from_counts(_counts(spark, d)).select(*assoc.PAIR, "p_adjusted"), 9, "p_adjusted")


@query
def significant_counts(spark: SparkSession, d: str) -> DataFrame:
    return assoc.significant_counts(assoc.tests_from_counts(_counts(spark, d)))


@query
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    tests = materialise(_spearman(spark, d, "ddr_burden").filter("p_value IS NOT NULL"), "correlations")
    return assoc.bonferroni(tests).select("response_id", "n_tests", "significant")


@query
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assoc.effect_sizes(_counts(spark, d)), 9, "cohens_d", "abs_cohens_d", "mean_sensitive", "mean_resistant")


def _spearman(spark: SparkSession, d: str, score: str = "hrd_score") -> DataFrame:
    scores = roles.scored_flags(spark, d).select("entity_id", F.col(score).alias("score"))
    return assoc.planned_spearman(_responses(spark, d), scores, roles.plan(spark))


@query
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_spearman(spark, d), 9, "spearman_rho", "p_value")


@query
def spearman_scatter(spark: SparkSession, d: str) -> DataFrame:
    points = labels.drop_missing(roles.responses(spark, d)).join(_hrd(spark, d), "entity_id")
    return rounded(points.select("response", "entity_id", "score", "y"), 9, "y")


@query
def subgroup_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    groups = roles.scored_flags(spark, d).select("entity_id", F.col("msi_status").alias("flag"))
    table = assoc.subgroup_sensitivity(roles.responses(spark, d), groups)
    return rounded(table, 9, "median_member", "median_other", "p_value")


@query
def association_matrix(spark: SparkSession, d: str) -> DataFrame:
    effects = assoc.effect_sizes(_counts(spark, d)).withColumn(
        "response", F.concat(F.lit("r"), F.substring("response", 1, 1))
    )
    names = [f"r{r[0]}" for r in roles.RESPONSES]
    return rounded(assoc.association_matrix(effects, names), 9, *names)


# ---------------------------------------------------------------- folds


@query
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return roles.folded(spark, d)


@query
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds.balanced_weights(stratified_folds(spark, d)), 9, "weight")


@query
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds.fold_scales(roles.design(spark, d), roles.FEATURES), 9, "scale", "mean_scaled_held_out")


# ---------------------------------------------------------------- curves


def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs = roles.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    marks = roles.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(marks, "doc_id").withColumn("model", F.lit("n_chars"))


def _quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_counts(_quality(spark, d), ["model"])


@query
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_points(_quality_counts(spark, d), ["model"]), 9, "fpr", "tpr")


@query
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(_quality_counts(spark, d), ["model"]), 9, "auc")


@query
def pr_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pr_points(_quality_counts(spark, d), ["model"]), 9, "precision", "recall")


@query
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pr_auc(_quality_counts(spark, d), ["model"]), 9, "pr_auc_trapezoid")


#: Models that are compared: name and features of each, both with C = 1.
COMPARED = {"HR": roles.HR, "full": roles.FEATURES}


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    """Held-out probabilities of the models under comparison, as patterns with counts ``n``."""
    design = materialise(roles.design(spark, d), "design")
    parts = []
    for name, features in COMPARED.items():
        patterns = logistic.training_patterns(design, features)
        oof, _ = logistic.cross_validate(patterns, len(features) + 1, [1.0])
        parts.append(oof.select("response", F.lit(name).alias("model"), "fold", "label", "prob", "n"))
    return materialise(parts[0].union(parts[1]), "oof")


@query
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.prevalence(_held_out(spark, d), n="n"), 9, "prevalence")


@query
def confusion(spark: SparkSession, d: str) -> DataFrame:
    scored = _held_out(spark, d).withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
    return metrics.confusion(scored, ["response", "model"], n="n")


@query
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    table = metrics.classification_metrics(_held_out(spark, d), ["response", "model", "fold"], n="n")
    return rounded(table, 9, *metrics.METRICS)


def _panel_comparison(spark: SparkSession, d: str) -> DataFrame:
    per_fold = metrics.classification_metrics(_held_out(spark, d), ["response", "model", "fold"], n="n")
    return metrics.compare_models(per_fold, ["response", "model"])


@query
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _panel_comparison(spark, d)


@query
def best_model(spark: SparkSession, d: str) -> DataFrame:
    per_fold = metrics.classification_metrics(_held_out(spark, d), ["response", "model", "fold"], n="n")
    means = metrics.mean_metrics(per_fold, ["response", "model"])
    return rounded(metrics.best_model(means, {name: i for i, name in enumerate(COMPARED)}), 9, *metrics.METRICS)


@query
def comparison_long(spark: SparkSession, d: str) -> DataFrame:
    return metrics.comparison_long(_panel_comparison(spark, d), ["response", "model"])


# ---------------------------------------------------------------- logistic regression


def _flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return assoc.contrast_counts(roles.labelled(spark, d), roles.hits(spark, d), roles.FULL)


@query
def lr_closed_form(spark: SparkSession, d: str) -> DataFrame:
    return rounded(attribution.closed_form_logit(_flag_counts(spark, d)), 9, "intercept", "coefficient")


def _patterns(spark: SparkSession, d: str, features=roles.FEATURES) -> DataFrame:
    return logistic.training_patterns(roles.design(spark, d), features, ("fold", "inner_fold"))


@query
def lr_select_c(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    grid = logistic.inner_cv(patterns, "inner_fold", len(roles.FEATURES) + 1, roles.CONFIG.c_values)
    return rounded(logistic.select_c(grid), 6, "auc")


def _lr(spark: SparkSession, d: str):
    patterns = _patterns(spark, d)
    return patterns, *logistic.cross_validate_selected(patterns, len(roles.FEATURES) + 1, roles.CONFIG.c_values)


@query
def lr_nested_cv(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics with C chosen inside each outer fold."""
    oof, _ = logistic.cross_validate_selected(_patterns(spark, d), len(roles.FEATURES) + 1, roles.CONFIG.c_values, nested=True)
    per_fold = metrics.classification_metrics(oof, ["response", "fold"], n="n")
    return rounded(metrics.mean_metrics(per_fold, ["response"]), 6, *metrics.METRICS)


@query
def lr_cv(spark: SparkSession, d: str) -> DataFrame:
    _, oof, _ = _lr(spark, d)
    per_fold = metrics.classification_metrics(oof, ["response", "fold"], n="n")
    return rounded(metrics.mean_metrics(per_fold, ["response"]), 6, *metrics.METRICS)


@query
def models_persist(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics from the written models, read back and applied to the patterns again."""
    patterns, _, models = _lr(spark, d)
    folder = results.write_results(new_path(spark, "models"), models=models)
    oof = logistic.predict(patterns, results.read_results(spark, folder, "models"), "fold")
    per_fold = metrics.classification_metrics(oof, ["response", "fold"], n="n")
    return rounded(metrics.mean_metrics(per_fold, ["response"]), 6, *metrics.METRICS)


def _panel_cv(spark: SparkSession, d: str) -> screen.PanelCv:
    return screen.cross_validate_panel(
        _responses(spark, d), materialise(roles.flags(spark, d), "flags"), roles.plan(spark), roles.HR, roles.CONFIG.seed
    )


@query
def per_response_cv_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_panel_cv(spark, d).cv.drop("response"), 6, "cv_auc_mean", "cv_auc_std")


# ---------------------------------------------------------------- attribution


@query
def linear_attribution(spark: SparkSession, d: str) -> DataFrame:
    counts = _flag_counts(spark, d)
    table = attribution.linear_attribution(counts, attribution.closed_form_logit(counts))
    return rounded(table.select(*assoc.PAIR, "mean_abs_shap"), 9, "mean_abs_shap")


@query
def attribution_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.labelled(spark, d)
    counts = _flag_counts(spark, d)
    dense = matrices.to_long(roles.flags(spark, d), "feature", "v", roles.FULL)
    table = attribution.attribution_rows(rows, dense, counts, attribution.closed_form_logit(counts))
    return rounded(table, 9, "phi")


@query
def attribution_best_response(spark: SparkSession, d: str) -> DataFrame:
    return rounded(screen.attribute_best(_panel_cv(spark, d), roles.HR), 6, "mean_abs_shap", "mean_signed_shap")


@query
def importance_fallback(spark: SparkSession, d: str) -> DataFrame:
    _, _, models = screen.scaled_cv(roles.quartile_design(spark, d), roles.HR)
    table = attribution.coefficient_importance(attribution.long_coefficients(models, roles.HR, "scaled"))
    return rounded(table, 6, "mean_abs_shap")


@query
def biomarker_summary(spark: SparkSession, d: str) -> DataFrame:
    """Evidence on every feature of the model; attributions are those of the refit on all rows."""
    patterns, _, models = _lr(spark, d)
    counts = assoc.counts_from_patterns(patterns, roles.FEATURES)
    linear = attribution.linear_attribution(counts, attribution.long_coefficients(models, roles.FEATURES))
    table = assoc.biomarker_summary(linear, assoc.tests_from_counts(counts), assoc.effect_sizes(counts))
    return rounded(rounded(table, 6, "mean_abs_shap"), 9, "p_value", "p_adjusted", "cohens_d", "abs_cohens_d")


@query
def resubstitution_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of the regression refitted on all rows, on those rows."""
    patterns, _, models = _lr(spark, d)
    again = logistic.predict(patterns, models, None).withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
    return metrics.confusion(again, ["response"], n="n")


@query
def oof_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of the same regression on the rows it had not seen."""
    _, oof, _ = _lr(spark, d)
    return metrics.confusion(oof.withColumn("predicted", (F.col("prob") > 0.5).cast("int")), ["response"], n="n")


@query
def top_biomarkers(spark: SparkSession, d: str) -> DataFrame:
    place = Window.partitionBy("response").orderBy("composite_rank", "feature")
    return (
        biomarker_summary(spark, d)
        .withColumn("place", F.row_number().over(place))
        .filter("place <= 5")
        .select("response", "place", "feature", "composite_rank")
    )


# ---------------------------------------------------------------- boosting


def _boosting_patterns(spark: SparkSession, d: str) -> DataFrame:
    return boosting.boosting_patterns(roles.design(spark, d), roles.FEATURES, roles.CONFIG.seed)


@query
def gbt_cv(spark: SparkSession, d: str) -> DataFrame:
    patterns, params = _boosting_patterns(spark, d), roles.CONFIG.boosting
    models = boosting.fit_boosting(patterns, params, range(roles.CONFIG.folds))
    oof = boosting.predict_boosting(patterns, models, params.depth, "fold")
    per_fold = metrics.classification_metrics(oof, ["response", "fold"], n="n")
    return rounded(metrics.mean_metrics(per_fold, ["response"]), 6, *metrics.METRICS)


def _boosted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    patterns = _boosting_patterns(spark, d)
    return patterns, boosting.fit_boosting(patterns, roles.CONFIG.boosting, [logistic.ALL_ROWS])


@query
def tree_attribution(spark: SparkSession, d: str) -> DataFrame:
    vectors = attribution.tree_attribution_vectors(*_boosted(spark, d))
    return rounded(attribution.tree_attribution(vectors, roles.FEATURES), 6, "mean_abs_shap", "mean_signed_shap")


@query
def tree_local_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors whose attributions don't add up to the margin within 1e-9: none."""
    return attribution.tree_local_accuracy(*_boosted(spark, d), roles.CONFIG.boosting.depth)


@query
def tree_importance(spark: SparkSession, d: str) -> DataFrame:
    _, models = _boosted(spark, d)
    return rounded(attribution.tree_importance(models, roles.FEATURES), 6, "mean_abs_shap")


@query
def boosted_persist(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose probability by the written, reread boosted models differs: none."""
    patterns, models = _boosted(spark, d)
    folder = results.write_results(new_path(spark, "models"), models=models)
    depth = roles.CONFIG.boosting.depth
    again = boosting.predict_boosting(patterns, results.read_results(spark, folder, "models"), depth, None)
    key = ["response", "fold", "part", "label", "x"]
    now = boosting.predict_boosting(patterns, models, depth, None).withColumnRenamed("prob", "now")
    both = again.join(now.select(*key, "now"), key)
    return both.groupBy("response").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("prob") == F.col("now"), 0).otherwise(F.col("n"))).alias("n_off"))


def _screen(spark: SparkSession, d: str) -> screen.Screen:
    return screen.run_screen(roles.responses(spark, d), roles.flags(spark, d), roles.CONFIG)


@query
def screen_summary(spark: SparkSession, d: str) -> DataFrame:
    table = _screen(spark, d).summary
    return rounded(table, 6, "mean_abs_shap", "p_value", "p_adjusted", "cohens_d", "abs_cohens_d")


# ---------------------------------------------------------------- context and reports


@query
def context_onehot(spark: SparkSession, d: str) -> DataFrame:
    return report.context_onehot(roles.entities(spark, d), roles.CONTEXTS)


BASE_SET, FULL_SET = "flags", "flags + context"


def _ablation(spark: SparkSession, d: str) -> DataFrame:
    """Fold AUCs on extreme quartiles: flags and the instability flag, without and with the context."""
    design = roles.quartile_design(spark, d, extreme=True)
    sizes = labels.class_balance(design).select("response", "n", "n_sensitive").join(roles.plan(spark), "response")
    context = tuple(f"context_{c}" for c in roles.CONTEXTS)
    base = (*roles.FULL, "msi_status")
    runs = []
    for name, features in ((BASE_SET, base), (FULL_SET, (*base, *context))):
        fold_auc, _, _ = screen.scaled_cv(design, features)
        runs.append(metrics.auc_summary(fold_auc, ["response"]).withColumn("feature_set", F.lit(name)))
    keys = ["response_id", "response_name", "n", "n_sensitive"]
    return report.ablation(runs[0].unionByName(runs[1]).join(sizes, "response"), keys, BASE_SET, FULL_SET)


@query
def feature_set_ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ablation(spark, d), 6, "auc_base", "std_base", "auc_full", "std_full", "delta")


def _score_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Fold AUCs of the models on the narrow and on the full feature set, side by side for each response."""
    scored = _held_out(spark, d)
    keys = ["response", "model", "fold"]
    per_fold = metrics.roc_auc(metrics.score_counts(scored, keys, "prob", n="n"), keys)
    cv = metrics.auc_summary(per_fold, ["response", "model"]).withColumnRenamed("model", "feature_set")
    sizes = labels.class_balance(roles.labelled(spark, d)).select("response", "n", "n_sensitive")
    keys = ["response_id", "response_name", "n", "n_sensitive"]
    return report.ablation(cv.join(sizes, "response").join(roles.plan(spark), "response"), keys, "HR", "full")


@query
def score_ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_score_ablation(spark, d), 9, "auc_base", "std_base", "auc_full", "std_full", "delta")


@query
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    return report.benchmark_lines(_score_ablation(spark, d), "HR", "full")


@query
def ablation_csv_report(spark: SparkSession, d: str) -> DataFrame:
    """The ablation written as CSV, read again by its schema, and printed as a report."""
    path = results.write_table(_score_ablation(spark, d), new_path(spark, "ablation"), "csv")
    schema = "response_id int, response_name string, n long, n_sensitive long, auc_base double, std_base double, auc_full double, std_full double, delta double"
    good, _ = results.read_csv_result(spark, path, schema)
    return report.benchmark_lines(good, "HR", "full")


@query
def score_report(spark: SparkSession, d: str) -> DataFrame:
    requested = [*roles.HR, "Brand#98"]
    absent = {r.feature for r in _absent(spark, d, requested).collect()}
    used, missing = [b for b in requested if b not in absent], [b for b in requested if b in absent]
    return report.score_lines(_hrd(spark, d), _spearman(spark, d), used, missing)


@query
def results_persist(spark: SparkSession, d: str) -> DataFrame:
    scored = _held_out(spark, d)
    per_fold = metrics.classification_metrics(scored, ["response", "model", "fold"], n="n")
    folder = results.write_results(new_path(spark, "results"), oof=scored, fold_metrics=per_fold)
    oof = results.read_results(spark, folder, "oof").groupBy("response", "model", "fold").agg(F.sum("n").alias("n"))
    kept = results.read_results(spark, folder, "fold_metrics").select("response", "model", "fold", "accuracy")
    return rounded(oof.join(kept, ["response", "model", "fold"]), 9, "accuracy")
