import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from dataclasses import replace

from assaylens.config import BoostingParams
from assaylens.operators import folds, logistic
from assaylens.plans import roles, screen
from assaylens.session import materialise, new_path
from assaylens.sources import results

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    rows = []
    for response, slope in (("r", 3.0), ("s", -3.0)):
        for i in range(160):
            x = rng.integers(0, 2, 3)
            p = 1 / (1 + np.exp(-slope * (x[0] - 0.5)))
            rows.append((i, response, int(rng.random() < p), *map(int, x)))
    df = spark.createDataFrame(rows, "entity_id int, response string, label int, a int, b int, c int")
    return folds.stratified_folds(df, {"fold": 5, "inner_fold": 3}, 42).persist()


def objective_gradient(x, y, w, beta, c):
    p = 1 / (1 + np.exp(-(x @ beta)))
    penalty = np.r_[0.0, beta[1:]]
    return penalty + c * x.T @ (w * (p - y))


def test_fits_are_optimal(spark, design):
    patterns = logistic.training_patterns(design, NAMES, ("fold", "inner_fold"))
    for split, held, c in (("fold", 2, 1.0), ("inner_fold", 0, 0.01), ("fold", logistic.ALL_ROWS, 10.0)):
        fits = logistic.plan_fits(patterns, [split], 4, [c], True).filter(F.col("held_out") == held)
        for fit in logistic.fit_many(patterns, [split], fits, 4).collect():
            rows = design.filter(F.col("response") == fit.response).toPandas()
            rows = rows[rows[split] != held]
            y = rows.label.to_numpy()
            w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            x = np.column_stack([np.ones(len(rows)), rows[NAMES].to_numpy(float)])
            assert np.abs(objective_gradient(x, y, w, np.r_[fit.intercept, fit.coefficients], c)).max() < 1e-8


def test_fit_equals_mllib(spark, design):
    patterns = logistic.training_patterns(design, NAMES)
    _, models = logistic.cross_validate(patterns, 4, [1.0])
    ours = models.filter((F.col("held_out") == -1) & (F.col("response") == "r")).first()
    rows = design.filter("response = 'r'")
    n, n1 = rows.count(), rows.filter("label = 1").count()
    weighted = rows.withColumn("w", F.when(F.col("label") == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1))))
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(weighted)
    model = LogisticRegression(weightCol="w", regParam=1 / n, standardization=False, maxIter=500, tol=1e-12).fit(data)
    assert ours.intercept == pytest.approx(model.intercept, abs=1e-5)
    assert ours.coefficients == pytest.approx(list(model.coefficients), abs=1e-5)


def test_groups_of_fits_change_nothing(spark, design, monkeypatch):
    patterns = logistic.training_patterns(design, NAMES)

    def fitted():
        models = logistic.fit_many(patterns, ["fold"], logistic.plan_fits(patterns, ["fold"], 4, [1.0], scaled=True), 4)
        return sorted(models.collect(), key=lambda r: (r.response, r.held_out))

    whole = fitted()
    monkeypatch.setattr(logistic, "STATE_DOUBLES", 50)
    split = fitted()
    assert len(split) == len(whole) == 10
    for a, b in zip(whole, split, strict=True):
        assert (a.response, a.held_out) == (b.response, b.held_out) and a.scaled == pytest.approx(b.scaled, abs=1e-10)


def test_scaling_inside_the_training_fold(spark, design):
    patterns = logistic.training_patterns(design, NAMES)
    table = {(r.response, r.fold, r.feature): r.scale for r in folds.fold_scales(design, NAMES).collect()}
    for fit in logistic.plan_fits(patterns, ["fold"], 4, [1.0], scaled=True).collect():
        expected = [table[(fit.response, fit.held_out, f)] for f in NAMES]
        assert fit.scale == pytest.approx([1.0, *expected])


def test_separable_data_converges(spark):
    df = spark.createDataFrame([(i, "r", int(i < 20), int(i < 20), i % 5) for i in range(40)], "entity_id int, response string, label int, a int, fold int")
    patterns = logistic.training_patterns(df, ["a"])
    fits = logistic.fit_many(patterns, ["fold"], logistic.plan_fits(patterns, ["fold"], 2, [100.0], True), 2).collect()
    assert len(fits) == 6 and all(f.note == "" and np.isfinite(f.intercept) and f.coefficients[0] > 0 for f in fits)


def test_a_fit_that_fails_is_a_note(spark, design):
    """One response has one class, one an infinite feature; the other is fitted as if alone."""
    odd = design.filter("response = 's'")
    lone = odd.withColumn("label", F.lit(1)).withColumn("response", F.lit("lone"))
    broken = odd.withColumn("response", F.lit("broken")).withColumn("a", F.when(F.col("entity_id") == 3, F.lit(float("inf"))).otherwise(F.col("a")))
    wide = design.withColumn("a", F.col("a").cast("double"))
    together = wide.unionByName(lone.withColumn("a", F.col("a").cast("double"))).unionByName(broken)
    oof, models = logistic.cross_validate(logistic.training_patterns(together, NAMES), 4, [1.0])
    errors = {r.response: r.error for r in logistic.fit_errors(models).collect()}
    assert errors == {"lone": "one class", "broken": "sums are not finite"}
    assert oof.filter("response in ('r', 's')").agg(F.sum("n")).first()[0] == 320
    _, alone = logistic.cross_validate(logistic.training_patterns(design, NAMES), 4, [1.0])
    key = lambda r: (r.response, r.held_out)
    for a, b in zip(sorted(alone.collect(), key=key), sorted(models.filter("response in ('r', 's')").collect(), key=key), strict=True):
        assert a.coefficients == pytest.approx(b.coefficients, abs=1e-9)


def test_panel_cv_keeps_error_rows(spark):
    rng = np.random.default_rng(2)
    flags = spark.createDataFrame([(i, int(rng.integers(0, 2)), float("inf") if i == 3 else 1.0 * int(rng.integers(0, 2))) for i in range(120)], "entity_id int, a int, b double")
    rows = [(i, r, float(rng.normal())) for i in range(120) for r in ("good", "bad") if r == "bad" or i != 3]
    responses = spark.createDataFrame(rows, "entity_id int, response string, y double")
    plan = spark.createDataFrame([(1, "good", "Good"), (2, "bad", "Bad"), (3, "gone", "Gone")], "response_id int, response string, response_name string")
    cv = {r.response: r for r in screen.cross_validate_panel(materialise(responses, "r"), materialise(flags, "f"), plan, ["a", "b"]).cv.collect()}
    assert cv["bad"].note == "cv error: sums are not finite" and cv["bad"].cv_auc_mean is None and cv["bad"].n == 120
    assert cv["good"].note == "" and 0 < cv["good"].cv_auc_mean < 1 and cv["gone"].note == "response absent"


def test_nested_selection_ignores_the_held_out_fold(spark):
    """Each outer fold's C equals the plain choice on the other folds' rows alone, and the folds differ."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        x = rng.integers(0, 2, 8)
        p = 1 / (1 + np.exp(-(0.9 * x[0] - 0.45)))
        rows.append((i, "r", int(rng.random() < p), *map(int, x)))
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame(rows, "entity_id int, response string, label int, " + ", ".join(f"{f} int" for f in names))
    patterns = logistic.training_patterns(folds.stratified_folds(df, {"fold": 4, "inner_fold": 3}, 5), names, ("fold", "inner_fold"))
    grid = [0.001, 0.1, 10.0]
    nested = logistic.nested_cv(patterns, "fold", "inner_fold", 9, grid)
    got = {(r.held_out, r.c): r.auc for r in nested.collect()}
    for fold in range(4):
        rest = logistic.inner_cv(patterns.filter(F.col("fold") != fold), "inner_fold", 9, grid)
        assert {(fold, r.c): r.auc for r in rest.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in got.items() if k[0] == fold}
    chosen = {r.held_out: r.c for r in logistic.select_c(nested).collect()}
    plain = logistic.select_c(logistic.inner_cv(patterns, "inner_fold", 9, grid)).first().c
    assert set(chosen) == set(range(4)) and set(chosen.values()) != {plain}
    oof, models = logistic.cross_validate_selected(patterns, 9, grid, nested=True)
    assert {r.held_out: r.c for r in models.collect()} == chosen and oof.agg(F.sum("n")).first()[0] == 240


def test_smaller_c_wins_ties(spark):
    grid = spark.createDataFrame([("r", 10.0, 0.6), ("r", 0.1, 0.6), ("r", 1.0, 0.5)], "response string, c double, auc double")
    assert logistic.select_c(grid).first().c == 0.1


def test_screen_on_the_small_tables(spark):
    config = replace(roles.CONFIG, boosting=BoostingParams(trees=2, depth=2), responses=roles.RESPONSES[:2], c_values=(0.1, 1.0))
    run = screen.run_screen(roles.responses(spark, SMALL), roles.flags(spark, SMALL), config)
    summary = run.summary.collect()
    assert len(summary) == 2 * 16
    assert all(0 <= r.p_value <= 1 and 0 <= r.p_adjusted <= 1 for r in summary)
    for row in run.fold_metrics.collect():
        assert all(0 <= row[m] <= 1 for m in ("auc", "accuracy", "precision", "recall", "f1"))
    entities = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    assert run.oof.count() == 2 * 2 * entities
    cells = run.confusion.groupBy("response").agg(F.sum("n").alias("n")).collect()
    assert [r.n for r in cells] == [entities] * 2
    folder = screen.write_screen(run, new_path(spark, "screen"))
    curves = screen.evaluate_results(spark, folder)
    assert curves["roc_auc"].count() == 4 and curves["comparison"].count() == 20
    assert curves["prevalence"].first().n == 4 * entities
    models = results.read_results(spark, folder, "models")
    assert models.count() == 2 * (roles.CONFIG.folds + 1) and len(models.first().features) == len(models.first().coefficients)
    with pytest.raises(ValueError, match="not found"):
        screen.run_screen(roles.responses(spark, SMALL), roles.flags(spark, SMALL), replace(config, responses=("nope",)))
    apart = roles.flags(spark, SMALL).withColumn("entity_id", F.col("entity_id") + 10**9)
    with pytest.raises(ValueError, match="share no entity"):
        screen.run_screen(roles.responses(spark, SMALL), apart, config)
    back = spark.read.csv(f"{folder}/biomarkers", header=True)
    assert back.count() == 32 and "response" in back.columns


def test_score_study_on_the_small_tables(spark):
    study = screen.run_score_study(
        roles.responses(spark, SMALL), roles.flags(spark, SMALL), roles.plan(spark), [*roles.HR, "Brand#99"]
    )
    assert [r.feature for r in study.missing.collect() if r.feature == "Brand#99"] == ["Brand#99"]
    notes = {r.response: r.note for r in study.cv.collect()}
    assert notes["6-ABSENT"] == "response absent" and notes["5-LOW"] == ""
    assert study.correlations.count() == 6
    assert study.attribution.count() == 6
    assert study.lines.count() > 6
