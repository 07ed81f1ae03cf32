import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assaylens.config import StudyConfig
from assaylens.operators import association as assoc
from assaylens.operators import folds, labels, metrics, panels, report
from assaylens.session import dimension, materialise, new_path, shared_dir
from assaylens.sources import matrices, results

RESP = "entity_id int, response string, y double"


def responses(spark, rows):
    return spark.createDataFrame(rows, RESP)


# ---- sources


def test_csv_roundtrip_and_default(spark):
    wide = spark.createDataFrame([(1, 0.5, None), (2, -1.0, 2.0)], "entity_id int, a double, b double")
    path = results.write_table(wide, new_path(spark, "t"), "csv", compression="gzip")
    back = matrices.read_matrix(spark, path, "entity_id int, a double, b double", splits=2)
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, None), (2, -1.0, 2.0)]
    gone = new_path(spark, "gone")
    assert matrices.read_matrix(spark, gone, "entity_id int", wide) is wide
    assert matrices.read_matrix(spark, None, "entity_id int", wide) is wide
    with pytest.raises(AnalysisException):
        matrices.read_matrix(spark, gone, "entity_id int")


def test_long_and_wide_keep_missing_cells(spark):
    wide = spark.createDataFrame([(1, 0.5, None), (2, None, 2.0)], "entity_id int, a double, b double")
    long = matrices.to_long(wide, "response", "y")
    assert long.count() == 4
    assert sorted(map(tuple, matrices.to_wide(long, "response", "y", ["a", "b"]).collect())) == sorted(map(tuple, wide.collect()))


def test_dirty_flags(spark):
    raw = [("1",), ("0",), ("x",), (None,), ("1.9",), ("-1.9",), ("NaN",), (" 1",), ("1e99",)]
    got = [r[0] for r in spark.createDataFrame(raw, "v string").select(matrices.to_flag("v")).collect()]
    assert got == [1, 0, 0, 0, 1, -1, 0, 1, 0]


def test_response_key_parsing(spark):
    df = spark.createDataFrame([("Drug_1017_IC50",), ("other",)], "response string")
    assert [r.response_id for r in matrices.response_key(df).collect()] == [1017, None]


def test_merge_renames_collisions_and_keeps_shared_rows(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "entity_id int, a double")
    right = spark.createDataFrame([(2, 5), (3, 6)], "entity_id int, a int")
    context = spark.createDataFrame([(2, "x")], "entity_id int, a string")
    assert matrices.merge_matrices(left, right, context).collect()[0].asDict() == {
        "entity_id": 2, "a": 2.0, "a_mut": 5, "a_meta": "x",
    }
    with pytest.raises(ValueError):
        matrices.require_overlap(left, right.filter("entity_id = 3"))


def test_results_lookup(spark):
    folder = new_path(spark, "res")
    with pytest.raises(FileNotFoundError, match="run the screen first"):
        results.read_results(spark, folder)
    results.write_table(spark.range(1), f"{folder}/model_comparison")
    with pytest.raises(FileNotFoundError, match="summary only"):
        results.read_results(spark, folder)
    results.write_results(folder, oof=spark.range(3))
    assert results.read_results(spark, folder).count() == 3
    with pytest.raises(ValueError):
        results.write_results(folder, other=spark.range(1))


def test_report_lines_are_written_in_order(spark):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    path = results.write_lines(lines, "line_no", new_path(spark, "txt"))
    assert [r.value for r in spark.read.text(path).collect()] == ["a", "b"]


class FakeSession:
    """Stands for a session: its checkpoint setting, its master, its context's folder."""

    def __init__(self, setting=None, master="local[2]"):
        self.setting, self.master, self.folder = setting, master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.setting if key == "spark.checkpoint.dir" and self.setting else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(FakeSession("hdfs://x/shared", "yarn")) == "hdfs://x/shared"
    local = FakeSession()
    assert shared_dir(local) == shared_dir(local) == local.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(master="yarn"))
    assert new_path(spark, "x").startswith(shared_dir(spark))
    assert new_path(spark, "x") != new_path(spark, "x")


def test_config_checks():
    StudyConfig().validate()
    for bad in (
        {"hr_panel": ("NOPE",)}, {"mmr_panel": ("NOPE",)}, {"folds": 1}, {"seed": -1}, {"responses": ()},
    ):
        with pytest.raises(ValueError):
            StudyConfig(**bad).validate()


# ---- panels


def test_scores_ignore_unknown_genes_and_missing_flags(spark):
    wide = spark.createDataFrame([(1, 1, 1), (2, None, 1), (3, 0, 0)], "entity_id int, A int, B int")
    scored = panels.add_scores(wide, {"s": ["A", "B", "X"], "m": ["B"], "none": ["X"]}, flags=("m", "none"))
    assert [(r.s, r.m, r.none) for r in scored.orderBy("entity_id").collect()] == [(2, 1, 0), (1, 1, 0), (0, 0, 0)]
    hits = panels.sparse_features(wide.fillna(0), ["A", "B"])
    long = panels.composite_scores(wide, hits, {"s": ["A", "B", "X"], "m": ["B"]}, flags=("m",))
    assert [(r.s, r.m) for r in long.orderBy("entity_id").collect()] == [(2, 1), (1, 1), (0, 0)]
    assert [r.feature for r in panels.missing_features(spark, wide.columns, ["A", "X"]).collect()] == ["X"]
    assert panels.select_panel_columns(wide, ["B", "X"]).columns == ["entity_id", "B"]
    dense = panels.flag_matrix(wide.select("entity_id"), hits, ["A", "B", "X"])
    assert sorted(map(tuple, dense.collect())) == [(1, 1, 1, 0), (2, 0, 1, 0), (3, 0, 0, 0)]


def test_interactions_long_and_wide_agree(spark):
    wide = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 1)], "entity_id int, A int, B int, C int")
    pairs = [("A", "B"), ("B", "C"), ("A", "X")]
    got = panels.interactions(panels.sparse_features(wide, ["A", "B", "C"]), pairs).collect()
    assert [(r.entity_id, r.feature, r.v) for r in got] == [(1, "A_x_B", 1.0)]
    assert panels.add_interaction_columns(wide, pairs).columns == ["entity_id", "A", "B", "C", "A_x_B", "B_x_C"]


# ---- labels


def test_threshold_is_strict_and_missing_is_resistant(spark):
    df = responses(spark, [(1, "r", -0.1), (2, "r", 0.0), (3, "r", None), (4, "r", float("nan"))])
    got = {r.entity_id: r.label for r in labels.threshold_labels(df, 0.0).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}


def test_quantile_label_is_inclusive_and_drops_missing(spark):
    df = responses(spark, [(i, "r", float(i)) for i in range(1, 6)] + [(6, "r", None), (7, "r", float("nan"))])
    got = {r.entity_id: r.label for r in labels.quantile_labels(df).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    ends = {r.entity_id: r.label for r in labels.extreme_labels(df).collect()}
    assert ends == {1: 1, 2: 1, 4: 0, 5: 0}


def test_gate_and_unknown_responses(spark):
    rows = [(i, "ok", -1.0 if i < 15 else 1.0) for i in range(30)] + [(i, "thin", -1.0 if i < 14 else 1.0) for i in range(40)]
    df = responses(spark, rows)
    kept = labels.gate(labels.threshold_labels(df, 0.0), 15)
    assert {r.response for r in kept.select("response").distinct().collect()} == {"ok"}
    labels.require_responses(df, ["ok"])
    with pytest.raises(ValueError, match="nope"):
        labels.require_responses(df, ["ok", "nope"])


def test_status_notes(spark):
    rows = (
        [(i, "good", float(i)) for i in range(50)]
        + [(i, "few", float(i)) for i in range(39)]
        + [(i, "flat", 1.0) for i in range(50)]
        + [(i, "apart", float(i)) for i in range(100, 150)]
    )
    df = responses(spark, rows)
    plan = dimension(
        spark, [(1, "good", "G"), (2, "few", "F"), (3, "flat", "L"), (4, "apart", "A"), (5, "gone", "N")],
        "response_id int, response string, response_name string",
    )
    joined = labels.joined_responses(df, spark.range(60).select(F.col("id").cast("int").alias("entity_id")))
    got = {r.response: (r.n, r.n_sensitive, r.note) for r in labels.response_status(df, labels.quantile_labels(joined), plan).collect()}
    assert got == {
        "good": (50, 13, ""),
        "few": (39, 0, "insufficient samples"),
        "flat": (50, 50, "class imbalance"),
        "apart": (0, 0, "no joined rows"),
        "gone": (0, 0, "response absent"),
    }


# ---- tests of association


def contrast(spark, label, value, panel=None):
    lab = spark.createDataFrame([(i, "r", c) for i, c in enumerate(label)], "entity_id int, response string, label int")
    feat = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(value)], "entity_id int, feature string, v double")
    return assoc.contrast_counts(lab, feat, panel)


def brute_u(label, value):
    ones = [v for c, v in zip(label, value, strict=True) if c == 1]
    zeros = [v for c, v in zip(label, value, strict=True) if c == 0]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)


def test_rank_sum_against_pairs(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 80).tolist()
    value = np.round(rng.normal(size=80), 1).tolist()
    row = assoc.rank_sum(contrast(spark, label, value), assoc.PAIR).first()
    assert row.u_statistic == brute_u(label, value)
    assert 0 < row.p_value <= 1


def test_rank_sum_special_cases(spark):
    flat = assoc.rank_sum(contrast(spark, [1, 1, 0, 0], [2, 2, 1, 1]), assoc.PAIR).first()
    assert (flat.u_statistic, flat.p_value) == (0.0, 1.0)
    empty = assoc.rank_sum(contrast(spark, [0, 0, 0], [1, 2, 3]), assoc.PAIR).first()
    assert (empty.u_statistic, empty.p_value) == (0.0, 1.0)
    exact = assoc.rank_sum(contrast(spark, [1, 1, 1, 0, 0, 0], [1, 2, 3, 4, 5, 6]), assoc.PAIR).first()
    assert exact.u_statistic == 0.0 and exact.p_value == pytest.approx(0.1)


def test_sparse_counts_equal_dense_counts(spark):
    label, value = [1, 1, 0, 0, 1], [0, 2, 0, 1, 0]
    lab = spark.createDataFrame([(i, "r", c) for i, c in enumerate(label)], "entity_id int, response string, label int")
    dense = [(i, "f", float(v)) for i, v in enumerate(value)]
    schema = "entity_id int, feature string, v double"
    full = assoc.contrast_counts(lab, spark.createDataFrame(dense, schema))
    thin = assoc.contrast_counts(lab, spark.createDataFrame([r for r in dense if r[2]], schema), ["f", "never"])
    assert sorted(map(tuple, thin.filter("feature = 'f'").collect())) == sorted(map(tuple, full.collect()))
    assert [tuple(r) for r in thin.filter("feature = 'never'").collect()] == [("r", "never", 0.0, 3.0, 2.0)]
    never = assoc.rank_sum(thin, assoc.PAIR).filter("feature = 'never'").first()
    assert (never.u_statistic, never.p_value) == (0.0, 1.0)


def test_effect_size_rules(spark):
    def d(label, value):
        return assoc.effect_sizes(contrast(spark, label, value)).first()

    label, value = [1, 1, 1, 0, 0], [3.0, 4.0, 8.0, 1.0, 2.0]
    ones, zeros = np.array(value[:3]), np.array(value[3:])
    pooled = math.sqrt((2 * ones.var(ddof=1) + zeros.var(ddof=1)) / 3)
    assert d(label, value).cohens_d == pytest.approx((ones.mean() - zeros.mean()) / pooled)
    assert d([1, 0, 0], [5, 1, 2]).cohens_d == pytest.approx((5 - 1.5) / math.sqrt(0.5 / 1))
    assert d([1, 1, 0, 0], [2, 2, 1, 1]).cohens_d == 0.0
    one_class = d([0, 0, 0], [1, 2, 3])
    assert one_class.cohens_d is None and one_class.mean_sensitive is None and one_class.mean_resistant == 2.0
    # a large offset must not swamp the spread
    shifted = d(label, [v + 1e9 for v in value])
    assert shifted.cohens_d == pytest.approx(d(label, value).cohens_d, rel=1e-6)


def test_fdr_with_ties_against_the_loop(spark, tiny_groups):
    p = [0.001, 0.01, 0.01, 0.2, 0.2, 0.2, 0.9, 1.0, 0.04, 0.03]
    tests = materialise(spark.createDataFrame([("r", f"f{i}", v) for i, v in enumerate(p)], "response string, feature string, p_value double"), "t")
    order = np.argsort(p)
    raw = np.minimum(1, np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))
    expected = dict(zip([f"f{i}" for i in order], np.minimum.accumulate(raw[::-1])[::-1], strict=True))
    got = {r.feature: r.p_adjusted for r in assoc.adjust_fdr(tests).collect()}
    assert got == pytest.approx(expected)
    flagged = assoc.bonferroni(tests).filter("significant = 1").collect()
    assert {r.feature for r in flagged} == {"f0"}


def test_spearman_against_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"response": "r", "score": rng.integers(0, 4, 70), "y": np.round(rng.normal(size=70), 1)})
    row = assoc.spearman(spark.createDataFrame(pdf)).first()
    expected = pdf.score.rank().corr(pdf.y.rank())
    assert row.n == 70 and row.spearman_rho == pytest.approx(expected, abs=1e-12)
    flat = assoc.spearman(spark.createDataFrame(pdf.assign(score=1))).first()
    assert flat.spearman_rho is None and flat.p_value is None


def test_summary_fills_missing_evidence(spark):
    key = "response string, feature string, "
    shap = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.1)], key + "mean_abs_shap double")
    tests = spark.createDataFrame([("r", "a", 3.0, 0.01, 0.02), ("r", "c", 1.0, 0.5, 0.5)], key + "u_statistic double, p_value double, p_adjusted double")
    effects = spark.createDataFrame([("r", "b", -2.0, 2.0)], key + "cohens_d double, abs_cohens_d double")
    got = {r.feature: r for r in assoc.biomarker_summary(shap, tests, effects).collect()}
    assert got["c"].mean_abs_shap == 0.0 and got["b"].p_adjusted == 1.0 and got["a"].abs_cohens_d == 0.0
    assert got["a"].cohens_d is None and got["b"].u_statistic is None
    assert got["a"].effect_rank == got["c"].effect_rank == 2.5
    assert {f: r.composite_rank for f, r in got.items()} == {"a": 4.5, "b": 6.0, "c": 7.5}


# ---- folds and metrics


def test_folds_are_stratified_and_stable(spark):
    df = spark.createDataFrame([(i, "r", int(i % 3 == 0)) for i in range(100)], "entity_id int, response string, label int")
    dealt = folds.stratified_folds(df, {"fold": 5, "inner": 3}, 42)
    sizes = dealt.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        per = [r["count"] for r in sizes if r.label == label]
        assert len(per) == 5 and max(per) - min(per) <= 1
    again = folds.stratified_folds(df.repartition(7), {"fold": 5, "inner": 3}, 42)
    assert dealt.exceptAll(again.select(dealt.columns)).count() == 0
    other = folds.stratified_folds(df, {"fold": 5, "inner": 3}, 43)
    assert dealt.exceptAll(other.select(dealt.columns)).count() > 0


def test_metrics_edge_cases(spark):
    rows = [("one", 1, 0.7), ("one", 1, 0.4), ("none", 1, 0.1), ("none", 0, 0.2)]
    df = spark.createDataFrame(rows, "model string, label int, prob double")
    got = {r.model: r for r in metrics.classification_metrics(df, ["model"]).collect()}
    assert (got["one"].auc, got["one"].accuracy, got["one"].recall) == (0.5, 0.5, 0.5)
    assert (got["none"].auc, got["none"].precision, got["none"].f1) == (0.0, 0.0, 0.0)
    at_half = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.4)], "model string, label int, prob double")
    assert metrics.classification_metrics(at_half, ["model"]).first().recall == 0.0


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(2)
    label, score = rng.integers(0, 2, 60), rng.integers(0, 12, 60) / 10
    df = spark.createDataFrame([("m", int(c), float(s)) for c, s in zip(label, score, strict=True)], "model string, label int, score double")
    counts = metrics.score_counts(df, ["model"])
    assert metrics.roc_auc(counts, ["model"]).first().auc == pytest.approx(
        brute_u(label, score) / (label.sum() * (1 - label).sum())
    )
    points = metrics.roc_points(counts, ["model"]).orderBy("fpr", "tpr").collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:], strict=False))
    assert area == pytest.approx(metrics.roc_auc(counts, ["model"]).first().auc)
    pr = metrics.pr_points(counts, ["model"]).orderBy(F.col("threshold").asc_nulls_last()).collect()
    area = sum((a.recall - b.recall) * (a.precision + b.precision) / 2 for a, b in zip(pr, pr[1:], strict=False))
    assert area == pytest.approx(metrics.pr_auc(counts, ["model"]).first().pr_auc_trapezoid)


def test_best_model_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("r", "GBM", 0.7), ("r", "LR", 0.7), ("s", "GBM", 0.8), ("s", "LR", 0.7)], "response string, model string, auc double")
    got = {r.response: r.model for r in metrics.best_model(df, {"LR": 0, "GBM": 1}).collect()}
    assert got == {"r": "LR", "s": "GBM"}


# fixed values: published fold AUC means and deviations of two feature sets
PUBLISHED_CV = [
    (1017, "Olaparib", 424, 212, 0.6033328059906132, 0.05107495761085224, 0.7356905552918841, 0.05047175285724946),
    (1175, "Rucaparib", 460, 230, 0.522117202268431, 0.04619056943885953, 0.6814744801512287, 0.046257102365998434),
    (1259, "Talazoparib", 456, 228, 0.5831621508086536, 0.05178946568890084, 0.7130833858433102, 0.029639274873727067),
    (1030, "KU-55933", 424, 212, 0.5867518325159522, 0.05440912142406868, 0.7500026367136001, 0.02469083067981608),
    (1022, "AZD7762", 424, 212, 0.5940410272636185, 0.04932804464342719, 0.7724753467278385, 0.035911543056351046),
]


def test_published_benchmark_table(spark):
    rows = [(*r[:4], name, *pair) for r in PUBLISHED_CV for name, pair in (("base", r[4:6]), ("full", r[6:8]))]
    cv = spark.createDataFrame(rows, "response_id int, response_name string, n int, n_sensitive int, feature_set string, cv_auc_mean double, cv_auc_std double")
    table = report.ablation(cv, ["response_id", "response_name", "n", "n_sensitive"], "base", "full")
    lines = [r.line for r in report.benchmark_lines(table, "base", "full").orderBy("section", "key").collect()]
    assert "| Olaparib | 424 | 212 | 0.603 ± 0.051 | 0.736 ± 0.050 | +0.132 |" in lines
    assert "| AZD7762 | 424 | 212 | 0.594 ± 0.049 | 0.772 ± 0.036 | +0.178 |" in lines
    assert lines[-3:] == ["**Mean AUC (base): 0.578**", "**Mean AUC (full): 0.731**", "**Mean Δ: +0.153 AUC**"]


# ---- definitions at size and at the edges


def test_dirty_numbers(spark):
    texts = ["1d", "7F", "3000000000", " 12 ", "-3.9", "1e3", "NaN", "Infinity", "", None, "x", "1e30", ".5", "5."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.k for r in df.select("i", matrices.to_flag("t").alias("k")).orderBy("i").collect()]
    assert got == [0, 0, 3000000000, 12, -3, 1000, 0, 0, 0, 0, 0, 0, 0, 5]


def test_all_zero_column_is_not_missing(spark):
    assert panels.missing_features(spark, ["entity_id", "Z"], ["Z", "Y"]).collect()[0].feature == "Y"


def test_scales_with_an_offset(spark):
    rows = [("r", i % 3, 1e9 + i % 3) for i in range(30)] + [("r", i % 3, 1e9 + (i + 1) % 3) for i in range(30)]
    got = folds.fold_scales(spark.createDataFrame(rows, "response string, fold int, x double"), ["x"]).collect()
    for r in got:
        train = [x for _, f, x in rows if f != r.fold]
        mean = sum(train) / len(train)
        assert r.scale == pytest.approx((sum((x - mean) ** 2 for x in train) / len(train)) ** 0.5, rel=1e-8)


def test_constant_score_has_no_correlation(spark):
    pairs = spark.createDataFrame([("r", 1.0, float(i)) for i in range(50)] + [("s", float(i), float(i)) for i in range(50)], "response string, score double, y double")
    got = {r.response: (r.spearman_rho, r.p_value) for r in assoc.spearman(pairs).collect()}
    assert got["r"] == (None, None) and got["s"][0] == 1.0


def test_missing_p_is_kept_outside_its_family(spark):
    rows = [("a", 0.01), ("a", 0.02), ("a", None), (None, 0.03)]
    tests = materialise(spark.createDataFrame(rows, "response string, p_value double"), "tests")
    got = sorted(((r.response, r.p_value, r.p_adjusted) for r in assoc.adjust_fdr(tests).collect()), key=str)
    assert got == sorted([("a", 0.01, 0.02), ("a", 0.02, 0.02), ("a", None, None), (None, 0.03, 0.03)], key=str)


def test_report_order_and_digits(spark):
    ps = spark.createDataFrame([(0.0123456,), (0.5,), (1.0,), (1.5e-10,), (0.00012345,), (0.0,), (None,)], "p double")
    got = [r.p for r in ps.select(report.significant(F.col("p")).alias("p")).collect()]
    assert got == ["0.0123", "0.5", "1", "1.5e-10", "0.000123", "0", "nan"]
    table = spark.createDataFrame([(5_000_000, "B", 4, 2, *[0.5] * 4, 0.1), (7, "A", 4, 2, *[0.5] * 4, 0.1)], "response_id int, response_name string, n int, n_sensitive int, auc_base double, std_base double, auc_full double, std_full double, delta double")
    lines = [r.line[:3] for r in report.benchmark_lines(table, "x", "y").orderBy("section", "key").collect()]
    assert lines == ["| R", "| -", "| A", "| B", "**M", "**M", "**M"]
