"""Boosted trees against a plain version on single rows, in both plans."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylens.config import BoostingParams
from assaylens.operators import attribution, boosting, folds
from assaylens.operators.logistic import ALL_ROWS
from assaylens.session import new_path
from assaylens.sources import results

NAMES = ["a", "b", "c"]
PARAMS = BoostingParams(trees=12, depth=3, min_leaf=4, min_split=9)


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    rows = []
    for response, slope in (("r", 3.0), ("s", -3.0)):
        for i in range(160):
            a, b, c = int(rng.integers(0, 2)), int(rng.integers(0, 4)), float(np.round(rng.normal(), 1))
            p = 1 / (1 + np.exp(-slope * (a - 0.5) - 0.3 * b * c))
            rows.append((i, response, int(rng.random() < p), a, b, c))
    rows += [(i, "one", 1, 0, 0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "entity_id int, response string, label int, a int, b int, c double")
    return folds.stratified_folds(df, {"fold": 5}, 42).persist()


@pytest.fixture(scope="module")
def patterns(design):
    return boosting.boosting_patterns(design, NAMES, 42)


@pytest.fixture(scope="module")
def models(patterns):
    return boosting.fit_boosting(patterns, PARAMS, [0, ALL_ROWS])


def _plain(rows, params):
    """Margins of all rows after boosting on those that train, one node after the other."""
    x = np.array([[r.a, r.b, r.c] for r in rows], float)
    y = np.array([r.label for r in rows], float)
    part = np.array([int(hashlib.md5(f"part#42#{r.entity_id}".encode()).hexdigest()[:8], 16) % 10 for r in rows])
    margin = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())))

    def grow(at, depth, tree):
        s, h = res[at].sum(), (p * (1 - p))[at].sum()
        leaf = params.learning_rate * (s / h if h > 1e-150 else 0)
        best = None
        if depth < params.depth and len(at) >= params.min_split:
            for f in range(3):
                for v in np.unique(x[:, f])[:-1]:
                    left = at[x[at, f] <= v]
                    n, m = len(left), len(at) - len(left)
                    if min(n, m) >= params.min_leaf:
                        sl = res[left].sum()
                        gain = round(sl**2 / n + (s - sl) ** 2 / m - s**2 / len(at), 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, f, v
        if best is None:
            return leaf
        _, f, v = best
        return f, v, grow(at[x[at, f] <= v], depth + 1, tree), grow(at[x[at, f] > v], depth + 1, tree)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for t in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        res = y - p
        tree = grow(np.flatnonzero(~np.isin(part, boosting.left_out(t, params.subsample))), 0, None)
        margin = margin + np.array([value(tree, row) for row in x])
    return dict(zip([r.entity_id for r in rows], margin))


def _margins(design, models, held):
    x = F.array(*[F.col(n).cast("double") for n in NAMES])
    rows = design.withColumn("x", x).withColumn("held_out", F.lit(held)).join(models.where("note = ''"), ["response", "held_out"])
    return {(r.response, r.entity_id): r.m for r in rows.withColumn("m", boosting.boosted_margin(F.col("x"), PARAMS.depth)).collect()}


def test_fits_equal_a_plain_version(design, models):
    for held in (0, ALL_ROWS):
        got = _margins(design, models, held)
        for response in "rs":
            rows = [r for r in design.filter(F.col("response") == response).collect() if r.fold != held]
            for entity, margin in _plain(rows, PARAMS).items():
                assert got[response, entity] == pytest.approx(margin, abs=1e-9)


def test_shared_passes_grow_the_same_trees(spark, patterns):
    params = BoostingParams(trees=3, depth=3, min_leaf=4, min_split=9)
    one, many = (sorted(boosting.fit_boosting(patterns, params, [1, ALL_ROWS], g).collect(), key=lambda r: (r.response, r.held_out)) for g in (10**6, 0))
    assert len(one) == len(many) == 6
    for a, b in zip(one, many):
        assert (a.response, a.held_out, a.note, a.feature, a.nodes) == (b.response, b.held_out, b.note, b.feature, b.nodes)
        for name in ("cut", "value", "cover", "gain"):
            assert (a[name] is None and b[name] is None) or a[name] == pytest.approx(b[name], abs=1e-9)


def test_one_class_is_a_note(models):
    notes = {(r.response, r.held_out): r.note for r in models.collect()}
    assert notes["one", 0] == notes["one", -1] == "one class" and notes["r", 0] == notes["s", -1] == ""


def test_subsamples_take_turns():
    sets = [tuple(boosting.left_out(t, 0.8)) for t in range(90)]
    assert all(len(s) == 2 for s in sets) and len(set(sets)) == 45
    assert boosting.left_out(3, 1.0) == []


def test_attributions_add_up_to_the_margin(spark, patterns, models):
    for salts in (10**6, 7):
        off = attribution.tree_local_accuracy(patterns, models, PARAMS.depth, rows=salts).collect()
        assert {r.response for r in off} == {"r", "s"} and all(r.n_off == 0 and r.n_vectors > 10 for r in off)


def test_attributions_equal_all_orders(spark):
    """Two features, one tree: Shapley values by hand."""
    flat = (0, -1, 1, -1, -1, -1, -1), (0.0, 0, 0, 0, 0, 0, 0), (0.0, 1.0, 0, 0, 0, 2.0, 6.0), (10.0, 6.0, 4, 0, 0, 1.0, 3.0)
    leaves = attribution.leaf_paths(7, *flat)
    phi = attribution.shapley_values(np.array([[1.0, 1.0], [0.0, 1.0]]), leaves)
    mean = 0.6 * 1 + 0.1 * 2 + 0.3 * 6
    only_a, only_b = np.array([5.0, 1.0]), 0.6 * 1 + 0.4 * 6
    both = np.array([6.0, 1.0])
    assert phi[:, 0] == pytest.approx(((only_a - mean) + (both - only_b)) / 2)
    assert phi[:, 1] == pytest.approx(((only_b - mean) + (both - only_a)) / 2)


def test_importances_and_reload(spark, patterns, design, models):
    importance = attribution.tree_importance(models, NAMES).collect()
    best = {}
    for row in importance:
        best.setdefault(row.response, []).append((row.mean_abs_shap, row.feature))
    assert {r: max(v)[1] for r, v in best.items()} == {"r": "a", "s": "a"}
    assert all(sum(x for x, _ in v) == pytest.approx(1) for v in best.values())
    folder = results.write_results(new_path(spark, "models"), models=models)
    assert _margins(design, results.read_results(spark, folder, "models"), 0) == _margins(design, models, 0)


def test_a_response_that_fails_gets_its_importances(spark, patterns, models):
    """The trees of one response have an empty node, which leaves no shares."""
    broken = models.withColumn("cover", F.when(F.col("response") == "s", F.transform("cover", lambda c: F.lit(0.0))).otherwise(F.col("cover")))
    tree = attribution.tree_attribution(attribution.tree_attribution_vectors(patterns, broken), NAMES)
    told = attribution.with_fallback(tree, attribution.tree_importance(models, NAMES)).collect()
    assert {(r.response, r.note) for r in told} == {("r", ""), ("s", "importance fallback")} and len(told) == 6
    assert all((r.mean_signed_shap is None) == (r.response == "s") for r in told)
    odd = spark.createDataFrame([("r", "a", 1.0, 1.0), ("r", "b", float("nan"), 0.0)], "response string, feature string, mean_abs_shap double, mean_signed_shap double")
    assert {r.note for r in attribution.with_fallback(odd, attribution.tree_importance(models, NAMES)).collect()} == {"importance fallback"}


def test_bad_lines_of_a_result_are_set_aside(spark):
    path = results.write_table(spark.createDataFrame([(1, "x", 0.5), (2, "y", None)], "id int, name string, v double"), new_path(spark, "table"), "csv")
    spark.createDataFrame([("id,name,v",), ("3,z,0.25",), ("4,w,not a number",), ("5,too,1.0,many",), ("6",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = results.read_csv_result(spark, path, "id int, name string, v double")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x", 0.5), (2, "y", None), (3, "z", 0.25)]
    assert sorted(r.line for r in bad.collect()) == ["4,w,not a number", "5,too,1.0,many", "6"]


def test_predictions_keep_the_models_out_of_the_rows(spark, patterns, models):
    """A join of rows with models copied a model of all trees for each row of the table that is streamed."""
    odd = patterns.union(patterns.limit(9).withColumn("x", F.transform("x", lambda v, i: F.when(i == 2, float("nan")).when(i == 1, v))))
    for split in (None, "fold"):
        got = boosting.predict_boosting(odd, models.where("held_out = -1") if split is None else models, PARAMS.depth, split)
        assert "feature#" not in got._jdf.queryExecution().optimizedPlan().toString()
        held = F.lit(ALL_ROWS) if split is None else F.col("fold")
        walked = odd.withColumn("held_out", held).join(models.where("note = ''"), ["response", "held_out"])
        walked = walked.select(*odd.columns, (1 / (1 + F.exp(-boosting.boosted_margin(F.col("x"), PARAMS.depth)))).alias("prob"))
        assert got.columns == (["response"] if split is None else ["response", "fold"]) + [c for c in odd.columns if c not in ("response", split)] + ["prob"]
        want = sorted(map(str, walked.collect()))
        assert sorted(map(str, got.select(*walked.columns).collect())) == want and want


def test_equal_vectors_are_fitted_as_one(spark, monkeypatch):
    """Forty patterns of two vectors are a group of two."""
    monkeypatch.setattr(boosting, "_fit_shared", None)
    rows = [("r", f, p, y, [float(p % 2)], 3) for f in (0, 1) for p in range(10) for y in (0, 1)]
    table = spark.createDataFrame(rows, "response string, fold int, part int, label int, x array<double>, n long")
    got = boosting.fit_boosting(table, PARAMS, [0, 2, ALL_ROWS], 2).collect()
    assert {(r.held_out, r.note, r.cover[0]) for r in got} == {(0, "", 48.0), (2, "", 96.0), (-1, "", 96.0)}
    lone = boosting.fit_boosting(table.where("fold = 0"), PARAMS, [0], 2).collect()
    assert [r.note for r in lone] == ["one class"]
