"""Panels as tables: any number of features and panels with one plan."""

from assaylens.operators import panels


def _nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_thousands_of_features_make_no_larger_plan(spark):
    hits = [(e, f"f{(e * 37 + k * 11) % 5000}", 1) for e in range(200) for k in range(20)]
    table = spark.createDataFrame(hits, "entity_id int, feature string, v int")
    small = {"a": ["f0"]}
    large = {f"p{i}": [f"f{j}" for j in range(i, 5000, 7)] for i in range(7)} | {"all": [f"f{j}" for j in range(5000)], "none": ["g"]}
    got = panels.panel_score_rows(table, panels.panel_table(spark, large))
    assert _nodes(got) == _nodes(panels.panel_score_rows(table, panels.panel_table(spark, small)))
    want = {}
    for e, f, v in hits:
        for p in (f"p{int(f[1:]) % 7}", "all"):
            want[e, p] = want.get((e, p), 0) + v
    assert {(r.entity_id, r.panel): r.score for r in got.collect()} == want


def test_edges(spark):
    hits = [(1, "a", 2.0), (1, "a", 3.0), (1, None, 9.0), (2, "a", 0.0), (3, "b", None), (None, "b", 1.0), (4, "z", 1.0)]
    table = spark.createDataFrame(hits, "entity_id int, feature string, v double")
    members = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a"), ("q", "b"), ("r", "y"), ("p", None)], "panel string, feature string")
    got = {(r.entity_id, r.panel): (r.score, r.hit) for r in panels.panel_score_rows(table, members).collect()}
    five, zero = (5.0, True), (0.0, False)
    assert got == {(1, "p"): five, (1, "q"): five, (2, "p"): zero, (2, "q"): zero, (3, "q"): zero, (None, "q"): (1.0, True)}
    told = {r.panel: (r.features, r.entities, r.total, r.most) for r in panels.panel_summary(table, members).collect()}
    assert told == {"p": (1, 1, 5.0, 5.0), "q": (2, 2, 6.0, 5.0), "r": (1, 0, 0.0, 0.0)}
    empty = panels.panel_summary(table.limit(0), members)
    assert sorted(r.entities for r in empty.collect()) == [0, 0, 0]


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    """Pairs of entity and panel were folded by the tasks that had counted the hits, however many they were."""
    monkeypatch.setattr(panels, "TASK_ROWS", 50)
    hits = [(e, f"f{e % 3}", 1) for e in range(300)]
    table = spark.createDataFrame(hits, "entity_id int, feature string, v int").coalesce(2)
    members = panels.panel_table(spark, {f"p{i}": ["f0", "f1", "f2"] for i in range(10)})
    got = panels.panel_score_rows(table, members)
    assert "REPARTITION_BY_NUM" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "(entity_id#" in plan
    assert got.rdd.getNumPartitions() == 60
    assert {(r.entity_id, r.panel): r.score for r in got.collect()} == {(e, f"p{i}"): 1.0 for e in range(300) for i in range(10)}
