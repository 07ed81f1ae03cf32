import math

import numpy as np
import pytest
from conftest import SMALL

from assaylens.llm import graphs
from assaylens.llm.queries import QUERIES


def _plain(rows, queries, k):
    out = []
    for key, q in queries:
        found = [(-float(np.dot(np.array(q), np.array(v))), i) for i, v in rows if i != key and len(v) == len(q)]
        out += [(key, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def _recall(got, expected):
    asked = {(q, i) for q, _, i, _ in expected}
    return len(asked & {(q, i) for q, _, i, _ in got}) / len(asked)


def _clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return centres[rng.integers(0, 10, n)] * rng.uniform(0.2, 1, (n, 1)) + rng.normal(size=(n, dim)) * 0.7


def test_whole_table_against_all_products(spark):
    for folder in (SMALL, SMALL.replace("0.001", "0.1")):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = [tuple(r) for r in QUERIES["op12_shard_graphs"](spark, folder).collect()]
        expected = _plain(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
        assert len(got) == len(expected) and _recall(got, expected) >= 0.9
        vectors = dict(rows)
        for q, rank, i, score in got:
            assert q != i and math.isclose(score, float(np.dot(np.array(vectors[q]), np.array(vectors[i]))), abs_tol=1e-12)
        for q in {g[0] for g in got}:
            own = sorted((g for g in got if g[0] == q), key=lambda g: g[1])
            assert [g[1] for g in own] == list(range(1, len(own) + 1))
            assert own == sorted(own, key=lambda g: (-g[3], g[2]))


@pytest.mark.parametrize("shard", [400, 3_000])
def test_graphs_of_unequal_norms(spark, monkeypatch, shard):
    """Layers, several shards and many blocks, with vectors whose norms differ fivefold."""
    monkeypatch.setattr(graphs, "SHARD_ROWS", shard)
    monkeypatch.setattr(graphs, "QUERIES", 7)
    vectors = _clustered(2_500, 24, 3)
    rows = list(enumerate(vectors.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [tuple(r) for r in graphs.nearest(df, df.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "vector"), 10).collect()]
    expected = _plain(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert len(got) == len(expected) and _recall(got, expected) >= 0.9


def test_one_common_vector(spark):
    """A third of the rows hold one vector: copies are one node, and ties go to the smaller ids."""
    vectors = _clustered(2_000, 16, 4)
    rows = [(i, (vectors[0] if i % 3 == 0 else vectors[i]).tolist()) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = df.where("vec_id in (0, 999, 1, 1001)").selectExpr("vec_id query_id", "vector")
    got = [tuple(r) for r in graphs.nearest(df, asked, 20).collect()]
    expected = _plain(rows, [r for r in rows if r[0] in (0, 999, 1, 1001)], 20)
    assert _recall(got, expected) >= 0.9
    assert [g[2] for g in sorted(got) if g[0] == 999] == [e[2] for e in expected if e[0] == 999]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [2.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (20, [3.0]), (40, None), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").selectExpr("*", "'x' shard", "'y' nr", "'z' dim")
    asked = df.where("vec_id % 20 = 0 or vec_id = 9").selectExpr("vec_id query_id", "vector", "shard rank")
    got = sorted(tuple(r) for r in graphs.nearest(df, asked, 20).collect())
    nine = [(9, 1, 0, 1.0), (9, 2, 1, 0.5)]
    assert got == sorted([(0, 1, 9, 1.0), (0, 2, 9, 1.0), (0, 3, 1, 0.5), *nine, *nine, (20, 1, 8, 6.0)])
    nothing = df.limit(0)
    assert graphs.nearest(nothing, asked).count() == 0
    assert graphs.nearest(df, nothing.selectExpr("vec_id query_id", "vector")).count() == 0


def test_flat_arrays_round_trip():
    vectors = np.repeat(_clustered(1_500, 8, 5), 2, axis=0)
    batch = graphs._row(0, 8, np.arange(3_000), vectors)
    graph, distinct, ids, edges = graphs._loaded(batch.to_pylist()[0])
    assert len(distinct) == 1_500 and sorted(ids.tolist()) == list(range(3_000))
    assert [len(g) for g in graph.layers] == sorted(len(g) for g in graph.layers)
    bottom = graph.layers[-1]
    assert bottom.shape == (1_500, graphs.ROOM) and (bottom >= -1).all() and (bottom < 1_500).all()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(bottom))
    for node in range(0, 1_500, 97):
        assert (vectors[ids[edges[node] : edges[node + 1]]] == distinct[node]).all()
