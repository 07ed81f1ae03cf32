import zlib

import brute
import compare
import pytest
from compare import connect, differences
from conftest import SMALL

from assaylens.llm import search
from assaylens.llm.common import components
from assaylens.llm.queries import ORACLES, QUERIES
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name, monkeypatch):
    monkeypatch.setitem(compare.ALIKE, "boolean", {"BOOLEAN"})
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name], 1e-6) == []


@pytest.mark.parametrize("folder", [SMALL, "odd"])
def test_shards(spark, tables, folder):
    folder = tables.get(folder, folder)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op8_prefix_shards"](spark, folder).collect()
    expected = [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    share, most = sum(r["size"] for r in got) / 16, max(r["size"] for r in got)
    for shard in range(16):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - share) <= most
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    assert QUERIES["op8_prefix_shards"](spark, tables["empty"]).count() == 0


def test_search_against_all_scores(spark, odd, empty, tables, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    queries = [(1, "the quick brown fox"), (2, rows[0][1]), (3, "two words"), (4, "?!"), (5, "nothingofthekind"), (6, "日本語 é")]
    asked = spark.createDataFrame([*queries, (7, None), (None, "one")], "query_id long, text string")
    for chars in (search.SHARD_CHARS, 500):
        monkeypatch.setattr(search, "SHARD_CHARS", chars)
        got = {}
        for r in search.top(odd, asked, 3).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {q: d for q, d in brute.bm25(rows, queries, 3).items() if d}
    assert search.top(empty, asked).count() == 0
    assert QUERIES["op4_block_max_search"](spark, tables["empty"]).count() == 0
    assert QUERIES["op4_block_max_search"](spark, tables["odd"]).count() > 0


def test_pruned_search_is_exact(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    queries = [(d, t) for d, t in rows if d % 20 == 0][:4]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = {}
    for r in search.top(docs, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute.bm25(rows, queries, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 140)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline

    for folder in (SMALL, tables["odd"], tables["empty"]):
        rows = spark.read.parquet(f"{folder}/documents.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        texts = {r["doc_id"]: r["text"] for r in rows.collect()}
        left = {r["doc_id"] for r in got.collect()}
        assert left <= set(texts)
        squeezed = {brute.squeezed(texts[d]) for d in left if d is not None}
        assert "" not in squeezed and len(squeezed) == len({d for d in left if d is not None})
