"""op4 and op12: shards meet the queries in rounds."""

import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from assaylens.llm import common, graphs, search


def _counted(monkeypatch):
    rounds, plain = [], common._round
    monkeypatch.setattr(common, "_round", lambda *a: rounds.append(a[4]) or plain(*a))
    return rounds


@pytest.fixture
def files(spark):
    """As many files of a written table as shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_of_search(spark, files, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120)
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    monkeypatch.setattr(search, "meetings", lambda *a: common.meetings(*a, together=1))
    monkeypatch.setattr(search, "QUERIES", 1)  # as many parts of query blocks as there can be
    monkeypatch.setattr(common, "ROUND_TASKS", 10_000)
    rounds = _counted(monkeypatch)
    plain = sorted(search.top(docs, asked, 3).collect())
    assert len(rounds) == 1
    monkeypatch.setattr(common, "ROUND_TASKS", 1)
    assert sorted(search.top(docs, asked, 3).collect()) == plain
    # every group of blocks once, and a shard is sent once in a round
    assert len(rounds) > 2 and all(b - a == 1 for a, b in rounds[1:])
    assert len({a for a, _ in rounds[1:]}) == len(rounds) - 1


def test_rounds_of_graphs(spark, monkeypatch):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = rows.select("vec_id", F.col(next(c for c, t in rows.dtypes if t.startswith("array"))).alias("vector"))
    asked = rows.select(F.col("vec_id").alias("query_id"), "vector")
    asked = asked.repartition(5)
    monkeypatch.setattr(graphs, "meetings", lambda *a: common.meetings(*a, together=1))
    monkeypatch.setattr(common, "ROUND_TASKS", 10_000)
    rounds = _counted(monkeypatch)
    plain = sorted(graphs.nearest(rows, asked, 3).collect())
    monkeypatch.setattr(common, "ROUND_TASKS", 1)
    assert sorted(graphs.nearest(rows, asked, 3).collect()) == plain
    assert len(rounds) > 2


def test_no_row_is_copied_for_those_it_meets(spark, monkeypatch):
    index = spark.range(5, numPartitions=2).select(F.col("id").cast("int").alias("shard"), F.array("id", F.col("id") * 10).alias("values"))
    blocks = spark.range(7).select("id", F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("asked"))

    def answer(held, asked):
        for block in asked:
            row = [held["shard"], int(held["values"].sum()), block["id"], len(block["asked"])]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], ["shard", "total", "block", "size"])

    rounds = _counted(monkeypatch)
    for most, tasks, n in ((64_000_000, 10_000, 1), (64_000_000, 1, 4), (1, 10_000, 4)):
        monkeypatch.setattr(common, "ROUND_BYTES", most)
        monkeypatch.setattr(common, "ROUND_TASKS", tasks)
        rounds.clear()
        found = common.meetings(index, 5, blocks, 7, answer, "shard long, total long, block long, size long", lambda x: x, together=2)
        assert sorted(map(tuple, found.collect())) == [(s, 11 * s, b, b) for s in range(5) for b in range(7)]
        assert len(rounds) == n
        if n == 1:  # neither an explosion, whose rows lie in memory together, nor a shuffle
            plan = found._jdf.queryExecution().toString()
            assert "Generate" not in plan and "Exchange" not in plan


def test_each_shard_has_a_file(spark):
    docs = spark.range(0, 3, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_900_000).alias("text"))
    shards, n = search.index(docs)
    assert n == 3 and len([f for f in shards.inputFiles() if "/index-" in f]) == 3
