"""Row ids when the splits of a table change between two scans of one query, as cores come and go."""

import hashlib

import brute
import pytest
from odd_tables import prose
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens import session
from assaylens.llm import counting, exact, jaccard, private, repeats, search


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Six files with exact and near copies, shared passages, personal data and repeated ids."""
    passage = prose(9, 40)
    texts = []
    for i in range(240):
        base = prose(i % 50, 30 + i % 7)
        texts.append((None if i % 40 == 7 else i, [base, base + " ", base + f" x{i}", passage + f" {i} " + base, f"mail a{i}@b{i}.org " + base][i % 5]))
    path = str(tmp_path_factory.mktemp("places"))
    spark.createDataFrame(texts, "doc_id long, text string").repartition(6).write.option("parquet.block.size", 4096).parquet(f"{path}/d")
    return spark.read.parquet(f"{path}/d")


@pytest.fixture
def changing(spark, monkeypatch):
    """Other splits after each table that is written."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    sizes = iter(["2k", "100m", "700", "9k", "1300"] * 200)
    plain = session.materialise_counted

    def written(df: DataFrame, tag: str):
        out = plain(df, tag)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    for module in (session, exact, counting):
        monkeypatch.setattr(module, "materialise_counted", written)
    yield
    for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        spark.conf.unset(name)


def test_places_don_t_follow_the_splits(spark, docs, changing):
    seen = []
    for size in ("1k", "100m"):
        placed = exact.with_place(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({(r["_row"], r["doc_id"], r["text"]) for r in placed.collect()})
    assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == 240
    free = exact.with_place(spark.createDataFrame([(1,), (1,)], "_file long"))
    assert free.columns == ["_file", "_row"] and free.select("_row").distinct().count() == 2


def test_same_rows_whatever_the_splits(spark, docs, changing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    placed = exact.with_place(docs)
    got = counting.counts(placed, "piece_bpe_32k.model").collect()
    assert len(got) == 240 and all(r["n_tokens"] > 0 for r in got)
    kept = [r["text"] for r in exact.keep_first(docs).collect()]
    assert sorted(brute.squeezed(t) for t in kept) == sorted({brute.squeezed(t) for _, t in rows})
    near = [r["text"] for r in jaccard.keep_one(docs).collect()]
    label, _ = brute.near([t for _, t in rows], 5, 80)
    assert len(near) == len(set(label)) and len({label[[t for _, t in rows].index(t)] for t in near}) == len(near)
    cut = repeats.without_repeats(exact.with_place(docs)).collect()
    expected = sorted((str(d), *x) for (d, _), x in zip(rows, brute.repeats(rows), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in cut) == expected
    masked = {(r["doc_id"], r["text"]) for r in private.mask(docs).collect()}
    assert len(masked) == len(set(rows)) and not any("@b" in t for _, t in masked)
    assert {t for _, t in masked if "[EMAIL]" not in t} <= {t for _, t in rows}


def test_search_with_a_shard_without_words(spark, tmp_path):
    for i, text in enumerate(["some words here", "?!", "other words"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    spark.conf.set("spark.sql.files.openCostInBytes", str(10**9))
    try:
        got = {(r["query_id"], r["rank"], r["doc_id"]) for r in search.top(docs, asked).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(0, 1, 0), (0, 2, 2), (2, 1, 2), (2, 2, 0)}
