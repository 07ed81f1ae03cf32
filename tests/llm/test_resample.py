import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from assaylens.llm import resample
from assaylens.llm.queries import QUERIES
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


def _features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def _plain(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of every row, one feature at a time."""
    told = [_features(t) for _, t in docs]
    s, t = (Counter(zlib.crc32(f.encode()) % 10000 for fs in lists for f in fs) for lists in ([x[0] for x in told], [_features(x)[0] for x in target]))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (fs, words) in zip(docs, told):
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {}
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault((r[0], r[3]), []).append(i)
    for r in out:
        r[4] = rank[r[0], r[3]].pop(0) if rank.get((r[0], r[3])) else None
    return sorted((tuple(r) for r in out), key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("folder", [SMALL, "odd"])
def test_draw_against_plain(spark, tables, folder):
    docs = spark.read.parquet(f"{tables.get(folder, folder)}/documents.parquet")
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    goal = [r["text"] for r in target.collect()]
    for percent in (5, 60):
        assert _got(resample.draw(docs, target, percent)) == _plain(rows, goal, percent)


def test_ties_are_cut_by_doc_id_and_row(spark):
    """A third of the rows are one row, and the cutoff lies among them."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + f" x{i}") for i in range(40)] + [(50, text)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (40, 55, 100):
        got = _got(resample.draw(docs, docs.where("doc_id < 3"), percent))
        assert sorted(r[4] for r in got if r[4]) == list(range(1, percent * 60 // 100 + 1))
        assert [r[:4] for r in got] == [r[:4] for r in _plain(rows, [t for d, t in rows if d < 3], percent)]
        drawn = [r[3] for r in got if r[4]]
        assert min(drawn) >= max((r[3] for r in got if not r[4]), default=min(drawn))


def test_long_features_and_runs():
    texts = ["a" * 500 + " b " + "é" * 90 + " c", "", "one", "x" * 95 + " y", "Ünï 1+2=3 ÀB"]
    bucket, owner, words = resample.buckets(texts)
    for i, text in enumerate(texts):
        fs, n = _features(text)
        assert n == words[i]
        assert sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in fs)


def test_threshold_counts(spark):
    values = [5, 5, 5, -3, 2**62, -(2**62), 7, 7, 0, 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 3, 6, 10):
        at = sorted(values)[wanted - 1]
        assert resample.threshold(df, "v", wanted) == (at, sum(v < at for v in values), sum(v <= at for v in values))


def test_empty_tables(spark, tables, empty, odd):
    assert resample.draw(empty, odd).count() == 0
    got = resample.draw(odd, empty, 50).collect()
    assert len(got) == odd.count() and all(r["score"] is not None for r in got)
    assert resample.histogram(empty).sum() == 0 and np.all(resample.gains(np.zeros(10_000, int), np.zeros(10_000, int)) == 0)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op11_threshold_resampling"](spark, SMALL)
    assert got.count() == docs.count()
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert got.where(F.col("rank").isNotNull()).count() > 0
