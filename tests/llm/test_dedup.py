import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from assaylens.llm import exact, jaccard, repeats
from assaylens.llm.queries import QUERIES
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


def _rows(df):
    return exact.with_row(df.select("doc_id", "text"))


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")])
def test_recipes_against_groups(odd, digest):
    """Also with digests that stand for many chunks: identifiers are verified."""
    got = exact.duplicates(_rows(odd), digest).toPandas()
    text = {r["_row"]: r["text"] for r in _rows(odd).collect()}
    groups = {}
    for r in got.itertuples():
        groups.setdefault(brute.squeezed(text[r._1]), []).append(r)
    for key, members in groups.items():
        assert {r.group_size for r in members} == {len(members)}
        assert [r.kept for r in members].count(True) == 1
        best = max(len(text[r._1] or "") for r in members)
        ids = [r.doc_id for r in members if len(text[r._1] or "") == best and r.doc_id == r.doc_id]
        stays = next(r for r in members if r.kept)
        assert stays.doc_id == min(ids) if ids else stays.doc_id != stays.doc_id
        assert {r.text_sha256 for r in members} == {hashlib.sha256(key.encode()).hexdigest()}
    assert len(got) == len(text)


def test_chunks_cover_the_text(spark, odd):
    cut = odd.select(exact.normalised(F.col("text")).alias("t")).withColumn("c", F.regexp_extract_all("t", F.lit(exact.CHUNK), F.lit(0)))
    assert all("".join(r["c"]) == r["t"] and all(len(c) <= exact.MOST for c in r["c"]) for r in cut.collect())


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_components_against_all_pairs(odd, words, percent):
    got = jaccard.classes(_rows(odd), jaccard.Rule(words, percent)).toPandas().sort_values("_row", ignore_index=True)
    rows = sorted(_rows(odd).collect(), key=lambda r: r["_row"])
    label, sizes = brute.near([r["text"] for r in rows], words, percent)
    assert got["n_shingles"].tolist() == sizes
    for i in range(len(rows)):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if label[j] == label[i] and rows[j]["doc_id"] is not None]
        value = got["component_id"][i]
        assert value == min(ids) if ids else value != value


def test_many_near_copies_over_blocks(spark, monkeypatch):
    """Chains of small changes, with components cut into blocks of a few sets."""
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "GROUP", 100)
    words = [f"w{i}" for i in range(70)]
    texts, now = [], list(words)
    for i in range(40):
        now[(i * 13) % 70] = f"v{i}"
        texts.append(" ".join(now))
        texts.append(" ".join(now[: 60 - i]) + f" tail{i}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"{__import__('tempfile').mkdtemp()}/t"
    df.write.parquet(path)
    df = spark.read.parquet(path)
    got = jaccard.classes(_rows(df), jaccard.Rule(2, 80)).toPandas().sort_values("doc_id")
    label, _ = brute.near(texts, 2, 80)
    assert got["component_id"].tolist() == label and len(set(label)) > 1


def test_keys_meet(monkeypatch):
    """Linked sets share as many keys as each of them says, also when parts are few."""
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        rule = jaccard.Rule(4, percent)
        for n in [*range(2, 40), 100, 400, 2000]:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = n - (percent * n + 99) // 100
            drop = rng.integers(0, most + 1)
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, 2).astype(np.uint64)])) if percent < 95 and n > 30 else b
            both = len(np.intersect1d(a, b))
            if drop and 100 * both >= percent * (len(a) + len(b) - both):
                (ka, na), (kb, nb) = jaccard.keys(a, rule), jaccard.keys(b, rule)
                assert len(np.intersect1d(ka, kb)) >= max(1, min(na, nb))


def test_repeats_against_windows(odd):
    for hot in (repeats.HOT, 1):
        cut = repeats.without_repeats(_rows(odd).withColumn("doc_id", F.col("doc_id")), hot).toPandas()
        rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
        got = sorted((str(d if d == d else None).split(".")[0], n, m, len(s), hashlib.sha256(k).hexdigest()) for d, n, m, s, k in cut.itertuples(index=False))
        assert got == sorted((str(d), *x) for (d, _), x in zip(rows, brute.repeats(rows), strict=True))


def test_bounded_expansion_on_one_text():
    import numpy as np

    a, b = b"x" * 30 + bytes(range(97, 123)) * 3, bytes(range(97, 123)) * 3 + b"y" * 20
    leasts = repeats.repeated([a, b, b"q" * 60], np.array([5, 3, 9]))
    first = {}
    for t, d in ((a, 5), (b, 3), (b"q" * 60, 9)):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], 99))
    assert [x.tolist() for x in leasts] == [[first[t[i : i + 50]] for i in range(len(t) - 49)] for t in (a, b, b"q" * 60)]


def test_empty_and_stages(spark, tables, odd, empty):
    for name in ("op3_chunk_recipes", "op10_ngram_jaccard", "op5_bounded_expansion"):
        assert QUERIES[name](spark, tables["empty"]).count() == 0
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    texts = [brute.squeezed(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({brute.squeezed(r["text"]) for r in odd.collect()})
    near = jaccard.keep_one(odd)
    assert near.columns == odd.columns
    rows = [r["text"] for r in odd.collect()]
    assert near.count() == len(set(brute.near(rows, 5, 80)[0]))
    assert exact.keep_first(empty).count() == jaccard.keep_one(empty).count() == 0
