"""op5 with many null doc_ids and one passage in a third of the documents."""

import hashlib
import random

import brute
import pytest

from assaylens.llm import exact, repeats


@pytest.mark.parametrize("hot", [repeats.HOT, 20])
def test_common_passage_and_null_ids(spark, tmp_path, hot):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text += " " + passage + " " + " ".join(word() for _ in range(rng.randint(0, 20)))
        # a third of the rows has no doc_id, some with the passage and some without
        rows.append((None if i % 9 < 3 else i, text))
    own = " ".join(word() for _ in range(30))  # held by null doc_ids alone: none is smaller
    rows += [(None, own)] * 5 + [(7000, passage[:60]), (7000, passage[-49:])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    cut = repeats.without_repeats(exact.with_place(spark.read.parquet(str(tmp_path / "d"))), hot).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in cut)
    assert got == sorted((str(d), *x) for (d, _), x in zip(rows, brute.repeats(rows), strict=True))
    nulls = [r for r in cut if r["doc_id"] is None]
    assert sum(r["n_removed"] > 0 for r in nulls) > 20
    assert sum(bytes(r["kept"]) == own.encode() and r["n_removed"] == 0 for r in nulls) == 5
