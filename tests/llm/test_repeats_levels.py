"""op5: levels of the expansion, arrays of a worker, and tables that are left on disk."""

import os
import random

import numpy as np
import pyarrow as pa

from assaylens.llm import exact, repeats
from assaylens.session import shared_dir


def _segments(seed):
    rng = random.Random(seed)
    passage = bytes(rng.choice(b"abcd ") for _ in range(90))
    out = []
    for _ in range(60):
        cut = rng.randint(0, 30)
        out.append(passage[cut : cut + rng.randint(50, 60)] + bytes(rng.choice(b"abcd\0\xff") for _ in range(rng.randint(0, 9))))
    return [*out, b"q" * 70, b"q" * 50]


def test_expansion_by_eight_bytes(monkeypatch):
    calls, plain = [], repeats._several
    monkeypatch.setattr(repeats, "_several", lambda *a: calls.append(1) or plain(*a))
    segments = _segments(3)
    smallest = np.arange(len(segments))[::-1].copy()
    got = repeats.repeated(segments, smallest)
    least = {}
    for s, doc in zip(segments, smallest, strict=True):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], doc), doc)
    for s, found in zip(segments, got, strict=True):
        assert found.tolist() == [least[s[i : i + 50]] for i in range(len(s) - 49)]
    assert len(calls) <= 7  # one a level: 42 bytes in steps of eight


def test_ranges_of_rows():
    parts = [[(5, 60), (0, 50), (70, 120)], None, [], [(0, 50), (50, 101)], [(3, 53), (3, 90), (10, 60)]]
    rows = pa.array([None if p is None else [{"from": a, "to": b} for a, b in p] for p in parts], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
    got = list(zip(*(x.tolist() for x in repeats._spans(rows)), strict=True))
    assert got == [(0, 0, 60), (0, 70, 120), (3, 0, 101), (4, 3, 90)]
    assert list(zip(*(x.tolist() for x in repeats._spans(rows.slice(3))), strict=True)) == [(0, 0, 101), (1, 3, 90)]


def test_written_tables_go(spark, tmp_path):
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(12))
    rows = [(i, f"{rng.random()} " * rng.randint(0, 9) + passage * (i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    folder = f"{shared_dir(spark).removeprefix('file:')}/assaylens/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    cut = repeats.without_repeats(exact.with_place(spark.read.parquet(str(tmp_path / "d"))))
    assert cut.where("n_removed > 0").count() == 29
    left = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"shared", "segments", "distinct", "leasts"}
