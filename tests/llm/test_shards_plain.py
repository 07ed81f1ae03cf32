"""op8 against prefix sums and cuts in plain Python."""

import hashlib
import zlib

import pytest

from assaylens.llm import exact, shards
from odd_tables import odd, odd_rows, tables  # noqa: F401


def _plain(rows, count):
    """``(doc_id, size, crc32, shard, slot)`` by digest of the text, then doc_id, null first."""
    data = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
    data.sort(key=lambda x: (hashlib.sha256(x[1]).hexdigest(), x[0] is not None, x[0] or 0))
    total, before = sum(len(t) + 1 for _, t in data), 0
    out, filled = [], {}
    for doc, text in data:
        size = len(text) + 1
        # the shard in which the middle of the row lies
        shard = min((2 * before + size) * count // (2 * total), count - 1)
        out.append((doc, size, zlib.crc32(text), shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + 1
        before += size
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[3], r[4]))


@pytest.mark.parametrize("count", [1, 3, 16])
def test_cuts(odd, count):
    got = shards.assign(exact.with_row(odd.select("doc_id", "text")), count).collect()
    expected = _plain([(r["doc_id"], r["text"]) for r in odd.collect()], count)
    assert _sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got]) == _sorted(expected)


def test_even_and_large_rows(spark, tmp_path):
    """Rows of one size are dealt evenly; one row larger than a share leaves shards empty."""
    even = [(i, f"{i:07d}") for i in range(160)]
    spark.createDataFrame(even, "doc_id long, text string").write.parquet(str(tmp_path / "even"))
    got = shards.assign(exact.with_row(spark.read.parquet(str(tmp_path / "even")))).collect()
    assert all(sum(r["shard"] == s for r in got) == 10 for s in range(16))
    assert _sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got]) == _sorted(_plain(even, 16))
    large = [*even, (500, "x" * 50_000)]
    spark.createDataFrame(large, "doc_id long, text string").write.parquet(str(tmp_path / "large"))
    got = shards.assign(exact.with_row(spark.read.parquet(str(tmp_path / "large")))).collect()
    assert len({r["shard"] for r in got}) < 16
    assert _sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got]) == _sorted(_plain(large, 16))
