"""Importance resampling towards a target text distribution.

Word runs are hashed to buckets by the crc32 of their bytes. What a bucket gains, the log ratio of its
share in the target and in the corpus, is an array of BUCKETS numbers; a document weighs the sum over
its runs, and a seeded Gumbel number makes the draw. The scores are written once. The cutoff is then
found by bisection: jobs that count rows under numeric thresholds, of the score, then of the doc_id
among tied scores, then of the row. Only the drawn rows are dealt by range and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.common import numbered
from assaylens.session import materialise_counted

BUCKETS = 10_000
RUN = 3  # words of the longest feature
CHARS = 1_000_000  # characters hashed at once; a longer text is worked on alone
WAYS = 16  # thresholds counted by one job: four halvings
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: no other document is larger
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NEAR = 96  # bytes of a feature up to which its crc comes from tables


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """``[n, k, b]``: crc32 of byte *b* at place *k* of a crc after *n* more bytes of zero."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    out = np.empty((_NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(_NEAR):
        out[n + 1] = one[out[n] & 255] ^ (out[n] >> 8)
    return out


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, each feature's text, and the words of each text.

    Running crcs are taken at the words of the compacted text; that of a run of words is what the
    crc before it, shifted by its bytes, leaves of the crc after it.
    """
    lists = [_WORD.findall(t.encode("utf-8", "surrogatepass").translate(_LOWER)) for t in texts]
    n_words = np.fromiter(map(len, lists), np.int64, len(lists))
    words = [w for ws in lists for w in ws]
    crc32, now = zlib.crc32, 0
    before, after = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
    starts, ends = [], []
    for w in words:
        starts.append(now)
        now = crc32(w, now)
        ends.append(now)
        now = crc32(b" ", now)
    before[:], after[:] = starts, ends
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    owner, table = np.repeat(np.arange(len(lists)), n_words), _shifts()
    out, owners = [], []
    for run in range(1, RUN + 1):
        n = max(len(words) - run + 1, 0)
        a = np.flatnonzero(owner[:n] == owner[run - 1 : run - 1 + n])
        b = a + run - 1
        length, crc = end[b] - (end[a] - size[a]), before[a]
        near = np.minimum(length, _NEAR)
        shifted = table[near, 0, crc & 255]
        for k in range(1, 4):
            shifted = shifted ^ table[near, k, (crc >> np.uint32(8 * k)) & 255]
        found = after[b] ^ shifted
        for i in np.flatnonzero(length > _NEAR):
            found[i] = crc32(b" ".join(words[a[i] : b[i] + 1]))
        out.append((found % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(owner[a])
    return np.concatenate(out), np.concatenate(owners), n_words


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of whole rows of about CHARS characters: first and last row, texts with null as empty."""
    texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARS or i + 1 == len(texts):
            yield start, i + 1, texts[start : i + 1]
            start, size = i + 1, 0


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, texts in _parts(batch):
            total += np.bincount(buckets(texts)[0], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def histogram(rows: DataFrame) -> np.ndarray:
    """Features of ``rows(text)`` in each bucket; every task sends BUCKETS sums at most."""
    parts = rows.select("text").mapInArrow(_tally, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket."""
    all_s, all_t = int(corpus.sum()), int(target.sum())
    ratio = [((t + 1) * (all_s + BUCKETS)) / ((s + 1) * (all_t + BUCKETS)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every one of ``rows(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in _parts(batch):
                bucket, owner, n_words = buckets(texts)
                n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel number) from the seeded digest of a doc_id; null counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def threshold(rows: DataFrame, name: str, wanted: int) -> tuple[int, int, int]:
    """Least v such that *wanted* rows or more have a value up to v, and the rows below v and up to v.

    Bisection of the long column *name* of a written table by exact counts. *wanted* is at least 1
    and at most the rows.
    """
    low, high, upto = rows.agg(F.min(name), F.max(name), F.count(name)).first()
    below = 0
    while low < high:
        cuts = sorted({low + (high - low) * i // WAYS for i in range(WAYS)})
        inside = rows.where(F.col(name).between(low, high))
        counts = inside.agg(*[F.count_if(F.col(name) <= c) for c in cuts]).first()
        start = below
        for cut, n in zip(cuts, counts, strict=True):
            if start + n >= wanted:
                high, upto = cut, start + n
                break
            low, below = cut + 1, start + n
    return low, below, upto


def draw(rows: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Scores of ``rows(doc_id, text)`` against ``target(text)``, and ranks of those that are drawn.

    Returns ``doc_id, n_features, weight, score, rank`` for every row. Of the N rows with
    *least_words* words or more, floor(percent * N / 100) are drawn without replacement: those of
    highest score, ties to the smaller doc_id (null last), then to the earlier row; rank counts from 1
    in that order and is null for the others. A null or empty text has no features and weight 0;
    repeated rows are scored and drawn each; an empty table gives no rows; an empty target weighs by
    the corpus alone.
    """
    gain = gains(histogram(rows), histogram(target))
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = weigh(rows, gain).select(
        "doc_id", "n_features", "weight", score.alias("score"), (-score).alias("down"), F.coalesce("doc_id", F.lit(int(LAST))).alias("tie"),
        (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("nr"),
    )
    table, _ = materialise_counted(scored, "scores")
    able = table.where("able")
    wanted = percent * able.count() // 100
    chosen = F.lit(False)
    if wanted:
        # each threshold settles all rows but those that tie with it
        chosen, tied, open_ = F.lit(False), F.col("able"), wanted
        for name in ("down", "tie", "nr"):
            at, below, upto = threshold(table.where(tied), name, open_)
            chosen = chosen | (tied & (F.col(name) < at))
            tied, open_ = tied & (F.col(name) == at), open_ - below
            if upto - below == open_:
                break
        chosen = chosen | tied
    out = ["doc_id", "n_features", "weight", "score"]
    rest = table.where(~chosen).select(*out, F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return rest
    order = [F.col("down"), F.col("tie"), F.col("nr")]
    ranked = numbered(table.where(chosen).select(*out, "down", "tie", "nr"), order, "drawn", {"rank": F.lit(1).cast("long")})
    return rest.union(ranked.select(*out, (F.col("rank_before") + 1).cast("long").alias("rank")))
