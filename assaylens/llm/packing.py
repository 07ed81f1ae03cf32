"""Packing of documents into sequences by local search over kinds of bins.

A piece is known by its length alone, so the plan works on counts: how many pieces there are of
each length, and how many bins hold the same lengths. It starts from best fit by falling length.
Then pieces move, or are exchanged one for one, two for one or one for two, between underfull bins
so that the sum of squared fills rises, all bins of the two kinds at once, until the bins that lose
are empty. Spark counts the lengths, numbers the pieces of each length, and looks the places up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.llm.common import numbered
from assaylens.llm.vocab import CACHED, word_ids
from assaylens.session import materialise

LENGTH = 2048
END = b"\0\0\0\0"  # id 0 after each document
CHARS = 1_000_000  # characters encoded at once; a longer text is worked on alone

Kind = tuple[tuple[int, int], ...]  # (length, how often), by falling length


def pieces(rows: DataFrame, vocabulary: str, length: int = LENGTH, cached: int = CACHED) -> DataFrame:
    """``(_row, doc_id, piece, start, length, ids_crc32)``: ids of ``rows(_row, doc_id, text)``, cut.

    *cached* is the number of words in each of the two generations that a worker remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary, cached)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            row, doc = batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist()
            at, size, out = 0, 0, []
            for i, text in enumerate(texts):
                size += len(text)
                if size < CHARS and i + 1 < len(texts):
                    continue
                for j, ids in enumerate(encoder.ids(texts[at : i + 1]), at):
                    ids += END
                    for k, begin in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[begin : begin + 4 * length]
                        out.append((row[j], doc[j], k, begin // 4, len(part) // 4, zlib.crc32(part)))
                at, size = i + 1, 0
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["_row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def _fill(kind: Kind) -> int:
    return sum(size * n for size, n in kind)


def _with(kind: Kind, change: dict[int, int]) -> Kind:
    sizes = dict(kind)
    for size, n in change.items():
        sizes[size] = sizes.get(size, 0) + n
    return tuple(sorted(((s, n) for s, n in sizes.items() if n), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Kind]:
    """Bins of each kind after best fit by falling length, equal lengths placed together."""
    open_: dict[int, Counter[Kind]] = {}  # by the room left
    rooms: list[int] = []
    done: Counter[Kind] = Counter()

    def put(kind: Kind, room: int, n: int) -> None:
        if not n:
            return
        if not room:
            done[kind] += n
            return
        if room not in open_:
            open_[room] = Counter()
            bisect.insort(rooms, room)
        open_[room][kind] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                kind, room, bins = (), capacity, left
            else:
                room = rooms[at]
                kind, bins = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // size
            full = min(bins, left // each)
            put(_with(kind, {size: each}), room - each * size, full)
            left, bins = left - full * each, bins - full
            if left and bins and left < each:
                put(_with(kind, {size: left}), room - left * size, 1)
                left, bins = 0, bins - 1
            if kind:
                put(kind, room, bins)
    for kinds in open_.values():
        done.update(kinds)
    return done


def _exchange(low: Kind, high: Kind, room: int) -> tuple[dict[int, int], dict[int, int]] | None:
    """What *low* gives and takes so that *high*, with *room* left, becomes fuller; None if nothing."""
    mine, theirs = dict(low), dict(high)
    sizes = sorted(theirs)
    for x in mine:  # a move
        if x <= room:
            return {x: 1}, {}
    for x in mine:  # one for one
        at = bisect.bisect_left(sizes, x - room)
        if at < len(sizes) and sizes[at] < x:
            return {x: 1}, {sizes[at]: 1}
    for x in mine:  # one of low for two of high
        for y in sizes:
            if 2 * y >= x:
                break
            at = bisect.bisect_left(sizes, max(y, x - room - y))
            for z in sizes[at : at + 2]:
                if y + z < x and (z != y or theirs[y] > 1):
                    return {x: 1}, dict(Counter((y, z)))
    own = sorted(mine)
    for y in sizes:  # two of low for one of high
        for x in own:
            at = bisect.bisect_right(own, y - x)
            for z in own[at : at + 2]:
                if z >= x and y < x + z <= y + room and (z != x or mine[x] > 1):
                    return dict(Counter((x, z))), {y: 1}
    return None


def improve(bins: Counter[Kind], capacity: int) -> Counter[Kind]:
    """Local search from *bins* until no exchange helps or no packing can have fewer bins.

    The emptiest kind of bin gives to the others, the fullest first, for as many bins as both have.
    Each exchange makes a fuller bin fuller at the cost of an emptier one, so the sum of squared
    fills rises and the search ends.
    """
    bins = Counter(bins)
    total = sum(_fill(k) * n for k, n in bins.items())
    least = -(-total // capacity)
    stuck: set[Kind] = set()
    while bins.total() > least:
        under = sorted((k for k in bins if _fill(k) < capacity), key=lambda k: (_fill(k), k))
        low = next((k for k in under if k not in stuck), None)
        if low is None:
            break
        for high in reversed(under):
            if _fill(high) < _fill(low) or (high == low and bins[low] < 2):
                continue
            found = _exchange(low, high, capacity - _fill(high))
            if found:
                give, take = found
                n = bins[low] // 2 if high == low else min(bins[low], bins[high])
                back = {s: -c for s, c in give.items()}
                bins[low] -= n
                bins[high] -= n
                smaller = _with(_with(low, back), take)
                larger = _with(_with(high, give), {s: -c for s, c in take.items()})
                bins[larger] += n
                if smaller:
                    bins[smaller] += n
                bins = +bins
                stuck.clear()
                break
        else:
            stuck.add(low)
    return bins


def plan(counts: dict[int, int], capacity: int = LENGTH) -> pd.DataFrame:
    """Where the pieces of each length go, as runs of their numbers.

    Piece k of a run (k from 0 at ``first``) stands in sequence ``sequence + k // times``, at
    ``offset + k % times * length``. As many rows as kinds of bins and lengths in them, whatever
    the number of pieces.
    """
    rows, used, sequence = [], Counter(), 0
    for kind, n in sorted(improve(best_fit(counts, capacity), capacity).items(), reverse=True):
        offset = 0
        for size, times in kind:
            rows.append((size, used[size], sequence, times, offset))
            used[size] += n * times
            offset += size * times
        sequence += n
    runs = pd.DataFrame(rows, columns=["length", "first", "sequence", "times", "offset"], dtype="int64")
    return runs.sort_values(["length", "first"], ignore_index=True)


def pack(rows: DataFrame, vocabulary: str, length: int = LENGTH, cached: int = CACHED) -> DataFrame:
    """Sequences for every one of ``rows(_row, doc_id, text)``.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids
    and id 0; only one longer than *length* is cut, into pieces of that length and a last one. Null
    counts as empty: one piece, the id 0. Repeated rows are packed each. Pieces of a sequence stand
    without gaps from 0. An empty table gives no rows. The driver sees at most *length* counts;
    pieces of one length, however many, are numbered over ranges. Fewer *cached* words spare memory
    and cost time, the rows stay the same.
    """
    table = materialise(pieces(rows, vocabulary, length, cached), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).limit(length).collect()}
    runs = plan(counts, length)
    order = [F.col("length"), F.col("_row"), F.col("piece")]
    placed = numbered(table, order, "numbered", {"all": F.lit(1)})
    starts = np.cumsum([0, *[counts.get(s, 0) for s in range(1, length + 1)]])
    # runs of falling lengths lie one after the other in the numbers over all pieces
    begin = starts[runs["length"].to_numpy() - 1] + runs["first"].to_numpy() if len(runs) else np.zeros(0, np.int64)
    cols = [runs[c].to_numpy() for c in ("sequence", "times", "offset")]

    @F.pandas_udf("sequence_id long, offset long")
    def place(number: pd.Series, size: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(begin, number.to_numpy(), side="right") - 1
        k = number.to_numpy() - begin[at]
        sequence, times, offset = (c[at] for c in cols)
        return pd.DataFrame({"sequence_id": sequence + k // times, "offset": offset + k % times * size.to_numpy()})

    put = placed.withColumn("_at", place(F.col("all_before").cast("long"), F.col("length")))
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
