"""Removal of strings repeated across documents, by bounded expansion on a Burrows-Wheeler transform.

Every string of LEAST bytes has an anchor, the 16 bytes of smallest hash in it, and holds the 17
bytes to the left of it or, where the anchor begins too early for that, those to the right. Equal
strings have equal anchors and the same one of these sides, so strings whose side occurs in a single
document are left aside, and the others meet by anchor. Around an anchor they are one segment; equal
segments are folded to their smallest doc_id. The segments of many anchors make a text whose suffixes are sorted by
their first eight bytes, the symbols of the transform; a segment alone at its anchor has no other to share
a string with. Intervals of suffixes with a common prefix are extended backwards, breadth first, by the symbol before
each suffix; an interval of one suffix is done, and the search stops at LEAST bytes. What is left are the repeated strings.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.common import release
from assaylens.llm.shingles import mixed
from assaylens.session import delete_path, materialise, materialise_at, materialise_counted

LEAST = 50
GRAM = 16
SPAN = LEAST - GRAM + 1  # grams in a string of LEAST bytes
SIDE = (LEAST - GRAM) // 2  # a string holds as many bytes left or right of its anchor
CHARS = 100_000  # bytes of text worked on at once, so that arrays stay in the cache; a longer text is worked on alone
EIGHT = 8  # bytes of a symbol
BLOCK = 1_000_000  # bytes of a transform; more only if one anchor has more
HOT = 100_000  # different segments of an anchor above which its strings are dealt one by one
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: no other document is larger


MUL = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(31)  # low bits that give way to the place of a gram; the same in every batch


def _eights(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    eight = a.astype(np.uint64)
    for width in (1, 2, 4):
        eight = eight[:-width] | (eight[width:] << np.uint64(8 * width))
    return eight


def anchors(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: text, hash of the anchor, its place, first and last start of
    the run, and the hashes of the anchor with its left and its right side, 0 where no string of the
    run needs that side. A string needs the left one if it holds that, else the right one."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    a = np.frombuffer(b"".join(data), np.uint8)
    none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(a) < LEAST:
        return none, nothing, none, none, none, nothing, nothing
    eight = _eights(a)
    gram = mixed(eight[:-8] * MUL + mixed(eight[8:]))
    least = ((gram >> PLACE) << PLACE) | np.arange(len(gram), dtype=np.uint64)  # leftmost of equal grams
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    at = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(data)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + LEAST <= ends[owner])
    at, owner = at[start], owner[start]
    if not len(start):
        return none, nothing, none, none, none, nothing, nothing
    new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    owner, place = owner[first], at[first]
    first, last = start[first], start[last]

    def side(where: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Hashes of GRAM + SIDE bytes, 8 at a time, the last 8 overlapping."""
        where, out = np.where(needed, where, 0), np.zeros(len(where), np.uint64)
        for step in (*range(0, GRAM + SIDE - 8, 8), GRAM + SIDE - 8):
            out = mixed(out + eight[where + step] * MUL)
        return np.where(needed, np.maximum(out, np.uint64(1)), np.uint64(0))

    left = side(place - SIDE, place - first >= SIDE)
    right = side(place, place - last < SIDE)
    begin = (ends - sizes)[owner]
    return owner, gram[place], place - begin, first - begin, last - begin, left, right


def _digests(a: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for the *size* bytes of *a* from each *begin* on, of their bytes alone."""
    mul = np.full(len(a), MUL)
    mul[0] = 1
    back = np.full(len(a), np.uint64(pow(int(MUL), -1, 1 << 64)))
    back[0] = 1
    power, back = np.multiply.accumulate(mul), np.multiply.accumulate(back)
    eight = mixed(_eights(a))
    total = np.append(np.uint64(0), np.cumsum(eight * power[: len(eight)], dtype=np.uint64))
    inside = (total[begin + size - 7] - total[begin]) * back[begin]
    return mixed(inside + mixed(size.astype(np.uint64)))


def _pasted(a: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The *size* bytes of *a* from each *begin* on, as binary values."""
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(a[where])])


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Columns and UTF-8 bytes of whole rows, about CHARS bytes at once; null counts as empty."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    columns = [batch.column(n).to_pylist() for n in names]
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARS or i + 1 == len(texts):
            yield [*(c[at : i + 1] for c in columns), texts[at : i + 1]]
            at, size = i + 1, 0


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, nulls, data in _runs(batch, "doc", "null_row"):
            owner, *_, left, right = anchors(data)
            owner, sides = np.tile(owner, 2), np.concatenate([left, right])
            owner, sides = owner[sides != 0], sides[sides != 0]
            columns = [pa.array(sides.view(np.int64)), *(pa.array(np.array(c, np.int64)[owner]) for c in (docs, nulls))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc", "null_row"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_row", "doc", "at", "h", "sid", "segment"]
    for batch in batches:
        # what is shared is so in every document that has it
        known = np.unique(batch.column("shared").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        for rows, docs, data in _runs(batch, "_row", "doc"):
            owner, gram, place, first, last, left, right = anchors(data)
            left, right = (known[np.minimum(np.searchsorted(known, side), len(known) - 1)] == side for side in (left, right))
            keep = np.flatnonzero(left | right)
            if not len(keep):
                continue
            owner, gram, place, first, last, left, right = (x[keep] for x in (owner, gram, place, first, last, left, right))
            # only the strings that need a shared side
            first = np.where(left, first, np.maximum(first, place - SIDE + 1))
            last = np.where(right, last, np.minimum(last, place - SIDE))
            size = last - first + LEAST
            a = np.frombuffer(b"".join(data), np.uint8)
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            begin = (np.cumsum(sizes) - sizes)[owner] + first
            columns = [np.array(rows, np.int64)[owner], np.array(docs, np.int64)[owner], first.astype(np.int32), gram.view(np.int64), _digests(a, begin, size).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _pasted(a, begin, size)], names)


def repeated(segments: list[bytes], smallest: np.ndarray) -> list[np.ndarray]:
    """For each start of LEAST bytes in each segment, the least of *smallest* over equal strings."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    values = _repeated(np.frombuffer(b"".join(segments), np.uint8), sizes, smallest)
    return np.split(values, np.cumsum(np.maximum(sizes - LEAST + 1, 0))[:-1])


def _repeated(data: np.ndarray, sizes: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """:func:`repeated` for segments of *sizes* that lie one after the other in *data*, in one array."""
    text = np.zeros(len(data) + len(sizes) + EIGHT - 1, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False  # the marks between segments, which no string may cross
    inside[len(data) + len(sizes) :] = False
    outside = np.cumsum(np.append(0, ~inside))
    clean = outside[EIGHT:] == outside[:-EIGHT]
    # suffixes in the order of their first eight bytes, which are the symbols of the transform
    eight = _eights(text)
    at = np.flatnonzero(clean)
    at = at[np.argsort(eight[at])]
    fresh = np.append(True, eight[at[1:]] != eight[at[:-1]]) if len(at) else np.zeros(0, bool)
    symbol = np.full(len(eight), -1, np.int64)
    symbol[at] = np.cumsum(fresh)
    size = EIGHT
    while size < LEAST:
        at, fresh = _several(at, fresh)
        if not len(at):
            break
        # one symbol to the left, the last one in part: of each interval, the suffixes with the same one before them
        step = min(EIGHT, LEAST - size)
        size += step
        before = np.maximum(at - step, 0)
        ok = (at >= step) & (symbol[before] > 0)
        at, group = before[ok], np.cumsum(fresh)[ok]
        group = (group << 32) | symbol[at]
        if (group[1:] < group[:-1]).any():
            by = np.argsort(group)
            at, group = at[by], group[by]
        fresh = np.append(True, group[1:] != group[:-1]) if len(at) else np.zeros(0, bool)
    at, fresh = _several(at, fresh)
    starts_in = np.maximum(sizes - LEAST + 1, 0)
    out = np.repeat(smallest, starts_in)
    if len(at):
        owner = np.searchsorted(ends, at, side="right")
        starts = np.flatnonzero(fresh)
        least = np.minimum.reduceat(smallest[owner], starts)
        value = np.repeat(least, np.diff(np.append(starts, len(at))))
        out[(np.cumsum(starts_in) - starts_in)[owner] + at - (ends - sizes - 1)[owner]] = value
    return out


def _several(at: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the intervals of one suffix."""
    starts = np.flatnonzero(fresh)
    keep = np.repeat(np.diff(np.append(starts, len(at))) > 1, np.diff(np.append(starts, len(at))))
    return at[keep], fresh[keep]


LEASTS = "h long, sid long, a int, b int, least long"


def _least_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs of starts with one least document, from a to before b, for the segments that have another's strings."""
    h, sid, least, most = (batch.column(n).to_numpy() for n in ("h", "sid", "least", "most"))
    segments = batch.column("segment")
    new = np.append(True, h[1:] != h[:-1])
    met = ~(new & np.append(new[1:], True))  # not alone at its anchor
    held = segments if met.all() else segments.filter(pa.array(met))
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    values = _repeated(np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], sizes, least[met])
    starts_in = sizes - LEAST + 1
    owner = np.repeat(np.arange(len(sizes)), starts_in)
    cut = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)])
    of, doc = owner[cut], values[cut]
    runs = np.bincount(of, minlength=len(sizes))
    # strings of a single document stay behind
    keep = (runs > 1) | (least[met] != most[met])
    keep |= doc[np.cumsum(runs) - runs] != least[met] if len(doc) else False
    begin = cut - (np.cumsum(starts_in) - starts_in)[of]
    end = np.append(cut[1:], len(values)) - (np.cumsum(starts_in) - starts_in)[of]
    told = keep[of]
    alone = ~met & (least < most)
    whole = pc.binary_length(segments).to_numpy()[alone] - LEAST + 1
    columns = [
        np.append(h[met][of[told]], h[alone]),
        np.append(sid[met][of[told]], sid[alone]),
        np.append(begin[told], np.zeros(len(whole), np.int64)).astype(np.int32),
        np.append(end[told], whole).astype(np.int32),
        np.append(doc[told], least[alone]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "sid", "a", "b", "least"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transforms over sorted ``(h, sid, segment, least, most)``, cut between anchors."""
    held: list[pa.RecordBatch] = []
    size = 0
    batches = (b.select(["h", "sid", "segment", "least", "most"]) for b in batches if len(b))
    for batch, end in itertools.chain(((b, False) for b in batches), [(None, True)]):
        if not end:
            h = batch.column("h").to_numpy()
            new = np.flatnonzero(np.append(not held or held[-1].column("h")[-1].as_py() != h[0], h[1:] != h[:-1]))
            size += batch.column("segment").nbytes
            # up to the last anchor, which may go on
            if size <= BLOCK or not len(new) or (not held and new[-1] == 0):
                held.append(batch)
                continue
            full, rest = [*held, batch.slice(0, new[-1])], batch.slice(new[-1])
            held, size = [rest], rest.column("segment").nbytes
        else:
            full = held
        if full:
            yield _least_rows(pa.Table.from_batches(full).combine_chunks().to_batches()[0])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of a segment as a segment of its own, keyed by its digest."""
    names = ["h", "sid", "segment", "least", "most", "of_h", "of_sid", "of_at"]
    for batch in batches:
        for h, sid, segment, least, most in zip(*(batch.column(n).to_pylist() for n in names[:5]), strict=True):
            strings = [segment[i : i + LEAST] for i in range(len(segment) - LEAST + 1)]
            keys = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in strings]
            n = len(strings)
            columns = [keys, keys, strings, [least] * n, [most] * n, [h] * n, [sid] * n, list(range(n))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _leasts(distinct: DataFrame, hot_segments: int) -> DataFrame:
    """Table of LEASTS for the different segments. Anchors with many are dealt string by string."""
    hot = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).select("h")
    hot, n_hot = materialise_counted(hot, "hot")
    if not n_hot:
        return distinct.repartition("h").sortWithinPartitions("h").mapInArrow(_expand, LEASTS)
    cold = distinct.join(hot, "h", "left_anti")
    out = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_expand, LEASTS)
    fields = "h long, sid long, segment binary, least long, most long"
    single = materialise(distinct.join(hot, "h", "left_semi").mapInArrow(_strings, f"{fields}, of_h long, of_sid long, of_at int"), "strings")
    folded = single.groupBy("h", "sid", "segment").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = folded.repartition("h").sortWithinPartitions("h").mapInArrow(_expand, LEASTS)
    back = single.select("h", "sid", "of_h", "of_sid", "of_at").join(found.select("h", "sid", F.col("least").alias("doc")), ["h", "sid"])
    # strings that follow one another are a run
    place = F.row_number().over(Window.partitionBy("of_h", "of_sid", "doc").orderBy("of_at"))
    runs = back.withColumn("run", F.col("of_at") - place).groupBy("of_h", "of_sid", "doc", "run")
    told = runs.agg(F.min("of_at").alias("a"), (F.max("of_at") + 1).alias("b"))
    return out.union(told.select("of_h", "of_sid", "a", "b", "doc"))


def removed(rows: DataFrame, hot_segments: int = HOT) -> DataFrame:
    """``(_row, parts)``: byte ranges to remove from ``rows(_row, doc_id, text)``, where there are any.

    A byte goes if a string of LEAST bytes that covers it also starts in a document of smaller
    doc_id; strings are those of the input. A null text counts as empty; a null doc_id counts as
    larger than any other, and rows that repeat a doc_id are no smaller than each other. The ranges
    of a row may overlap. Texts are read whole, and matches never cross documents.
    """
    spark = rows.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    # rows of null doc_id are told one by one
    known = rows.select("_row", doc.alias("doc"), F.when(F.col("doc_id").isNull(), F.col("_row")).otherwise(-1).alias("null_row"), "text")
    found = known.select("doc", "null_row", "text").mapInArrow(_anchor_rows, "h long, doc long, null_row long")
    of = Window.partitionBy("h")
    several = found.select("h", "doc", "null_row", F.min("doc").over(of).alias("least"), F.max("doc").over(of).alias("most")).where("least < most")
    shared, shared_path = materialise_at(several.groupBy("doc", "null_row").agg(F.collect_set("h").alias("shared")), "shared")
    del found, several
    release(spark)
    met = known.join(shared, ["doc", "null_row"]).select("_row", "doc", "shared", "text")
    segments, segments_path = materialise_at(met.mapInArrow(_segment_rows, "_row long, doc long, at int, h long, sid long, segment binary"), "segments")
    del met
    delete_path(spark, shared_path)
    release(spark)
    distinct = segments.groupBy("h", "sid", "segment").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    distinct, distinct_path = materialise_at(distinct, "distinct")
    release(spark)
    leasts, leasts_path = materialise_at(_leasts(distinct, hot_segments), "leasts")
    delete_path(spark, distinct_path)
    release(spark)
    told = segments.select("_row", "doc", "at", "h", "sid").join(leasts, ["h", "sid"]).where("least < doc")
    part = F.struct((F.col("at") + F.col("a")).alias("from"), (F.col("at") + F.col("b") + (LEAST - 1)).alias("to"))
    out = materialise(told.groupBy("_row").agg(F.collect_list(part).alias("parts")), "parts")
    del told
    delete_path(spark, segments_path)
    delete_path(spark, leasts_path)
    release(spark)
    return out


def _spans(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal ranges that the ranges in each row of *parts* make up."""
    flat, rows = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    begin, end = (flat.field(n).to_numpy().astype(np.int64) for n in ("from", "to"))
    by = np.lexsort((begin, rows))
    rows, begin, end = rows[by], begin[by], end[by]
    # rows lie one after the other on a line
    far = end.max(initial=0) + 1
    begin, end = begin + rows * far, end + rows * far
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])[: len(begin)]
    last = np.append(new[1:], True)[: len(begin)]
    rows = rows[new]
    return rows, begin[new] - rows * far, reach[last] - rows * far


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        rows, begin, end = _spans(batch.column("parts"))
        first = np.searchsorted(rows, np.arange(len(sizes) + 1))
        n_removed = np.zeros(len(sizes), np.int64)
        np.add.at(n_removed, rows, end - begin)
        kept = []
        edges = np.column_stack([begin, end]).ravel()
        between = edges.tolist()
        for text, a, b in zip(texts, (2 * first[:-1]).tolist(), (2 * first[1:]).tolist(), strict=True):
            cuts = [0, *between[a:b], len(text)]
            kept.append(b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)))
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(edges) + 1, 2), pa.int32()), pa.array(edges))
        spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs)
        columns = [batch.column("doc_id"), pa.array(sizes), pa.array(n_removed), spans, pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)


def without_repeats(rows: DataFrame, hot_segments: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)`` for every one of ``rows(_row, doc_id, text)``.

    ``spans`` are the maximal removed ranges of bytes, ``kept`` the remaining bytes, which need not
    be UTF-8. An empty table gives no rows.
    """
    parts = removed(rows, hot_segments)
    joined = rows.join(parts, "_row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "parts", "text")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
