"""Divergence of the sources of each language by term frequencies.

Indexing is single-pass and in memory: a task keeps a block of postings (term, language, source) until
the block is full, then spills it as a run sorted by term, cut by the hash of the posting. The runs of
a hash shard are merged in order into frequencies, in Arrow arrays. Scores follow from frequencies alone. A source
pair is scored in the closed form over the terms that one of the two lacks, by the number of terms
of each count; what shared terms add to that is streamed over the postings of each term.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.session import materialise

#: A-Z lower-cased; what belongs to no term is a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 600_000  # postings that a task holds before it spills a run
SPILL = 10_000  # postings of a row of a run
HEAP = 2_000_000  # postings of runs merged at once; what comes out is merged with the next
SUMS = 4_000_000  # pairs of groups that are summed in one array; more are summed as they come
SCALE = 1_000_000_000

MARK = b"\xff"  # between the parts of a posting's key; no UTF-8 text holds it
RUN = "shard int, keys array<binary>, counts array<long>, docs array<long>"
POSTING = "term string, lang string, source string, n long, df long"
NAMES = ["keys", "counts", "docs"]
Block = dict[tuple[str, str], tuple[Counter, Counter]]
#: Keys of postings, and their occurrences and documents.
Postings = tuple[pa.BinaryArray, np.ndarray, np.ndarray]


def _spilled(block: Block, shards: int) -> Iterator[pa.RecordBatch]:
    """The block as rows of RUN: for each shard its postings in the order of their keys."""
    keys, counts, docs, dealt = [], [], [], []
    for group, (n, df) in block.items():
        tail = MARK + MARK.join(x.encode("utf-8", "surrogatepass") for x in group)
        # a group is told also where it has no term
        terms = [b"", *n]
        keys.append(pc.binary_join_element_wise(pa.array(terms, pa.binary()), pa.scalar(tail, pa.binary()), pa.scalar(b"", pa.binary())))
        counts.append(np.fromiter(chain([0], n.values()), np.int64, len(terms)))
        docs.append(np.fromiter(chain([0], map(df.__getitem__, n)), np.int64, len(terms)))
        dealt.append(np.fromiter(map(zlib.crc32, terms, repeat(zlib.crc32(tail))), np.int64, len(terms)) % shards)
    key, n, df, shard = pa.concat_arrays(keys), *map(np.concatenate, (counts, docs, dealt))
    order = pc.sort_indices(key).to_numpy()
    order = order[np.argsort(shard[order], kind="stable")]
    ends = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    for of, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        for at in range(start, end, SPILL):
            rows = order[at : min(at + SPILL, end)]
            columns = (key.take(pa.array(rows)), pa.array(n[rows]), pa.array(df[rows]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), *lists], ["shard", *NAMES])


def _index(shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "text")), strict=True):
                counts, docs = block.setdefault((lang, source), (Counter(), Counter()))
                terms = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                before = len(counts)
                counts.update(terms)
                docs.update(set(terms))
                held += len(counts) - before
                if held >= most:
                    yield from _spilled(block, shards)
                    block, held = {}, 0
        if block:
            yield from _spilled(block, shards)

    return run


def _summed(runs: list[Postings]) -> Postings:
    """The runs merged in the order of their keys, equal keys added up."""
    key, n, df = pa.concat_arrays([r[0] for r in runs]), *(np.concatenate([r[i] for r in runs]) for i in (1, 2))
    order = pc.sort_indices(key)
    key, n, df = key.take(order), n[order.to_numpy()], df[order.to_numpy()]
    new = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, new))
    return key.take(pa.array(first)), np.add.reduceat(n, first), np.add.reduceat(df, first)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies of a partition of shards: its runs, HEAP postings at a time."""
    runs: list[Postings] = []
    held = 0
    for batch in batches:
        columns = [batch.column(n) for n in NAMES]
        edges = columns[0].offsets.to_numpy()
        keys, *numbers = (c.values for c in columns)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            runs.append((keys.slice(a, b - a), *(x[a:b].to_numpy() for x in numbers)))
            held += b - a
            if held >= HEAP:
                runs = [_summed(runs)]
                held = max(0, len(runs[0][0]) - HEAP // 2)
    if not runs:
        return
    key, n, df = _summed(runs)
    for at in range(0, len(key), 50_000):
        parts = pc.split_pattern(key[at : at + 50_000], MARK).flatten()
        columns = [*(parts[i::3].cast(pa.string()) for i in range(3)), pa.array(n[at : at + 50_000]), pa.array(df[at : at + 50_000])]
        yield pa.RecordBatch.from_arrays(columns, ["term", "lang", "source", "n", "df"])


def frequencies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Written POSTING rows of ``docs(text, lang, source)``: occurrences and documents of each term.

    Null counts as the empty string in all three. Each (lang, source) that occurs has a row of the
    empty term besides, with n and df of 0.
    """
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = filled.mapInArrow(_index(shards, block), RUN)
    # a posting of a hot term or source is one entry in each run, so shards stay even
    return materialise(runs.repartition(shards, "shard").mapInArrow(_merged, POSTING), "frequencies")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact in integers; null where there is no term."""
    top = F.lit(SCALE).cast("decimal(19,0)") * (n + 1).cast("decimal(19,0)")
    whole = F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)")
    return F.call_function("div", top, whole) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q) of longs; both are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms with postings in both sources add to the closed form, summed by pair."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q = p[:, :, None], q[:, None, :]
        return ((p - q) ** 2).view(np.uint64) // q.view(np.uint64)

    def told(code: np.ndarray, total: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        a, b = names[code // len(names)], names[code % len(names)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total)], ["a", "b", "more"])

    for batch in batches:
        posts = batch.column("posts")
        start, size = posts.offsets.to_numpy()[:-1], posts.value_lengths().to_numpy()
        nr, p, zero = (posts.values.field(c).to_numpy() for c in ("nr", "p", "zero"))
        names, local = np.unique(nr, return_inverse=True)
        dense = np.zeros(len(names) ** 2, np.int64) if len(names) ** 2 <= SUMS else None
        # terms of as many postings are worked on together
        for g in np.unique(size).tolist():
            terms, step = start[size == g], max(1, 200_000 // g**2)
            for at in range(0, len(terms), step):
                of = terms[at : at + step, None] + np.arange(g)
                more = (f(p[of], p[of]) - f(p[of], zero[of]) - f(zero[of], p[of]) + f(zero[of], zero[of])).view(np.int64)
                code = local[of][:, :, None] * len(names) + local[of][:, None, :]
                if dense is not None:
                    np.add.at(dense, code.ravel(), more.ravel())
                    continue
                pair, place = np.unique(code.ravel(), return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, place, more.ravel())
                yield told(pair, total, names)
        if dense is not None:
            pair = np.flatnonzero(dense)
            yield told(pair, dense[pair], names)


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200, block: int = BLOCK) -> DataFrame:
    """Rows of parts `pair` and `term` for ``docs(text, lang, source)``.

    Returns ``lang, source, part, item, value, rank``. Terms are runs of letters (and of anything
    beyond ASCII), lower-cased in A-Z; a language keeps those in *least_docs* or more of its
    documents. Null lang, source or text count as '', which is a language or source like any other;
    other columns are not read. Repeated rows count each. Part `pair` gives every other source of the
    language with the sum of divergences over the kept terms (0 without any), so its rows grow with
    the square of the sources of a language. Part `term` gives the *ranks* kept terms in which the
    source exceeds its language most. Ranks follow value, then the bytes of the item. A group without
    terms is paired like any other; an empty table gives no rows.
    """
    posts = frequencies(docs, block)
    named = posts.where("term <> ''")
    # one row a term: its postings, one for each source of the language
    listed = named.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("posts")
    )
    kept = materialise(listed.where(F.col("df") >= least_docs).select("lang", "term", "all_n", "posts"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    single = kept.select("lang", "term", "all_n", F.explode("posts").alias("p")).select("lang", "term", "all_n", "p.source", "p.n")
    totals = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    everyone = posts.where("term = ''").select("lang", "source")
    zero = F.lit(0).cast("long")
    groups = everyone.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n"), F.coalesce("total", zero).alias("total")
    )
    groups = groups.withColumn("zero", probability(zero, F.col("total"), F.col("v"))).withColumn("nr", F.monotonically_increasing_id())
    groups = materialise(groups, "groups")
    own = probability(F.col("n"), F.col("total"), F.col("v"))
    known = single.join(groups, ["lang", "source"]).withColumn("p", own)

    # terms in which a source exceeds its language; the rank limit is applied before the shuffle, too
    lang_p = probability(F.col("all_n"), F.col("lang_n"), F.col("v"))
    over = known.withColumn("q", lang_p).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    # pairs: all terms as if none were shared, then the shared ones
    sizes = materialise(known.groupBy("nr", "lang", "p", "zero").agg(F.count(F.lit(1)).alias("terms")), "sizes")
    shared = known.groupBy("lang", "term").agg(F.collect_list(F.struct("nr", "p", "zero")).alias("posts")).where(F.size("posts") > 1)
    more = shared.select("posts").mapInArrow(_corrections, "a long, b long, more long").groupBy("a", "b").agg(F.sum("more").alias("more"))
    other = groups.select("lang", F.col("nr").alias("nr2"), F.col("zero").alias("zero2"))
    pairs = sizes.join(other, "lang").where("nr <> nr2")
    none = divergence(F.col("zero"), F.col("zero2"))
    back = divergence(F.col("zero2"), F.col("zero"))
    lone = pairs.select(
        "nr", "nr2",
        (F.col("terms") * (divergence(F.col("p"), F.col("zero2")) - none)).alias("as_p"),
        (F.col("terms") * (divergence(F.col("zero2"), F.col("p")) - back)).alias("as_q"),
    ).groupBy("nr", "nr2").agg(F.sum("as_p").alias("as_p"), F.sum("as_q").alias("as_q"))
    added = lone.select("nr", "nr2", F.col("as_p").alias("add")).union(lone.select("nr2", "nr", "as_q")).union(more)
    added = materialise(added.groupBy("nr", "nr2").agg(F.sum("add").alias("add")), "pairs")
    left = groups.select("lang", "source", "nr", "v", "zero")
    right = groups.select("lang", F.col("source").alias("item"), F.col("nr").alias("nr2"), F.col("zero").alias("zero2"))
    base = F.coalesce(F.col("v") * none, zero)
    scored = left.join(right, "lang").where("nr <> nr2").join(added, ["nr", "nr2"], "left")
    scored = scored.select("lang", "source", "item", (base + F.coalesce("add", zero)).alias("value"))
    paired = scored.withColumn("rank", F.row_number().over(best))
    fields = ["lang", "source", "part", "item", "value", "rank"]
    return paired.withColumn("part", F.lit("pair")).select(*fields).union(top.withColumn("part", F.lit("term")).select(*fields))
