"""Nearest neighbours by inner product: one hierarchical small-world graph for each shard of vectors.

Vectors are lengthened to a common norm, so that the largest inner product is the smallest distance
among them. Equal vectors of a shard are one node. Layers hold ever fewer nodes; a layer's graph is
an array of up to ROOM neighbours a node, grown in batches: a batch is searched for in the graph so far
and compared within itself, and neighbours are chosen to lie in different directions. A shard is
one row of flat arrays. Blocks of queries meet every shard, and the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.common import meetings
from assaylens.session import materialise, materialise_counted

SHARD_ROWS = 8_192  # vectors of a shard, fewer if they are long
SHARD_NUMBERS = 8_000_000
WIDTH = 32  # neighbours chosen for a node
ROOM = 48  # links a node may hold until they are chosen anew
FOUND = 96  # candidates kept while a graph is grown
SEEN = 192  # candidates kept by a query; at least k
THIN = 16  # a layer has one in THIN of the nodes below it
TOP = 256  # a layer this small is compared in full
BATCH = 256
STEPS = 4  # candidates expanded at once
QUERIES = 500  # queries of a block
SEED = 42


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The *keep* nearest nodes that a search from *start* finds for each query, and their products.

    Best first; nodes are -1 where fewer are found. All queries take their steps together.
    """
    n = len(queries)
    row = np.arange(n)[:, None]
    stamp = np.full((n, len(x)), -1, np.int32)  # also whether a node has been seen
    stamp[row, start[:, :keep]] = 0
    ids = np.full((n, keep), -1, np.int64)
    near = np.full((n, keep), -np.inf, np.float32)
    width = min(start.shape[1], keep)
    start = start[:, :width]
    again = np.tril(start[:, :, None] == start[:, None, :], -1).any(axis=2)
    ids[:, :width] = np.where(again, -1, start)
    near[:, :width] = np.where(again, -np.inf, np.matmul(x[start], queries[:, :, None])[:, :, 0])
    open_ = ids >= 0
    active = np.arange(n)
    while len(active):
        own = np.where(open_[active], near[active], -np.inf)
        steps = min(STEPS, keep)
        at = np.argpartition(-own, steps - 1, axis=1)[:, :steps]
        live = np.take_along_axis(own, at, 1) > -np.inf
        going = live.any(axis=1)
        active, at, live = active[going], at[going], live[going]
        if not len(active):
            break
        mine = active[:, None]
        chosen = ids[mine, at]
        open_[mine, at] = False
        new = np.where(live[:, :, None], links[np.where(live, chosen, 0)], -1).reshape(len(active), -1)
        there = new >= 0
        place = np.arange(1, new.shape[1] + 1, dtype=np.int32)[None, :]
        safe = np.where(there, new, 0)
        there &= stamp[mine, safe] < 0
        # of a node met twice in this step the last one counts
        r, c = np.nonzero(there)
        stamp[active[r], safe[r, c]] = place[0, c]
        there[r, c] = stamp[active[r], safe[r, c]] == place[0, c]
        product = np.full(new.shape, -np.inf, np.float32)
        r, c = np.nonzero(there)
        product[r, c] = np.einsum("ij,ij->i", x[new[r, c]], queries[active[r]])
        all_ids = np.concatenate([ids[active], np.where(there, new, -1)], axis=1)
        all_near = np.concatenate([near[active], product], axis=1)
        all_open = np.concatenate([open_[active], there], axis=1)
        best = np.argpartition(-all_near, keep - 1, axis=1)[:, :keep]
        ids[active], near[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_near, best, 1)
        open_[active] = np.take_along_axis(all_open, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to *most* neighbours among candidates, best first: nearer to the node than to a chosen one.

    Places left over go to the nearest of the rest. *ids* hold -1 where there is no candidate.
    """
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    n, k = ids.shape
    vectors = x[np.where(ids >= 0, ids, 0)]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    hidden = np.full((n, k), -np.inf, np.float32)  # product with the nearest chosen one
    taken = np.zeros((n, k), bool)
    count = np.zeros(n, np.int64)
    for j in range(k):
        fits = (ids[:, j] >= 0) & (near[:, j] > hidden[:, j]) & (count < most)
        taken[fits, j] = True
        count += fits
        hidden[fits] = np.maximum(hidden[fits], between[fits, j])
    first = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int64)
    picked = np.take_along_axis(ids, first, 1)
    out[:, : picked.shape[1]] = picked
    return out


def _closest(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray, keep: int) -> np.ndarray:
    """The *keep* nearest of *nodes* for each query, by all products."""
    keep = min(keep, len(nodes))
    product = queries @ x[nodes].T
    return nodes[np.argpartition(-product, keep - 1, axis=1)[:, :keep]]


def _layer(x: np.ndarray, starts) -> np.ndarray:
    """Graph of the rows of *x*; ``starts`` searches the layer above for where to begin."""
    n = len(x)
    links = np.full((n, ROOM), -1, np.int64)
    batch = max(16, min(BATCH, 4_000_000 // (FOUND * x.shape[1])))
    done = 0
    while done < n:
        size = min(batch, n - done)
        own = np.arange(done, done + size)
        inside = x[own] @ x[own].T
        np.fill_diagonal(inside, -np.inf)
        few = min(WIDTH, size - 1)
        by = np.argpartition(-inside, max(few - 1, 0), axis=1)[:, :few]
        ids, near = own[by], np.take_along_axis(inside, by, 1)
        if done:
            entry = starts(x[own], done)
            far_ids, far_near = _beam(x[:done], links[:done], x[own], entry, min(FOUND, done))
            ids, near = np.concatenate([far_ids, ids], axis=1), np.concatenate([far_near, near], axis=1)
        if ids.shape[1]:
            near = np.where(ids >= 0, near, -np.inf).astype(np.float32)
            links[own, :WIDTH] = _diverse(x, ids, near, WIDTH)
            _back(x, links, own)
        done += size
    return links


def _back(x: np.ndarray, links: np.ndarray, own: np.ndarray) -> None:
    """Adds the links of *own* in the other direction; a list over ROOM is chosen anew."""
    source = np.repeat(own, WIDTH)
    to = links[own, :WIDTH].ravel()
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    by = np.argsort(count, kind="stable")
    nodes, first, count = nodes[by], first[by], count[by]
    at = 0
    while at < len(nodes):
        widest = ROOM + int(count[min(at + 1023, len(nodes) - 1)])
        upto = at + max(16, min(1024, 4_000_000 // widest**2))
        some, f, c = nodes[at:upto], first[at:upto], count[at:upto]
        at = upto
        width = np.arange(c.max())
        added = np.where(width < c[:, None], source[np.minimum(f[:, None] + width, len(source) - 1)], -1)
        added[(added[:, :, None] == links[some][:, None, :]).any(axis=2)] = -1
        ids = np.concatenate([links[some], added], axis=1)
        held = (ids >= 0).sum(axis=1)
        plain = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :ROOM]
        full = held > ROOM
        links[some[~full]] = plain[~full]
        if full.any():
            ids = ids[full]
            near = np.einsum("nkd,nd->nk", x[np.where(ids >= 0, ids, 0)], x[some[full]])
            fewer = np.full((len(ids), ROOM), -1, np.int64)
            fewer[:, :WIDTH] = _diverse(x, ids, np.where(ids >= 0, near, -np.inf).astype(np.float32), WIDTH)
            links[some[full]] = fewer


class Graph:
    """Layers from the top: numbers of nodes, which are the first so many, and links among them."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        norm = (vectors * vectors).sum(axis=1)
        longer = np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0.0))
        self.x = np.column_stack([vectors, longer]).astype(np.float32)
        self.layers: list[np.ndarray] = []
        if layers is not None:
            self.layers = layers
            return
        n = len(vectors)
        sizes = [n]
        while sizes[-1] > TOP:
            sizes.append(-(-sizes[-1] // THIN))
        for above, size in zip([0, *sizes[:0:-1]], sizes[::-1], strict=True):
            def starts(queries: np.ndarray, upto: int, above=above) -> np.ndarray:
                return self.entry(queries, min(above, upto)) if above else np.zeros((len(queries), 1), np.int64)

            self.layers.append(_layer(self.x[:size], starts) if size > TOP else np.zeros((size, 0), np.int64))

    def entry(self, queries: np.ndarray, upto: int) -> np.ndarray:
        """Where to start in the next layer: the nearest of the layers so far, of the first *upto* nodes."""
        few = len(self.layers[0])
        found = _closest(self.x, np.arange(min(few, upto)), queries, STEPS)
        if upto < len(self.layers[-1]):
            return found
        for links in self.layers[1:]:
            found = _beam(self.x[: len(links)], links, queries, found, 2 * STEPS)[0]
            found = np.where(found >= 0, found, found[:, :1])
        return found

    def search(self, queries: np.ndarray, keep: int) -> np.ndarray:
        """The *keep* nearest nodes found for each query, -1 where there are fewer."""
        q = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        if len(self.layers) == 1:
            return _closest(self.x, np.arange(len(self.x)), q, keep)
        bottom, self.layers = self.layers[-1], self.layers[:-1]
        start = self.entry(q, len(self.layers[-1]))
        self.layers = [*self.layers, bottom]
        return _beam(self.x, bottom, q, start, min(keep, len(self.x)))[0]


INDEX = "shard int, dim int, vectors binary, ids binary, owners binary, sizes array<int>, links binary"


def _row(shard: int, dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """A shard as one row of INDEX: distinct vectors in a seeded order, ids by owner, layers end to end."""
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    order = np.random.default_rng(SEED).permutation(len(distinct))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    distinct, owner = distinct[order], place[owner.ravel()]
    by = np.lexsort((ids, owner))
    layers = Graph(distinct).layers
    columns = [[shard], [dim], [distinct.tobytes()], [ids[by].tobytes()], [owner[by].tobytes()], [[len(g) for g in layers]]]
    flat = b"".join(g.astype(np.int32).tobytes() for g in layers if g.shape[1])
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [flat]], kinds, strict=True)], ["shard", "dim", "vectors", "ids", "owners", "sizes", "links"])


def _loaded(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    flat, layers = np.frombuffer(row["links"], np.int32).astype(np.int64), []
    for size in row["sizes"]:
        width = ROOM if size > TOP else 0
        layers.append(flat[: size * width].reshape(size, width))
        flat = flat[size * width :]
    ids, owners = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owners"], np.int64)
    return Graph(vectors, layers), vectors, ids, np.searchsorted(owners, np.arange(len(vectors) + 1))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of INDEX from ``(shard, dim, vec_id, vector)`` sorted by shard; one shard is held at once."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        dim = table["dim"][0].as_py()
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return _row(table["shard"][0].as_py(), dim, table["vec_id"].to_numpy(), flat.reshape(-1, dim))

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
        for a, b in zip(edges, [*edges[1:], len(shards)], strict=True):
            if held and held[0].column("shard")[0].as_py() != shards[a]:
                yield flush()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without a null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """Written INDEX of ``rows(vec_id, vector)``, and the number of shards.

    A row with a null vec_id can't be named and is left out, as is a vector that isn't usable. Each
    length of vectors has shards of its own. Rows are dealt by the place they were written at, so
    that copies of one row are spread.
    """
    kept = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    table = materialise(kept.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("nr")), "vectors")
    first, shards = {}, 0
    for dim, n in sorted(table.groupBy("dim").agg(F.count(F.lit(1))).collect()):
        count = -(-n // max(1, min(SHARD_ROWS, SHARD_NUMBERS // dim)))
        first[dim], shards = (shards, count), shards + count
    if not shards:
        return table.sparkSession.createDataFrame([], INDEX), 0
    # one entry for each length of vectors
    starts, counts = (F.create_map(*[F.lit(x) for d, v in first.items() for x in (d, v[i])])[F.col("dim")] for i in (0, 1))
    dealt = table.select((starts + F.pmod(F.xxhash64("nr"), counts)).cast("int").alias("shard"), "dim", "vec_id", "vector")
    grown = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_grow, INDEX)
    return materialise(grown, "graphs"), shards


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(dim, nrs, ids, vectors)`` of up to QUERIES queries of one length."""
    held: dict[int, list[tuple]] = {}

    def flush(dim: int) -> pa.RecordBatch:
        nrs, ids, vectors = zip(*held.pop(dim), strict=True)
        columns = [[dim], [np.array(nrs, np.int64).tobytes()], [np.array(ids, np.int64).tobytes()], [np.array(vectors, np.float64).tobytes()]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["dim", "nrs", "query_ids", "asked"])

    for batch in batches:
        for nr, key, vector in zip(*(batch.column(n).to_pylist() for n in ("nr", "query_id", "vector")), strict=True):
            own = held.setdefault(len(vector), [])
            own.append((nr, key, vector))
            if len(own) >= QUERIES:
                yield flush(len(vector))
    for dim in list(held):
        yield flush(dim)


def _answer(k: int):
    def run(index: dict, blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        graph, vectors, ids, edges = _loaded(index)
        for block in blocks:
            if block["dim"] != index["dim"]:
                continue
            nrs, keys = (np.frombuffer(block[c], np.int64) for c in ("nrs", "query_ids"))
            asked = np.frombuffer(block["asked"], np.float64).reshape(len(nrs), -1)
            out = []
            for at in range(0, len(nrs), BATCH):
                found = graph.search(asked[at : at + BATCH], max(SEEN, k + 1))
                for nr, key, q, nodes in zip(nrs[at:], keys[at:], asked[at:], found, strict=False):
                    nodes = nodes[nodes >= 0]
                    score = (vectors[nodes] * q).sum(axis=1)
                    if len(score) > k + 1:  # one of the k + 1 best nodes may hold the query's own row only
                        far = score >= np.partition(score, -k - 1)[-k - 1]
                        nodes, score = nodes[far], score[far]
                    rows = []
                    for s, node in zip(score.tolist(), nodes.tolist(), strict=True):
                        copies = ids[edges[node] : edges[node + 1]]
                        rows += [(-s, i) for i in copies[copies != key][:k].tolist()]
                    out += [(nr, key, i, -s) for s, i in sorted(rows)[:k]]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["nr", "query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest found among ``rows(vec_id, vector)`` for each of ``queries(query_id, vector)``.

    Returns ``query_id, rank, vec_id, score``: the largest inner products in double precision, ties
    to the smaller vec_id. Graphs are searched, so a near vector may be missed; scores are exact.
    Rows whose vec_id is the query's are its own and are left out; other copies of a vector are found
    like any, repeated rows each. A null id, and a vector that is null, empty or zero or holds a
    null or non-finite number, takes no part on either side; vectors of different lengths don't
    meet. Repeated queries are answered each. Empty tables give no rows.
    """
    graphs, shards = index(rows)
    asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("vector")))
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.monotonically_increasing_id().alias("nr"))
    blocks, n_blocks = materialise_counted(asked.mapInArrow(_blocks, "dim int, nrs binary, query_ids binary, asked binary"), "queries")
    rank = F.row_number().over(Window.partitionBy("nr").orderBy(F.desc("score"), "vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return meetings(graphs, shards, blocks, n_blocks, _answer(k), "nr long, query_id long, vec_id long, score double", best)
