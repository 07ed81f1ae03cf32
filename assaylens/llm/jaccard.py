"""Jaccard join of shingle sets: size bands, key tiles, bitmap bounds, exact intersections.

Equal sets are one class first. Two different sets A, B can only link if they differ in at most k
elements, with k given by the size band. A set is dealt into k + 1 and some parts by hash; of its
non-empty parts at most k can differ, so two linked sets share whole parts, as many as there are
beyond k. A part's hash, with its tile (the size band of the smaller set), is a key. A set that
shares fewer of its keys with others than that links with none. The rest, joined by keys, are blocks
of candidates, compared inside by bitmaps, whose bit counts bound the intersection from above, and
then by intersecting the sorted arrays. Links inside a component that is already joined add
nothing and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm import vocab
from assaylens.llm.common import components, numbered, release
from assaylens.llm.exact import without
from assaylens.llm.shingles import mixed, shingle_sets
from assaylens.session import materialise

CHARS = 250_000  # characters shingled at once; a longer text is worked on alone
SEEN = 1_000_000  # set ids a task remembers, not to send the keys of equal sets again
GROUP = 200_000  # shingles of small components that share a task
BLOCK = 2_000_000  # shingles of a component compared at once: 16 MB for each side of a tile


@dataclass(frozen=True)
class Rule:
    """Shingles of *words* words; sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def differing(self, smaller: int) -> int:
        """Most elements in which linked sets differ if the smaller one has *smaller*."""
        return (100 - self.percent) * smaller // self.percent

    def bands(self, n: int) -> Iterator[tuple[int, int]]:
        """(tile, largest smaller size) of the tiles that a set of *n* elements belongs to.

        Tiles are bands of the smaller size, each half as wide as its lower end. Bands in which
        linked sets could not differ are left out: equal sets are one class already.
        """
        low = 1
        while low <= n:
            high = low * 3 // 2
            if self.differing(high) and (n <= high or n * self.percent <= 100 * high):
                yield low, high
            low = high + 1


def keys(items: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """Keys of a set, and how many of them any different set that links with it shares at least."""
    n, out, need = len(items), [], len(items)
    own = mixed(items + np.uint64(0x51ED270B))
    for tile, high in rule.bands(n):
        most = rule.differing(high)
        parts = most + 3 + (most + 3) // 4
        where = ((own >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, where.astype(np.int64), own)
        full = np.flatnonzero(np.bincount(where.astype(np.int64), minlength=parts))
        salt = mixed(np.uint64(tile) * np.uint64(1_000_003) + full.astype(np.uint64))
        out.append(mixed(total[full] + salt))
        need = min(need, max(1, len(full) - most))
        if len(full) <= most:
            # too few parts to be sure of a shared one: of two such sets, the smallest elements,
            # as many as may differ and one, have an element in common
            prefix = items[: n - (rule.percent * n + 99) // 100 + 1]
            out.append(mixed(prefix ^ mixed(np.array([tile + (1 << 40)], np.uint64))))
    return (np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)), need


def _parts(batch: pa.RecordBatch, *names: str) -> Iterator[list[list]]:
    """Columns of a batch in runs of whole rows of about CHARS characters of text, null as empty."""
    columns = [batch.column(n).to_pylist() for n in names]
    texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHARS:
            yield [c[start:i] for c in (*columns, texts)]
            start, size = i, 0
        size += len(text)
    if texts:
        yield [c[start:] for c in (*columns, texts)]


def _set_id(items: np.ndarray) -> tuple[int, int]:
    total = np.add.reduce(mixed(items), keepdims=True) + np.uint64(len(items))
    other = np.add.reduce(mixed(items ^ np.uint64(0xA5A5A5A55A5A5A5A)), keepdims=True)
    return int(mixed(total).view(np.int64)[0]), int(mixed(other).view(np.int64)[0])


PROFILE = "_row long, doc_id long, n_shingles long, set_id long, proof long, need long, keys array<long>"


def profiles(rows: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """One row of PROFILE for each of ``rows(_row, doc_id, text)``; set_id is null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        seen: set[int] = set()
        for batch in batches:
            for row, doc, texts in _parts(batch, "_row", "doc_id"):
                ids, proofs, sizes, needs, lists = [], [], [], [], []
                for items in shingle_sets(texts, rule.words, seed):
                    sizes.append(len(items))
                    known, proof = _set_id(items) if len(items) else (None, None)
                    ids.append(known)
                    proofs.append(proof)
                    new = known is not None and known not in seen
                    own, need = keys(items, rule) if new else (np.zeros(0, np.uint64), None)
                    lists.append(own.view(np.int64))
                    needs.append(need)
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(known)
                ends = np.cumsum([0, *map(len, lists)])
                flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                columns = [pa.array(c, pa.int64()) for c in (row, doc, sizes, ids, proofs, needs)]
                yield pa.RecordBatch.from_arrays([*columns, listed], ["_row", "doc_id", "n_shingles", "set_id", "proof", "need", "keys"])

    return rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmap of each set, as wide as the largest set, within 256 to 8,192 bits."""
    bits = 1 << min(13, max(8, int(max(map(len, sets))).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, items in enumerate(sets):
        at = (items >> np.uint64(13)) & np.uint64(bits - 1)
        np.bitwise_or.at(out[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def joined(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components among *sets*, as pairs of places; a spanning forest.

    *side* is the block of each set; with two blocks only pairs across them are compared.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    sets, side, size = [sets[i] for i in order], side[order], size[order]
    maps, label, across = _bitmaps(sets), np.arange(len(sets)), side.min() != side.max()
    links = []
    for i in range(len(sets) - 1):
        last = np.searchsorted(size, 100 * size[i] // percent, side="right")
        others = np.arange(i + 1, last)
        others = others[label[others] != label[i]]
        if across:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        need = -(-percent * (size[i] + size[others]) // (100 + percent))
        only_i = np.bitwise_count(maps[i] & ~maps[others]).sum(axis=1)
        only_j = np.bitwise_count(maps[others] & ~maps[i]).sum(axis=1)
        bound = np.minimum(size[i] - only_i.astype(np.int64), size[others] - only_j.astype(np.int64))
        for j in others[bound >= need]:
            if label[j] == label[i]:
                continue
            place = np.searchsorted(sets[j], sets[i])
            both = int((sets[j][np.minimum(place, size[j] - 1)] == sets[i]).sum())
            if 100 * both >= percent * (size[i] + size[j] - both):
                links.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return links


def _verify(rule: Rule):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in pdf.groupby("block_of", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
            ids = group["set_id"].to_numpy()
            found += [(ids[i], ids[j]) for i, j in joined(sets, group["block"].to_numpy(), rule.percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _met(dealt: DataFrame) -> DataFrame:
    """``(set_id, key)`` with ``hub``, the smallest set of the key, and whether it ``met`` another."""
    of = Window.partitionBy("key")
    least, most = F.min("set_id").over(of), F.max("set_id").over(of)
    return dealt.select("set_id", "key", least.alias("hub"), (least < most).alias("met"))


def _tiles(candidates: DataFrame, rule: Rule) -> DataFrame:
    """``(grp, i, j, block_of, block, set_id, rep)``: where each candidate set is compared.

    ``candidates(block_of, set_id, n, rep)`` are numbered in the order of their component and size.
    Small components share a group of about GROUP shingles. A larger one is cut into blocks of its
    size order, and every two blocks whose sizes may link are a tile.
    """
    order = [F.col("block_of"), F.col("n"), F.col("set_id")]
    placed = materialise(numbered(candidates, order, "order", {"all": F.col("n")}), "placed")
    ends = placed.groupBy("block_of").agg(F.min("all_before").alias("start"), F.max(F.col("all_before") + F.col("n")).alias("end"))
    placed = placed.join(materialise(ends, "ends"), "block_of")
    large = F.col("end") - F.col("start") > BLOCK
    fields = ["block_of", "block", "set_id", "rep"]
    small = placed.where(~large).withColumn("block", F.lit(0).cast("long"))
    small = small.select((F.col("start") / GROUP).cast("long").alias("grp"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), *fields)
    cut = placed.where(large).withColumn("block", ((F.col("all_before") - F.col("start")) / BLOCK).cast("long"))
    blocks = cut.groupBy("block_of", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = blocks.select("block_of", F.col("block").alias("i"), F.col("most").alias("most_i"))
    right = blocks.select("block_of", F.col("block").alias("j"), F.col("least").alias("least_j"))
    pairs = left.join(right, "block_of").where((F.col("i") <= F.col("j")) & (F.col("least_j") * rule.percent <= F.col("most_i") * 100))
    sides = F.array_distinct(F.array("i", "j"))
    deal = pairs.select("block_of", "i", "j", F.explode(sides).alias("block"))
    tiled = cut.join(deal, ["block_of", "block"]).select(F.col("block_of").alias("grp"), "i", "j", *fields)
    return small.union(tiled)


def classes(rows: DataFrame, rule: Rule) -> DataFrame:
    """Component of each of ``rows(_row, doc_id, text)`` under the rule's links.

    Returns ``_row, doc_id, n_shingles, component_id, first_row``: the smallest doc_id of the
    component, and its row of smallest doc_id (null last; then the first of the table). A null or
    empty text, or one without words, has no shingles and is a component of its own, whose
    component_id is its doc_id. Repeated rows and equal sets are one class. An empty table gives
    no rows. Every link between different sets is found; those inside a component that is already
    joined are not looked for.
    """
    seed = 0
    while True:
        table = materialise(profiles(rows, rule, seed), "profiles")
        known = table.where("set_id is not null")
        sets = materialise(
            known.groupBy("set_id").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_row")).alias("first"),
                F.max("n_shingles").alias("n"),
                F.max("need").alias("need"),
                F.min("proof").alias("proof"),
                F.max("proof").alias("proof_too"),
            ),
            "sets",
        )
        if not sets.where("proof <> proof_too").take(1):
            break
        seed += 1  # two sets with one id: number the shingles anew
    dealt = known.select("set_id", F.explode("keys").alias("key"))
    shared = materialise(_met(dealt).where("met").select("set_id", "key"), "shared")
    release(rows.sparkSession)
    enough = shared.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).join(sets.select("set_id", "need"), "set_id").where("n >= need")
    again = _met(shared.join(materialise(enough.select("set_id"), "enough"), "set_id", "left_semi")).where("met")
    stars = materialise(again.where("set_id <> hub").select("set_id", "hub").distinct(), "stars")
    near = components(stars.select(F.col("set_id").alias("a"), F.col("hub").alias("b")), "candidates")
    near = near.union(near.select(F.col("component").alias("node"), "component").distinct())
    candidates = near.select(F.col("component").alias("block_of"), F.col("node").alias("set_id")).join(
        sets.select("set_id", "n", F.col("first._row").alias("rep")), "set_id"
    )
    tiles = materialise(_tiles(candidates, rule), "tiles")

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        for batch in batches:
            names = ["grp", "i", "j", "block_of", "block", "set_id"]
            for *columns, texts in _parts(batch, *names):
                items = [s.tobytes() for s in shingle_sets(texts, rule.words, seed)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(items, pa.binary())], [*names, "items"])

    texts = rows.select(F.col("_row").alias("rep"), "text")
    # the candidates grow with the table, so neither side is broadcast
    sent = tiles.hint("merge").join(texts, "rep").drop("rep").mapInArrow(payload, "grp long, i long, j long, block_of long, block long, set_id long, items binary")
    links = materialise(sent.groupBy("grp", "i", "j").applyInPandas(_verify(rule), "a long, b long"), "links")
    roots = components(links, "components")
    root = F.coalesce("component", "set_id")
    labelled = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", root.alias("root"), "first")
    labelled = materialise(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = labelled.join(materialise(least, "least"), "root", "left").select("set_id", F.coalesce("least", "first").alias("least"))
    done = table.select("_row", "doc_id", "n_shingles", "set_id").join(materialise(told, "told"), "set_id", "left")
    alone = F.col("set_id").isNull()
    return done.select(
        "_row",
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(alone, F.col("_row")).otherwise(F.col("least._row")).alias("first_row"),
    )


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One document of each component, that of smallest doc_id; same columns."""
    return without(docs, lambda rows: classes(rows, rule or Rule()).where("_row <> first_row"), "near")
