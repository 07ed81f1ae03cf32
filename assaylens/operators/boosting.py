"""Gradient-boosted trees for all responses and held-out folds together.

Log-loss boosting of regression trees: least-squares splits of the residuals, Newton leaf values. Rows
are first collapsed to distinct (response, fold, part, label, feature vector) patterns with counts;
parts are PARTS hash classes of the entities, and each tree leaves some of them out as its
subsample. Equal vectors of a model always share a margin, so it is fitted on its distinct vectors, each
with its rows and positives by part. Features are cut into bins. While the vectors of a response are
few, each (response, fold) is one group and grows all of its trees there. Beyond that, no group is
gathered: every level of the next tree of all models is one aggregation keyed (model, node, feature,
bin), and margins, trees and models stay in tables. Both plans give the same trees.

A model is far larger than a row, so no join puts it beside every row: distinct vectors are dealt into
parts, and each part streams past one copy of its model.

A model is one row of flat arrays: node i of tree t stands at t * nodes + i, its children at 2i + 1
and 2i + 2; its feature is -1 where it is a leaf, and a value above ``cut`` goes to the right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylens.config import BoostingParams
from assaylens.operators.logistic import ALL_ROWS
from assaylens.session import delete_path, lookup, materialise, new_path

PARTS = 10
BINS = 256
#: Most feature vectors of a response that one task may hold; more are fitted in shared passes.
GROUP_PATTERNS = 200_000
#: Feature vectors that stream past one copy of their model.
VECTORS = 50_000
LEAST_GAIN = 1e-9
DIGITS = 9  # gains are compared rounded, so that the order of a sum can't decide between equal ones
MODEL = "response string, held_out int, note string, prior double, nodes int, feature array<int>, cut array<double>, value array<double>, cover array<double>, gain array<double>"
MODEL_KEY = ["response", "held_out"]


def boosting_patterns(design: DataFrame, features: Sequence[str], seed: int, fold: str = "fold") -> DataFrame:
    """Distinct (response, fold, part, label, x) with counts ``n``, materialised."""
    digest = F.md5(F.concat_ws("#", F.lit("part"), F.lit(str(seed)), F.col("entity_id").cast("string")).cast("binary"))
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PARTS).cast("int")
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return materialise(
        design.groupBy("response", F.col(fold).alias("fold"), part.alias("part"), "label", x.alias("x")).agg(F.count(F.lit(1)).alias("n")), "boosting"
    )


def left_out(tree: int, subsample: float) -> list[int]:
    """Parts that a tree does not see; over the trees all sets of two come up equally often."""
    first, size = tree % PARTS, round((1 - subsample) * PARTS)
    steps = range(1, PARTS) if size <= 2 else [s for s in range(1, PARTS) if gcd(s, PARTS) == 1]
    return sorted({(first + i * steps[tree // PARTS % len(steps)]) % PARTS for i in range(size)})


def bin_edges(patterns: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Ascending cut values of each feature: all of its distinct values but the largest, *bins* at most.

    A feature of more values is cut at approximate quantiles.
    """
    cells = patterns.select(F.posexplode("x").alias("pos", "v"), "n")
    sizes = cells.groupBy("pos").agg(F.approx_count_distinct("v").alias("k"))
    few = cells.join(sizes.where(F.col("k") <= bins), "pos").groupBy("pos").agg(F.array_sort(F.collect_set("v")).alias("v"))
    share = [i / bins for i in range(1, bins + 1)]
    many = cells.join(sizes.where(F.col("k") > bins), "pos").groupBy("pos").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", share, 100 * bins))).alias("v"))
    # as many rows as features, each of about *bins* numbers
    return [list(r["v"][:-1]) for r in few.union(many).orderBy("pos").collect()]


def _ratio(s: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.divide(s, h, out=np.zeros_like(s), where=h > 1e-150)


def part_counts(patterns: DataFrame, held_out: Sequence[int]) -> DataFrame:
    """Training rows ``n`` and positives ``pos`` by part, for each (response, held_out, x).

    Vectors that only the held-out fold has are there with zeros.
    """
    parts = range(PARTS)

    def arrays(of) -> list[Column]:
        sums = [[F.coalesce(F.sum(of(c, p)), F.lit(0)) for p in parts] for c in ("n", "pos")]
        return [F.array(*s).alias(c) for s, c in zip(sums, ("n", "pos"), strict=True)]

    rows = patterns.select("response", "fold", "part", "x", "n", (F.col("n") * F.col("label")).alias("pos"))
    cells = materialise(rows.groupBy("response", "fold", "x").agg(*arrays(lambda c, p: F.when(F.col("part") == p, F.col(c)))), "cells")
    each = cells.withColumn("held_out", F.explode(F.array(*[F.lit(int(h)) for h in held_out])))
    trains = ~F.col("fold").eqNullSafe(F.col("held_out"))
    return each.groupBy(*MODEL_KEY, "x").agg(*arrays(lambda c, p: F.when(trains, F.get(c, F.lit(p)))))


def _grow(bins: np.ndarray, n: np.ndarray, pos: np.ndarray, edges: list[list[float]], params: BoostingParams) -> tuple[float, dict]:
    """Prior and flat arrays of all trees of one model; *n* and *pos* have a column for each part."""
    nodes, width = 2 ** (params.depth + 1) - 1, bins.shape[1]
    size = max(map(len, edges), default=0) + 1
    total, positive = n.sum(), pos.sum()
    prior = float(np.log(positive / (total - positive)))
    margin = np.full(len(n), prior)
    trees = {"feature": np.full((params.trees, nodes), -1), **{k: np.zeros((params.trees, nodes)) for k in ("cut", "value", "cover", "gain")}}
    offset = np.arange(width) * size
    for t in range(params.trees):
        feature, cut, value, cover, gain = (trees[k][t] for k in ("feature", "cut", "value", "cover", "gain"))
        prob = 1 / (1 + np.exp(-margin))
        seen = np.setdiff1d(np.arange(PARTS), left_out(t, params.subsample))
        w = n[:, seen].sum(axis=1)
        parts = (w, pos[:, seen].sum(axis=1) - w * prob, w * prob * (1 - prob))
        cover[0], value[0] = parts[0].sum(), params.learning_rate * float(_ratio(*(np.array([p.sum()]) for p in parts[1:]))[0])
        node = np.zeros(len(n), np.int64)
        for level in range(params.depth):
            first = 2**level - 1
            rows = np.flatnonzero(node >= first)
            if not len(rows):
                break
            key = ((node[rows] - first)[:, None] * width * size + offset + bins[rows]).ravel()
            upto = [np.bincount(key, np.repeat(p[rows], width), (first + 1) * width * size).reshape(first + 1, width, size).cumsum(axis=2) for p in parts]
            whole = [u[:, :1, -1:] for u in upto]
            (nl, sl, hl), (nr, sr, hr) = upto, [a - u for a, u in zip(whole, upto, strict=True)]
            able = (nl >= params.min_leaf) & (nr >= params.min_leaf) & (whole[0] >= params.min_split)
            better = np.full(nl.shape, -np.inf)
            np.divide(sl**2, nl, out=better, where=able)
            better[able] += (sr**2 / np.where(able, nr, 1) - whole[1] ** 2 / np.where(able, whole[0], 1))[able]
            better = np.where(able, np.round(better, DIGITS), -np.inf).reshape(first + 1, -1)
            best = better.argmax(axis=1)  # of equal gains the lower feature, then the lower cut
            for i in np.flatnonzero(better.max(axis=1) > LEAST_GAIN):
                f, b = divmod(int(best[i]), size)
                at = first + i
                feature[at], cut[at], gain[at] = f, edges[f][b], better[i, best[i]]
                for child, c, s, h in ((2 * at + 1, nl, sl, hl), (2 * at + 2, nr, sr, hr)):
                    cover[child] = c[i, f, b]
                    value[child] = params.learning_rate * float(_ratio(s[i, f, b][None], h[i, f, b][None])[0])
                own = rows[node[rows] == at]
                node[own] = 2 * at + 1 + (bins[own, f] > b)
        margin += value[node]
    return prior, {k: v.ravel().tolist() for k, v in trees.items()}


def fit_boosting(patterns: DataFrame, params: BoostingParams, held_out: Sequence[int], group_patterns: int = GROUP_PATTERNS) -> DataFrame:
    """Written MODEL rows: one for each response and held-out fold; -1 leaves nothing out.

    A model whose training rows hold one class has the note 'one class' and nulls.
    """
    counts = materialise(part_counts(patterns, held_out), "counts")
    largest = counts.groupBy(*MODEL_KEY).count().agg(F.max("count")).first()[0] or 0
    edges = bin_edges(patterns)
    if largest > group_patterns:
        return _fit_shared(patterns, counts, params, held_out, edges)
    nodes = 2 ** (params.depth + 1) - 1

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"response": key[0], "held_out": key[1], "note": "", "prior": None, "nodes": nodes, **dict.fromkeys(("feature", "cut", "value", "cover", "gain"))}
        n, pos = (np.array(pdf[c].tolist(), float) for c in ("n", "pos"))
        if pos.sum() in (0, n.sum()):
            row["note"] = "one class"
        else:
            trains = n.any(axis=1)
            x = np.array(pdf["x"].tolist(), float)[trains]
            bins = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])])
            row["prior"], trees = _grow(bins, n[trains], pos[trains], edges, params)
            row |= trees
        return pd.DataFrame([row])

    # a number of partitions, as small ones would be joined although their work is long
    tasks = 4 * int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(counts.repartition(tasks, *MODEL_KEY).groupBy(*MODEL_KEY).applyInPandas(fit, MODEL), "boosted")


def _walk(x: Column, feature: Column, cut: Column, depth: int, start: Column | int = 0) -> Column:
    """Node that *x* reaches in the tree whose node 0 stands at *start*."""

    def down(i: Column, _: Column) -> Column:
        f = F.get(feature, start + i)
        return F.when(f < 0, i).otherwise(2 * i + 1 + F.when(F.get(x, f) > F.get(cut, start + i), 1).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)


def _fit_shared(patterns: DataFrame, counts: DataFrame, params: BoostingParams, held_out: Sequence[int], edges: list[list[float]]) -> DataFrame:
    """The same models in passes over all of them; only paths of written tables stay in the driver."""
    spark = patterns.sparkSession
    nodes = 2 ** (params.depth + 1) - 1
    cells = patterns.groupBy("response", "fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("pos"))
    models = cells.withColumn("held_out", F.explode(F.array(*[F.lit(int(h)) for h in held_out])))
    train = F.col("fold") != F.col("held_out")
    models = models.groupBy(*MODEL_KEY).agg(F.sum(F.when(train, F.col("n"))).alias("n"), F.sum(F.when(train, F.col("pos"))).alias("pos"))
    lone = F.coalesce((F.col("pos") == 0) | (F.col("pos") == F.col("n")), F.lit(True))
    models = models.select(*MODEL_KEY, F.when(lone, "one class").otherwise("").alias("note"), F.when(~lone, F.ln(F.col("pos") / (F.col("n") - F.col("pos")))).alias("prior"))
    models = materialise(models, "priors")
    cuts = F.array(*[F.array(*[F.lit(float(e)) for e in es]).cast("array<double>") for es in edges])
    binned = F.zip_with("x", cuts, lambda v, es: F.size(F.filter(es, lambda e: e < v)))
    trained = counts.where(F.exists("n", lambda n: n > 0)).select(*MODEL_KEY, binned.alias("x"), "n", "pos")
    state = trained.join(models.where("note = ''").drop("note"), MODEL_KEY).select(*MODEL_KEY, "x", "n", "pos", F.col("prior").alias("margin"))
    path = new_path(spark, "margins")
    state.write.parquet(path)
    grown = []
    none = F.sequence(F.lit(0), F.lit(nodes - 1))
    blank = models.where("note = ''").select(*MODEL_KEY, F.transform(none, lambda i: F.lit(-1)).alias("feature"), *[F.transform(none, lambda i: F.lit(0.0)).alias(k) for k in ("cut", "value", "cover", "gain")])
    for t in range(params.trees):
        state = spark.read.parquet(path)
        kept = [p for p in range(PARTS) if p not in left_out(t, params.subsample)]
        w, pos = (reduce(lambda a, b: a + b, [F.get(c, F.lit(p)) for p in kept]).cast("double") for c in ("n", "pos"))
        prob = 1 / (1 + F.exp(-F.col("margin")))
        seen = state.where(w > 0).select(*MODEL_KEY, "x", w.alias("w"), (pos - w * prob).alias("s"), (w * prob * (1 - prob)).alias("h"))
        tree = blank
        for level in range(params.depth):
            tree = materialise(_level(seen, tree, level, params), "tree")
        grown_path = new_path(spark, "grown")
        tree.withColumn("t", F.lit(t)).write.parquet(grown_path)
        grown.append(grown_path)
        last, path = path, new_path(spark, "margins")
        leaf = F.get("value", _walk(F.col("x"), F.col("feature"), F.col("cut"), params.depth))
        state.join(tree, MODEL_KEY).withColumn("margin", F.col("margin") + leaf).select(*state.columns).write.parquet(path)
        delete_path(spark, last)
    trees = spark.read.parquet(*grown) if grown else blank.withColumn("t", F.lit(0)).limit(0)
    names = ("feature", "cut", "value", "cover", "gain")
    # as many trees as configured
    flat = trees.groupBy(*MODEL_KEY).agg(F.array_sort(F.collect_list(F.struct("t", *names))).alias("all"))
    value = F.transform("feature", lambda f, i: F.when(f < 0, 0.0).otherwise(F.get(F.get(cuts, f), F.get("cut", i).cast("int"))))
    flat = flat.select(*MODEL_KEY, *[F.flatten(F.col(f"all.{k}")).alias(k) for k in names]).withColumn("cut", value)
    return materialise(models.join(flat, MODEL_KEY, "left").select(*MODEL_KEY, "note", "prior", F.lit(nodes).alias("nodes"), *names), "boosted")


def _level(seen: DataFrame, tree: DataFrame, level: int, params: BoostingParams) -> DataFrame:
    """*tree* with the splits of one level: its cuts are bins here."""
    first = 2**level - 1
    node = _walk(F.col("x"), F.col("feature"), F.col("cut"), params.depth)
    at = seen.join(tree.select(*MODEL_KEY, "feature", "cut"), MODEL_KEY).withColumn("node", node).where(F.col("node") >= first)
    key = [*MODEL_KEY, "node", "pos"]
    sums = at.select(*MODEL_KEY, "node", F.posexplode("x").alias("pos", "bin"), "w", "s", "h").groupBy(*key, "bin").agg(*[F.sum(c).alias(c) for c in "wsh"])
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    cut = sums.select(*key, "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "wsh"], *[F.sum(c).over(whole).alias(c) for c in "wsh"])
    cut = cut.withColumns({f"{c}r": F.col(c) - F.col(f"{c}l") for c in "wsh"})
    able = (F.col("wl") >= params.min_leaf) & (F.col("wr") >= params.min_leaf) & (F.col("w") >= params.min_split)
    gain = F.when(able, F.round(F.col("sl") ** 2 / F.col("wl") + F.col("sr") ** 2 / F.col("wr") - F.col("s") ** 2 / F.col("w"), DIGITS))
    gain = F.when(gain > LEAST_GAIN, gain)
    # the largest gain, then the lower feature, then the lower cut; the sums of a node come along
    best = F.max(F.struct(F.coalesce(gain, F.lit(-1.0)).alias("gain"), (-F.col("pos")).alias("pos"), (-F.col("bin")).alias("bin"), *[f"{c}{e}" for c in "wsh" for e in "lr"], "w", "s", "h")).alias("b")
    found = cut.groupBy(*MODEL_KEY, "node").agg(best)
    splits = found.groupBy(*MODEL_KEY).agg(F.map_from_entries(F.collect_list(F.struct("node", "b"))).alias("splits"))

    def newton(s: Column, h: Column) -> Column:
        return params.learning_rate * F.when(h > 1e-150, s / h).otherwise(0.0)

    def told(name: str, split, root) -> Column:
        """Array *name* with what the splits say of their own node and of their children."""

        def of(old: Column, i: Column) -> Column:
            own = F.element_at("splits", i)
            parent = F.element_at("splits", ((i - 1) / 2).cast("int"))
            child = parent["gain"] > 0
            out = F.when(own["gain"] > 0, split(own)).otherwise(old) if split else old
            if root:
                out = F.when((i > 0) & child, root(parent, i % 2 == 1)).otherwise(out)
                out = F.when((i == 0) & own.isNotNull(), root(own, None)).otherwise(out) if level == 0 else out
            return out

        return F.transform(name, of).alias(name)

    def side(s: Column, left: Column | None, c: str) -> Column:
        return s[c] if left is None else F.when(left, s[f"{c}l"]).otherwise(s[f"{c}r"])

    empty = F.coalesce("splits", F.create_map().cast(splits.schema["splits"].dataType))
    joined = tree.join(splits, MODEL_KEY, "left").withColumn("splits", empty)
    return joined.select(
        *MODEL_KEY,
        told("feature", lambda b: -b["pos"], None),
        told("cut", lambda b: (-b["bin"]).cast("double"), None),
        told("value", None, lambda b, left: newton(side(b, left, "s"), side(b, left, "h"))),
        told("cover", None, lambda b, left: side(b, left, "w")),
        told("gain", lambda b: b["gain"], None),
    )


def boosted_margin(x: Column, depth: int) -> Column:
    """Log-odds of *x* by the flat arrays of a model beside it; walks the nodes inside the JVM."""
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = F.col("feature"), F.col("cut"), F.col("value")
    starts = F.sequence(F.lit(0), F.size(feature) - 1, F.lit(nodes))

    def plus(total: Column, start: Column) -> Column:
        return total + F.get(value, start + _walk(x, feature, cut, depth, start))

    return F.when(F.size(feature) > 0, F.aggregate(starts, F.col("prior"), plus)).otherwise(F.col("prior"))


def deal(vectors: DataFrame, models: DataFrame, key: Sequence[str], rows: int = VECTORS) -> DataFrame:
    """Vectors in parts of about *rows*, each part behind a row with its ``model``, all else null.

    *models* has one row for each *key*; ``vectors(*key, x, ...)`` is read twice. Vectors without a model come too.
    """
    sizes = lookup(vectors.groupBy(*key).agg(F.count(F.lit(1)).alias("k")), "sizes")
    parts = F.ceil(F.col("k") / rows).cast("int")
    model = F.struct(*[c for c in models.columns if c not in key]).alias("model")
    others = [f for f in vectors.schema.fields if f.name not in key]
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in others]
    first = models.select(*key, model).join(sizes, list(key)).select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "model", *blank)
    rest = vectors.join(sizes, list(key)).select(*key, F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"), F.lit(None).cast(first.schema["model"].dataType).alias("model"), *[f.name for f in others])
    tasks = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.union(rest).repartition(tasks, *key, "part").sortWithinPartitions(*key, "part", F.col("model").isNull())


def walk_trees(x: np.ndarray, prior: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Log-odds of the rows of *x*: the trees are added one after the other, as in :func:`boosted_margin`."""
    margin, at, nodes = np.full(len(x), prior), np.arange(len(x)), 2 ** (depth + 1) - 1
    for f, c, v in zip(*(a.reshape(-1, nodes) for a in (feature, cut, value)), strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            own = f[node]
            node = np.where(own < 0, node, 2 * node + 1 + (x[at, own] > c[node]))
        margin += v[node]
    return margin


def predict_boosting(rows: DataFrame, models: DataFrame, depth: int, split: str | None) -> DataFrame:
    """Add ``prob`` to ``rows(response, x)`` by the model that left the fold out, or by the whole-data model.

    Each distinct vector of a model is scored once; rows find their probability by vector.
    """
    fitted = models.where("note = ''").drop("note", "nodes", "cover", "gain")
    if split is None:
        key, fitted = ["response"], fitted.filter(F.col("held_out") == ALL_ROWS).drop("held_out")
    else:
        key, fitted = ["response", split], fitted.withColumnRenamed("held_out", split)
    # a missing value goes to the left and NaN to the right, whatever the cut
    x = F.transform("x", lambda v: F.when(v.isNull(), float("-inf")).when(F.isnan(v), float("inf")).otherwise(v))
    rows = rows.withColumn("_x", x)
    vectors = materialise(rows.select(*key, F.col("_x").alias("x")).distinct(), "vectors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model = None
        for pdf in batches:
            for at, group in pdf.groupby([*key, "part"], sort=False):
                if at != known:
                    known, model = at, None
                    if group["x"].iloc[0] is None:
                        first = group["model"].iloc[0]
                        model = [first["prior"], *(np.array(first[c]) for c in ("feature", "cut", "value"))]
                        group = group.iloc[1:]
                if model is None or not len(group):
                    continue
                yield group[[*key, "x"]].assign(margin=walk_trees(np.array(group["x"].tolist(), float), *model, depth))

    schema = T.StructType([*vectors.schema.fields, T.StructField("margin", T.DoubleType())])
    scored = deal(vectors, fitted, key).mapInPandas(run, schema)
    prob = 1 / (1 + F.exp(-F.col("margin")))
    scored = materialise(scored.select(*key, F.col("x").alias("_x"), prob.alias("prob")), "scored")
    return rows.join(scored, [*key, "_x"]).drop("_x")
