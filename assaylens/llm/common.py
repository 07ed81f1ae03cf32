"""What the corpus operators share: reading, written intermediates, global numbering, components."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.session import materialise, materialise_counted, new_path, ship_package

#: Rows of an Arrow batch handed to Python; texts of a batch are cut further by their size.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """*name*, with underscores before it until no column of *df* has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order: list[Column], tag: str, measures: dict[str, Column]) -> DataFrame:
    """Running totals of *measures* before each row, over the whole table in *order*.

    Rows are dealt by range of *order*, which should be unique so that no key makes a range that
    can't be split. Each range is summed, the totals of earlier ranges are added to the running sum
    inside it. Returns the columns of *df* and ``<measure>_before`` for each measure.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = df
    for i, column in enumerate(order):
        named = named.withColumn(f"_order{i}", column)
    keys = [f"_order{i}" for i in range(len(order))]
    for name, value in measures.items():
        named = named.withColumn(f"_add_{name}", value)
    ranged = materialise(named.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), tag)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_add_{m}").alias(f"_sum_{m}") for m in measures])
    # one row for each range: as many as partitions, whatever the input
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_start_{m}") for m in measures])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range")
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_start_{m}") + F.coalesce(F.sum(f"_add_{m}").over(inside), F.lit(0)))
    drop = ["_range", *keys, *[f"_start_{m}" for m in measures], *[f"_add_{m}" for m in measures]]
    return out.drop(*drop)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``; nodes without an edge are absent.

    Alternates two star contractions: every node hands its larger neighbours to its smallest one,
    then its smaller ones. The rows never outgrow the edges, no node gathers a list, and the edges
    are written after each round. Ends when a round changes nothing. Returns (node, component).
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, rows = materialise_counted(both.distinct(), tag)
    if not rows:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: neighbours above u go to the smallest neighbour of u, or u
        around = now.union(now.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after, rows = materialise_counted(small.where("u <> v").distinct(), tag)
        # equal when both hold the same edges: stars whose centres have no smaller neighbour
        if not after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1):
            if after.groupBy("u").count().where("count > 1").take(1) == []:
                return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = after


ROUND_TASKS = 48  # meetings of a round; more only if there are more shards
GROUP_BYTES, ROUND_BYTES = 32_000_000, 64_000_000  # of the blocks of a group and of a round, unless one block is larger
MEETING_BYTES = 4_000_000  # of an Arrow batch of shards, so that they come one by one


def meetings(
    index: DataFrame,
    shards: int,
    blocks: DataFrame,
    n_blocks: int,
    answer: Callable[[dict, Iterator[dict]], Iterator[pa.RecordBatch]],
    schema: str,
    best: Callable[[DataFrame], DataFrame],
    together: int = 8,
) -> DataFrame:
    """``best`` of ``answer(row of index, its blocks)`` for every shard and up to *together* blocks at a time.

    *index* is a written table with a row for each of *shards* shards; *blocks* is a written table of
    *n_blocks* query blocks. All shards meet a group of blocks in one round, so *best* gets whatever was
    found for its queries. The blocks of a round are broadcast, and the shards stream past them where
    they are read: no row is copied for those it meets, neither in memory nor in a shuffle. A task holds
    one shard and the blocks of a round. The outcome of a round is written, and its blocks and shuffle are
    let go before the next.
    """
    spark = index.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MEETING_BYTES))
    if not shards or not n_blocks:
        return best(spark.createDataFrame([], schema))
    groups, sizes = _groups(blocks, together)
    each, rounds = max(1, ROUND_TASKS // shards), [(0, 1)]
    for g in range(1, len(groups)):
        first, last = rounds[-1]
        if last - first < each and sum(sizes[first : g + 1]) <= ROUND_BYTES:
            rounds[-1] = (first, g + 1)
        else:
            rounds.append((g, g + 1))
    if len(rounds) == 1:
        return best(_round(index, shards, blocks, groups, rounds[0], answer, schema)[0])
    path = new_path(spark, "met")
    for some in rounds:
        release(spark)
        found, sent = _round(index, shards, blocks, groups, some, answer, schema)
        found = best(found)
        found.write.mode("append").parquet(path)
        sent.destroy()
        kept = found.schema
        del found
    release(spark)
    return spark.read.schema(kept).parquet(path)


def _groups(blocks: DataFrame, together: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Least and largest hash of the blocks of each group, by hash, and the bytes of each group."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in blocks.dtypes if kind == "binary"), F.lit(0).cast("long"))
    groups, sizes, n = [], [], together
    for key, held in sorted(blocks.select(F.xxhash64(*blocks.columns), size).collect()):
        if groups and (key == groups[-1][1] or n < together and sizes[-1] + held <= GROUP_BYTES):
            groups[-1], sizes[-1], n = (groups[-1][0], key), sizes[-1] + held, n + 1
        else:
            groups, sizes, n = [*groups, (key, key)], [*sizes, held], 1
    return groups, sizes


def _round(index: DataFrame, shards: int, blocks: DataFrame, groups: list[tuple[int, int]], some: tuple[int, int], answer, schema: str) -> tuple[DataFrame, Broadcast]:
    """Answers of all shards to the blocks of the groups from the first of *some* to before the second, and what was broadcast for them."""
    spark, (first, end) = index.sparkSession, some
    key = F.xxhash64(*blocks.columns)
    asked: list[list[dict]] = [[] for _ in range(first, end)]
    starts = [least for least, _ in groups[first:end]]
    for batch in blocks.where(key.between(groups[first][0], groups[end - 1][1])).select(key.alias("key"), F.struct(*blocks.columns).alias("asked")).toArrow().to_batches():
        for place, block in zip(batch.column("key").to_pylist(), batch.column("asked"), strict=True):
            asked[bisect_right(starts, place) - 1].append(_plain(block))
    sent = spark.sparkContext.broadcast(asked)
    # a task for each part of the index and group: the parts are read again for each group, not dealt
    grp = spark.range(0, end - first, 1, end - first).select(F.col("id").cast("int").alias("grp"))
    met = index.select(F.struct(*index.columns).alias("held")).hint("shuffle_replicate_nl").crossJoin(grp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, grp in zip(batch.column("held"), batch.column("grp").to_pylist(), strict=True):
                yield from answer(_plain(held), iter(sent.value[grp]))

    return met.mapInArrow(run, schema), sent


def _plain(row: pa.StructScalar) -> dict:
    """Values of a row; arrays stay numpy arrays."""
    return {k: v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for k, v in row.items()}


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver's JVM collects its garbage; after a large shuffle whose outcome
    has been written this is worth a call. The first collection lets go of the plans, the second of
    what only they referred to.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
