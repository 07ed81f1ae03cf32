"""Token counts through a cache keyed by digests of the text and of the tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.vocab import path
from assaylens.session import materialise, materialise_counted, new_path

SCHEMA = "version string, digest string, n_tokens long"
CHARS = 1_000_000


def version(name: str) -> str:
    """Digest of the tokenizer file: another file is another version."""
    with open(path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Null counts as empty. Nothing else is changed: a count belongs to exact content."""
    return F.coalesce(text, F.lit(""))


@lru_cache(maxsize=2)
def _counter(name: str):
    """Counts of a list of texts, without any special token added."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(name: str, stamp: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(name)
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            at, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= CHARS or i + 1 == len(texts):
                    counts += count(texts[at : i + 1])
                    at, size = i + 1, 0
            stamps = pa.array([stamp] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([stamps, batch.column("digest"), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])

    return run


def stored(spark, cache: str) -> DataFrame:
    """The cache table; empty where nothing has been stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(SCHEMA).parquet(cache)
    return spark.createDataFrame([], SCHEMA)


def counts(rows: DataFrame, name: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Tokens of every one of ``rows(_row, doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Texts meet the cache by (tokenizer version, content digest). Of what it lacks each distinct text
    is encoded once, whole, and appended; then every row reads its count from the cache. *cache* is
    a folder all executors share, kept between runs; without one a new folder is used. Null counts
    as empty and has 0 tokens; repeated rows share a count; an empty table gives no rows. Two runs
    that append the same texts at once leave equal rows twice, which the reader folds.
    """
    spark = rows.sparkSession
    cache = cache or new_path(spark, "token-counts")
    stamp = version(name)
    content = normalised(F.col("text"))
    narrow = rows.select("_row", "doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("digest"))
    table, n_rows = materialise_counted(narrow, "digests")
    hits = stored(spark, cache).where(F.col("version") == stamp).select("digest").distinct()
    first = table.groupBy("digest").agg(F.min("_row").alias("_row"))
    misses, n_misses = materialise_counted(first.join(hits, "digest", "left_anti"), "misses")
    if n_misses:
        # texts needn't move if the shorter of the two lists of rows is small
        if 2 * n_misses <= n_rows:
            wanted = rows.join(misses.select("_row"), "_row", "left_semi")
        else:
            wanted = rows.join(materialise(table.join(misses, "_row", "left_anti").select("_row"), "known"), "_row", "left_anti")
        texts = wanted.select(content.alias("text"), F.sha2(content, 256).alias("digest"))
        texts.mapInArrow(_encode(name, stamp), SCHEMA).write.mode("append").parquet(cache)
    known = stored(spark, cache).where(F.col("version") == stamp).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = table.join(known, "digest", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
