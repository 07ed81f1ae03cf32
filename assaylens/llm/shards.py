"""Contiguous shards of near-equal bytes by global prefix sums, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.llm.common import numbered
from assaylens.session import materialise


def assign(rows: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and place of every one of ``rows(_row, doc_id, text)``.

    Rows stand in the order of the digest of their text, then doc_id (null first), then the row of
    the table, so that equal texts lie together and are parted only where a cut falls among them.
    Sizes (UTF-8 bytes and 1; null has no bytes) are summed by partition, then before each row. The
    cuts are at equal shares of the total: a row goes where the middle of its bytes lies, so a shard
    is off its share by less than one row at either end. Returns ``doc_id, size, text_crc32, law,
    shard, slot, grown_shard``; slots count from 0 without gaps in each shard. A row larger than a
    share may leave shards empty. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    sized = rows.select(
        "_row",
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("_digest"),
    )
    order = [F.col("_digest"), F.col("doc_id"), F.col("_row")]
    placed = numbered(sized, order, "sized", {"bytes": F.col("size"), "rows": F.lit(1).cast("long")})
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "bytes_before", "rows_before"), "prefix")
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = F.col("bytes_before") * 2 + F.col("size")
    at = (middle.cast("decimal(38,0)") * shards / F.lit(2 * total)).cast("int")
    cut = placed.withColumn("shard", F.least(at, F.lit(shards - 1)))
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
