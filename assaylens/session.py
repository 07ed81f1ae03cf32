"""Session helpers: the shared folder, written intermediate tables, small dimensions."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DIMENSION_BYTES = 8_000_000
LOOKUP_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a new temporary folder as its
    checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="assaylens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/assaylens/{app}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    Cuts the lineage at a point that survives lost executors; the file sizes also give the
    optimizer real statistics for the joins that follow.
    """
    return materialise_counted(df, tag)[0]


def materialise_counted(df: DataFrame, tag: str, file_rows: int = 0) -> tuple[DataFrame, int]:
    """The written table and its row count, observed while it is written; at most *file_rows* rows in a file, unless 0."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def materialise_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The written table and its path, for :func:`delete_path` once nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def lookup(df: DataFrame, tag: str, partner_rows: int | None = None) -> DataFrame:
    """The small side of a join with a large table, written so that its size is known.

    A small aggregate looks large to the optimizer before it has run; the join would then
    shuffle its large partner by a key as coarse as the response. Once written, its file size
    decides. For a partner of few rows the write is left out.
    """
    if partner_rows is not None and partner_rows <= LOOKUP_ROWS:
        return df
    return materialise(df, tag)


def drop_materialised(spark: SparkSession) -> None:
    """Delete everything this application has materialised."""
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/assaylens/{app}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table made of *rows*, broadcast up to ``DIMENSION_BYTES`` of their values as text.

    Above that there is no hint, and the join is planned by size as any other.
    """
    table = spark.createDataFrame(list(rows), schema)
    size = 0
    for row in rows:
        size += sum(len(repr(value)) for value in row)
        if size > DIMENSION_BYTES:
            return table
    return F.broadcast(table)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="assaylens-ship-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
