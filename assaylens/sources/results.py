"""Result tables: writing, lookup and reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.session import materialise
from assaylens.sources.matrices import path_exists

TABLES = ("oof", "fold_metrics", "models", "boosted")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None, compression: str | None = None) -> str:
    """Write a result as parquet or CSV; *partition* replaces one file per response."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def read_csv_result(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV result under *schema*, and the lines that don't fit it as ``line``.

    A line with too few or too many fields, or with a field of another type, is set aside whole.
    """
    read = spark.read.schema(f"{schema}, _line string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    table = materialise(read.csv(path), "csv-result")
    return table.filter("_line IS NULL").drop("_line"), table.filter("_line IS NOT NULL").select(F.col("_line").alias("line"))


def write_lines(report: DataFrame, order: str | list[str], path: str) -> str:
    """Write report lines as text, in order."""
    report.orderBy(order).select("line").write.mode("overwrite").text(path)
    return path


def write_results(folder: str, **tables: DataFrame) -> str:
    """Persist the result tables of a run below one folder."""
    for name, table in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown result table {name}; known: {', '.join(TABLES)}")
        write_table(table, f"{folder}/{name}")
    return folder


def read_results(spark: SparkSession, folder: str, name: str = "oof") -> DataFrame:
    """Reload a result table; says what is missing, and whether only a CSV summary is there."""
    path = f"{folder}/{name}"
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if path_exists(spark, f"{folder}/model_comparison"):
        raise FileNotFoundError(f"{path} is missing; {folder} has a comparison summary only, run the screen again")
    raise FileNotFoundError(f"no results in {folder}; run the screen first")
