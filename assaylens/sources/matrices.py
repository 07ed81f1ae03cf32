"""Matrix readers: wide CSV or parquet in, long or merged tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, path: str, schema: str, splits: int | None = None) -> DataFrame:
    """Read a CSV, plain or compressed, by an explicit schema; bad numbers become NULL.

    A gzip file cannot be split, so *splits* spreads its rows after the read.
    """
    table = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return table.repartition(splits) if splits else table


def read_matrix(
    spark: SparkSession, path: str | None, schema: str, default: DataFrame | None = None, splits: int | None = None
) -> DataFrame:
    """Read a wide matrix; a missing path falls back to *default*, or raises without one."""
    if path is not None and path_exists(spark, path):
        return read_csv(spark, path, schema, splits)
    if default is not None:
        return default
    raise AnalysisException(f"no matrix at {path} and no default given")


def to_long(wide: DataFrame, name: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Unpivot a wide matrix; missing cells stay as NULL rows."""
    columns = [c for c in wide.columns if c != "entity_id"] if columns is None else list(columns)
    return wide.unpivot("entity_id", columns, name, value)


def to_wide(long: DataFrame, name: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Pivot a long table to one column for each listed name."""
    return long.groupBy("entity_id").pivot(name, list(columns)).agg(F.first(value))


def strip_suffix(long: DataFrame, column: str, suffix: str) -> DataFrame:
    """Drop a name suffix such as ``_mut``."""
    return long.withColumn(column, F.regexp_replace(column, f"{suffix}$", ""))


def response_key(long: DataFrame, out: str = "response_id") -> DataFrame:
    """Parse the number out of response names such as ``Drug_1017_IC50``."""
    return long.withColumn(out, F.regexp_extract("response", r"^Drug_(\d+)_IC50$", 1).try_cast("int"))


def to_flag(column: str):
    """Dirty text or number as a bigint: unusable text is 0, fractions are cut toward zero.

    Only plain numbers are usable, not what Java would also read (``1d``, ``7F``, ``NaN``); a
    number beyond 64 bits is 0.
    """
    text = F.col(column).cast("string")
    plain = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    number = F.when(plain, F.trim(text).try_cast("double"))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def merge_matrices(left: DataFrame, right: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Inner-join the matrices on the entity; colliding columns get ``_mut`` or ``_meta``."""

    def suffixed(table: DataFrame, taken: Sequence[str], suffix: str) -> DataFrame:
        clash = [c for c in table.columns if c != "entity_id" and c in taken]
        return table.withColumnsRenamed({c: c + suffix for c in clash})

    merged = left.join(suffixed(right, left.columns, "_mut"), "entity_id")
    if context is None:
        return merged
    return merged.join(suffixed(context, merged.columns, "_meta"), "entity_id")


def require_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entities in both tables; raises ValueError when there are none."""
    shared = left.select("entity_id").join(right.select("entity_id"), "entity_id", "left_semi").distinct()
    if shared.isEmpty():
        raise ValueError("the two tables share no entity")
    return shared
