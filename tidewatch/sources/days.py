"""Records in partitions by day, read by window and within a ceiling of bytes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_days(df: DataFrame, path: str, day: str) -> None:
    """df in a folder for each day; days that df has replace those that stand there, other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(day).parquet(path)


def _days(spark: SparkSession, path: str) -> dict[date, int]:
    """The stored days and the bytes of each, from the folders alone: one entry for each day."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    found = {}
    for s in fs.listStatus(where):
        name, _, value = s.getPath().getName().partition("=")
        if s.isDirectory() and value and not value.startswith("__HIVE"):
            found[date.fromisoformat(value)] = fs.getContentSummary(s.getPath()).getLength()
    return found


def latest_day(spark: SparkSession, path: str) -> date | None:
    return max(_days(spark, path), default=None)


def read_days(spark: SparkSession, path: str, schema: StructType, day: str, first: date, last: date, most_bytes: int) -> DataFrame:
    """The records from first to last, both included; only those days' folders are read. Raises before anything runs if they hold more than most_bytes."""
    size = sum(n for d, n in _days(spark, path).items() if first <= d <= last)
    if size > most_bytes:
        raise ValueError(f"the window holds {size} bytes, more than {most_bytes}")
    return spark.read.schema(schema).parquet(path).filter(F.col(day).between(F.lit(first), F.lit(last)))
