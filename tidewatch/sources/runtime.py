"""What every job needs from its session: shared scratch tables and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH = "/tmp/checkpoints"
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{_OWN_SCRATCH}/tidewatch"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, where: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)


def delete_folder(spark: SparkSession, where: str) -> None:
    p = _path(spark, where)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs only a re-read.

    Tables made here live as long as the DataFrames that read them are needed; `drop` removes
    those that later tables have replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._n += 1
        where = f"{self.root}/t{self._n}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            where = getattr(t, "_scratch_path", None)
            if where:
                delete_folder(self.spark, where)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "tidewatch_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
