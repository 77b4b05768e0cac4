"""Parquet tables in partitions by the hash of a column, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidewatch.operators.sync import upsert
from tidewatch.sources.runtime import Scratch, delete_folder

BUCKETS = 64


class HashedTable:
    """A table partitioned by the hash of one column; the number of partitions is fixed when it is made, and one writer at a time may change it.

    A change is worked out in full before any file goes, so a lost task or a repeated call leaves the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, column: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.column, self.n = spark, path.rstrip("/"), schema, column, buckets

    def bucket(self, column: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.column) if column is None else column), F.lit(self.n)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all partitions, or of some, which are the only ones listed and read."""
        if not self._there():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(self.path)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def _there(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def touched(self, values: DataFrame) -> list[int]:
        """The partitions that values (one column) fall in: at most as many numbers as the table has partitions."""
        return sorted(r[0] for r in values.select(self.bucket(F.col(values.columns[0])).alias("b")).distinct().collect())

    def rewrite(self, buckets: list[int], rows: DataFrame) -> None:
        """rows, all of which belong in these partitions, in their place."""
        if not buckets:
            return
        scratch = Scratch(self.spark, "rewrite")
        staged = scratch.table(rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket"))
        held = {r[0] for r in staged.select("bucket").distinct().collect()}
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.path)
        for b in set(buckets) - held:  # an overwrite leaves partitions that have lost all rows
            delete_folder(self.spark, f"{self.path}/bucket={b}")
        scratch.drop(staged)


class KeyedTable(HashedTable):
    """One row for each key. With an order column, of two rows of a key the one of greater order stays, whichever came first."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS, order: str | None = None):
        super().__init__(spark, path, schema, key, buckets)
        self.order = order

    def _one_each(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.column]
        best = rows.groupBy(self.column).agg(F.max_by(F.struct(*rest), F.struct(self.order, F.xxhash64(*rest))).alias("r"))
        return best.select(self.column, *(F.col(f"r.{c}").alias(c) for c in rest))

    def upsert(self, source: DataFrame) -> list[int]:
        """source's rows in place of those of equal keys; returns the partitions rewritten. An empty source changes nothing. Without an order column a key may stand in source once."""
        source = source.select(*self.schema.names)
        if self.order is None and not source.groupBy(self.column).count().filter("count > 1").isEmpty():
            raise ValueError("a key stands in the source more than once")
        buckets = self.touched(source.select(self.column))
        old = self.read(buckets)
        self.rewrite(buckets, self._one_each(old.unionByName(source)) if self.order else upsert(old, source, self.column))
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows without those of the given keys (one column); returns the partitions rewritten."""
        keys = keys.toDF(self.column)
        buckets = self.touched(keys)
        self.rewrite(buckets, self.read(buckets).join(keys.distinct(), self.column, "left_anti"))
        return buckets
