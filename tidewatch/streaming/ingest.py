"""Incremental ingestion: new files of events counted by day with late ones merged in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.sync import funnel
from tidewatch.sources.tables import KeyedTable


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_funnel(events: DataFrame, late: str = "5 days") -> DataFrame:
    """Counts by day of a stream, final once the watermark has passed: events may be that late."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    kind = F.col("event_type")
    counts = stamped.groupBy(F.window("at", "1 day")).agg(F.count_if(kind == "view").alias("rss"), F.count_if(kind == "click").alias("gdelt"), F.count(F.lit(1)).alias("total"), F.count_if(kind == "purchase").alias("passed"))
    return counts.select(F.col("window.start").cast("date").alias("day"), "rss", "gdelt", "total", "passed")


def run_available(events: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what is there and stop: each batch's counts are added to the table of its own batch number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        funnel(batch.withColumn("day", F.col("ts").cast("date")), "day").write.mode("overwrite").parquet(f"{target}/batch={number}")

    events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()


def merged(spark: SparkSession, target: str) -> DataFrame:
    """The daily counts over all batches."""
    return spark.read.parquet(target).groupBy("day").agg(*(F.sum(c).alias(c) for c in ("rss", "gdelt", "total", "passed")))


def once(events: DataFrame, key: str, at: str = "ts", late: str = "5 days") -> DataFrame:
    """A stream without events whose key has come within the time that events may be late; the state holds that time's keys only."""
    stamped = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return stamped.dropDuplicatesWithinWatermark([key]).drop("at")


def keep_latest(events: DataFrame, table: KeyedTable, target: str, checkpoint: str, after: Callable[[int], None] | None = None) -> None:
    """Take in what is there: the last event of each key goes into the table, and each batch's counts into the part of its number.

    The table keeps the row of greater order and a batch's part replaces itself, so a batch that was cut off and is repeated, whole or in part, changes nothing. after is called with the
    number of each batch written.
    """

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch)
        funnel(batch.withColumn("day", F.col("ts").cast("date")), "day").write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after is not None:
            after(number)

    events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
