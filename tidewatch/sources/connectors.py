"""Readers and writers: feeds, JSON arrays, databases, and the sinks of results."""

from __future__ import annotations

import contextlib
import io
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.dates import feed_date
from tidewatch.functions.text import feed_title
from tidewatch.operators.sync import upsert


_ITEMS = "file string, position int, title string, link string, pubDate string, description string"


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """All items of RSS files with their file and their position in it, from 0. A file that breaks off gives the items before the break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                position = 0
                with contextlib.suppress(ElementTree.ParseError):
                    for _, item in ElementTree.iterparse(io.BytesIO(content)):
                        if item.tag == "item":
                            rows.append((file, position, *("".join(e.itertext()).strip() if (e := item.find(c)) is not None else None for c in ("title", "link", "pubDate", "description"))))
                            position += 1
                            item.clear()
            names = ["file", "position", "title", "link", "pubDate", "description"]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ITEMS)


def read_feed(spark: SparkSession, path: str, most: int = 12) -> DataFrame:
    """The first items of RSS files as articles, by file and then in the order of the document."""
    items = feed_items(spark, path).orderBy("file", "position").limit(most)
    return items.select(feed_title(F.col("title")).alias("title"), "link", F.col("pubDate").alias("pub_date"), feed_date(F.col("pubDate")).alias("pub_date_clean"), "description", F.lit("google_news_rss").alias("source_type"))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table, some columns of it, in parts by a numeric key if bounds (low, high, parts) are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2])
    df = reader.load()
    return df.select(*columns) if columns else df


def pooled(*harvests: DataFrame) -> DataFrame:
    """All harvests as one table; columns that some lack are null there."""
    out = harvests[0]
    for h in harvests[1:]:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def live_or_static(live: DataFrame, static: DataFrame) -> DataFrame:
    """The live table unless it is empty."""
    return static if live.isEmpty() else live


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_parquet(spark: SparkSession, path: str, source: DataFrame, key: str) -> str:
    """A new version of a Parquet table beside the old one, which readers may still use; returns its path."""
    if source.isEmpty():
        return path
    version = f"{path}_v{uuid.uuid4().hex}"
    upsert(spark.read.parquet(path), source, key).write.mode("overwrite").parquet(version)
    return version
