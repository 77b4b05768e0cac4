"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Documents are followed by doc_id. Rows without one can't be told apart: they are kept and taken once.
Rows that share a doc_id and a text are one document from exact dedup on; rows that share a doc_id alone stay
or go together. Empty tables give empty results. Further columns of any name go through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.exact_dedup import exact_dedup, normalised
from tidewatch.llm.mixing import mix
from tidewatch.llm.near_dedup import near_dedup
from tidewatch.llm.pieces import encode
from tidewatch.llm.queries import learned_labels
from tidewatch.llm.sieve import sieve
from tidewatch.llm.toxicity import toxicity
from tidewatch.sources.runtime import Scratch, table

#: Near copies of the stage: a similarity of 0.8 or more; a pair at 0.8 is missed by all bands with probability 1.2e-6.
NEAR_PERCENT, NEAR_ROWS, NEAR_BANDS = 80, 7, 58


def _fresh() -> str:
    """A column name that no table has."""
    return f"pipeline_{uuid.uuid4().hex}"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids (one column), and those without one. Only rows that a bounded filter lets pass are shuffled with their texts."""
    key = _fresh()
    gone = Scratch(docs.sparkSession, "gone").table(ids.toDF(key).filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key)).distinct())
    maybe = F.coalesce(sieve(gone, key)(F.col("doc_id").cast("bigint")), F.lit(False))
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, F.col("doc_id") == F.col(key), "left_anti"))


def _dropped(found: DataFrame) -> DataFrame:
    """Ids of which no row is kept."""
    return found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Rows without an id stay."""
    found = toxicity(docs, learned_labels(table(spark, sf_dir, "labels")))
    return _without(docs, found.filter("predicted = 1").select("id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    kept = _without(docs, _dropped(exact_dedup(docs)))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return kept
    # Rows that repeat a doc_id and its text can't be parted by their ids.
    key = _fresh()
    one = kept.filter("doc_id is not null").withColumn(key, F.sha2(normalised(F.coalesce("text", F.lit(""))), 256)).dropDuplicates(["doc_id", key]).drop(key)
    return one.unionByName(kept.filter("doc_id is null"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return _without(docs, _dropped(near_dedup(docs, percent=NEAR_PERCENT, rows=NEAR_ROWS, bands=NEAR_BANDS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; those taken no times go."""
    taken, key = _fresh(), _fresh()
    copies = mix(docs).filter("copies > 0 and id is not null").groupBy("id").agg(F.max("copies").cast("int").alias("copies")).toDF(key, taken)
    rows = docs.join(copies, F.col("doc_id") == F.col(key), "left").withColumn(taken, F.when(F.col("doc_id").isNull(), 1).otherwise(F.coalesce(taken, F.lit(0))))
    return rows.filter(F.col(taken) > 0).withColumn(taken, F.explode(F.sequence(F.lit(1), taken))).drop(key, taken)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with sampled segmentations."""
    return encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: No stage's model or sampling can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
