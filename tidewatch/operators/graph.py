"""Edges between incidents: repair, induced subgraph, neighbours, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import or_else


def with_defaults(edges: DataFrame) -> DataFrame:
    """Missing relation, description and confidence filled; a confidence of 0 counts as missing."""
    return edges.withColumns({
        "relation_type": or_else(F.col("relation_type"), "related_cause"), "description": F.coalesce("description", F.lit("")),
        "confidence": F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.9)),
    })


def repaired_ids(edges: DataFrame, id_col: str = "edge_id", order: str = "seq") -> DataFrame:
    """Missing ids, and those seen before, become EDGE-R and the row's own order number, which is unique."""
    w = Window.partitionBy(id_col).orderBy(order)
    seen = F.when(F.col(id_col).isNull(), 2).otherwise(F.row_number().over(w))
    return edges.withColumn("fixed_id", F.when(seen == 1, F.col(id_col)).otherwise(F.concat(F.lit("EDGE-R"), F.col(order).cast("string"))))


def induced(edges: DataFrame, nodes: DataFrame, src: str = "source_key", dst: str = "target_key", key: str = "key") -> DataFrame:
    """Edges both of whose ends are among nodes."""
    ids = nodes.select(F.col(key).alias("k")).distinct()
    return edges.join(ids, F.col(src) == F.col("k"), "left_semi").join(ids, F.col(dst) == F.col("k"), "left_semi")


def neighbours(edges: DataFrame, src: str = "source_key", dst: str = "target_key") -> DataFrame:
    """(node, other, relation_type) in both directions."""
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), "relation_type").unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other"), "relation_type"))


def degrees(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("others"))


def contracted(df: DataFrame, by: str) -> DataFrame:
    """One node for each value: members and size 25 + min(3n, 25)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(25) + F.least(3 * F.col("n"), F.lit(25)))


def contracted_edges(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """Edges between values instead of nodes, with how many there are."""
    a, b = (nodes.select(F.col("key").alias(k), F.col(by).alias(v)) for k, v in (("source_key", "source"), ("target_key", "target")))
    return edges.join(a, "source_key").join(b, "target_key").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
