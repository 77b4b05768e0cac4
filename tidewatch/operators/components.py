"""Connected components by label propagation with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.sources.runtime import Scratch
from tidewatch.sources.tables import HashedTable


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an undirected edge list; component is the smallest node reachable.

    A round takes the least label among a node's neighbours, hangs the node's former label below it
    as well, and lets every label jump to its own label, so long chains shorten geometrically. Labels
    only fall, so an unchanged sum ends the loop. Self loops and repeated edges do no harm; edges with a
    null end are ignored. Each round's labels are written out, which ends lineage there; what a round needs twice is kept on the executors
    meanwhile. Nothing but the sum reaches the driver.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u is not null and v is not null")
    both = scratch.table(pairs.union(pairs.select("v", "u")))
    labels = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label"))

    def total(t: DataFrame):
        return t.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]

    now = total(labels)
    while now is not None:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("least")).persist()
        hooks = labels.join(near, labels["node"] == near["u"]).select(F.col("label").alias("node"), F.col("least").alias("label"))
        fallen = labels.unionByName(near.select(F.col("u").alias("node"), F.col("least").alias("label"))).unionByName(hooks).groupBy("node").agg(F.min("label").alias("label")).persist()
        up = fallen.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = scratch.table(fallen.join(up, "label").select("node", F.col("upper").alias("label")))
        near.unpersist()
        fallen.unpersist()
        scratch.drop(labels)
        labels, before = jumped, now
        now = total(labels)
        if now == before:
            break
    scratch.drop(both)
    return labels.withColumnRenamed("label", "component")


class ComponentStore:
    """Labels of all nodes seen so far, kept in a table by component. A batch of edges is merged without reading earlier edges.

    Only the components that the batch's edges meet are labelled anew, and only the partitions that hold or get them are rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.labels = HashedTable(spark, path, StructType.fromDDL("node bigint, component bigint"), "component", buckets)

    def read(self) -> DataFrame:
        """(node, component), as connected_components gives it for all edges so far."""
        return self.labels.read()

    def merge(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> list[int]:
        """Take in a batch of edges; returns the partitions rewritten. A batch taken in twice changes nothing more. Edges with a null end are ignored."""
        scratch = Scratch(self.spark, "merge")
        pairs = scratch.table(edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u is not null and v is not null").distinct())
        ends = pairs.select("u").union(pairs.select("v")).distinct()
        now = scratch.table(ends.join(self.read().withColumnRenamed("node", "u"), "u", "left"))  # component is null for new nodes
        of = lambda c: now.select(F.col("u").alias(c), F.coalesce("component", "u").alias(f"c{c}"))
        met = pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("src"), F.col("cv").alias("dst")).distinct()
        moves = scratch.table(connected_components(met).select(F.col("node").alias("old"), F.col("component").alias("new")))
        fresh = now.filter("component is null").select(F.col("u").alias("node")).join(moves, F.col("node") == F.col("old")).select("node", F.col("new").alias("component"))
        moved = moves.join(now.filter("component is not null").select(F.col("component").alias("old")).distinct(), "old").filter("old <> new")
        moved = scratch.table(moved)
        buckets = self.labels.touched(moved.select("old").union(moved.select("new")).union(fresh.select("component")))
        kept = self.labels.read(buckets).join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        self.labels.rewrite(buckets, kept.unionByName(fresh))
        scratch.drop(pairs, now, moves, moved)
        return buckets
