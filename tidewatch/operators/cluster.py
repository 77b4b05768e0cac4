"""Consolidation of duplicate records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import normalize_url
from tidewatch.operators.components import connected_components


def membership(records: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """records with cluster: the smallest id that links reach."""
    found = connected_components(edges)
    return records.join(found, F.col(id_col) == F.col("node"), "left").withColumn("cluster", F.coalesce("component", F.col(id_col))).drop("node", "component")


def consolidate(members: DataFrame, id_col: str, usd: str, summary: str, urls: str, parties: str) -> DataFrame:
    """One row for each cluster: largest damage, longest summary (the first of equals), URLs distinct by normal form in order, parties sorted."""
    base = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.max(usd).alias("usd"),
        F.max_by(F.col(summary), F.struct(F.length(F.coalesce(summary, F.lit(""))).alias("n"), (-F.col(id_col)).alias("first"))).alias("summary"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(parties)))).alias("parties"),
    )
    each = members.select("cluster", id_col, F.posexplode(urls).alias("pos", "url")).withColumn("norm", normalize_url(F.col("url")))
    first = each.groupBy("cluster", "norm").agg(F.min(F.struct(F.col(id_col), F.col("pos"), F.col("url"))).alias("f"))
    joined = first.groupBy("cluster").agg(F.sort_array(F.collect_list("f")).alias("fs")).select("cluster", F.col("fs.url").alias("urls"))
    return base.join(joined, "cluster", "left")


def fuzzy_merge(members: DataFrame, cluster: str, order: str) -> DataFrame:
    """Earliest date, largest damage, first text that isn't empty, all URLs of all members, each where it appears first."""
    some = F.nullif("full_text", F.lit(""))
    base = members.groupBy(cluster).agg(F.min("date").alias("date"), F.max("financial_damage_usd").alias("usd"), F.min_by(some, F.when(some.isNotNull(), F.col(order))).alias("text"))
    each = members.select(cluster, order, F.posexplode("source_urls").alias("pos", "url")).groupBy(cluster, "url").agg(F.min(F.struct(order, "pos")).alias("at"))
    urls = each.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("at", "url"))).alias("u")).select(cluster, F.col("u.url").alias("urls"))
    return base.join(urls, cluster, "left")
