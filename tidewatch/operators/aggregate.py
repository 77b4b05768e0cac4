"""Counts, totals, roll-ups by region and clusters of event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import clean
from tidewatch.functions.text import url_slug
from tidewatch.operators.explore import is_macro


def totals() -> tuple[Column, Column]:
    """Discrete and macro damage, positive amounts only."""
    usd = F.col("financial_damage_usd")
    return (
        F.coalesce(F.sum(F.when(~is_macro() & (usd > 0), usd)), F.lit(0)).cast("long").alias("discrete_usd"),
        F.coalesce(F.sum(F.when(is_macro() & (usd > 0), usd)), F.lit(0)).cast("long").alias("macro_usd"),
    )


def top_value(df: DataFrame, column: str, order: Column) -> DataFrame:
    """The most frequent value; of equally frequent ones the first by order; N/A for an empty table."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.agg(F.max(F.struct("n")).alias("m"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("first"), F.col(column).alias("value"))).alias("b"))
    return best.select(F.coalesce("b.value", F.lit("N/A")).alias(f"top_{column}"))


def briefing(df: DataFrame) -> DataFrame:
    """One row: incidents, critical ones, damage, distinct parties, the top harm domain."""
    discrete, macro = totals()
    base = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), discrete, macro)
    parties = df.select(F.explode("affected_parties").alias("p")).agg(F.count_distinct("p").alias("parties"))
    order = F.struct((-F.coalesce("financial_damage_usd", F.lit(0))).alias("a"), F.col("incident_id"))
    return base.crossJoin(parties).crossJoin(top_value(df, "harm_domain", order))  # three tables of one row


def counts_by(df: DataFrame, *dimensions: str) -> DataFrame:
    """Counts for each dimension on its own, in one pass."""
    sets = df.groupingSets([[F.col(d)] for d in dimensions], *map(F.col, dimensions)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(dimensions)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        at = F.col("g") == (full & ~(1 << (len(dimensions) - 1 - i)))
        name, value = F.when(at, d).otherwise(name), F.when(at, F.col(d)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def by_region(df: DataFrame, gazetteer: DataFrame, canonical: bool = False) -> DataFrame:
    """Incidents, critical ones and damage by listed region; by key as tagged, or by the place that keys stand for."""
    keys = df.select(F.explode(F.array_distinct(F.transform(clean(F.col("geographic_scope")), lambda s: F.lower(s)))).alias("region_key"), "severity", "financial_damage_usd", "incident_id")
    joined = keys.join(F.broadcast(gazetteer), "region_key")  # 22 rows
    by = ["region_name"] if canonical else ["region_key", "region_name"]
    n = F.count_distinct("incident_id") if canonical else F.count(F.lit(1))
    return joined.groupBy(*by).agg(n.alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum(F.coalesce("financial_damage_usd", F.lit(0))).cast("long").alias("usd"))


def in_region(key: str, name: str) -> Column:
    """Whether a scope names the region by its key or by its place."""
    return F.exists(clean(F.col("geographic_scope")), lambda s: F.lower(s).isin(key.lower(), name.lower()))


def bounded(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def news_clusters(records: DataFrame, keywords: dict[str, list[str]], since: Column | None, tone_below: float = -1.0, size: int = 15, url_only: bool = False) -> DataFrame:
    """Event records about the subjects, clustered by the last segment of their URLs: the clusters of most reports.

    A record needs an entity in its URL (or organisations) and an incident word in its URL (or themes),
    no excluded word, and a tone below the bound. Ties in reports go to the later, then by slug.
    """
    url = F.lower("DocumentIdentifier")
    orgs, themes = F.lower(F.coalesce("V2Organizations", F.lit(""))), F.lower(F.coalesce("V2Themes", F.lit("")))
    about, what = url.rlike(bounded(keywords["url_entities"])), url.rlike(bounded(keywords["incident_keywords"]))
    if not url_only:
        about, what = about | orgs.rlike(bounded(keywords["organizations"])), what | themes.rlike(bounded(keywords["gdelt_themes"]))
    tone = F.split("V2Tone", ",")[0].try_cast("double")
    kept = records.filter(since) if since is not None else records
    kept = kept.filter(about & what & ~url.rlike(bounded(keywords["exclude_url_terms"])) & (tone < tone_below)).select("DATE", F.col("DocumentIdentifier").alias("url"), F.col("SourceCommonName").alias("source"), tone.alias("tone"), url_slug(F.col("DocumentIdentifier")).alias("slug"))
    grouped = kept.filter("slug is not null").groupBy("slug").agg(
        F.min("DATE").alias("first_published"), F.min("url").alias("example_url"), F.count(F.lit(1)).alias("number_of_reports"),
        F.slice(F.sort_array(F.collect_set("source")), 1, 5).alias("reported_by_samples"), F.round(F.avg(F.col("tone").cast("decimal(18,6)")), 2).cast("double").alias("avg_tone"),
    )
    return grouped.orderBy(F.desc("number_of_reports"), F.desc("first_published"), "slug").limit(size)
