"""Upserts, mirrors, first-wins dedupe, surrogate ids and nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import or_else


def first_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by an aggregation that combines before it shuffles."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """source's rows, and those of target whose keys source lacks; an empty source changes nothing."""
    return source.unionByName(target.join(source.select(key), key, "left_anti"))


def mirror_deletions(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Keys to delete remotely: those that local lacks; none if local is empty."""
    some = local.select(F.lit(1).alias("one")).limit(1)
    gone = remote.select(key).join(local.select(key), key, "left_anti")
    return gone.join(F.broadcast(some)).drop("one")  # `some` has one row or none


def unseen_by_url(known: DataFrame, new: DataFrame, urls: str) -> DataFrame:
    """Rows of new none of whose URLs is known."""
    seen = known.select(F.explode(urls).alias("u")).distinct()
    hit = new.select("key", F.explode(urls).alias("u")).join(seen, "u", "left_semi").select("key").distinct()
    return new.join(hit, "key", "left_anti")


def surrogate_ids(df: DataFrame, date: str, order: str, start: int = 0) -> DataFrame:
    """INC-yyyymmdd-NNN; the number counts the day's rows from start + 1, so days are numbered in parallel."""
    n = F.row_number().over(Window.partitionBy(date).orderBy(order)) + start
    return df.withColumn("surrogate_id", F.concat(F.lit("INC-"), F.date_format(date, "yyyyMMdd"), F.lit("-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


TAXONOMY = ["lifecycle_phase", "system_classification", "root_cause_category", "harm_domain", "temporality", "impact_scope", "intent", "primary_purpose", "harm_type", "eu_ai_act_tier", "natsec_impact", "nist_ai_rmf_function", "iso_42001_category"]


def nested(df: DataFrame) -> DataFrame:
    """Flat records as table rows: defaults filled, the taxonomy in one struct."""
    return df.select(
        "incident_id", "title", "summary", "date", or_else(F.col("verification_status"), "confirmed").alias("verification_status"), or_else(F.col("severity"), "medium").alias("severity"),
        F.coalesce("financial_damage_usd", F.lit(0)).cast("long").alias("financial_damage_usd"), F.struct(*TAXONOMY).alias("taxonomy"), "geographic_scope", "affected_parties", "source_urls",
    )


def flattened(rows: DataFrame) -> DataFrame:
    """Table rows as flat records: the taxonomy's fields with the read side's defaults."""
    d = {"eu_ai_act_tier": "unclassified", "intent": "unintentional_failure", "impact_scope": "discrete_incident"}
    fields = [or_else(F.col(f"taxonomy.{c}"), d[c]).alias(c) if c in d else F.col(f"taxonomy.{c}").alias(c) for c in TAXONOMY]
    return rows.select(*(c for c in rows.columns if c != "taxonomy"), *fields)


#: The taxonomy as tables hold it.
STORED = ["lifecycle_phase", "system_classification", "root_cause_category", "root_cause_subtype", "failure_mode", "harm_domain", "temporality", "intent", "primary_purpose", "harm_type", "eu_ai_act_tier", "natsec_impact", "impact_scope", "valuation_methodology", "source_type", "financial_damage_usd"]
#: What stands on read where neither a column nor the taxonomy has a value (fixed values).
ON_READ = {
    "verification_status": "confirmed", "severity": "medium", "source_type": "google_news_rss", "financial_damage_usd": 0, "lifecycle_phase": "operation_and_monitoring",
    "system_classification": "general_purpose_model", "root_cause_category": "governance", "root_cause_subtype": "", "failure_mode": "", "harm_domain": "persons_rights",
    "temporality": "actual", "impact_scope": "discrete_incident",
}


def table_rows(df: DataFrame) -> DataFrame:
    """Flat records as table rows with the whole taxonomy; fields that df lacks are null there."""
    own = {"source_type": or_else(F.col("source_type"), "google_news_rss"), "financial_damage_usd": F.coalesce("financial_damage_usd", F.lit(0)).cast("long")}
    kinds = {"natsec_impact": "boolean", "financial_damage_usd": "long"}
    field = lambda c: own.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
    columns = [c for c in ("incident_id", "title", "summary", "full_text", "date", "verification_status", "severity") if c in df.columns]
    return df.select(*columns, own["source_type"].alias("source_type"), own["financial_damage_usd"].alias("financial_damage_usd"), F.struct(*map(field, STORED)).alias("taxonomy"), "geographic_scope", "affected_parties", "source_urls")


def on_read(rows: DataFrame) -> DataFrame:
    """Table rows as flat records: a row's own column, else the taxonomy's field, else the default. Empty text counts as none."""

    def value(c: str) -> Column:
        levels = ([F.col(c)] if c in rows.columns else []) + ([F.col(f"taxonomy.{c}")] if c in STORED else [])
        if c not in ("financial_damage_usd", "natsec_impact"):
            levels = [F.nullif(x, F.lit("")) for x in levels]
        return F.coalesce(*levels, *([F.lit(ON_READ[c])] if c in ON_READ else [])).alias(c)

    plain = [c for c in rows.columns if c not in ("taxonomy", *ON_READ, *STORED)]
    return rows.select(*plain, *(value(c) for c in dict.fromkeys([*ON_READ, *STORED]) if c in rows.columns or c in STORED))


def without(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """target's rows but those of the given keys: what stays after a point delete."""
    return target.join(keys.select(key), key, "left_anti")


def filled(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the given text columns taken from new where that has something."""
    fresh = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = old.join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(f"new_{c}", F.lit("")), F.col(c)) for c in columns}).drop(*(f"new_{c}" for c in columns))


def funnel(events: DataFrame, day: str) -> DataFrame:
    """A day's counts by kind of event: seen, fetched, total and passed."""
    kind = F.col("event_type")
    return events.groupBy(day).agg(F.count_if(kind == "view").alias("rss"), F.count_if(kind == "click").alias("gdelt"), F.count(F.lit(1)).alias("total"), F.count_if(kind == "purchase").alias("passed"))
