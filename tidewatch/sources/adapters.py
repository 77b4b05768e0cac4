"""Views of the driver's tables as incidents, edges, articles and event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.sources.keywords import INCIDENT_WORDS, URL_ENTITIES
from tidewatch.sources.runtime import table


#: Last segments of event records' URLs: subjects and happenings that the harvest's keywords know, and some that they don't or that they exclude.
SUBJECTS = [*URL_ENTITIES, "harbour", "garden", "weather", "Airline", "paint"]
HAPPENINGS = [*INCIDENT_WORDS, "festival", "opening", "flight", "Report"]

#: Places of incidents whose nation's key is even: names and short forms that the map knows, written as sources write them, and one that it doesn't.
PLACES = ["UK", " United Kingdom ", "usa", "France", "EU", "Germany", "Japan ", "china", "India", "Brazil", "United States", "Atlantis", "South Korea"]


def pick(values: list[str], index: Column) -> Column:
    """The value at index (from 0) of a fixed list."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident for each order, with its customer's nation and region and its suppliers as parties."""
    t = lambda name: table(spark, sf_dir, name)
    parties = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("suppliers"))
    k = F.col("o_orderkey")
    joined = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(parties, k == F.col("l_orderkey"), "left")
    )
    none = F.lit(None).cast("string")
    suppliers = F.coalesce("suppliers", F.array().cast("array<string>"))
    factor = F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(6))), (k % 6 + 1).cast("int"))
    title = F.concat("o_orderpriority", F.lit(" report from "), "n_name")
    summary = F.concat("c_name", F.lit(": "), pick(S.PHRASES, k % len(S.PHRASES)))
    return joined.select(
        k.alias("key"),
        F.concat(F.lit("INC-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), k.cast("string")).alias("incident_id"),
        title.alias("title"), summary.alias("summary"), F.concat(title, F.lit(". "), summary).alias("full_text"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "alleged").otherwise("disputed").alias("verification_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low").alias("severity"),
        F.when(k % 5 == 0, none).when(k % 2 == 0, S.DEFAULT_SOURCE).otherwise("gdelt").alias("source_type"),
        F.when(k % 7 == 0, F.lit(0).cast("long")).otherwise(F.floor("o_totalprice").cast("long") * factor).alias("financial_damage_usd"),
        F.when(k % 11 == 0, S.MACRO_SCOPE).when(k % 5 == 0, none).otherwise(S.DISCRETE_SCOPE).alias("impact_scope"),
        pick(S.SYSTEMS, F.length("c_mktsegment") % 5).alias("system_classification"),
        pick(S.LIFECYCLES, k % 5).alias("lifecycle_phase"), pick(S.ROOT_CAUSES, k % 6).alias("root_cause_category"),
        pick(S.HARM_DOMAINS, k % 7).alias("harm_domain"), pick(S.TEMPORALITIES, k % 3).alias("temporality"),
        F.when(k % 9 == 0, none).otherwise(pick(S.INTENTS, k % 2)).alias("intent"), pick(S.PURPOSES, k % 9).alias("primary_purpose"),
        pick(S.HARM_TYPES, k % 8).alias("harm_type"), F.when(k % 10 == 0, none).otherwise(pick(S.EU_TIERS, k % 4)).alias("eu_ai_act_tier"),
        pick(S.NIST, k % 4).alias("nist_ai_rmf_function"), pick(S.ISO, k % 4).alias("iso_42001_category"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("natsec_impact"),
        F.when(k % 13 != 0, (k % 100) / 100.0).alias("confidence_severity"),
        F.array(F.when(F.col("n_nationkey") % 2 == 0, pick(PLACES, F.expr(f"n_nationkey div 2 % {len(PLACES)}"))).otherwise(F.col("n_name")), F.col("r_name")).alias("geographic_scope"),
        F.when(k % 2 == 0, F.concat(F.array("c_name"), suppliers)).otherwise(suppliers).alias("affected_parties"),
        F.array(F.concat(F.lit("https://news.example.com/"), F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-"))), F.lit("/"), k.cast("string"))).alias("source_urls"),
    )


def latest_date(spark: SparkSession, sf_dir: str):
    """The latest date of any incident, from the one table that has it."""
    return table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's consecutive orders; some ids missing or repeated, some ends unknown."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    both = table(spark, sf_dir, "orders").withColumn("prev", F.lag("o_orderkey").over(order)).filter("prev is not null")
    none = F.lit(None).cast("string")
    return both.select(
        F.when(k % 17 == 0, none).when(k % 19 == 0, "EDGE-DUP").otherwise(F.concat(F.lit("EDGE-"), k.cast("string"))).alias("edge_id"),
        F.col("prev").alias("source_key"), F.when(k % 23 == 0, -k).otherwise(k).alias("target_key"),
        pick(S.RELATIONS, k % 5).alias("relation_type"), F.when(k % 4 == 0, none).otherwise(F.lit("linked")).alias("description"),
        F.when(k % 6 == 0, F.lit(0.0)).when(k % 8 == 1, F.lit(None).cast("double")).otherwise((k % 100) / 100.0).alias("confidence"), k.alias("seq"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records: a page's URL with two words of news, a tone, an organisation, a theme and a day from an event."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    n = pages.agg(F.max("page_id") + 1).first()[0] or 1
    seen = events.select("event_id", "ts", "value", "event_type", (F.col("event_id") % n).alias("p"))
    words = F.concat(F.lit("/"), pick(SUBJECTS, F.col("event_id") % len(SUBJECTS)), F.lit("-"), pick(HAPPENINGS, F.expr(f"event_id div 7 % {len(HAPPENINGS)}")))
    return seen.join(pages, F.col("p") == F.col("page_id")).select(
        F.date_format("ts", "yyyyMMdd").cast("long").alias("DATE"), F.concat("url", words).alias("DocumentIdentifier"), F.concat(F.col("event_type"), F.lit(".example.org")).alias("SourceCommonName"),
        F.concat(F.format_string("%.2f", 5.0 - F.col("value") % 10), F.lit(",1,2")).alias("V2Tone"),
        F.when(F.col("event_id") % 3 == 0, "OpenAI;Acme").when(F.col("event_id") % 3 == 1, "Acme").alias("V2Organizations"),
        F.when(F.col("event_id") % 2 == 0, "CYBER_ATTACK;TAX").otherwise("TAX").alias("V2Themes"), F.col("ts").cast("date").alias("day"),
    )
