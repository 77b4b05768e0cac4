"""Search, filters, sort orders and exports of incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.text import or_else
from tidewatch.sources.runtime import Scratch

ALL = "all"


def source_of() -> Column:
    return or_else(F.col("source_type"), S.DEFAULT_SOURCE)


def scope_of() -> Column:
    return or_else(F.col("impact_scope"), S.DISCRETE_SCOPE)


def is_macro() -> Column:
    return F.coalesce((F.col("impact_scope") == S.MACRO_SCOPE) | (F.col("financial_damage_usd") >= S.MACRO_USD), F.lit(False))


def graph_matches(query: str, severity: str = ALL) -> Column:
    """The graph view's filter: a severity, and a substring of title, id or any party."""
    found = matches(query, ("title", "incident_id")) if query else F.lit(True)
    return found if severity == ALL else found & (F.col("severity") == severity)


def matches(query: str, columns: tuple[str, ...] = ("title", "summary"), parties: str = "affected_parties") -> Column:
    """Case-insensitive substring in any of the columns or any party; % and _ have no special meaning."""
    q = query.lower()
    hits = [F.contains(F.lower(F.col(c)), F.lit(q)) for c in columns]
    return reduce(lambda a, b: a | b, [*hits, F.exists(parties, lambda p: F.contains(F.lower(p), F.lit(q)))])


# Filters by equality: parameter and expression.
_EQUAL = {
    "severity": lambda: F.col("severity"), "status": lambda: F.col("verification_status"), "system": lambda: F.col("system_classification"), "intent": lambda: F.col("intent"),
    "eu_tier": lambda: F.col("eu_ai_act_tier"), "nist": lambda: F.col("nist_ai_rmf_function"), "iso": lambda: F.col("iso_42001_category"), "purpose": lambda: F.col("primary_purpose"),
    "source": source_of, "lifecycle": lambda: F.col("lifecycle_phase"), "harm_domain": lambda: F.col("harm_domain"), "harm_type": lambda: F.col("harm_type"),
    "root_cause": lambda: F.col("root_cause_category"), "scope": scope_of, "temporality": lambda: F.col("temporality"),
}
_DAMAGE = {"any": 1, "1m": 1_000_000, "10m": 10_000_000}


def predicate(search: str = "", natsec: str = ALL, country: str = ALL, damage: str = ALL, start: str | None = None, end: str | None = None, **equal: str) -> Column:
    """All filters that aren't 'all', joined by AND. natsec yes and no both leave out unknowns."""
    parts = [_EQUAL[k]() == v for k, v in equal.items() if v != ALL]
    if search:
        parts.append(matches(search))
    if natsec != ALL:
        parts.append(F.col("natsec_impact") == (natsec == "yes"))
    if country != ALL:
        parts.append(F.array_contains("geographic_scope", country))
    if damage != ALL:
        parts.append(F.coalesce("financial_damage_usd", F.lit(0)) >= _DAMAGE[damage])
    if start:
        parts.append(F.col("date") >= F.lit(start).cast("date"))
    if end:
        parts.append(F.col("date") <= F.lit(end).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def severity_rank() -> Column:
    return reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), list(S.SEVERITY_RANK.items())[1:], F.when(F.col("severity") == "critical", 4)).otherwise(0)


def sort_keys(by: str) -> list[Column]:
    """The order of a list; ties by incident_id."""
    entity = F.lower(F.coalesce(F.try_element_at("affected_parties", F.lit(1)), F.col("title")))
    amount = F.coalesce("financial_damage_usd", F.lit(0))
    confidence = F.coalesce(F.nullif("confidence_severity", F.lit(0.0)), F.lit(1.0))
    name, _, way = by.partition("_")
    key = {"date": F.col("date"), "entity": entity, "severity": severity_rank(), "damage": amount, "confidence": confidence}[name]
    return [key.asc() if way == "asc" else key.desc(), F.col("incident_id").asc()]


def page(df: DataFrame, by: str, size: int) -> DataFrame:
    """The first rows of a sorted list with their positions; only `size` rows are ever numbered."""
    top = df.orderBy(*sort_keys(by)).limit(size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*sort_keys(by))))


def numbered(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """incident_id and the given columns of all rows, with position, prev_id and next_id in a sorted list.

    Rows are sorted in ranges. Numbers, and the rows on either side of a range's ends, are carried from range to range, one row for each.
    """
    spark = df.sparkSession
    key, tie = sort_keys(by)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, tie).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(key, tie)
    placed = dealt.select(
        "part", "incident_id", *columns, F.row_number().over(inside).cast("long").alias("place"),
        F.lag("incident_id").over(inside).alias("before"), F.lead("incident_id").over(inside).alias("after"),
    )
    scratch = Scratch(spark, "order")
    rows = scratch.table(placed)
    ranges = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("incident_id", "place").alias("first"), F.max_by("incident_id", "place").alias("last"))
    along = Window.orderBy("part")
    carried = ranges.select(
        "part", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"),
        F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after"),
    )
    joined = rows.join(F.broadcast(carried), "part")  # one row for each range
    return joined.select("incident_id", *columns, (F.col("place") + F.col("carry")).alias("position"), F.coalesce("before", "last_before").alias("prev_id"), F.coalesce("after", "first_after").alias("next_id"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))


def csv_line() -> Column:
    """One row of the CSV export: text quoted, damage bare, arrays joined, quotes doubled in title and URL."""
    double = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))
    fields = [
        quoted(F.col("incident_id")), quoted(F.col("date").cast("string")), quoted(double(F.col("title"))), quoted(F.col("severity")), quoted(scope_of()),
        F.coalesce("financial_damage_usd", F.lit(0)).cast("string"), quoted(F.array_join("geographic_scope", "; ")), quoted(F.col("system_classification")),
        quoted(F.col("lifecycle_phase")), quoted(F.col("primary_purpose")), quoted(F.col("intent")), quoted(F.col("harm_domain")), quoted(F.col("harm_type")),
        quoted(F.col("root_cause_category")), quoted(F.col("eu_ai_act_tier")), quoted(F.col("nist_ai_rmf_function")), quoted(F.col("iso_42001_category")),
        quoted(F.when(F.col("natsec_impact"), "Yes").otherwise("No")), quoted(F.col("verification_status")), quoted(double(F.try_element_at("source_urls", F.lit(1)))),
    ]
    return F.concat_ws(",", *fields)


def briefing_line() -> Column:
    """One line of the briefing text."""
    amount = F.when(F.coalesce("financial_damage_usd", F.lit(0)) > 0, F.concat(F.lit("$"), F.format_number("financial_damage_usd", 0), F.lit(" USD"))).otherwise("N/A")
    scope = F.when(F.col("impact_scope") == S.MACRO_SCOPE, "[Macro Industry Trend]").otherwise("[Discrete Event]")
    return F.concat(F.upper("severity"), F.lit(" — "), F.col("title"), F.lit(": "), F.col("summary"), F.lit(" ("), scope, F.lit(" Est. Impact: "), amount, F.lit(")"))


def drilldown(dimension: str, value: str) -> Column:
    """Rows of one bar of a chart, compared in lower case with spaces for underscores."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return plain(F.col(dimension)) == value.replace("_", " ").lower()
