"""Columns for display: nodes and edges of a graph, table defaults, badges, active filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import or_else

# Colours by severity and badges by way of valuation (fixed values).
COLOURS = {"critical": "#ef4444", "high": "#f97316", "medium": "#eab308", "low": "#3b82f6"}
BADGES = {
    "explicit_confirmed": "Confirmed Official Figure", "vsl_benchmark": "US DOT VSL Benchmark", "statutory_formula": "Lower-Bound Statutory Formula",
    "cyber_breach_report": "IBM Cyber Breach Baseline", "regulatory_turnover": "Regulatory Fine Baseline",
}
LOWER_BOUND = "Conservative Lower Bound"


def _by(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.coalesce(c, F.lit(""))), F.lit(default))


def node_colour(severity: Column) -> Column:
    return _by(severity, COLOURS, COLOURS["low"])


def node_size(severity: Column) -> Column:
    return F.when(severity == "critical", 22).when(severity == "high", 18).otherwise(14)


def node_label(title: Column) -> Column:
    return F.when(F.length(title) > 28, F.concat(F.substring(title, 1, 25), F.lit("..."))).otherwise(title)


def edge_label(relation: Column) -> Column:
    return F.replace(relation, F.lit("_"), F.lit(" "))


def edge_dashed(relation: Column) -> Column:
    """Edges of the law are dashed."""
    return F.lower(relation).isin("lawsuit", "lawsuit_action", "regulatory_action")


def badge(method: Column) -> Column:
    """How a damage was valued; unknown ways are lower bounds."""
    return _by(method, BADGES, LOWER_BOUND)


def table_tier(tier: Column) -> Column:
    """limited_risk by default; only the first underscore becomes a space."""
    return F.regexp_replace(or_else(tier, "limited_risk"), "^([^_]*)_", "$1 ")


def table_countries(scope: Column) -> Column:
    return F.array_join(F.coalesce(scope, F.array(F.lit("Global"))), ", ")


def detail_default(c: Column, kind: str) -> Column:
    return or_else(c, {"nist": "MAP", "iso": "System_Impact"}.get(kind, "N/A"))


def chips(**active: Column) -> Column:
    """Labels of the filters that aren't 'all', empty or null, in the order given."""
    label = lambda k, v: F.when(or_else(v, "all") != "all", F.concat(F.lit(k.replace("_", " ").title() + ": "), F.replace(v, F.lit("_"), F.lit(" "))))
    return F.array_compact(F.array(*(label(k, v) for k, v in active.items())))
