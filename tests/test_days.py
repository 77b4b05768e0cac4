"""Records by day within a ceiling, and regions on matching rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import aggregate
from tidewatch.sources import days


def test_days(spark, tmp_path):
    where = str(tmp_path / "r")
    rows = spark.range(300).select("id", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"))
    assert days.latest_day(spark, where) is None
    days.write_days(rows, where, "day")
    assert days.latest_day(spark, where) == date(2026, 1, 30)
    window = days.read_days(spark, where, rows.schema, "day", date(2026, 1, 26), date(2026, 1, 30), 1 << 20)
    assert window.count() == 50
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "(day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="more than 10"):
        days.read_days(spark, where, rows.schema, "day", date(2026, 1, 26), date(2026, 1, 30), 10)
    assert days.read_days(spark, where, rows.schema, "day", date(2027, 1, 1), date(2027, 2, 1), 10).count() == 0
    days.write_days(rows.filter("id < 0").unionByName(spark.createDataFrame([(7, date(2026, 1, 2))], rows.schema)), where, "day")
    left = days.read_days(spark, where, rows.schema, "day", date(2026, 1, 1), date(2026, 1, 3), 1 << 20)
    assert left.count() == 21 and [r["id"] for r in left.filter("day = '2026-01-02'").collect()] == [7]


def test_regions(spark):
    rows = [("a", "critical", 5, ["UK", "uk", " United Kingdom "]), ("b", "low", None, ["France", "ASIA"]), ("c", "critical", 7, ["United Kingdom"]), ("d", "low", 1, ["Nowhere", None]), ("e", "low", 1, None), ("f", "low", 2, [])]
    df = spark.createDataFrame(rows, "incident_id string, severity string, financial_damage_usd bigint, geographic_scope array<string>")
    tagged = {r["region_key"]: (r["region_name"], r["n"], r["critical"], r["usd"]) for r in aggregate.by_region(df, geo.gazetteer(spark)).collect()}
    assert tagged["uk"] == ("United Kingdom", 1, 1, 5) and tagged["united kingdom"] == ("United Kingdom", 2, 2, 12) and tagged["france"] == ("France", 1, 0, 0)
    places = {r["region_name"]: r["n"] for r in aggregate.by_region(df, geo.gazetteer(spark), canonical=True).collect()}
    assert places["United Kingdom"] == 2 and places["France"] == 1
    assert sorted(r["incident_id"] for r in df.filter(aggregate.in_region("UK", "United Kingdom")).collect()) == ["a", "c"]
