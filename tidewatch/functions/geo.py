"""Regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas as S


def scope_array(c: Column) -> Column:
    """A scope held as text: null and '' are Global, a JSON array or a comma list gives its trimmed parts."""
    t = F.trim(c)
    parts = F.coalesce(F.when(t.rlike(r"^\[.*\]$"), F.from_json(t, "array<string>")), F.split(t, ","))
    return F.when(c.isNull() | (c == ""), F.array(F.lit("Global"))).otherwise(clean(parts))


def clean(scope: Column) -> Column:
    """An array scope with its parts trimmed and empty ones gone; null is Global."""
    return F.coalesce(F.filter(F.transform(scope, lambda s: F.trim(s)), lambda s: s != ""), F.array(F.lit("Global")))


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.REGIONS, "region_key string, region_name string, lat double, lng double")
