"""Money for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def damage_text(usd: Column) -> Column:
    """N/A, $999, $3K, $1.00M or $1.50B; halves round up."""
    d = usd.cast("decimal(20,2)")
    part = lambda by, digits: F.round(d / F.lit(by).cast("decimal(12,0)"), digits).cast(f"decimal(20,{digits})").cast("string")
    return (
        F.when(d.isNull() | (d <= 0), "N/A").when(d >= 1_000_000_000, F.concat(F.lit("$"), part(1_000_000_000, 2), F.lit("B")))
        .when(d >= 1_000_000, F.concat(F.lit("$"), part(1_000_000, 2), F.lit("M"))).when(d >= 1000, F.concat(F.lit("$"), part(1000, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), d.cast("long").cast("string")))
    )


def thousands(usd: Column) -> Column:
    """Whole dollars with commas."""
    return F.format_number(usd, 0)
