"""The bounded filter before a join."""

from pyspark.sql import functions as F

from tidewatch.llm import sieve


def test_sieve_keeps_all_keys(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") > 10, F.col("id") - 5000).alias("id"), F.lit("x").alias("text"))
    keys = spark.range(0, 20_000, 50).select((F.col("id") - 5000).alias("k")).union(spark.sql("select cast(null as bigint)"))
    for most in (sieve.LEAST, 1 << 12):
        monkeypatch.setattr(sieve, "MOST", most)
        got = sieve.sieved(rows, "id", keys, "k")
        assert got.columns == ["id", "text"]
        assert got.join(keys, F.col("id") == F.col("k"), "left_semi").count() == 399 and got.count() < 2000
    assert sieve.sieved(rows, "id", keys.limit(0), "k").count() == 0
