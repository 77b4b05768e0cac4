"""How many others each record shares a key with, on keys of any number of holders, without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.runtime import Scratch, ship_package

BLOCK = 512  # classes of one key that a task holds against as many others


def partners(key: str, left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
    """(class, links) of the pairs between two blocks, or within one, whose least common key is this one. A row: class, size, keys."""
    sides = [left] if right is None else [left, right]
    # Keys before this one that stand in the way of a pair: those that two rows may have in common.
    names: dict[str, int] = {}
    for side in sides:
        for r in side:
            for k in r["keys"]:
                if k < key:
                    names.setdefault(k, len(names))
    masks = []
    for side in sides:
        m = np.zeros((len(side), len(names)), np.float32)
        for i, r in enumerate(side):
            m[i, [names[k] for k in r["keys"] if k < key]] = 1
        masks.append(m)
    counted = (masks[0] @ masks[-1].T == 0).astype(np.int64)
    sizes = [np.array([r["size"] for r in side], np.int64) for side in sides]
    if right is None:
        np.fill_diagonal(counted, 0)
        return list(zip([r["class"] for r in left], (counted @ sizes[0]).tolist(), strict=True))
    return [*zip([r["class"] for r in left], (counted @ sizes[1]).tolist(), strict=True), *zip([r["class"] for r in right], (counted.T @ sizes[0]).tolist(), strict=True)]


def _counted(rows: DataFrame) -> DataFrame:
    """(class, links) of rows sorted by key, lo and hi; those of one such block pair are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["class", "links"])

        every = (r for batch in batches for r in batch.to_pylist())
        for (key, lo, hi), some in groupby(every, lambda r: (r["key"], r["lo"], r["hi"])):
            some = list(some)
            if lo == hi:
                out += partners(key, some, None)
            else:
                out += partners(key, [r for r in some if r["own"] == lo], [r for r in some if r["own"] == hi])
            if len(out) > 100_000:
                yield taken()
        yield taken()

    return rows.mapInArrow(run, "class bigint, links bigint")


def link_counts(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, class, links) for each id of keys (id, key): the number of other ids that it shares a key with, and the least id with the same shared keys.

    Keys that one id has alone link nothing. Ids that have the same other keys are one class, so a key of any number of holders costs no more than its distinct classes.
    Where those are many, they are dealt in blocks, and each pair of blocks is one task's; a pair of classes counts at its least common key only. Null
    ids and keys are ignored, repeated rows do no harm; an id's own keys are gathered in a row. An empty table gives an empty result.
    """
    spark = keys.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "links")
    held = scratch.table(keys.select(F.col("id").cast("bigint").alias("id"), F.col("key").cast("string").alias("key")).filter("id is not null and key is not null").distinct())
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    own = scratch.table(held.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    classes = scratch.table(own.groupBy("keys").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size")))
    by_key = classes.select(F.explode("keys").alias("key"), "class", "size", "keys")
    blocks = by_key.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "blocks")
    dealt = by_key.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "size", "keys")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _counted(dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"))
    linked = classes.join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").select("keys", "class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = own.join(scratch.table(linked), "keys").select("id", "class", "links")
    return held.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
