"""A bounded filter that spares a shuffle most of the rows a join would drop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 10, 1 << 20  # words of 64 bits
BITS = 16  # for each key, as long as that fits


def _bit(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words * 64))


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """Whether a column that isn't null is among the keys, or one of a few others.

    The keys' hashes are bits of a map of at most MOST * 64 of them (8 MB), which is broadcast whatever their number: with more keys
    more other rows pass. Null is no key. The column must be a bigint, as must the key.
    """
    n = keys.count()
    words = LEAST
    while words < MOST and words * 64 < n * BITS:
        words *= 2
    at = _bit(F.col(key), words)
    set_ = keys.filter(F.col(key).isNotNull()).select(F.shiftrightunsigned(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = set_.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most MOST rows of two numbers
    bits = np.zeros(words, np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    held = keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))

    def passes(col: Column) -> Column:
        own = _bit(col, words)
        # As a scalar, the map is part of a filter, which stays below the caller's join.
        word = F.get(held.scalar(), F.shiftrightunsigned(own, 6).cast("int"))
        return F.getbit(word, own.bitwiseAND(F.lit(63)).cast("int")) == 1

    return passes


def sieved(rows: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """All rows whose col is among the keys and a few others, without a shuffle; the exact join is the caller's."""
    return rows.filter(F.col(col).isNotNull() & sieve(keys, key)(F.col(col)))
