"""Mixing sources to target weights by entropy balancing.

Among all rates of documents that meet each source's token target, and leave the corpus its shares of tokens by length of document, entropy balancing
takes those nearest to the documents' own amounts: it minimises the sum of size * (w ln w - w + 1). Sources differ in the lengths of their documents, so
taking more of one source and less of another would shift those shares; a rate that is the same throughout a source can't undo that. The solution is an exponential tilt, w = min(cap, level of the
source * exp(mu of the length band)). The convex dual is solved by Newton steps over the bands' multipliers: each step sums gradient and Hessian over the sources' tables, with every source's level at what
meets its target. Shares of length give way to targets where both can't be met: their multipliers carry a penalty, so there is always one solution.
Rates become whole copies by systematic rounding in order of size, with one of many offsets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.runtime import Scratch

CAP = 3  # no source is asked for, and no document taken, more often than that
UNIT = 1 << 20  # rates are counted in whole 1/UNIT of a copy, so sums don't depend on their order
BANDS = 8  # of the number of words, by powers of four; the last has no end
PENALTY = 0.05  # of the bands' multipliers
OFFSETS = 64  # starting points tried for each source


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources: source, source_size. Adds weight and target.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ...; they share all sizes by weight, but
    none gets more than cap times its size, and what that leaves is shared again. That is target =
    min(cap * size, level * weight), with the level at which all targets sum to all sizes: sources are
    full in order of size / weight, so the level follows from running sums over the sources.
    """
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ratio = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    # Were this source and those after it not full, the level would be:
    level = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    leveled = ratio.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    # The first open source in that order has the level; later ones, which count open sources as full, have less.
    held = leveled.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    return held.select("source", "source_size", "weight", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def band(size: Column) -> Column:
    """The length band of a number of words: 0 for up to 3, 1 for up to 15, and so on."""
    return F.least(F.lit(BANDS - 1), F.floor((F.length(F.bin(F.greatest(size, F.lit(1)))) - 1) / 2)).cast("int")


def _level(mu: list[float], cap: float) -> Column:
    """The level at which a source meets its target: bands at the cap, the greatest multipliers first, and the others by their tilt. Columns: target, s0, s1, ..."""
    order = sorted(range(len(mu)), key=lambda i: (-mu[i], i))
    cases = []
    for m in range(len(mu)):
        full = sum((F.col(f"s{i}") for i in order[:m]), F.lit(0))
        rest = sum((F.col(f"s{i}") * math.exp(mu[i]) for i in order[m:]), F.lit(0.0))
        level = F.when(rest > 0, (F.col("target") - cap * full) / rest)
        cases.append(F.when(level * math.exp(mu[order[m]]) <= cap * (1 + 1e-12), level))
    return F.coalesce(*cases, F.lit(cap * math.exp(-min(mu, default=0.0))))  # else all are at the cap


def balance(cells: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = 40, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """(source, level) and the multiplier of each band. cells: source, band, size; goals: source, target, at most cap times the source's size.

    Every source meets its target whatever the multipliers; at most `steps` steps. Sources of target 0 or size 0 have no level. A step brings two
    sums for each band and one for each pair of bands to the driver, whatever the number of sources.
    """
    scratch = Scratch(cells.sparkSession, "balance")
    k = range(BANDS)
    wide = cells.groupBy("source").agg(*(F.coalesce(F.sum(F.when(F.col("band") == i, F.col("size"))), F.lit(0)).alias(f"s{i}") for i in k))
    goal = goals.filter("target > 0").select(F.col("source").alias("s"), "target")
    held = scratch.table(wide.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").filter(" + ".join(f"s{i}" for i in k) + " > 0"))
    sums = held.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in k), _exact(F.col("target")).alias("target")).first()
    size, target = np.array([float(sums[f"s{i}"] or 0) for i in k]), sums["target"] or 0.0
    wanted = size * (target / size.sum()) if size.sum() else size
    mu = [0.0] * BANDS
    for _ in range(steps if target else 0):
        tilt = [math.exp(m) for m in mu]
        level = held.select(*(f"s{i}" for i in k), F.explode_outer(F.array(_level(mu, cap))).alias("level"))  # computed once for all that follows
        taken = level.select(*((F.col(f"s{i}") * F.least(F.lit(float(cap)), F.col("level") * tilt[i])).alias(f"q{i}") for i in k), *(F.when(F.col("level") * tilt[i] < cap, F.col(f"s{i}") * F.col("level") * tilt[i]).otherwise(0.0).alias(f"u{i}") for i in k))
        free = taken.withColumn("u", sum(F.col(f"u{i}") for i in k))
        shared = lambda i, j: F.when(F.col("u") > 0, F.col(f"u{i}") * F.col(f"u{j}") / F.col("u")).otherwise(0.0)
        r = free.agg(*(_exact(F.col(f"q{i}")).alias(f"q{i}") for i in k), *(_exact(F.col(f"u{i}")).alias(f"u{i}") for i in k), *(_exact(shared(i, j)).alias(f"h{i}_{j}") for i in k for j in range(i, BANDS))).first()
        gradient = np.array([r[f"q{i}"] - wanted[i] + PENALTY * wanted[i] * mu[i] for i in k])
        if np.abs(gradient).max() <= tolerance * target:
            break
        hessian = np.array([[(r[f"u{i}"] if i == j else 0.0) - r[f"h{min(i, j)}_{max(i, j)}"] + (PENALTY * wanted[i] + (wanted[i] == 0) if i == j else 0.0) for j in k] for i in k])
        # A step of at most 1 in each multiplier keeps the far side of the exponential in check.
        mu = [m - float(d) for m, d in zip(mu, np.clip(np.linalg.solve(hessian, gradient), -1, 1), strict=True)]
    return held.select("source", _level(mu, cap).alias("level")), mu


def _corrected(scratch: Scratch, done: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of one document of each source: the one that brings the words taken nearest to the target."""
    gaps = done.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).withColumnRenamed("source", "s")
    open_ = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("gap") - F.col("size"))
    able = done.join(gaps, F.col("source").eqNullSafe(F.col("s"))).filter(open_ & (left < F.abs("gap")))
    best = able.groupBy("source").agg(F.min(F.struct(left.alias("left"), "h", "id", "rid")).alias("b"), F.first("gap").alias("gap"))
    picked = scratch.table(best.select(F.col("b.rid").alias("r"), F.signum("gap").cast("long").alias("more")))  # one row for each source
    return done.join(picked, F.col("rid") == F.col("r"), "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("r", "more")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, offsets: int = OFFSETS, corrections: int = 3) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, rate, copies, taken.

    Null and empty texts have size 0; a source of them alone is taken once. Null is a source of its own, last in
    order. Copies of a document lie between 0 and cap. Systematic rounding goes by (source, size
    descending, hash of id, id): running sums are taken within ranges of that order and carried from range
    to range, so a source of any size is spread over tasks. Rows that tie in all of these are alike, and
    any of them gets the next copy. Of the offsets tried, each source takes the one whose taken words come
    nearest to its target, the smallest on ties; then a few single copies
    are added or dropped where that brings a source nearer. Texts are counted whole. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.desc("size"), F.asc("h"), F.asc("id")]
    dealt = sized.withColumn("h", F.xxhash64("id")).repartitionByRange(n, *order)
    rows = scratch.table(dealt.withColumn("part", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()))
    sources = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    cells = rows.filter("size > 0").groupBy("source", band(F.col("size")).alias("band")).agg(F.sum("size").alias("size"))
    goals = scratch.table(targets(sources, cap))
    levels, mu = balance(cells, goals, cap)
    plan = scratch.table(goals.join(levels.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))

    rated = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tilt = F.coalesce(F.col("level") * F.get(F.array(*(F.lit(math.exp(m)) for m in mu)), band(F.col("size"))), F.lit(1.0))
    rated = rated.withColumn("rate", F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(cap)), tilt))).drop("level")
    rated = rated.withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    # Carried sums: one row for each range and source, which is about as many as there are ranges and sources.
    ranges = rated.groupBy("source", "part").agg(F.sum("units").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = scratch.table(ranges.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carry")))
    inside = Window.partitionBy("part", "source").orderBy(F.desc("size"), "h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rated.withColumn("run", F.sum("units").over(inside))
    summed = scratch.table(summed.join(carried, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("run") + F.col("carry")).drop("p", "s", "run", "carry"))

    def copies(offset: Column | int) -> Column:
        whole = lambda c: F.shiftright(c + (F.lit(offset).cast("long") if isinstance(offset, int) else offset), UNIT.bit_length() - 1)
        return whole(F.col("upto")) - whole(F.col("upto") - F.col("units"))

    starts = [i * UNIT // offsets for i in range(offsets)]
    tried = summed.groupBy("source").agg(F.first("target").alias("target"), *(F.sum(copies(o) * F.col("size")).alias(f"o{i}") for i, o in enumerate(starts)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"o{i}") - F.col("target")).alias("off"), F.lit(o).cast("long").alias("offset")) for i, o in enumerate(starts))))
    chosen = scratch.table(tried.select(F.col("source").alias("s"), best["offset"].alias("offset")))
    done = scratch.table(summed.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(F.col("offset"))).drop("s", "offset"))
    scratch.drop(rows, sources, plan, carried, summed)
    for _ in range(corrections):
        done = _corrected(scratch, done, cap)
    return done.select("id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
