"""Line dedup over levelled sorted runs, in DataFrame operations only.

The store is a set of runs: tables of line keys sorted within their partitions, no key in two runs.
A batch of documents merge-joins its own keys against the runs: keys found there were seen in an
earlier batch, the others belong to their smallest document in the batch and are written as a new
run of level 0. When a level has `fanout` runs they are compacted into one run of the next level,
so a key is rewritten only as often as there are levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import SPACES, ascii_lower, hash128, text_or_empty
from tidewatch.sources.runtime import Scratch

MIN_KEY, BATCHES, FANOUT = 10, 4, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled runs of the line keys (h1, h2) seen so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(spark, "lines")
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def seen(self, keys: DataFrame) -> DataFrame:
        """keys with a column seen: whether a run holds the key."""
        runs = self.all()
        if runs is None:
            return keys.withColumn("seen", F.lit(False))
        return keys.join(runs.withColumn("seen", F.lit(True)), ["h1", "h2"], "left").withColumn("seen", F.col("seen").isNotNull())

    def add(self, keys: DataFrame) -> None:
        """keys: distinct and in no run yet."""
        self._put(0, self.scratch.table(keys.select("h1", "h2").sortWithinPartitions("h1", "h2")))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            self.levels[level] = []
            merged = self.scratch.table(reduce(DataFrame.unionByName, runs).repartition("h1").sortWithinPartitions("h1", "h2"))
            self.scratch.drop(*runs)
            self._put(level + 1, merged)


def dropped_keys(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """The lines that a batch loses; the batch's new keys join the runs.

    lines: id, h1, h2 and what else tells them apart; every id above those of earlier batches.
    """
    keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    keys = runs.scratch.table(runs.seen(keys))
    runs.add(keys.filter("not seen"))
    losing = keys.filter("seen or owner < last")
    return runs.scratch.table(lines.join(losing, ["h1", "h2"]).filter("seen or id > owner").select(*lines.columns))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of docs: id_col, n_lines, n_dropped, kept_text.

    Lines are cut at \\n; null or empty text is one empty line. A line's key is the line without white
    space at both ends, A-Z in lower case; keys shorter than min_key code points are never dropped.
    A line goes if a document with a smaller id holds its key, so repeated lines within the owner
    stay and rows that share an id count as one document. Rows without an id own and lose nothing.
    An empty table gives an empty result; other columns of docs are ignored. Of very long texts each line is a row
    until its fate is known, and the text is put together from the numbers of its lines that stay, in time that grows with their count.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    cuts = docs.filter(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)]).alias("q")).first()["q"] if batches > 1 else []
    batch = reduce(lambda a, c: a + (F.col("id") > c).cast("int"), sorted(set(cuts or [])), F.lit(0))
    h1, h2 = hash128(F.col("key"))
    # Texts that share an id are told apart by a hash.
    exploded = source.filter("id is not null").select("id", F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("id", "tag", "at", line_key(F.col("line")).alias("key"))
    lines = runs.scratch.table(exploded.filter(F.char_length("key") >= min_key).select("id", "tag", "at", h1.alias("h1"), h2.alias("h2"), batch.alias("batch")), partition_by="batch")
    lost = [dropped_keys(lines.filter(F.col("batch") == b).drop("batch"), runs).select("id", "tag", "at") for b in range(len(set(cuts or [])) + 1)]
    sets = reduce(DataFrame.unionByName, lost).groupBy(F.col("id").alias("i"), F.col("tag").alias("t")).agg(F.collect_set("at").alias("lost"))

    joined = source.join(sets, (F.col("id") == F.col("i")) & (F.xxhash64("text") == F.col("t")), "left").select("id", F.when(F.col("lost").isNull(), F.col("text")).alias("whole"), F.split("text", "\n", -1).alias("lines"), "lost")
    # array_except looks numbers up in a hash set and keeps their order.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = joined.select("id", "whole", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("whole").isNull(), F.transform(stay, lambda i: F.get("lines", i))).alias("left"))
    return kept.select(
        F.col("id").alias(id_col), "n_lines",
        F.when(F.col("whole").isNotNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.coalesce("whole", F.array_join("left", "\n")).alias("kept_text"),
    )
