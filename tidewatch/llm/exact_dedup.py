"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg), in DataFrame operations only.

Each text, without white space, is cut into blocks of a fixed number of code points. The distinct
blocks are sorted and get integers as names; then the distinct pairs of adjacent names are sorted
and named in turn, until every document is down to one name. Two documents have the same
(level, name) if and only if their texts are equal: nothing rests on a hash.

Blocks travel as text once, to be named. Their occurrences find the names by a 128-bit key, which
is verified to be free of collisions over all distinct blocks, and drawn anew with another seed if it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import hash128, text_or_empty
from tidewatch.sources.runtime import Scratch

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _blocks(norm: Column, block: int) -> Column:
    """At least one block: the empty text is one empty block."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _key(b: Column, seed: int, bits: int) -> Column:
    h1, h2 = hash128(b, seed)
    if bits < 64:
        h1, h2 = F.shiftrightunsigned(h1, 64 - bits), F.lit(0).cast("long")
    return F.struct(h1.alias("h1"), h2.alias("h2"))


def _keys(blocks: Column, seed: int, bits: int) -> Column:
    return F.transform(blocks, lambda b: _key(b, seed, bits))


def _sorted_names(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer for each row: its partition and its place in the partition's sorted order."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, n_chars, n_blocks.

    Null text counts as empty; all empty texts are one group. Of equal texts the one with the most
    code points before white space is removed stays, then the smallest id; null ids come last.
    Repeated rows are members like any other, and only one row of a group is kept. An empty table
    gives an empty result. Other columns of docs are ignored, so names can't clash.
    key_bits below 64 shortens the keys of blocks (tests use it to meet collisions).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    raw = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("raw"))
    norm = raw.select("id", F.char_length("raw").cast("long").alias("n_chars"), normalised(F.col("raw")).alias("norm"))

    seed = 0
    while True:
        rows = scratch.table(
            norm.select(
                F.monotonically_increasing_id().alias("rid"), "id", "n_chars", F.sha2("norm", 256).alias("sha"),
                _keys(_blocks(F.col("norm"), block), seed, key_bits).alias("keys"),
            )
        )
        distinct = norm.select(F.explode(_blocks(F.col("norm"), block)).alias("b")).select(_key(F.col("b"), seed, key_bits).alias("k"), "b").distinct()
        names = scratch.table(_sorted_names(distinct, ["b"]).select("k.h1", "k.h2", "name"))
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        scratch.drop(rows, names)
        seed += 1

    occurrences = rows.select("rid", F.posexplode("keys").alias("pos", "k")).select("rid", "pos", "k.h1", "k.h2")
    sequences = scratch.table(_gathered(occurrences.join(names, ["h1", "h2"])))
    scratch.drop(names)
    identities, level, used = [], 0, []
    while True:
        identities.append(sequences.filter(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        used.append(sequences)
        longer = sequences.filter(F.size("names") > 1)
        if longer.isEmpty():
            break
        pairs = longer.select("rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("(size(names) - 1) div 2")), lambda i: F.struct(F.get("names", 2 * i).alias("l"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("r")))).alias("pos", "p")).select("rid", "pos", "p.l", "p.r")
        names = scratch.table(_sorted_names(pairs.select("l", "r").distinct(), ["l", "r"]))
        sequences = scratch.table(_gathered(pairs.join(names, ["l", "r"])))
        scratch.drop(names)
        level += 1

    identity = identities[0]
    for more in identities[1:]:
        identity = identity.unionByName(more)
    members = scratch.table(rows.select("rid", "id", "n_chars", "sha", F.size("keys").alias("n_blocks")).join(identity, "rid"))
    scratch.drop(rows, *used)
    groups = scratch.table(
        members.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_chars", (-F.col("id")).alias("neg"), (-F.col("rid")).alias("neg_rid"))).alias("best"))
        .select("level", "name", "group_size", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.neg_rid")).alias("keep_rid"))
    )
    return members.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", "n_blocks"
    )


def _gathered(named: DataFrame) -> DataFrame:
    """Each document's names in order; a document's own sequence is no longer than its text."""
    return named.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("s")).select("rid", F.col("s.name").alias("names"))
