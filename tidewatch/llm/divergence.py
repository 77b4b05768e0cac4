"""Source divergence audit: how far apart the sources of a language are in their use of terms, by dense tiles.

Terms are counted by language, source and term. The kept terms of a language are dealt in blocks, its sources are cut in
blocks by rank; a tile is one block of terms over two blocks of sources: a dense matrix of counts, groups by terms, from which all
pairs of groups come by broadcasting. Tiles are added up in partial pair matrices, and each group keeps a heap of its most
outstanding terms; what the tasks have is merged by pairs and by groups. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.batches import ROWS
from tidewatch.llm.text import text_or_empty
from tidewatch.sources.runtime import Scratch, ship_package

MIN_DOCS, TOP = 10, 10
TERMS, GROUPS = 256, 128  # of a tile: terms, and sources of each of its two blocks
HELD = 400_000  # counts that a task holds before it hands them on
UNIT = 1_000_000_000
SMALL = 10_000  # rows of a table of at most 128 numbers each that may be broadcast
#: Letters A-Z, a-z and all bytes of other characters stay, with A-Z in lower case; the rest parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def _partial_counts(rows: DataFrame) -> DataFrame:
    """_COUNTS of each task, some of them in several rows; each group also has a row without a term."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict = defaultdict(Counter)
        docs: defaultdict = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in counts.items():
                terms = pa.array([*n, None], pa.binary()).cast(pa.string())
                numbers = np.fromiter(n.values(), np.int64, len(n)), np.fromiter(map(docs[lang, source].__getitem__, n), np.int64, len(n))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), terms, *(pa.array(np.append(x, 0)) for x in numbers)], names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            docs.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS).to_pydict()
                for text, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True):
                    terms = terms_of(text)
                    counts[lang, source].update(terms)
                    docs[lang, source].update(set(terms))
                if sum(map(len, counts.values())) > HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, _COUNTS)


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / size), without a product that could pass 64 bits: long division by thousands. size at least 2."""
    whole, rest = np.divmod(count + 2, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return 1 + whole


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Tiles:
    """Partial pair matrices and heaps over the tiles that a task meets."""

    def __init__(self, top: int, width: int):
        self.top, self.width = top, width
        self.pairs: dict[tuple, np.ndarray] = {}
        self.heaps: defaultdict = defaultdict(list)

    def add(self, lang: str, a: int, b: int, n_terms: int, sizes: list[np.ndarray], lang_size: int, counts: list[pa.StructArray]) -> None:
        """A tile of n_terms terms over blocks a and b of sources of these sizes; counts: term, rank of the source, n, lang_n (n in the language). One entry in lists if a is b."""
        terms = pa.concat_arrays([c.field("term") for c in counts]).dictionary_encode()
        place = np.split(terms.indices.to_numpy(zero_copy_only=False), [len(counts[0])])
        shape = len(terms.dictionary)
        matrices = []
        for c, block, size, at in zip(counts, (a, b), sizes, place, strict=False):
            m = np.zeros((len(size), shape), np.int64)
            m[c.field("rank").to_numpy(zero_copy_only=False) - block * self.width, at] = c.field("n").to_numpy(zero_copy_only=False)
            matrices.append(m)
        ps = [shares(m, s[:, None]) for m, s in zip(matrices, sizes, strict=True)]
        p, q = ps[0], ps[-1]
        total = np.zeros((len(p), len(q)), np.int64)
        step = max(1, (1 << 18) // max(1, total.size))
        for at in range(0, shape, step):
            total += _apart(p[:, None, at : at + step], q[None, :, at : at + step]).sum(axis=2)
        unseen = n_terms - shape  # kept terms that neither block's sources have: alike for all of them
        if unseen:
            none = [shares(np.zeros(len(s), np.int64), s) for s in sizes]
            total += unseen * _apart(none[0][:, None], none[-1][None, :])
        key = (lang, a, b)
        self.pairs[key] = self.pairs[key] + total if key in self.pairs else total
        if a == b and shape:
            in_lang = np.zeros(shape, np.int64)
            in_lang[place[0]] = counts[0].field("lang_n").to_numpy(zero_copy_only=False)
            self._outstanding(lang, a, matrices[0], p, shares(in_lang, np.array([lang_size], np.int64)), terms.dictionary.to_pylist())

    def _outstanding(self, lang: str, block: int, counts: np.ndarray, p: np.ndarray, q: np.ndarray, terms: list[str]) -> None:
        f = np.where((counts > 0) & (p > q), _apart(p, q[None, :]), -1)
        for g in range(len(p)):
            heap = self.heaps[lang, block * self.width + g]
            least = -heap[-1][0] if len(heap) == self.top else 0
            open_ = np.flatnonzero(f[g] >= least)
            if len(open_):
                best = [(-int(f[g, t]), terms[t].encode("utf-8"), terms[t]) for t in open_]
                self.heaps[lang, block * self.width + g] = heapq.nsmallest(self.top, [*heap, *best])

    def full(self) -> bool:
        return len(self.pairs) > 64 or len(self.heaps) > 4096

    def taken(self) -> pa.RecordBatch:
        """lang, i, j, item, value: pairs without an item, both ways; a group's terms without j."""
        out = []
        for (lang, a, b), m in self.pairs.items():
            for i, j in zip(*np.nonzero(np.ones(m.shape, bool)), strict=True):
                x, y = a * self.width + int(i), b * self.width + int(j)
                if x != y:
                    out.append((lang, x, y, None, int(m[i, j])))
                    if a != b:
                        out.append((lang, y, x, None, int(m[i, j])))
        out += [(lang, g, None, t, -f) for (lang, g), heap in self.heaps.items() for f, _, t in heap]
        self.pairs.clear()
        self.heaps.clear()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names=["lang", "i", "j", "item", "value"])


def _tiled(tiles: DataFrame, top: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tiles(top, width)
        for batch in batches:
            plain = batch.select(["lang", "a", "b", "n_terms", "lang_size", "sizes_a", "sizes_b"]).to_pylist()
            for i, t in enumerate(plain):
                sides = ("a",) if t["a"] == t["b"] else ("a", "b")
                held.add(t["lang"], t["a"], t["b"], t["n_terms"], [np.array(t[f"sizes_{s}"], np.int64) for s in sides], t["lang_size"], [batch.column(f"counts_{s}").slice(i, 1).flatten() for s in sides])
                if held.full():
                    yield held.taken()
        yield held.taken()

    return tiles.mapInArrow(run, "lang string, i int, j int, item string, value bigint")


def _small(df: DataFrame) -> DataFrame:
    """A table of languages or groups, broadcast as long as it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _div(c: Column | str, by: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / by).cast("int")


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = TERMS, width: int = GROUPS
) -> DataFrame:
    """lang, source, part, item, value, rank: for every group of a language and source, all other sources of the language by distance
    (part `pair`) and the terms that stand out most against the language (part `term`, at most `top`).

    Null text, language and source are read as ''. Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms of at
    least min_docs of its rows; every group gives every kept term p = 1 + floor(10^9 (n + 2) / (N + 2 V)). Two groups are apart by the sum of
    floor((p - q)^2 / (p + q)) over the kept terms, 0 where a language keeps none. Ranks go by value descending, then item ascending in UTF-8, so ties have one order. Repeated rows count
    each, texts are counted whole, groups without terms take part, an empty table gives an empty result and other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = docs.select(text_or_empty(text_col).alias("text"), text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"))
    counts = scratch.table(_partial_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = scratch.table(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs).drop("docs"))
    held = scratch.table(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("words"))
    every = counts.filter("term is null").select("lang", "source").distinct()
    sized = every.join(held.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    # One row for each group, at least 2 as its size where there is nothing to divide.
    size = F.greatest(F.lit(2), F.coalesce("words", F.lit(0)) + 2 * F.coalesce("v", F.lit(0)))
    groups = scratch.table(sized.select("lang", "source", size.alias("size"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("rank")))
    scratch.drop(counts)

    blocks = groups.groupBy("lang", _div("rank", width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "size"))).alias("s"))
    blocks = scratch.table(blocks.select("lang", "block", F.col("s.size").alias("sizes")))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / block)).cast("long")
    plan = blocks.groupBy("lang").agg(F.max("block").alias("last")).join(langs, "lang", "left")
    plan = scratch.table(plan.select("lang", "last", n_blocks.alias("n_blocks"), F.greatest(F.lit(2), F.coalesce("words", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_size")))
    few_langs, few_groups, few_blocks = _small(plan.select("lang", "n_blocks")), _small(groups.select("lang", "source", "rank")), _small(blocks)
    dealt = lambda t: t.join(few_langs, "lang").withColumn("dealt", F.pmod(F.xxhash64("term"), F.col("n_blocks"))).drop("n_blocks")
    numbers = dealt(kept).groupBy("lang", "dealt").agg(F.count(F.lit(1)).alias("n_terms"))
    entries = dealt(held).join(few_groups, ["lang", "source"])
    cells = scratch.table(entries.groupBy("lang", "dealt", _div("rank", width).alias("block")).agg(F.collect_list(F.struct("term", "rank", "n", "lang_n")).alias("counts")))
    grid = plan.withColumn("a", F.explode(F.sequence(F.lit(0), "last"))).withColumn("b", F.explode(F.sequence("a", "last"))).withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    tiles = grid.join(numbers, ["lang", "dealt"], "left").select("lang", "dealt", "a", "b", F.when(F.col("a") != F.col("b"), F.col("b")).alias("other"), "lang_size", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    for side, at in (("a", "a"), ("b", "other")):  # a block beside itself is there once
        tiles = tiles.join(few_blocks.select("lang", F.col("block").alias(at), F.col("sizes").alias(f"sizes_{side}")), ["lang", at], "left")
        tiles = tiles.join(cells.select("lang", "dealt", F.col("block").alias(at), F.col("counts").alias(f"counts_{side}")), ["lang", "dealt", at], "left")
    found = scratch.table(_tiled(tiles, top, width))
    scratch.drop(cells, held, kept)

    few_names = _small(groups.select("lang", "source", "rank"))
    named = lambda c: few_names.select("lang", F.col("rank").alias(c), F.col("source").alias(f"source_{c}"))
    pairs = found.filter("j is not null").groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).join(named("i"), ["lang", "i"]).join(named("j"), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("source_i").alias("source"), F.lit("pair").alias("part"), F.col("source_j").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.filter("item is not null").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    terms = terms.join(named("i"), ["lang", "i"]).select("lang", F.col("source_i").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
