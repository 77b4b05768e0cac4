"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, both equal for two
sets with a probability of their Jaccard similarity. Values are banded; documents with an equal band make a bucket, and those
of a bucket are candidates.

Links are confirmed on full sets. First each document is compared with the least one in its buckets. Then it goes bucket by bucket,
but never over all pairs of one: in each round a bucket has one pivot, with which its members of other classes are compared, and classes grow together along the links found. A bucket is done
when all its members that haven't been pivots are in one class. Only ids and band keys travel in these rounds; sets are read
for the pairs to be compared. What is left after some rounds (buckets of many texts that are alike, but not enough) is
compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches
from tidewatch.llm.sieve import sieved
from tidewatch.llm.text import words_of
from tidewatch.operators.components import connected_components
from tidewatch.sources.runtime import Scratch, ship_package

WORDS, ROWS, BANDS = 5, 8, 43
SEED = 20011


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met most lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class MinMax:
    """Band keys from the minimum and the maximum under each permutation: half as many hashes as values."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = SEED):
        n = rows * bands // 2
        if 2 * n != rows * bands:
            raise ValueError("rows * bands must be even")
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint32)
        self.rows, self.bands = rows, bands
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # Maxima are shifted by half a band, so that bands mix permutations alike.
        self.order = np.concatenate([np.arange(n), n + np.roll(np.arange(n), rows // 2)])
        self._buf = np.empty((512, n), np.uint32)

    def values(self, x: np.ndarray) -> np.ndarray:
        """All minima, then all maxima."""
        small = ((x >> np.uint64(32)) ^ x).astype(np.uint32)
        lo = hi = None
        for at in range(0, len(small), len(self._buf)):
            part = small[at : at + len(self._buf), None]
            buf = self._buf[: len(part)]
            np.multiply(part, self.a, out=buf)
            np.add(buf, self.b, out=buf)
            buf ^= buf >> np.uint32(15)
            np.multiply(buf, np.uint32(0x846CA68B), out=buf)
            mn, mx = buf.min(0), buf.max(0)
            lo, hi = (mn, mx) if lo is None else (np.minimum(lo, mn), np.maximum(hi, mx))
        return np.concatenate([lo, hi])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, as int64; the band's number is part of it."""
        v = self.values(x)[self.order].astype(np.uint64).reshape(self.bands, self.rows)
        h = self.salt.copy()
        for i in range(self.rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
        return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 85) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _digest(x: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


_SIGNED = "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"
_SETS = "id bigint, s1 bigint, s2 bigint, words binary"
CELL, CELL_BYTES = 256, 4 << 20  # members of a block, and bytes of their sets, about; a task compares two blocks at a time
ROUNDS = 2  # of pivots, before blocks


def _signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    def start():
        hashes, minmax = WordHashes(), MinMax(rows, bands)

        def work(batch):
            out = {"id": batch["id"], "n": [], "s1": [], "s2": [], "bands": []}
            for text in batch["text"]:
                x = shingles(text, hashes, width)
                a, b = _digest(x)
                out["n"].append(len(x))
                out["s1"].append(a)
                out["s2"].append(b)
                out["bands"].append(minmax.keys(x) if len(x) else None)
            return out

        return work

    return map_batches(docs, start, _SIGNED)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text; the full set of each, as bytes."""

    def start():
        hashes = WordHashes()

        def work(batch):
            sets = [shingles(t, hashes, width) for t in batch["text"]]
            marks = [_digest(x) for x in sets]
            return {"id": batch["id"], "s1": [m[0] for m in marks], "s2": [m[1] for m in marks], "words": [x.tobytes() for x in sets]}

        return work

    return map_batches(docs, start, _SETS)


def _links(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst of those pairs (a, b) that are near duplicates. Both sides of both joins are plain exchanges, so hot ids can be split."""
    pairs = pairs.persist(StorageLevel.DISK_ONLY)
    sets = sieved(sets, "id", pairs.select("a").union(pairs.select("b")), "a")

    def start():
        def work(batch):
            view = lambda b: np.frombuffer(b, np.uint64)
            linked = [similar(view(x), view(y), percent) for x, y in zip(batch["words"], batch["other"], strict=True)]
            return {"src": [i for i, on in zip(batch["a"], linked, strict=True) if on], "dst": [i for i, on in zip(batch["b"], linked, strict=True) if on]}

        return work

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("words").alias("other")), "b").join(sets.select(F.col("id").alias("a"), "words"), "a")
    found = scratch.table(map_batches(both.select("a", "b", "words", "other"), start, "src bigint, dst bigint"))
    pairs.unpersist()
    return found


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links: components of the graph of components."""
    of = labels.select(F.col("node").alias("n"), "component")
    named = links.join(of, F.col("src") == F.col("n"), "left").select(F.coalesce("component", "src").alias("src"), "dst")
    named = named.join(of, F.col("dst") == F.col("n"), "left").select("src", F.coalesce("component", "dst").alias("dst"))
    more = connected_components(named)
    renamed = labels.join(more.select(F.col("node").alias("n"), F.col("component").alias("c")), F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"))
    merged = scratch.table(renamed.unionByName(more).groupBy("node").agg(F.min("component").alias("component")))
    scratch.drop(labels, more)
    return merged


def cell_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets (or within one): a spanning forest of them, by exact intersections."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(numbers.max() + 1, bool)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(left)):
        own = numbers[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[numbers], starts, dtype=np.int64)
        mark[own] = False
        hit = 100 * both >= percent * (sizes + sizes[i] - both)
        hit[: i + 1 if right is None else len(left)] = False
        for j in np.flatnonzero(hit):
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                out.append((i, int(j)))
    return out


def _cells(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """Links that the pivots leave open. members: key, id, words, linked; linked ones are the bucket's largest class.

    Members of other classes are compared with one another and with the largest class, in blocks of CELL or CELL_BYTES dealt by
    hash; the largest class needs no comparison within itself. Each cell is
    one pair of blocks, so a task holds two blocks however large the bucket is.
    """
    size = F.octet_length("words").cast("long")
    of = lambda on, x: F.sum(F.when(on, x).otherwise(F.lit(0).cast("long")))
    blocks = lambda on: F.ceil(F.greatest(of(on, F.lit(1).cast("long")) / CELL, of(on, size) / CELL_BYTES)).cast("int")
    counts = scratch.table(members.groupBy("key").agg(blocks(~F.col("linked")).alias("n_open"), blocks(F.col("linked")).alias("n_done")))
    dealt = members.join(counts, "key").withColumn("block", F.when(F.col("linked"), F.pmod(F.xxhash64("id"), F.greatest("n_done", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("n_open"))).cast("int"))
    opens = F.sequence(F.lit(0), F.col("n_open") - 1)
    # A cell (a, b): b < n_open is another open block, a <= b; above that, b - n_open is a block of linked members.
    cells = F.when(F.col("linked"), F.transform(opens, lambda a: F.struct(a.alias("a"), (F.col("n_open") + F.col("block")).alias("b"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(opens, lambda x: F.struct(F.least(x, F.col("block")).alias("a"), F.greatest(x, F.col("block")).alias("b"), F.when(x < F.col("block"), 1).otherwise(0).alias("side"))),
            F.when(F.col("n_done") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_done") - 1, F.lit(0))), lambda y: F.struct(F.col("block").alias("a"), (F.col("n_open") + y).alias("b"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<a:int,b:int,side:int>>")),
        )
    )
    spread = dealt.select("key", "id", "words", F.explode(cells).alias("c")).select("key", "c.a", "c.b", "c.side", "id", "words")

    def links(group: pa.Table) -> pa.Table:
        sides: dict[int, list] = {0: [], 1: []}
        for i, w, s in zip(group["id"].to_pylist(), group["words"].to_pylist(), group["side"].to_pylist(), strict=True):
            sides[s].append((i, np.frombuffer(w, np.uint64)))
        one, two = sides[0], sides[1]
        within = group["a"][0].as_py() == group["b"][0].as_py()
        if not one or not (two or within):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        found = cell_links([x for _, x in one], None if within else [x for _, x in two], percent)
        ids = [i for i, _ in one + two]
        return pa.table({"src": pa.array([ids[i] for i, _ in found], pa.int64()), "dst": pa.array([ids[j] for _, j in found], pa.int64())})

    ship_package(members.sparkSession)
    # Rows already lie by key, which would do for the grouping below: dealt anew, a bucket's cells go to many tasks.
    return spread.repartition("key", "a", "b").groupBy("key", "a", "b").applyInArrow(links, "src bigint, dst bigint")


def _classes(scratch: Scratch, nodes: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """node, component of the documents that are linked with others. nodes: rep, lead (the least id in its buckets), keys of its buckets."""
    links = _links(scratch, nodes.filter("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")), sets, percent)
    labels = connected_components(links)
    rest = None
    for n in range(rounds + 1):
        named = labels.select(F.col("node").alias("n"), "component")
        members = nodes if rest is None else rest
        own = members.join(named, F.col("rep") == F.col("n"), "left").withColumn("class", F.coalesce("component", "rep")).drop("n", "component")
        own = (own if rest is not None else own.select("rep", "lead", "class", F.explode("keys").alias("key"))).persist(StorageLevel.DISK_ONLY)
        counted = own.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "lead")).alias("r"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("h2"))
        open_ = counted.groupBy("key").agg(
            F.count(F.lit(1)).alias("classes"), F.min(F.struct("n", "class", "r")).alias("least"), F.max(F.struct("n", "class")).alias("most"),
            F.sum("n").alias("size"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"),
        ).filter("classes > 1")
        # Buckets of the same documents, told by two hashes that don't depend on order, are one. The next pivot is of the smallest class: it is compared with the larger ones.
        open_ = open_.groupBy("size", "h1", "h2").agg(F.min(F.struct("key", F.col("least.class").alias("own"), F.col("least.r.rep").alias("pivot"), F.col("least.r.lead").alias("pivot_lead"), F.col("most.class").alias("largest"))).alias("o"))
        open_ = open_.select("o.*").persist(StorageLevel.DISK_ONLY)
        here = None if open_.isEmpty() else scratch.table(own.join(open_, "key"))
        own.unpersist()
        open_.unpersist()
        scratch.drop(links)
        if here is None:
            break
        if n < rounds:
            # A document and its lead are compared already.
            pairs = here.filter("class != own and lead != pivot and pivot_lead != rep").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
            links = _links(scratch, pairs, sets, percent)
            rest = here.filter("rep != pivot").select("key", "rep", "lead")
        else:
            blocks = here.join(sets, F.col("rep") == F.col("id")).select("key", "id", "words", (F.col("class") == F.col("largest")).alias("linked"))
            links = scratch.table(_cells(scratch, scratch.table(blocks), percent))
        if not links.isEmpty():
            labels = _merged(scratch, labels, links)
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = 85, rows: int = ROWS, bands: int = BANDS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Texts with equal shingle sets are one class. Classes that share a band key are candidates; every
    link is confirmed on full sets. A pair at the threshold is missed by all bands with a probability
    of (1 - (percent / 100) ** rows) ** bands, 1.2e-6 by default; a lower percent needs fewer rows or more bands. Buckets of
    the same documents are handled once, by `rounds` rounds of pivots and then by blocks.

    Null and empty texts, or texts of white space, have no shingles and link with nothing. Rows that share
    an id are one node. Rows without an id link with nothing, have no component and are kept. Ties go
    to the smallest id. Very long texts are compared whole; two sets have to fit in a task. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.table(_signatures(source, width, rows, bands))
    reps = scratch.table(signed.filter("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = scratch.table(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).filter("size > 1").select("key", "first"))
    nodes = scratch.table(buckets.join(shared, "key").groupBy("rep").agg(F.min("first").alias("lead"), F.collect_list("key").alias("keys")))  # `bands` keys at most
    scratch.drop(shared)

    chosen = nodes.select(F.col("rep").alias("r"))
    found = _sets(sieved(source, "id", chosen, "r").join(chosen, F.col("id") == F.col("r"), "left_semi"), width)
    # Where rows share an id, the set that the class was made from counts.
    sets = scratch.table(found.join(reps.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"]).dropDuplicates(["id", "s1", "s2"]).select("id", "words"))
    final = _classes(scratch, nodes, sets, percent, rounds)
    classes = scratch.table(reps.select("s1", "s2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")))
    scratch.drop(reps, nodes, sets)
    # A component may hold rows that share an id with another class; the smallest id of a class stands for it.
    return signed.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
