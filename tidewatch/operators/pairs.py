"""All pairs of documents that are alike or share a key, held against each other in blocks: no row for a candidate is ever shuffled.

Documents that share their most widespread term, and of these such as weigh alike in widespread terms, stand together in blocks of bounded size, packed in a row each.
Each pair of blocks is one step of a Cartesian product that reads the blocks' table. There the rare common terms are multiplied entry by entry; what the others can add
is bounded by the lengths of their parts of both vectors (Cauchy-Schwarz), and only pairs that can reach the threshold are multiplied in full. Time still
grows with the square of the number of documents, memory and disk don't: a task holds two blocks and BLOCK * BLOCK bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.batches import parse_schema
from tidewatch.operators.bags import VECTORS, _small_batches
from tidewatch.sources.runtime import Scratch

BLOCK, ENTRIES = 4096, 1 << 21  # documents and terms of a block, about
LEAST, SPREAD = 512, 8  # so many blocks, of so many documents at least, where one would do
DENSE = 1 / 1024  # a term that this part of a matrix's cells have in common is cheaper as a column
COLUMNS, PRODUCTS = 512, 1 << 16  # of a dense step; of a sparse one
RARE = 1 << 15  # one cell in so many has a rare term in common
PARTS = 12  # of the other terms, by frequency, each with a bound of its own
SLACK = 1e-5  # above what single precision can err
CROWDED = 1 / 64  # of a row's cells: beyond, whole rows are multiplied
ROWS, SINGLE = 1024, 1 << 20  # of a matrix in one step; cells and entries of single pairs in one step
PAIRS = "id1 bigint, id2 bigint, is_exact boolean, shared_parties boolean, sim double"
COUNTS = "exact bigint, others bigint"
PACKED = "block bigint, new boolean, held binary"


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from each start on, and which start each belongs to."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) + (starts - np.cumsum(sizes) + sizes)[which], which


class Incidence:
    """What documents hold, sorted by term: each of `terms` has the entries from its start to the next one's."""

    def __init__(self, lists: pa.ListArray, values: np.ndarray | None = None):
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        order = np.argsort(flat, kind="stable")
        terms, starts = np.unique(flat[order], return_index=True)
        docs = np.repeat(np.arange(len(sizes)), sizes)[order]
        self._set(len(sizes), terms, np.diff(np.append(starts, len(flat))), docs, np.ones(len(flat)) if values is None else values[order])

    def _set(self, n: int, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, values: np.ndarray) -> Incidence:
        self.n, self.terms, self.counts, self.docs, self.values = n, terms, counts, docs, values
        self.starts = np.cumsum(counts) - counts
        return self

    @classmethod
    def of(cls, *parts) -> Incidence:
        return cls.__new__(cls)._set(*parts)

    def only(self, docs: np.ndarray) -> Incidence:
        """Of these documents, numbered anew."""
        new = np.full(self.n, -1)
        new[docs] = np.arange(len(docs))
        number = new[self.docs]
        on = number >= 0
        counts = np.bincount(np.repeat(np.arange(len(self.terms)), self.counts)[on], minlength=len(self.terms))
        return Incidence.of(len(docs), self.terms[counts > 0], counts[counts > 0], number[on], self.values[on])

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the terms at these places, and which of `at` each belongs to."""
        return _spans(self.starts[at], self.counts[at])

    def lengths(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Of each document's entries for these terms, by part."""
        entry, which = self.entries(at)
        return np.sqrt(np.bincount(self.docs[entry] * PARTS + part[which], self.values[entry] ** 2, minlength=self.n * PARTS)).reshape(self.n, PARTS).astype(np.float32)

    def by_document(self, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the entries of these documents for these terms start, by document (others have none), and these: which of `at`, and the values."""
        entry, which = self.entries(at)
        wanted = np.zeros(self.n, bool)
        wanted[docs] = True
        kept = wanted[self.docs[entry]]
        entry, which = entry[kept], which[kept]
        held = self.docs[entry]
        order = np.argsort(held.astype(np.uint16) if self.n < 1 << 16 else held, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(held, minlength=self.n))]), which[order], self.values[entry[order]]


def _common(a: Incidence, b: Incidence) -> tuple[np.ndarray, np.ndarray]:
    """Places of common terms in both."""
    if len(a.terms) > len(b.terms):
        return _common(b, a)[::-1]
    at = np.searchsorted(b.terms, a.terms)
    at[at == len(b.terms)] = 0
    i = np.flatnonzero(b.terms[at] == a.terms) if len(b.terms) else np.zeros(0, np.int64)
    return i, at[i]


def _multiply(out: np.ndarray, a: Incidence, b: Incidence, i: np.ndarray, j: np.ndarray) -> None:
    """Adds each entry of a times all of b's of the same term, for the terms at i and j."""
    flat, step = out.reshape(-1), np.cumsum(a.counts[i] * b.counts[j]) // PRODUCTS
    for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(step)) + 1), len(step)]):
        if lo < hi:
            entry, which = a.entries(i[lo:hi])
            other, back = b.entries(j[lo:hi][which])
            left = entry[back]
            np.add.at(flat, a.docs[left] * b.n + b.docs[other], (a.values[left] * b.values[other]).astype(out.dtype))


def product(a: Incidence, b: Incidence) -> np.ndarray:
    """The sum over common terms of the values' products, for each document of a and each of b."""
    out = np.zeros((a.n, b.n))
    i, j = _common(a, b)
    dense = a.counts[i] * b.counts[j] > a.n * b.n * DENSE
    for at in range(0, int(dense.sum()), COLUMNS):
        sides = []
        for x, on in ((a, i[dense][at : at + COLUMNS]), (b, j[dense][at : at + COLUMNS])):
            entry, column = x.entries(on)
            m = np.zeros((x.n, len(on)))
            m[x.docs[entry], column] = x.values[entry]
            sides.append(m)
        out += sides[0] @ sides[1].T
    _multiply(out, a, b, i[~dense], j[~dense])
    return out


def possible(a: Incidence, b: Incidence, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells can reach the threshold: some that don't, and all that do. i, j: places of the common terms."""
    cells = a.counts[i] * b.counts[j]
    rare = cells * RARE <= a.n * b.n
    sums = np.zeros((a.n, b.n), np.float32)
    _multiply(sums, a, b, i[rare], j[rare])
    i, j, cells = i[~rare], j[~rare], cells[~rare]
    part = np.minimum(np.log2(np.maximum(cells * (RARE / (a.n * b.n)), 1)).astype(np.int64), PARTS - 1)
    left, right = a.lengths(i, part), b.lengths(j, part)
    out = np.empty((a.n, b.n), bool)
    for at in range(0, a.n, ROWS):
        one = slice(at, at + ROWS)
        sums[one] += left[one] @ right.T
        np.greater_equal(sums[one], threshold - SLACK, out=out[one])
    return out


def single(a: Incidence, b: Incidence, i: np.ndarray, j: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """What product() has for these cells, sorted by row, one by one. Of each, the document of b is read entry by entry: the side with fewer."""
    if np.bincount(a.docs, minlength=a.n)[rows].sum() < np.bincount(b.docs, minlength=b.n)[columns].sum():
        order = np.argsort(columns, kind="stable")
        out = np.empty(len(rows))
        out[order] = _single(b, a, j, i, columns[order], rows[order])
        return out
    return _single(a, b, i, j, rows, columns)


def _single(a: Incidence, b: Incidence, i: np.ndarray, j: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    starts, term, value = a.by_document(i, rows)
    others, other_term, other_value = b.by_document(j, columns)
    sizes, out = np.diff(others)[columns], np.empty(len(rows))
    some, first = np.unique(rows, return_index=True)
    many = max(1, min(len(some), SINGLE // max(len(i), 1)))
    held = np.zeros((many, len(i)))
    for at in range(0, len(some), many):
        own, first_at, last = some[at : at + many], first[at], first[at + many] if at + many < len(some) else len(rows)
        entry, row = _spans(starts[own], starts[own + 1] - starts[own])
        held[row, term[entry]] = value[entry]
        step = np.cumsum(sizes[first_at:last]) // SINGLE
        for lo, hi in pairwise(first_at + np.array([0, *(np.flatnonzero(np.diff(step)) + 1), last - first_at])):
            other, cell = _spans(others[columns[lo:hi]], sizes[lo:hi])
            row_of = np.searchsorted(own, rows[lo:hi]) * len(i)
            out[lo:hi] = np.bincount(cell, held.reshape(-1)[row_of[cell] + other_term[other]] * other_value[other], minlength=hi - lo)
        held[row, term[entry]] = 0
    return out


def alike(a: Incidence, b: Incidence, threshold: float, also: np.ndarray | None = None, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and sums of the cells that reach the threshold, and of those in `also`; all within `within`."""
    i, j = _common(a, b)
    maybe = possible(a, b, i, j, threshold)
    if also is not None:
        maybe |= also
    if within is not None:
        maybe &= within
    crowded = np.flatnonzero(np.count_nonzero(maybe, axis=1) > b.n * CROWDED)
    columns = np.flatnonzero(maybe[crowded].any(axis=0))
    right = b.only(columns) if len(columns) else None
    for at in range(0, len(crowded), ROWS):
        rows = crowded[at : at + ROWS]
        sums = product(a.only(rows), right)
        hit = maybe[rows][:, columns]
        hit &= sums >= threshold if also is None else (sums >= threshold) | also[rows][:, columns]
        r, c = np.nonzero(hit)
        yield rows[r], columns[c], sums[r, c]
    maybe[crowded] = False
    rows, columns = np.nonzero(maybe)
    if len(rows):
        sums = single(a, b, i, j, rows, columns)
        hit = sums >= threshold if also is None else (sums >= threshold) | also[rows, columns]
        yield rows[hit], columns[hit], sums[hit]


_KINDS = ("<i8", "<f8", "<i8", "<i4", "<i4", "<u2", "<i4", "<i8", "<i4", "<u2", "<i8", "<i4", "<u2")


def pack_block(docs: pa.Table) -> bytes:
    """Documents' ids and norms; their terms with counts and frequencies, and entries by term; keys of both kinds likewise. By bytes of one weight, compressed."""
    column = lambda name: docs[name].combine_chunks()
    columns = [column("id").to_numpy(), column("norm").to_numpy()]
    for name in ("terms", "exact", "parties"):
        lists = column(name)
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        order = np.argsort(flat, kind="stable")
        terms, starts = np.unique(flat[order], return_index=True)
        columns += [np.diff(terms, prepend=0), np.diff(np.append(starts, len(flat)))]
        columns += [column("dfs").flatten().to_numpy()[order][starts]] if name == "terms" else []
        columns += [np.repeat(np.arange(len(sizes)), sizes)[order]]
        columns += [column("tfs").flatten().to_numpy()[order]] if name == "terms" else []
    body = [np.ascontiguousarray(x, k).view(np.uint8).reshape(len(x), np.dtype(k).itemsize).T.tobytes() for x, k in zip(columns, _KINDS, strict=True)]
    return zstandard.compress(b"".join([np.array([len(x) for x in columns], "<i8").tobytes(), *body]), 1)


class Block:
    def __init__(self, held: bytes, n_docs: int):
        raw = zstandard.decompress(held)
        columns, at = [], 8 * len(_KINDS)
        for n, kind in zip(np.frombuffer(raw, "<i8", len(_KINDS)), map(np.dtype, _KINDS), strict=True):
            columns.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel())
            at += n * kind.itemsize
        self.ids, norms, steps, counts, dfs, docs, tfs, *keys = columns
        docs, counts = docs.astype(np.int64), counts.astype(np.int64)
        v = tfs * np.repeat(np.log((1 + n_docs) / (1 + dfs.astype(np.int64))) + 1, counts) / norms[docs]
        self.terms = Incidence.of(len(self.ids), np.cumsum(steps), counts, docs, v)
        self.keys = [Incidence.of(len(self.ids), np.cumsum(x), y.astype(np.int64), z.astype(np.int64), np.ones(len(z))) for x, y, z in (keys[:3], keys[3:])]


def _met(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    exact, parties = (product(x, y) > 0 if len(x.terms) and len(y.terms) else None for x, y in zip(a.keys, b.keys, strict=True))
    also = parties if exact is None else exact if parties is None else exact | parties
    for i, j, sims in alike(a.terms, b.terms, threshold, also, a.ids[:, None] < b.ids[None, :] if same else None):
        of = lambda m: np.zeros(len(i), bool) if m is None else m[i, j]  # noqa: B023, E731
        yield a.ids[i], b.ids[j], of(exact), of(parties), sims


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int, entries: int) -> Iterator[pa.RecordBatch]:
    """PACKED of a task's documents in their order; no block has both new ones and others."""
    number, kept, n, held = TaskContext.get().partitionId() << 32, [], 0, 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, kept[0]["new"][0].as_py(), pack_block(pa.Table.from_batches(kept))), schema, strict=True)], schema=schema)

    for batch in batches:
        sizes = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in ("terms", "exact", "parties"))
        fresh, lo = batch.column("new").to_numpy(zero_copy_only=False), 0
        for at in range(batch.num_rows):
            if n and (n >= most or held + sizes[at] > entries or fresh[at] != before):
                kept += [batch.slice(lo, at - lo)] if at > lo else []
                yield packed()
                number, kept, n, held, lo = number + 1, [], 0, 0, at
            n, held, before = n + 1, held + sizes[at], fresh[at]
        kept.append(batch.slice(lo))
    if n:
        yield packed()


def block_pairs(vectors: DataFrame, n_docs: int, threshold: float, exact: DataFrame | None = None, parties: DataFrame | None = None, new: Column | None = None, counts: bool = False, block: int = BLOCK) -> DataFrame:
    """PAIRS, id1 < id2, with a cosine of the threshold or more, or a key in common; counts: instead COUNTS of these that share an exact key or not, in several rows.

    vectors: VECTORS, one row for each id; exact, parties: (id, key), of ids with or without a vector. new: a condition on a row of vectors that one of each pair meets.
    """
    spark = vectors.sparkSession
    _small_batches(vectors)
    scratch = Scratch(spark, "blocks")
    docs = vectors.filter("id is not null")
    for name, keys in (("exact", exact), ("parties", parties)):
        if keys is None:
            docs = docs.withColumn(name, F.array().cast("array<bigint>"))
            continue
        given = keys.filter("id is not null and key is not null")
        # A key of one id links nothing.
        shared = given.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
        # Keys by number; written, so that a lost task doesn't number anew.
        numbered = scratch.table(shared.select("key", F.monotonically_increasing_id().alias("number")))
        own = given.join(numbered, "key").groupBy("id").agg(F.collect_set("number").alias(name))
        docs = docs.join(own, "id", "full")
    no = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    docs = docs.select("id", no("terms", "array<bigint>"), no("tfs", "array<int>"), no("dfs", "array<int>"), F.coalesce("norm", F.lit(1.0)).alias("norm"), no("exact", "array<bigint>"), no("parties", "array<bigint>"), "lead", "common", (F.lit(True) if new is None else F.coalesce(new, F.lit(False))).alias("new"))
    docs = scratch.table(docs)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms") + F.size("exact") + F.size("parties")).alias("entries")).first()
    most = math.ceil(max(1, block) * 1.5), math.ceil(ENTRIES * 1.5)  # ranges are of about one size
    n_blocks = max(1, math.ceil(total["n"] / block), math.ceil((total["entries"] or 0) / ENTRIES), min(SPREAD, math.ceil(total["n"] / LEAST)))
    # New documents come before the others; the first of each pair of blocks is one of theirs.
    order = [F.col("new").desc(), F.col("lead").desc_nulls_last(), F.col("common"), F.col("id")]
    packing = to_arrow_schema(parse_schema(PACKED))
    packed = docs.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order).mapInArrow(lambda x: _blocks(x, packing, *most), PACKED)
    where = f"{scratch.root}/blocks"
    packed.write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(where)
    scratch.drop(docs)
    held = spark.read.schema(PACKED).parquet(where)
    a, b = (held.select(*(F.col(c).alias(f"{c}{k}") for c in held.columns)).hint("shuffle_replicate_nl") for k in (1, 2))
    met = a.join(b, (F.col("block1") <= F.col("block2")) & F.col("new1"))
    schema = to_arrow_schema(parse_schema(COUNTS if counts else PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                lo, hi = batch.column("block1")[at].as_py(), batch.column("block2")[at].as_py()
                if number != lo:
                    number, left = lo, Block(batch.column("held1")[at].as_py(), n_docs)
                right = left if lo == hi else Block(batch.column("held2")[at].as_py(), n_docs)
                for id1, id2, is_exact, shared, sim in _met(left, right, lo == hi, threshold):
                    if counts:
                        found = [np.array([is_exact.sum()]), np.array([(~is_exact).sum()])]
                    else:
                        found = [np.minimum(id1, id2), np.maximum(id1, id2), is_exact, shared, sim]
                    whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)
                    for k in range(0, whole.num_rows, 65_536):
                        yield whole.slice(k, 65_536)
                right = whole = None
            pa.default_memory_pool().release_unused()

    return met.select("block1", "held1", "block2", "held2").mapInArrow(run, COUNTS if counts else PAIRS)
