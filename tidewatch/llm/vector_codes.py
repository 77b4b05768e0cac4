"""Compression of vectors to codes: product quantisation over integers, with a vantage-point tree for each part position.

A vector's components become whole numbers and are cut into parts; each part is replaced by the index of the
nearest entry of its position's codebook. Entries stand in a vantage-point tree: a node has one entry as vantage
point and two subtrees with the least and the greatest distance of their entries to it. A search goes down with a batch of
parts at a time and leaves out a subtree only for those parts to which, by the triangle inequality, none of its entries
can be as near as the best one found. Radii and distances are rounded outwards and the comparison isn't strict, so
rounding can't lose an entry; what decides is the squared distance in whole numbers, then the lower index.

Codebooks are the only thing that goes through the driver: 64 entries of one vector's length, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.runtime import Scratch, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4  # entries of a leaf
LARGEST = 1 << 55  # components at least as far from 0 have no integer here
BATCH = 4096
_SLACK = 2.0**-50  # of a square root of a whole number, and of a difference of two


def _down(x):
    return x * (1 - _SLACK)


def _up(x):
    return x * (1 + _SLACK)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


class VantageTree:
    """The entries of one codebook; its search gives the nearest, the lowest index of equals."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._grown(np.arange(len(entries)))

    def _grown(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        vantage, rest = ids[0], ids[1:]
        d = _root(_squares(self.entries[rest], self.entries[vantage]))
        order = np.argsort(d, kind="stable")
        children = []
        for half in np.array_split(order, 2):
            children.append((_down(d[half].min()), _up(d[half].max()), self._grown(np.sort(rest[half]))))
        return vantage, children

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of x."""
        self._x = x
        self._index = np.zeros(len(x), np.int64)
        self._best = _squares(x, self.entries[0])
        self._search(self.top, np.arange(len(x)))
        return self._index, self._best

    def _offer(self, entry: int, rows: np.ndarray) -> np.ndarray:
        d2 = _squares(self._x[rows], self.entries[entry])
        best = self._best[rows]
        won = (d2 < best) | ((d2 == best) & (entry < self._index[rows]))
        self._best[rows[won]] = d2[won]
        self._index[rows[won]] = entry
        return d2

    def _search(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._offer(entry, rows)
            return
        vantage, (near, far) = node
        d = _root(self._offer(vantage, rows))
        inside = d <= near[1]
        for some, order in ((inside, (near, far)), (~inside, (far, near))):
            part, away = rows[some], d[some]
            for least, most, child in order:
                gap = _down(np.maximum(_down(away) - most, least - _up(away)))
                self._search(child, part[gap <= _up(_root(self._best[part]))])


def _bounds(length: int, parts: int) -> list[tuple[int, int]]:
    width = -(-length // parts)
    return [(min(i * width, length), min((i + 1) * width, length)) for i in range(parts)]


class Codec:
    """Trees over the codebooks of all part positions. books: entries by components, whole numbers."""

    def __init__(self, books: np.ndarray, parts: int):
        self.books, self.bounds = books, _bounds(books.shape[1], parts)
        self.widest = int(np.abs(books).max(initial=0))
        self.trees = self._trees(books)

    def _trees(self, books: np.ndarray) -> list[VantageTree]:
        return [VantageTree(np.ascontiguousarray(books[:, a:b])) for a, b in self.bounds]

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes by part, summed squared distances) of rows of whole numbers."""
        largest = max(self.widest, int(np.abs(x).max(initial=0)))
        if 4 * largest * largest * max(1, x.shape[1]) >= 1 << 62:  # sums of squares could pass 64 bits: Python's own integers
            x = x.astype(object)
            trees = self._trees(self.books.astype(object))
        else:
            trees = self.trees
        codes, error = np.empty((len(x), len(trees)), np.int64), 0
        for i, (tree, (a, b)) in enumerate(zip(trees, self.bounds, strict=True)):
            codes[:, i], d2 = tree.nearest(x[:, a:b])
            error = error + d2
        return codes, error


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(which rows aren't null, the lengths of those, their elements)."""
    there = column.is_valid()
    held = column.filter(there)
    return there.to_numpy(zero_copy_only=False), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64), held.flatten()


def _per_row(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether any element of each list is flagged."""
    upto = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths] > 0


def _wholes(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, v: whole numbers of each vector that is there and finite; null where they are too large for 64 bits."""
    schema = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, lengths, flat = _lists(batch.column("v"))
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            fine = ~_per_row(~np.isfinite(x), lengths)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
                small = np.abs(x) < LARGEST
                whole = np.where(small, x, 0).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            fits = ~_per_row(~small, lengths)
            v = pa.ListArray.from_arrays(offsets, pa.array(whole, pa.int64()), mask=pa.array(~fits))
            keep = np.flatnonzero(there)[fine]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), batch.column("label").take(pa.array(keep)), v.take(pa.array(np.flatnonzero(fine)))], names=["id", "label", "v"])

    return rows.mapInArrow(run, f"id bigint, label {schema}, v array<bigint>")


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces, with the rows that have vectors of the length and those vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            usable = pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), length), False)
            x = batch.column("v").filter(usable).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            picked = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
            yield batch, picked, x.reshape(len(picked), length)


def _sums(rows: DataFrame, codec: Codec, length: int) -> DataFrame:
    """(entry, pos, n, total) of each task: how many parts an entry has got, and the sums of their components, as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(codec.books)
        totals, counts = np.zeros((k, length), object), np.zeros((k, len(codec.bounds)), np.int64)
        for _, _, x in _matrices(batches, length):
            codes, _ = codec.assigned(x)
            for i, (a, b) in enumerate(codec.bounds):
                counts[:, i] += np.bincount(codes[:, i], minlength=k)
                # A batch's sum fits in 64 bits: 2^12 rows of numbers below 2^51; larger ones are added as Python's integers.
                part = x[:, a:b] if not len(x) or int(np.abs(x).max()) < 1 << 51 else x[:, a:b].astype(object)
                some = np.zeros((k, b - a), part.dtype)
                np.add.at(some, codes[:, i], part)
                totals[:, a:b] += some.astype(object)
        entry, pos = np.nonzero(np.repeat(counts, [b - a for a, b in codec.bounds], axis=1))
        part = np.searchsorted(np.array([b for _, b in codec.bounds]), pos, side="right")
        yield pa.RecordBatch.from_arrays(
            [pa.array(entry, pa.int32()), pa.array(pos, pa.int32()), pa.array(counts[entry, part], pa.int64()), pa.array([str(t) for t in totals[entry, pos]], pa.string())], names=["entry", "pos", "n", "total"]
        )

    found = rows.select("v").mapInArrow(run, "entry int, pos int, n bigint, total string")
    return found.groupBy("entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _coded(rows: DataFrame, codec: Codec | None, length: int) -> DataFrame:
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, picked, x in _matrices(batches, length):
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if codec is not None and len(picked):
                codes, found = codec.assigned(x)
                text = codes.astype(np.uint8).tobytes().hex()
                wide = 2 * codes.shape[1]
                code[picked] = [text[i : i + wide] for i in range(0, len(text), wide)]
                error[picked] = [int(e) if int(e) < 1 << 63 else None for e in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id bigint, label {label}, code string, error bigint")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    on_books: Callable[[np.ndarray], None] | None = None,
) -> DataFrame:
    """One row for each vector that is there and has no null or non-finite component: id, code, error, label_error, codebooks_sha256.

    Vectors must be arrays of numbers. Codebooks start as the vectors of the least ids (of equal ids the least vectors; null ids come last) and
    have fewer entries where there are fewer vectors; repeated rows count each. The length of vectors is the commonest one, the greater of equals; vectors of other lengths, and those with a component of
    2^47 or more, keep their row with a null code and error and teach the codebooks nothing. A length that the number of parts doesn't
    divide leaves the last parts shorter, or empty (code 0). An error of 2^63 or more is null. Equal labels, nulls together, share a label_error, null where none
    of their vectors has an error. An empty table gives an empty result; other columns are ignored. At most 256 entries. on_books gets the final codebooks.
    """
    if entries > 256:
        raise ValueError("a code has two digits a part")
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "codes")
    rows = scratch.table(_wholes(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), scale))
    size = rows.filter("v is not null").groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    codec, length, digest = None, 0, hashlib.sha256(b"").hexdigest()
    if size is not None:
        length = size["size"]
        first = rows.filter(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books = np.array([r["v"] for r in first], np.int64).reshape(len(first), length)
        for _ in range(rounds):
            # As many rows as the codebooks have numbers.
            for r in _sums(rows, Codec(books, parts), length).toLocalIterator():
                books[r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        codec = Codec(books, parts)
        digest = hashlib.sha256(",".join(str(v) for a, b in codec.bounds for v in books[:, a:b].ravel()).encode()).hexdigest()
        if on_books is not None:
            on_books(books)
    coded = scratch.table(_coded(rows, codec, length))
    scratch.drop(rows)
    totals = scratch.table(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "l")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("l"))).select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
