"""Documents as bags of terms, counted in the row and numbered by chunk, so that no row for each document and term is shuffled.

A chunk is some documents of one task, about CHUNK words. Its distinct terms, sorted, are numbered from 0; a document holds these numbers and its counts. Only the
distinct terms of chunks meet, dealt by hash in SLICES and packed in a row for each chunk and slice, for the numbers of documents that hold them; only those
held by two documents or more come back to their chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.functions.text import content_words
from tidewatch.llm.batches import BATCH_BYTES, parse_schema
from tidewatch.sources.runtime import ship_package

CHUNK = 1 << 20  # words
SLICES = 1024
_RANK = 40  # bits of a term's number within its slice
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of documents have ids and packed sizes, terms and counts; a slice's row has the packed numbers, counts (of documents) and names of the chunk's terms in it.
BAGS = "chunk bigint, ids array<bigint>, sizes binary, slice int, held binary"
ROWS = 256  # documents of a row
SHARED = "chunk bigint, slice int, held binary"
VECTORS = "id bigint, terms array<bigint>, tfs array<int>, dfs array<int>, norm double, lead bigint, common double, chunk bigint"
WIDESPREAD = 256  # one document in so many has a widespread term
TOP = "id bigint, term string, rank int, v double"


def _small_batches(df: DataFrame) -> None:
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_ARROW, None) is None:
        df.sparkSession.conf.set(_ARROW, BATCH_BYTES)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of small integers, by bytes of one weight, and what follows, compressed."""
    body = [np.ascontiguousarray(c, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.compress(b"".join([len(columns[0]).to_bytes(4, "little"), *body, tail]))


def _unpack(blob: bytes, k: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4 + 4 * n * i).reshape(4, n).T).view("<i4").ravel() for i in range(k)], raw[4 + 4 * n * k :]


_FRONT = 16  # bytes of a name that may be its forerunner's


def _pack_names(local: np.ndarray, counts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> bytes:
    """Sorted names, each without what it begins with like the one before."""
    starts, front = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
    live = np.arange(1, len(sizes))
    for k in range(_FRONT):
        live = live[np.minimum(sizes[live], sizes[live - 1]) > k]
        live = live[data[starts[live] + k] == data[starts[live - 1] + k]]
        front[live] = k + 1
    kept = np.arange(len(data)) - np.repeat(starts, sizes) >= np.repeat(front, sizes)
    return _pack(np.diff(local, prepend=0), counts, sizes, front, tail=data[kept].tobytes())


def _names(sizes: np.ndarray, front: np.ndarray, tail: bytes) -> pa.Array:
    sizes, front = sizes.astype(np.int64), front.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data, kept = np.empty(ends[-1], np.uint8), np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) >= np.repeat(front, sizes)
    data[kept] = np.frombuffer(tail, np.uint8)
    for k in range(int(front.max(initial=0))):
        own = np.maximum.accumulate(np.where((front <= k) & (sizes > k), np.arange(len(sizes)), 0))
        lent = np.flatnonzero(front > k)
        data[ends[lent] + k] = data[ends[own[lent]] + k]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


def _held(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers within the chunk, counts and names of a slice's terms."""
    (steps, counts, sizes, front), tail = _unpack(blob, 4)
    return np.cumsum(steps), counts, _names(sizes, front, tail)


def _chunk(number: int, ids: pa.Array, parts: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk. parts: the word lists of each document; bigrams don't reach from one list to the next."""
    n, texts = len(ids), parts.flatten()
    part_of = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
    doc_of = np.repeat(np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy()), pc.list_value_length(texts).to_numpy())
    words = texts.flatten().cast(pa.large_string())
    within = np.flatnonzero(part_of[1:] == part_of[:-1])
    pairs = pc.binary_join_element_wise(words.take(pa.array(within)), words.take(pa.array(within + 1)), pa.scalar("_", pa.large_string()))
    coded = pa.concat_arrays([words, pairs]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    held, tfs = np.unique(np.concatenate([doc_of, doc_of[within]]) * max(len(names), 1) + rank[coded.indices.to_numpy()], return_counts=True)
    doc, term = np.divmod(held, max(len(names), 1))
    sizes, counts = np.bincount(doc, minlength=n), np.bincount(term, minlength=len(names))

    def rows(m: int, **given: pa.Array) -> pa.RecordBatch:
        given["chunk"] = pa.array(np.full(m, number), pa.int64())
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(m, f.type) for f in schema], schema=schema)

    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, n, ROWS):
        to = min(at + ROWS, n)
        one = slice(ends[at], ends[to])
        some = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), ids[at:to].cast(pa.int64()))
        yield rows(1, ids=some, sizes=pa.array([_pack(sizes[at:to])], pa.binary()), held=pa.array([_pack(np.diff(term[one], prepend=0), tfs[one])], pa.binary()))
    if not len(names):
        return
    slices = (hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % SLICES).astype(np.int64)
    by = np.argsort(slices, kind="stable")
    dealt, cuts = names.take(pa.array(by)), np.searchsorted(slices[by], np.arange(SLICES + 1))
    sizes, data = pc.binary_length(dealt).to_numpy(), np.frombuffer(dealt.buffers()[2], np.uint8)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    on = np.flatnonzero(np.diff(cuts))
    packed = [_pack_names(by[lo:hi], counts[by[lo:hi]], sizes[lo:hi], data[ends[lo] : ends[hi]]) for lo, hi in zip(cuts[on], cuts[on + 1], strict=True)]
    yield rows(len(on), slice=pa.array(on, pa.int32()), held=pa.array(packed, pa.binary()))


def bags(docs: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """BAGS of words and bigrams, to be written before it is used. Rows of one id are one document. most: documents of a chunk."""
    _small_batches(docs)
    # What explode_outer gives is computed once.
    words = docs.select(F.col(id_col).cast("bigint").alias("id"), F.explode_outer(F.array(content_words(F.col(text_col)))).alias("w"))
    ids = docs.select(F.col(id_col).alias("id"))
    if ids.groupBy("id").count().filter("count > 1").isEmpty():
        whole = words.select("id", F.array("w").alias("parts"))
    else:
        whole = words.groupBy("id").agg(F.collect_list("w").alias("parts"))
    schema = to_arrow_schema(parse_schema(BAGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, n_words, n_docs = TaskContext.get().partitionId() << 15, [], [], 0, 0
        for batch in batches:
            step = min(most or 256, 256)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                size = pc.sum(pc.list_value_length(some.column("parts").flatten())).as_py() or 0
                if n_docs and (n_words + size > CHUNK or n_docs + some.num_rows > (most or n_docs + some.num_rows)):
                    yield from _chunk(number, pa.concat_arrays(ids), pa.concat_arrays(parts), schema)
                    number, ids, parts, n_words, n_docs = number + 1, [], [], 0, 0
                ids.append(some.column("id"))
                parts.append(some.column("parts"))
                n_words, n_docs = n_words + size, n_docs + some.num_rows
        if n_docs:
            yield from _chunk(number, pa.concat_arrays(ids), pa.concat_arrays(parts), schema)

    return whole.mapInArrow(run, BAGS)


def chunk_terms(table: DataFrame) -> DataFrame:
    """(chunk, local, term, n): each chunk's terms, their numbers in it and how many of its documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("held"), strict=True):
                local, n, names = _held(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(local), chunk.as_py())), pa.array(local, pa.int32()), names.cast(pa.string()), pa.array(n, pa.int64())], names=["chunk", "local", "term", "n"])

    return table.filter("slice is not null").select("chunk", "held").mapInArrow(run, "chunk bigint, local int, term string, n bigint")


def shared_terms(table: DataFrame) -> DataFrame:
    """SHARED: of each chunk's terms in a slice those that two documents or more hold, packed: number in the chunk, in how many documents, number in the slice."""
    schema = to_arrow_schema(parse_schema(SHARED))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")  # numbers are the same if a lost task is repeated
        parts = [_held(x.as_py()) for x in group["held"]]
        sizes = [len(p[0]) for p in parts]
        code = pa.concat_arrays([p[2] for p in parts]).dictionary_encode().indices.to_numpy()
        df = np.bincount(code, np.concatenate([p[1] for p in parts])).astype(np.int64)
        rank, out = np.cumsum(df > 1) - 1, []
        for (local, _, _), own in zip(parts, np.split(code, np.cumsum(sizes)[:-1]), strict=True):
            kept = df[own] > 1
            out.append(_pack(np.diff(local[kept], prepend=0), df[own[kept]], rank[own[kept]]))
        return pa.table([group["chunk"], group["slice"], pa.array(out, pa.binary())], names=schema.names).cast(schema)

    return table.filter("slice is not null").select("chunk", "slice", "held").groupBy("slice").applyInArrow(run, SHARED)


def _documents(sizes: bytes, held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and all terms' numbers and counts in turn."""
    (steps, tfs), _ = _unpack(held, 2)
    return _unpack(sizes, 1)[0][0], np.cumsum(steps), tfs.astype(np.int64)


def document_terms(table: DataFrame) -> DataFrame:
    """(chunk, id, local, tf) for each document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, local, tf = _documents(batch.column("sizes")[at].as_py(), batch.column("held")[at].as_py())
                ids = batch.column("ids").slice(at, 1).flatten().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(local), batch.column("chunk")[at].as_py())), ids, pa.array(local, pa.int32()), pa.array(tf, pa.int32())], names=["chunk", "id", "local", "tf"])

    return table.filter("slice is null").select("chunk", "ids", "sizes", "held").mapInArrow(run, "chunk bigint, id bigint, local int, tf int")


def _weighed(table: DataFrame, n_docs: int, ddl: str, made, named: bool = False) -> DataFrame:
    """named: rows has the slices too. made(ids, doc, local, tf, df, term, weight, norm, rows) for each chunk; doc: of each entry, from 0 on; norm: of each document."""
    _small_batches(table)
    schema = to_arrow_schema(parse_schema(ddl))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.filter(pc.is_null(left["slice"]))
        parts = [_documents(x, y) for x, y in zip(docs["sizes"].to_pylist(), docs["held"].to_pylist(), strict=True)]
        sizes, local, tf = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3))
        ids, sizes = docs["ids"].combine_chunks().flatten().filter(pa.array(sizes > 0)), sizes[sizes > 0]
        df, term = np.ones((local.max() if len(local) else 0) + 1, np.int64), np.full((local.max() if len(local) else 0) + 1, -1, np.int64)
        for number, blob in zip(right["slice"].to_pylist(), right["held"].to_pylist(), strict=True):
            (steps, dfs, ranks), _ = _unpack(blob, 3)
            at = np.cumsum(steps)
            df[at], term[at] = dfs, (number << _RANK) + ranks.astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        weight = tf * (np.log((1 + n_docs) / (1 + df[local])) + 1)
        norm = np.sqrt(np.bincount(doc, weight * weight, minlength=len(sizes)))
        return pa.table(made(ids, doc, local, tf, df[local], term[local], weight, norm, left)).select(schema.names).cast(schema)

    rows = table if named else table.filter("slice is null")
    return rows.select("chunk", "ids", "sizes", "slice", "held").groupBy("chunk").cogroup(shared_terms(table).groupBy("chunk")).applyInArrow(run, ddl)


def vectors(table: DataFrame, n_docs: int) -> DataFrame:
    """VECTORS: each document's terms that another one holds too, by number; the norm is that of all its terms. Documents without terms have no row.

    lead: by the most widespread of these, greater if in more documents; common: the share of the widespread ones in the vector's length.
    """

    def made(ids, doc, local, tf, df, term, weight, norm, rows):
        kept = term >= 0
        sizes = np.bincount(doc[kept], minlength=len(ids))
        lead = np.zeros(len(ids), np.int64)
        np.maximum.at(lead, doc[kept], (df[kept] << 24) + term[kept] % 16_777_213)
        common = np.sqrt(np.bincount(doc, np.where(df * WIDESPREAD >= n_docs, weight, 0) ** 2, minlength=len(ids))) / norm
        return {"chunk": pa.array(np.full(len(ids), rows["chunk"][0].as_py() if len(ids) else 0)), "lead": pa.array(lead), "common": pa.array(common), "id": ids, "terms": _lists(term[kept], sizes, pa.int64()), "tfs": _lists(tf[kept], sizes, pa.int32()), "dfs": _lists(df[kept], sizes, pa.int32()), "norm": pa.array(norm)}

    return _weighed(table, n_docs, VECTORS, made)


def top_terms(table: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(id, term, rank, v): each document's k heaviest terms; v is a part of a vector of length 1. Those equal to nine places go by the term."""

    def made(ids, doc, local, tf, df, term, weight, norm, rows):
        v = weight / norm[doc]
        order = np.lexsort((local, -np.round(v, 9), doc))
        sizes = np.bincount(doc, minlength=len(ids))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best, rank = order[place < k], place[place < k] + 1
        held = [_held(x) for x in rows.filter(pc.is_valid(rows["slice"]))["held"].to_pylist()]
        names, at = (pa.concat_arrays([x[2] for x in held]), np.concatenate([x[0] for x in held])) if held else (pa.array([], pa.large_string()), np.zeros(0, np.int64))
        place_of = np.empty(len(at), np.int64)
        place_of[at] = np.arange(len(at))
        return {"id": ids.take(pa.array(doc[best])), "term": names.take(pa.array(place_of[local[best]])), "rank": pa.array(rank, pa.int32()), "v": pa.array(v[best])}

    return _weighed(table, n_docs, TOP, made, named=True)
