"""Substring dedup: passages of many words that also stand in an earlier document, by prefix-partitioned suffix trees.

Of every window of `window` words one position is its anchor: the leftmost of those whose short word sequence (the prefix) has the least
hash. The anchor depends on the window's words alone, so equal windows have it at the same place, and only suffixes at anchors, a
few in a hundred, have to be compared. A prefix of a single document can't be part of a repeat and is left out.

The others split the suffixes into groups, of which many fit in one task's memory. A group's suffixes, sorted, with the lengths of
their common beginnings, are its suffix tree: a common beginning of d words or more over a run of suffixes is an internal node of depth d. The same is done for
the words before the anchors, read backwards. A window that starts o words before its anchor repeats where the tree to the left has a node
of depth o, and the tree to the right one of depth window - o, over the same suffixes; the least document below both nodes holds the
window first.

Groups of more than `most` suffixes are dealt in blocks of about that size, and each block gets its tree. All but the first holders of a
window in a block are settled there; for the first ones the prefix grows to the whole window: then a group is a single node, and what it needs is
a minimum, which is combined before the shuffle. So no passage is too common. Trees compare the words themselves; whole windows of different blocks are equal if their SHA-256 is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import ROWS, map_batches
from tidewatch.llm.near_dedup import WordHashes, _mix
from tidewatch.llm.sieve import sieve
from tidewatch.llm.text import text_or_empty
from tidewatch.sources.runtime import Scratch, ship_package

WINDOW = 50
MOST = 2048  # suffixes of a group or block that a tree is built for
TREE = 8192  # suffixes at which a task stops taking more groups into one round of trees
LONG = 32  # bytes of a word; longer ones are compared by their SHA-256 in hexadecimal digits

_ANCHORS = "id bigint, th bigint, key bigint, at int, first int, last int"
_CONTEXTS = "key bigint, blocks int, block int, id bigint, th bigint, first int, before int, words binary"
_SPANS = "id bigint, th bigint, a int, b int, whole binary"


def prefix_length(window: int) -> int:
    return max(1, window // 6)


def words_of(text: str) -> list[bytes]:
    """bytes.split knows exactly the white space of the contract."""
    return text.encode("utf-8", "surrogatepass").split()


def prefix_hashes(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return _mix(out)


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least hash in every run of width places."""
    n = len(hashes) - width + 1
    least, place, span = hashes, np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        a, b = least[: len(least) - step], least[step:]
        later = b < a
        least, place = np.where(later, b, a), np.where(later, place[step:], place[: len(place) - step])
        span += step
    return place[:n]


def windows_of(words: list[bytes], hashes: WordHashes, window: int) -> tuple[np.ndarray, ...] | None:
    """(key, at, first, last) of each anchor: hash of its prefix, its place, and the first and last starts of the windows it belongs to."""
    if len(words) < window:
        return None
    k = prefix_length(window)
    h = prefix_hashes(words, hashes, k)
    at = anchors(h, window - k + 1)
    change = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(at)]]) - 1
    return h[at[first]].view(np.int64), at[first], first, last


def _anchors_of(docs: DataFrame, window: int) -> DataFrame:
    """_ANCHORS of id, th, text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found, row = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    got = windows_of(words_of(text), hashes, window)
                    if got is not None:
                        found.append(got)
                        row.append((i, len(got[0])))
                if not found:
                    continue
                own = pa.array(np.repeat([i for i, _ in row], [n for _, n in row]))
                key, place, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                ids, ths = batch.column("id").take(own), batch.column("th").take(own)
                yield pa.RecordBatch.from_arrays([ids, ths, pa.array(key), *(pa.array(c.astype(np.int32)) for c in (place, first, last))], names=["id", "th", "key", "at", "first", "last"])

    return docs.mapInArrow(run, _ANCHORS)


def _shortened(word: bytes) -> bytes:
    return word if len(word) <= LONG else hashlib.sha256(word).hexdigest().encode()


def _contexts(docs: DataFrame, window: int) -> DataFrame:
    """_CONTEXTS of id, th, text, marks: for each anchor the words of all its windows."""

    def start():
        def work(batch):
            out = {c: [] for c in ("key", "blocks", "block", "id", "th", "first", "before", "words")}
            for i, th, text, marks in zip(batch["id"], batch["th"], batch["text"], batch["marks"], strict=True):
                words = list(map(_shortened, words_of(text)))
                for m in marks:
                    row = (m["key"], m["blocks"], m["block"], i, th, m["first"], m["at"] - m["first"], b" ".join(words[m["first"] : m["last"] + window]))
                    for c, v in zip(out.values(), row, strict=True):
                        c.append(v)
            return out

        return work

    return map_batches(docs, start, _CONTEXTS, rows=16)


class Tree:
    """Sorted rows of integers and the lengths of common beginnings of neighbours."""

    def __init__(self, rows: np.ndarray):
        wide = np.ascontiguousarray(rows.astype(">u4"))
        self.order = np.argsort(wide.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
        ordered = rows[self.order]
        apart = ordered[1:] != ordered[:-1]
        self.common = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the node at this depth above it."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.common < depth)])
        return out


def repeats(keys: np.ndarray, ids: np.ndarray, before: np.ndarray, contexts: list[bytes], window: int) -> np.ndarray:
    """rows by starts: whether the window at each start of a row's context stands in a row of the same key and a smaller id.

    before: words of the context before its anchor. Starts that a context doesn't have are false.
    """
    n, k = len(keys), prefix_length(window)
    split = [c.split(b" ") for c in contexts]
    lengths = np.fromiter(map(len, split), np.int64, n)
    names: dict[bytes, int] = {}
    flat = np.fromiter((names.setdefault(w, len(names) + 1) for ws in split for w in ws), np.int64, int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    _, group = np.unique(keys, return_inverse=True)

    def matrix(offset: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """The group, then the words at these places of the contexts; 0 beyond them."""
        got = np.where(valid, flat[np.clip(begin[:, None] + offset, 0, len(flat) - 1)], 0)
        return np.concatenate([group[:, None] + 1, got], axis=1)

    ahead = before[:, None] + np.arange(window)[None, :]
    right = Tree(matrix(ahead, ahead < lengths[:, None]))
    back = before[:, None] - 1 - np.arange(window - k)[None, :]
    left = Tree(matrix(back, back >= 0))
    by_id = np.argsort(ids, kind="stable")
    out = np.zeros((n, window - k + 1), bool)
    starts = lengths - window + 1
    for o in range(window - k + 1):
        rows = by_id[(before[by_id] >= o) & (before[by_id] - o < starts[by_id])]
        if len(rows) < 2:
            continue
        # Depths count the group as one more.
        node = right.nodes(window - o + 1)[rows] * n + left.nodes(o + 1)[rows]
        order = np.argsort(node, kind="stable")  # within a node by id
        new = np.concatenate([[True], np.diff(node[order]) != 0])
        least = ids[rows[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        again = rows[order][ids[rows[order]] > least]
        out[again, before[again] - o] = True
    return out


def _tree_spans(contexts: DataFrame, window: int, tree: int) -> DataFrame:
    """_SPANS that trees find; with whole, the windows that are the first of their block. Partitions must hold whole blocks, sorted by key and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, step = 0, min(ROWS, tree)

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            column = lambda c: table[c].to_numpy()
            ids, ths, first, contexts = column("id"), column("th"), column("first"), table["words"].to_pylist()
            new = np.concatenate([[True], (np.diff(column("key")) != 0) | (np.diff(column("block")) != 0)])
            found = repeats(np.cumsum(new), ids, column("before").astype(np.int64), contexts, window)
            edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, a = np.nonzero(edges == 1)
            _, b = np.nonzero(edges == -1)
            yield spans(ids[row], ths[row], first[row] + a, first[row] + b - 1 + window, [None] * len(row))
            for i in np.flatnonzero(column("blocks") > 1):
                words = contexts[i].split(b" ")
                open_ = [w for w in range(len(words) - window + 1) if not found[i, w]]
                if open_:
                    at = np.array(open_) + first[i]
                    yield spans(np.repeat(ids[i], len(at)), np.repeat(ths[i], len(at)), at, at + window, [hashlib.sha256(b" ".join(words[w : w + window])).digest() for w in open_])

        def spans(ids, ths, a, b, whole) -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(whole, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "th", "a", "b", "whole"])

        def last(batch: pa.RecordBatch, i: int) -> tuple:
            return batch["key"][i].as_py(), batch["block"][i].as_py()

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if size >= tree and last(held[-1], -1) != last(batch, 0):
                    yield from solved(pa.Table.from_batches(held))
                    held, size = [], 0
                elif size >= tree:  # the block at hand goes on: all before it can be solved
                    table = pa.Table.from_batches(held)
                    key, block = last(held[-1], -1)
                    cut = int(np.argmax((table["key"].to_numpy() == key) & (table["block"].to_numpy() == block)))
                    if cut:
                        yield from solved(table.slice(0, cut))
                        held = table.slice(cut).combine_chunks().to_batches()
                        size = sum(b.num_rows for b in held)
                held.append(batch)
                size += batch.num_rows
            pa.default_memory_pool().release_unused()
        if held:
            yield from solved(pa.Table.from_batches(held))

    return contexts.mapInArrow(run, _SPANS)


def _kept(docs: DataFrame) -> DataFrame:
    """id, n_words, n_removed, kept_text of id, text, spans."""

    def start():
        def work(batch):
            out = {"id": batch["id"], "n_words": [], "n_removed": [], "kept_text": []}
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words = words_of(text)
                left = words
                if spans:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [s["a"] for s in spans], 1)
                    np.add.at(cover, [s["b"] for s in spans], -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept_text"].append(b" ".join(left).decode("utf-8", "surrogatepass"))
            return out

        return work

    return map_batches(docs, start, "id bigint, n_words bigint, n_removed bigint, kept_text string", rows=16)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = MOST, tree: int = TREE) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_text (the kept words joined by one space).

    Words are runs of characters other than ASCII white space, taken as they are. A word goes if it is in a window of that many words whose sequence also
    starts in a document with a smaller id; what an earlier document itself loses doesn't matter. Null and empty texts have no words. Rows that share an id are one document: they don't
    take words from each other, and repeated rows come out alike. Rows without an id own and lose nothing. Texts are taken whole: a long one has
    a row for each of its anchors and gathers its own marks. An empty table gives an empty result; other columns are ignored.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "repeats")
    # Rows that share an id but not a text are told apart by a hash of the text.
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found = scratch.table(_anchors_of(rows.filter("id is not null"), window))
    shared = scratch.table(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").select("key", "n"))
    blocks = F.ceil(F.col("n") / most).cast("int")
    mark = F.struct("key", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "th", "at"), blocks).cast("int").alias("block"), "at", F.col("first").alias("first"), "last")
    marks = scratch.table(found.join(shared, "key").groupBy("id", "th").agg(F.collect_set(mark).alias("marks")))
    scratch.drop(found, shared)
    candidates = rows.filter(F.col("id").isNotNull() & sieve(marks, "id")(F.col("id")))
    contexts = _contexts(candidates.join(marks, ["id", "th"]), window)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = scratch.table(_tree_spans(contexts.repartition(n, "key", "block").sortWithinPartitions("key", "block"), window, tree))
    scratch.drop(marks)
    firsts = again.filter("whole is not null")
    owners = firsts.groupBy("whole").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").select("whole", "least")
    late = firsts.join(owners, "whole").filter("id > least")
    every = again.filter("whole is null").select("id", "th", "a", "b").unionByName(late.select("id", "th", "a", "b"))
    spans = scratch.table(every.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    scratch.drop(again)
    touched = sieve(spans, "id")(F.col("id"))
    some = rows.filter(F.col("id").isNotNull() & touched).join(spans, ["id", "th"], "left").select("id", "text", "spans")
    none = rows.filter(F.col("id").isNull() | ~touched).select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return _kept(some.unionByName(none))
