"""Leader clustering: in order, a record joins the first leader that it resembles enough, or becomes a leader.

Which records lead depends on the order alone, so it is worked out in rounds. A round takes the first open records, a block of a bounded
size, and finds the leaders among them; all open records have been held against every earlier leader by then. The new leaders go to
all tasks, which hold the open records against them; records that find one are settled. So each record is compared with leaders only,
never with all others, whatever the size of a cluster. Records of the same content are one from the start.

The likeness of titles is costly, so it is bounded first: by the lengths, then by the characters that two titles share. Both bounds are
never below the likeness itself, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.runtime import Scratch, ship_package

THRESHOLD = 0.52
TITLE, WORDS, PARTY = 0.5, 0.35, 0.15  # fixed weights
BLOCK, LARGEST, BLOCK_BYTES = 1024, 32_768, 16 << 20  # records of the first block and of any later one, and bytes of their texts
CHUNK = 512

_RECORDS = "digest binary, id bigint, title string, words array<string>, parties array<string>, size bigint"


class Chunk:
    """Up to CHUNK leaders in order, found by their words and parties."""

    def __init__(self):
        self.titles: list[str] = []
        self.words: dict[str, list[int]] = {}
        self.parties: dict[str, list[int]] = {}
        self.n_words = np.zeros(CHUNK)
        self.lengths = np.zeros(CHUNK)
        self._matchers: dict[int, SequenceMatcher] = {}

    def add(self, title: str, words: list[str], parties: list[str]) -> None:
        i = len(self.titles)
        self.titles.append(title)
        self.n_words[i], self.lengths[i] = len(words), len(title)
        for index, names in ((self.words, words), (self.parties, parties)):
            for name in names:
                index.setdefault(name, []).append(i)

    def first(self, title: str, words: list[str], parties: list[str], threshold: float) -> int | None:
        """The first leader that is similar enough: title, words and parties are those of a later record, in lower case and distinct."""
        n = len(self.titles)
        both, party = np.zeros(n), np.zeros(n)
        for w in words:
            if w in self.words:
                both[self.words[w]] += 1
        for p in parties:
            if p in self.parties:
                party[self.parties[p]] = PARTY
        jaccard = both / np.maximum(len(words) + self.n_words[:n] - both, 1)
        total = len(title) + self.lengths[:n]
        longest = np.where(total > 0, 2.0 * np.minimum(len(title), self.lengths[:n]) / np.maximum(total, 1), 1.0)
        for i in np.flatnonzero(longest * TITLE + jaccard * WORDS + party >= threshold):
            if self._similar(int(i), title, jaccard[i] * WORDS, party[i], threshold):
                return int(i)
        return None

    def _similar(self, i: int, title: str, words: float, party: float, threshold: float) -> bool:
        matcher = self._matchers.get(i)
        if matcher is None:
            matcher = self._matchers[i] = SequenceMatcher(None, "", self.titles[i])
        matcher.set_seq1(title)
        return matcher.quick_ratio() * TITLE + words + party >= threshold and matcher.ratio() * TITLE + words + party >= threshold


class Leaders:
    """Leaders in order, in chunks; a search ends at the first that is similar enough."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.chunks: list[Chunk] = []
        self.names: list[bytes] = []

    def add(self, name: bytes, title: str, words: list[str], parties: list[str]) -> None:
        if len(self.names) % CHUNK == 0:
            self.chunks.append(Chunk())
        self.chunks[-1].add(title, words, parties)
        self.names.append(name)

    def find(self, title: str, words: list[str], parties: list[str]) -> bytes | None:
        for k, chunk in enumerate(self.chunks):
            i = chunk.first(title, words, parties, self.threshold)
            if i is not None:
                return self.names[k * CHUNK + i]
        return None


def _prepared(rows: DataFrame) -> DataFrame:
    """_RECORDS of id, title, summary, parties: all in lower case, words and parties distinct and sorted, with a digest of the three."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                title = (r["title"] or "").lower()
                words = sorted(set((r["summary"] or "").lower().split()))
                parties = sorted({p.lower() for p in r["parties"] or () if p is not None})
                text = repr((title, words, parties)).encode("utf-8", "surrogatepass")
                out.append({"digest": hashlib.sha256(text).digest(), "id": r["id"], "title": title, "words": words, "parties": parties, "size": len(text)})
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(("digest", "id", "title", "words", "parties", "size"), kinds, strict=True)], names=["digest", "id", "title", "words", "parties", "size"])

    return rows.mapInArrow(run, _RECORDS)


def _led(block: DataFrame, threshold: float) -> DataFrame:
    """(digest, leader) of the records of one ordered block, and its leaders' content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = Leaders(threshold)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                name = leaders.find(r["title"], r["words"], r["parties"])
                if name is None:
                    leaders.add(name := r["digest"], r["title"], r["words"], r["parties"])
                found.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.binary()), batch.column("title"), batch.column("words"), batch.column("parties")], names=["digest", "leader", "title", "words", "parties"])

    return block.mapInArrow(run, "digest binary, leader binary, title string, words array<string>, parties array<string>")


def _held_against(rows: DataFrame, leaders: pa.Table, settled: dict[bytes, bytes], threshold: float) -> DataFrame:
    """rows with their leader, null while none is found, and 1 in open then; a settled row's content is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Leaders(threshold)
        for r in leaders.to_pylist():
            known.add(r["digest"], r["title"], r["words"], r["parties"])
        for batch in batches:
            found = [settled.get(r["digest"]) or known.find(r["title"], r["words"], r["parties"]) for r in batch.select(["digest", "title", "words", "parties"]).to_pylist()]
            leader = pa.array(found, pa.binary())
            open_ = leader.is_null()
            kept = [pa.array([v if o else None for v, o in zip(batch.column(c).to_pylist(), open_.to_pylist(), strict=True)], batch.schema.field(c).type) for c in ("title", "words", "parties")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("id"), *kept, batch.column("size"), leader, open_.cast(pa.int32())], names=["digest", "id", "title", "words", "parties", "size", "leader", "open"])

    return rows.mapInArrow(run, f"{_RECORDS}, leader binary, open int")


def leader_clusters(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(id, leader), one row for each row of rows (id, title, summary, parties): the id of the first leader in order of id that a record resembles.

    The likeness is half that of the titles (twice the matching characters over all), 0.35 of the Jaccard likeness of the summaries' words and 0.15 for a party in
    common, all in lower case. A leader's own content counts, not that of its members. Null texts and parties count as empty. Records with neither words nor parties
    resemble nothing and lead themselves. Rows without an id come last; records of one content that share the least id are alike, and of different contents under one id the lesser
    digest comes first. An empty table gives an empty result; other columns are ignored. Very long titles cost time with the square of their length.
    threshold must be above 0.5 and at most 0.65, where equal contents with words or parties always meet.
    """
    if not TITLE < threshold <= TITLE + PARTY:
        raise ValueError("threshold must be above 0.5 and at most 0.65")
    scratch = Scratch(rows.sparkSession, "leaders")
    members = scratch.table(_prepared(rows.select(F.col("id").cast("bigint").alias("id"), "title", "summary", "parties")))
    firsts = members.groupBy("digest").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("title", "words", "parties", "size")))
    contents = scratch.table(firsts)
    alone = (F.size("words") == 0) & (F.size("parties") == 0)
    order = [F.col("id").asc_nulls_last(), F.col("digest").asc()]
    open_, settled = contents.filter(~alone), []
    while True:
        sizes = [r["size"] for r in open_.orderBy(*order).limit(block).select("size").collect()]  # numbers only
        if not sizes:
            break
        n = max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_BYTES, side="right")))
        head = scratch.table(_led(open_.orderBy(*order).limit(n), threshold))
        leaders = head.filter("digest = leader").select("digest", "title", "words", "parties").toArrow()  # a block of bounded rows and bytes, in order
        found = {r["digest"]: r["leader"] for r in head.select("digest", "leader").toArrow().to_pylist()}
        step = scratch.table(_held_against(open_, leaders, {bytes(k): bytes(v) for k, v in found.items()}, threshold), partition_by="open")
        scratch.drop(head)
        open_ = step.filter("open = 1").drop("leader", "open")
        settled.append(step.filter("open = 0").select("digest", "leader"))
        block = min(2 * block, largest)
    led = contents.filter(F.lit(False)).select("digest", F.col("digest").alias("leader"))
    for s in settled:
        led = led.unionByName(s)
    names = contents.select(F.col("digest").alias("leader"), F.col("id").alias("leader_id"))
    led = scratch.table(led.join(names, "leader").select("digest", "leader_id"))
    return members.join(led, "digest", "left").select("id", F.when(alone, F.col("id")).otherwise(F.col("leader_id")).alias("leader"))
