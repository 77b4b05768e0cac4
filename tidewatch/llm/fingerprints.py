"""Document fingerprints by consistent weighted sampling.

Each term (a word, with its count as weight) has for each of `samples` hashes two Gamma(2, 1) draws
and one uniform draw, all from the term's own hash. A document's sample is the term of least
ln a = ln c - r (t - b) - r with t = floor(ln w / r + b); it keeps (term, t). Two documents agree in a
sample with a probability equal to their generalised Jaccard similarity, sum of min over sum of max.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches, parse_schema
from tidewatch.llm.text import words_of
from tidewatch.sources.runtime import Scratch, ship_package

SAMPLES = 64
_EMPTY = "0" * 4


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles(n: int) -> np.ndarray:
    """Midpoint quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    p, x = (np.arange(n) + 0.5) / n, np.full(n, 1.7)
    for _ in range(60):
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 3, x * 3 + 1e-6)
    return x.astype(np.float32)


class _Numbered(dict):
    """Terms and their numbers; a term asked for the first time gets the next one and is noted in new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        self.new.append(term)
        return n


class Sampler:
    """Draws for terms, and the samples of documents.

    The draws of the first `kept` terms stay at hand for later batches, which saves most of the work
    as frequent words come first; those of other terms are made anew for each batch.
    """

    def __init__(self, samples: int = SAMPLES, chunk: int = 2048, kept: int = 12288):
        self.samples, self.chunk, self.kept = samples, chunk, kept
        self.lanes = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.gamma = _gamma_quantiles(1 << 16)
        self.known = _Numbered()
        self.table = np.empty((4, kept, samples), np.float32)
        self.hashes = np.empty(kept, np.uint64)

    def draws(self, terms: np.ndarray) -> np.ndarray:
        """r, b, ln c and the score of weight 1 for each term and sample; one 64-bit word gives all of them."""
        out = np.empty((4, len(terms), self.samples), np.float32)
        for at in range(0, len(terms), 512):
            h = _mix(terms[at : at + 512, None] ^ self.lanes)
            r, b, c, one = out[:, at : at + 512]
            np.take(self.gamma, (h & np.uint64(0xFFFF)).astype(np.int64), out=r)
            unit = lambda shift, bits, h=h: (((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-bits)
            b[:] = unit(16, 12)
            np.log(-np.log(unit(28, 18) * unit(46, 18)), out=c)
            np.subtract(c, r * (1 - b), out=one)
        return out

    def signatures(self, bags: list[Counter]) -> list[str]:
        """A string of four hex digits for each sample; documents without terms share one of zeros."""
        known, n = self.known, len(self.known)
        indexes = [np.fromiter(map(known.__getitem__, bag), np.int64, len(bag)) for bag in bags]
        add, known.new = known.new, []
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, add), np.uint64, len(add))
        room = min(self.kept - n, len(add))
        if room:
            self.table[:, n : n + room], self.hashes[n : n + room] = self.draws(hashed[:room]), hashed[:room]
        for w in add[room:]:
            del known[w]
        extra = self.draws(hashed[room:]) if len(add) - room <= 8 * self.chunk else None
        return [self._one(index, np.fromiter(bag.values(), np.int64, len(bag)), hashed[room:], extra) for index, bag in zip(indexes, bags, strict=True)]

    def _one(self, index: np.ndarray, counts: np.ndarray, hashed: np.ndarray, extra) -> str:
        if not len(index):
            return _EMPTY * self.samples
        lane, best = np.arange(self.samples), None
        old = index < self.kept
        for single in (True, False):
            for new in (True, False):
                chosen = np.flatnonzero(((counts == 1) == single) & (old != new))
                for a in range(0, len(chosen), self.chunk):  # a long text goes through in slices
                    at = chosen[a : a + self.chunk]
                    rows = index[at] - self.kept * new
                    table = self.table if not new else extra
                    if table is None:
                        table, rows = self.draws(hashed[rows]), np.arange(len(rows))
                    if single:
                        score, t = table[3][rows], None
                    else:
                        r, b, c, _ = (x[rows] for x in table)
                        t = np.floor(np.log(counts[at].astype(np.float32))[:, None] / r + b)
                        score = c - r * (t - b + 1)
                    i = score.argmin(0)
                    now = (score[i, lane], (hashed if new else self.hashes)[index[at][i] - self.kept * new], np.zeros(self.samples) if single else t[i, lane])
                    best = now if best is None else tuple(np.where(now[0] < best[0], x, y) for x, y in zip(now, best, strict=True))
        ids = _mix(best[1] ^ _mix(best[2].astype(np.int64).astype(np.uint64) + np.uint64(1)))
        return (ids >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of samples in which two fingerprints agree."""
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def bag_of(text: str | None) -> Counter:
    return Counter(words_of(text))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id and fingerprint of each row of docs. Null and empty texts share one fingerprint; ids may be null or repeated."""

    def start():
        sampler = Sampler(samples)
        return lambda batch: {"id": batch["id"], "fingerprint": sampler.signatures([bag_of(t) for t in batch["text"]])}

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), start, "id bigint, fingerprint string")


def spliced(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR_DDL = "part int, id bigint, text string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near the edited text and the next document are.

    The next document is the one of next greater id; after the last comes the first. Documents are dealt
    by ranges of ids and read in order, so each text moves once; the last document of each range meets
    the first of the following one in a second step over those rows alone. Null text counts as empty,
    and two empty texts have likeness 1. Null ids come first; rows that share an id follow one another in
    any order. A single document is its own next one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "prints")
    schema = parse_schema(_PAIR_DDL)

    def compared(sampler, ids, texts, parts=None):
        """Rows for all texts but the last, whose next one is not known here."""
        n = len(texts) - 1
        edited = [spliced(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        both = sampler.signatures([bag_of(t) for t in (*texts, *edited)])
        prints, changed = both[: n + 1], both[n + 1 :]
        return {
            "part": [None] * n if parts is None else parts[:n], "id": ids[:n], "text": [None] * n, "n_chars": [len(t) for t in texts[:n]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], "fingerprint": prints[:n], "edited_fingerprint": changed,
            "near_edited": [likeness(a, b) for a, b in zip(prints, changed, strict=False)], "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
        }

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in out_schema], schema=out_schema)
        edge = lambda part, i, t: {f.name: [None] for f in out_schema} | {"part": [part], "id": [i], "text": [t]}
        sampler, last, first, part = Sampler(samples), None, None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                got = whole.slice(at, 64).to_pydict()
                ids, texts = got["id"], got["text"]
                if first is None:
                    part = got["part"][0]
                    first = (ids[0], texts[0])
                if last is not None:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = (ids[-1], texts[-1])
                if len(texts) > 1:
                    yield pack(compared(sampler, ids, texts))
        if first is not None:  # the two ends wait for their neighbours: n_chars tells which end it is
            yield pack(edge(part, *first) | {"n_chars": [0]})
            yield pack(edge(part, *last) | {"n_chars": [1]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = source.repartitionByRange(n, "id").sortWithinPartitions("id").select(F.spark_partition_id().alias("part"), "id", "text")
    rows = scratch.table(dealt.mapInArrow(run, _PAIR_DDL))
    ends = rows.filter("text is not null")
    firsts, lasts = ends.filter("n_chars = 0"), ends.filter("n_chars = 1")
    parts = sorted(r["part"] for r in firsts.select("part").collect())  # one for each partition
    after = {p: q for p, q in zip(parts, parts[1:] + parts[:1], strict=True)}
    if not parts:
        return rows.drop("part", "text")
    follow = spark.createDataFrame(list(after.items()), "part int, after int")
    pairs = lasts.select("part", "id", "text").join(follow, "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next")), "after")

    def start():
        sampler = Sampler(samples)

        def work(batch):
            out: dict[str, list] = {}
            for i, t, nxt in zip(batch["id"], batch["text"], batch["next"], strict=True):
                for k, v in compared(sampler, [i, None], [t, nxt]).items():
                    out.setdefault(k, []).extend(v)
            return out

        return work

    joined = map_batches(pairs.select("id", "text", "next"), start, _PAIR_DDL, rows=8)
    return rows.filter("text is null").unionByName(joined).drop("part", "text")
