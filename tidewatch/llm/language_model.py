"""Language-model scoring by prediction by partial matching over bytes.

A text is a sequence of tokens: words and one end. A word is its bytes and a space; the end is a
symbol of its own. Each byte within a word is predicted from the longest context seen in training: the whole of its
word so far (a path in the trie of words), and then, after an escape, the last two bytes, the last
one, none, and all symbols alike. An escape excludes every symbol of the context that was left.
Escape probabilities of trie nodes are estimated by leaving one out, by class of node (occurrences and
distinct symbols); the short contexts use distinct / (occurrences + distinct).
A token's first symbol is predicted over the space: from the last two bytes of the word before, then its last one,
then none (the trie's root), with escapes and exclusion likewise.

That is the pretrained model. A document's own tokens so far are the longest context of all. After t tokens, K of which
had the same first symbol and k of which were the same token, a token's first symbol has probability
(K + LEAD * q) / (t + LEAD), and the token given its first symbol (k + ADAPT * p) / (K + ADAPT * r): q, p and r are the
pretrained model's probabilities of the symbol after the word before, of the token, and of the symbol at the root.

The trie is never in one place. Its nodes down to a cut and the short contexts are small tables, bounded
by the number of three-byte strings and of heavy prefixes. Deeper nodes are built where the words with the same cut are: their first
DEPTH bytes, and one more as long as too many distinct words share them. So each distinct word is scored once, and documents look their words up: the
HEAD most frequent in a table of fixed size, the others by a join.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches
from tidewatch.llm.text import words_of
from tidewatch.sources.runtime import Scratch, ship_package

HEAD = 1 << 16  # words that every task looks up at hand
ADAPT, LEAD = 3000.0, 80.0  # weights of the pretrained model against the document's own tokens, in tokens: of words, of their first symbols
DEPTH = 3  # bytes of a word that decide where its part of the trie is built, unless too many words share them
LEAST_HEAVY, MOST_HEAVY, SHARE = 1 << 12, 1 << 18, 1024  # a prefix of more than a SHARE-th of all distinct words, within these bounds, is cut one byte later
GROUP = 50_000  # distinct words that a task handles at once, and those of one cut
END = 256
FLUSH = 200_000  # distinct words that a task counts before it passes them on


def node_class(n: int, d: int) -> tuple[int, int]:
    """Classes of nodes for escape estimation: n exactly up to 8, then by doubling; d up to 8 likewise."""
    return n if n <= 8 else 8 + (n - 1).bit_length() - 3, d if d <= 8 else 8 + (d - 1).bit_length() - 3


def left_out(counts: list[int], into: dict[tuple[int, int], list[int]]) -> None:
    """Add what a node would have met had each of its occurrences been left out in turn."""
    n, d = sum(counts), len(counts)
    if n < 2:
        return
    ones = counts.count(1)
    if ones and d > 1:
        cell = into[node_class(n - 1, d - 1)]
        cell[0] += ones
        cell[1] += ones
    if n > ones:
        into[node_class(n - 1, d)][0] += n - ones


class Escapes:
    """Escape probability of a node; classes without statistics fall back on distinct / (occurrences + distinct)."""

    def __init__(self, stats: dict[tuple[int, int], tuple[int, int]]):
        self.stats = stats
        self.memo: dict[tuple[int, int], float] = {}

    def __call__(self, n: int, d: int) -> float:
        key = node_class(n, d)
        if key not in self.memo:
            total, novel = self.stats.get(key, (0, 0))
            self.memo[key] = (novel + 0.5) / (total + 1) if total >= 20 else -1.0
        e = self.memo[key]
        return e if e >= 0 else d / (n + d)


class Short:
    """Contexts of two, one and no bytes: counts of their symbols."""

    def __init__(self, tables: dict[bytes, dict[int, int]]):
        self.tables = tables
        self.sums = {ctx: (sum(t.values()), len(t)) for ctx, t in tables.items()}
        self.memo: dict[bytes, float] = {}  # by context and symbol, so bounded like the tables

    def logp(self, symbol: int, context: bytes, out: set[int] | dict[int, int]) -> float:
        """log10 of the symbol's probability, with the symbols in out excluded."""
        lp, out = 0.0, set(out)
        for k in (2, 1, 0):
            ctx = context[len(context) - k :] if k else b""
            t = self.tables.get(ctx)
            if t is None or (k and len(context) < k):
                continue
            n, d = self.sums[ctx]
            for s in out:
                if s in t:
                    n -= t[s]
                    d -= 1
            if not d:
                continue
            if symbol in t and symbol not in out:
                return lp + math.log10(t[symbol] / (n + d))
            lp += math.log10(d / (n + d))
            out |= t.keys()
        return lp - math.log10(257 - len(out))

    def tail(self, text: bytes, at: int, out: list[int]) -> float:
        """log10 probability of text from `at` on without the trie, the first symbol with those in out excluded."""
        led, lp = b" " + text, 0.0
        for i in range(at, len(text)):
            if i == at and out:
                lp += self.logp(text[i], led[max(0, i - 1) : i + 1], out)
                continue
            key = led[max(0, i - 1) : i + 2]
            got = self.memo.get(key)
            if got is None:
                got = self.memo[key] = self.logp(text[i], key[:-1], ())
            lp += got
        return lp


def deep_nodes(words: list[tuple[bytes, int]], depth: int = DEPTH) -> dict[bytes, dict[int, int]]:
    """Symbol counts of the trie nodes of `depth` bytes and more, from words that share their shard."""
    nodes: dict[bytes, dict[int, int]] = {}
    for w, c in words:
        if c:
            s = w + b" "
            for i in range(depth, len(s)):
                node = nodes.setdefault(s[:i], {})
                node[s[i]] = node.get(s[i], 0) + c
    return nodes


def word_logp(word: bytes, nodes: dict[bytes, dict[int, int]], upper: dict[bytes, dict[int, int]], sums: dict[bytes, tuple[int, int]], short: Short, escapes: Escapes) -> float:
    """log10 probability of a word and the space after it."""
    s, lp = word + b" ", 0.0
    led = b" " + s
    on_path = True
    for i, symbol in enumerate(s):
        prefix = s[:i]
        node = (upper.get(prefix) or nodes.get(prefix)) if on_path else None
        if node is None:
            lp += short.logp(symbol, led[max(0, i - 1) : i + 1], ())
            continue
        got = sums.get(prefix)
        if got is None:
            got = sums[prefix] = (sum(node.values()), len(node))
        n, d = got
        e = escapes(n, d)
        c = node.get(symbol)
        if c:
            lp += math.log10((1 - e) * c / n)
        else:
            lp += math.log10(e) + short.logp(symbol, led[max(0, i - 1) : i + 1], node)
            on_path = False
    return lp


REACH = 33  # symbols of a word that are handled in arrays; what lies beyond goes through dicts


class Shard:
    """The words of whole cuts in order, and the trie nodes below their cuts, level by level.

    Words with one prefix stand together, so a node is a range of rows: its occurrences and its children's
    are sums over ranges. Nodes deeper than REACH belong to long words alone and are built from those.
    """

    def __init__(self, words: list[tuple[bytes, int]], heavy: frozenset[bytes] = frozenset()):
        words = sorted(words)
        self.words = [w for w, _ in words]
        self.text = [w + b" " for w in self.words]
        self.c = np.fromiter((c for _, c in words), np.int64, len(words))
        self.sizes = np.fromiter(map(len, self.text), np.int64, len(words))
        flat = np.frombuffer(b"".join(t[:REACH].ljust(REACH, b"\0") for t in self.text), np.uint8).reshape(-1, REACH)
        self.symbols = flat
        differs = flat[1:] != flat[:-1]
        same = np.where(differs.any(1), differs.argmax(1), REACH)
        self.shared = np.concatenate([[-1], np.minimum(same, np.minimum(self.sizes[1:], self.sizes[:-1]))]) if len(words) else np.empty(0, np.int64)
        self.long = deep_nodes([x for x in words if len(x[0]) >= REACH], REACH)
        self.cuts = np.full(len(words), DEPTH)
        if heavy:
            self.cuts[:] = [cut_of(t, heavy) for t in self.text]

    def levels(self):
        """For each depth: rows with a symbol there, and for these the numbers of their node and of its child; sums by node and child."""
        for i in range(DEPTH, REACH):
            rows = np.flatnonzero((self.sizes > i) & (self.cuts <= i))
            if not len(rows):
                continue
            node, child = self.shared[rows] < i, self.shared[rows] < i + 1
            node[0] = child[0] = True
            node_at, child_at = np.flatnonzero(node), np.flatnonzero(child)
            c = self.c[rows]
            n, nc = np.add.reduceat(c, node_at), np.add.reduceat(c, child_at)
            first = np.searchsorted(child_at, node_at)  # each node's first child
            d = np.add.reduceat((nc > 0).astype(np.int64), first)
            yield i, rows, node.cumsum() - 1, child.cumsum() - 1, n, d, nc, first, child_at

    def left_out(self, into: dict) -> None:
        for _, _, _, _, n, d, nc, first, _ in self.levels():
            ones = np.add.reduceat((nc == 1).astype(np.int64), first)
            use = n >= 2
            for n_, d_, total, novel in ((n[use] - 1, d[use] - 1, ones[use], ones[use]), (n[use] - 1, d[use], n[use] - ones[use], 0 * n[use])):
                key = node_classes(n_) * 1000 + node_classes(d_)
                keys, inverse = np.unique(key[(d_ > 0) & (total > 0)], return_inverse=True)
                for k, x, y in zip(keys.tolist(), np.bincount(inverse, total[(d_ > 0) & (total > 0)]).tolist(), np.bincount(inverse, novel[(d_ > 0) & (total > 0)]).tolist(), strict=True):
                    into[k // 1000, k % 1000][0] += int(x)
                    into[k // 1000, k % 1000][1] += int(y)
        for node in self.long.values():
            left_out(list(node.values()), into)

    def logps(self, upper: dict, short: Short, escapes: Escapes) -> np.ndarray:
        """The same as word_logp for each word."""
        lp, on = np.zeros(len(self.words)), np.zeros(len(self.words), bool)
        starts: dict[bytes, float | None] = {}
        sums: dict = {}
        for r, t in enumerate(self.text):
            head = t[: self.cuts[r]]
            if len(t) >= DEPTH and head not in starts:
                starts[head] = head_logp(head, upper, escapes)
            at = starts.get(head)
            if at is None:
                lp[r] = word_logp(self.words[r], {}, upper, sums, short, escapes)
            else:
                lp[r], on[r] = at, True
        for i, rows, node, child, n, d, nc, first, child_at in self.levels():
            live = on[rows]
            known = live & (nc[child] > 0)
            stays = np.fromiter((1 - escapes(int(a), int(b)) if a else 1.0 for a, b in zip(n, d, strict=True)), float, len(n))
            lp[rows[known]] += np.log10(stays[node[known]] * nc[child[known]] / n[node[known]])
            for j in np.flatnonzero(live & ~known).tolist():
                r, g = int(rows[j]), int(node[j])
                on[r] = False
                seen: list[int] = []
                if n[g]:
                    kids = range(int(first[g]), int(first[g + 1]) if g + 1 < len(first) else len(nc))
                    seen = [int(self.symbols[rows[child_at[k]], i]) for k in kids if nc[k]]
                    lp[r] += math.log10(escapes(int(n[g]), int(d[g])))
                lp[r] += short.tail(self.text[r], i, seen)
        for r in np.flatnonzero(on & (self.sizes > REACH)).tolist():
            lp[r] += long_logp(self.text[r], self.long, short, escapes)
        return lp


def cut_of(text: bytes, heavy: frozenset[bytes]) -> int:
    """How many bytes of a word and its space say where its part of the trie is built."""
    cut = DEPTH
    while text[:cut] in heavy:
        cut += 1
    return cut


def head_logp(head: bytes, upper: dict, escapes: Escapes) -> float | None:
    """log10 probability of a word's first symbols down to its cut, None if they weren't all seen."""
    lp = 0.0
    for i, symbol in enumerate(head):
        node = upper.get(head[:i])
        if not node or symbol not in node:
            return None
        n = sum(node.values())
        lp += math.log10((1 - escapes(n, len(node))) * node[symbol] / n)
    return lp


def long_logp(text: bytes, nodes: dict, short: Short, escapes: Escapes) -> float:
    """What the symbols from REACH on add, the word being on the trie's path so far."""
    lp = 0.0
    for i in range(REACH, len(text)):
        node = nodes.get(text[:i])
        if node is None:
            return lp + short.tail(text, i, [])
        n, d = sum(node.values()), len(node)
        c = node.get(text[i])
        if not c:
            return lp + math.log10(escapes(n, d)) + short.tail(text, i, list(node))
        lp += math.log10((1 - escapes(n, d)) * c / n)
    return lp


def node_classes(x: np.ndarray) -> np.ndarray:
    """node_class of one number, on arrays."""
    return np.where(x <= 8, x, 5 + np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64))


def root_probabilities(upper: dict[bytes, dict[int, int]], short: Short, escapes: Escapes) -> np.ndarray:
    """Of each symbol and the end at a token's start, whatever stands before."""
    root = upper.get(b"", {})
    n, d = sum(root.values()), len(root)
    if not n:
        return 10 ** np.array([short.logp(s, b" ", ()) for s in range(END + 1)])
    e = escapes(n, d)
    return np.array([(1 - e) * root[s] / n if s in root else e * 10 ** short.logp(s, b" ", root) for s in range(END + 1)])


def leads(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Of every token (ends too) of texts given as words: text, place in it, the two bytes before its space as a number, first symbol."""
    blocks = [b"   " + b" ".join(ws) + b" " if ws else b"   " for ws in texts]
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    tokens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    arr = np.frombuffer(b"".join(blocks) + b" ", np.uint8)
    space = arr == 32
    starts = sizes.cumsum() - sizes
    space[starts] = space[starts + 1] = space[-1] = False
    at = np.flatnonzero(space)
    symbol = arr[at + 1].astype(np.int64)
    ends = tokens.cumsum()
    symbol[ends - 1] = END
    return np.repeat(np.arange(len(texts)), tokens), np.arange(len(at)) - np.repeat(ends - tokens, tokens), arr[at - 2].astype(np.int64) << 8 | arr[at - 1], symbol


class Crossing:
    """First symbols by the last two bytes of the word before, its last one, none: escapes with exclusion."""

    def __init__(self, tables: dict[bytes, dict[int, int]], root: np.ndarray):
        self.two, self.root = tables, root
        self.one: dict[bytes, dict[int, int]] = {}
        for ctx, t in tables.items():
            into = self.one.setdefault(ctx[1:], {})
            for symbol, c in t.items():
                into[symbol] = into.get(symbol, 0) + c
        self.reset()

    def reset(self) -> None:
        self.rows, self.table = np.full(1 << 16, -1), np.empty((0, END + 1))

    @staticmethod
    def _after(t: dict[int, int] | None, low: np.ndarray) -> np.ndarray:
        if not t:
            return low
        seen, c = np.fromiter(t, np.int64, len(t)), np.fromiter(t.values(), np.float64, len(t))
        rest = low.copy()
        rest[seen] = 0
        left = rest.sum()
        out = rest * (len(t) / (c.sum() + len(t)) / left) if left > 0 else rest
        out[seen] = c / (c.sum() + len(t) * (left > 0))
        return out

    def __call__(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probabilities of symbols after contexts (two bytes as a number)."""
        new = [x for x in np.unique(context).tolist() if self.rows[x] < 0]
        if new:
            if len(self.table) > 1 << 14:
                self.reset()
                return self(context, symbol)
            self.rows[new] = np.arange(len(new)) + len(self.table)
            found = [self._after(self.two.get(c), self._after(self.one.get(c[1:]), self.root)) for c in (x.to_bytes(2, "big") for x in new)]
            self.table = np.concatenate([self.table, np.stack(found)])
        return self.table[self.rows[context], symbol]


def _word_counts(docs: DataFrame) -> DataFrame:
    """docs: text, held. kind 0: distinct words with their occurrences in training texts, 0 for those of others alone.

    kind 1: two bytes before a token and its first symbol (nothing for an end) with their occurrences in training texts.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        count: Counter = Counter()
        crossing: Counter = Counter()

        def table(kind, keys, values):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int8()), pa.array(keys, pa.binary()), pa.array(values, pa.int64())], names=["kind", "word", "c"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256).to_pydict()
                trained = []
                for t, held in zip(rows["text"], rows["held"], strict=True):
                    words = words_of(t)
                    if held:
                        for w in words:
                            count.setdefault(w, 0)
                    else:
                        count.update(words)
                        trained.append(words)
                if trained:
                    _, _, context, symbol = leads(trained)
                    keys, n = np.unique(context << 9 | symbol, return_counts=True)
                    crossing.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                if len(count) > FLUSH:
                    yield table(0, list(count), list(count.values()))
                    count.clear()
        if count:
            yield table(0, list(count), list(count.values()))
        if crossing:
            yield table(1, [(k >> 9).to_bytes(2, "big") + (b"" if k & 511 == END else bytes([k & 511])) for k in crossing], list(crossing.values()))

    return docs.mapInArrow(run, "kind tinyint, word binary, c bigint").groupBy("kind", "word").agg(F.sum("c").alias("c"))


def _small_tables(words: DataFrame) -> tuple[dict, dict]:
    """The trie's nodes above DEPTH and the short contexts, both by context; at most a symbol and three bytes each."""

    def start():
        def work(batch):
            led = [b" " + w + b" " for w in batch["word"]]
            sizes = np.fromiter(map(len, led), np.int64, len(led))
            weights = np.repeat(np.array(batch["c"], np.int64), sizes)
            text = np.frombuffer(b"".join(led), np.uint8).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(text)) - np.repeat(starts, sizes)
            out = {"kind": [], "ctx": [], "symbol": [], "c": []}

            def add(kind: int, width: int, where: np.ndarray) -> None:
                """Counts of the symbols at `where`, by the `width` bytes before them."""
                code = text[where]
                for k in range(1, width + 1):
                    code = code + (text[where - k] << (8 * k))
                keys, inverse = np.unique(code, return_inverse=True)
                sums = np.bincount(inverse, weights[where]).astype(np.int64)
                out["kind"] += [kind] * len(keys)
                out["ctx"] += [int(x).to_bytes(width, "big") for x in keys >> 8]
                out["symbol"] += (keys & 255).tolist()
                out["c"] += sums.tolist()

            for k in (0, 1, 2):
                add(1, k, np.flatnonzero(place >= max(k, 1)))
            for depth in range(DEPTH):  # the space in front stands at place 0
                add(0, depth, np.flatnonzero(place == depth + 1))
            return out

        return work

    rows = map_batches(words.filter("c > 0"), start, "kind int, ctx binary, symbol int, c bigint", rows=50_000).groupBy("kind", "ctx", "symbol").agg(F.sum("c").alias("c"))
    upper: dict[bytes, dict[int, int]] = {}
    short: dict[bytes, dict[int, int]] = {}
    for r in rows.collect():
        (short if r["kind"] else upper).setdefault(bytes(r["ctx"]), {})[r["symbol"]] = r["c"]
    return upper, short


def _prefix(depth: int) -> Column:
    return F.substring(F.concat("word", F.lit(b" ")), 1, depth)


def _heavy(words: DataFrame, distinct: int) -> list[list[bytes]]:
    """Prefixes that too many distinct words share, by length from DEPTH on: at most distinct / LEAST_HEAVY or SHARE for each length, whichever is less, or distinct / MOST_HEAVY."""
    most = min(MOST_HEAVY, max(LEAST_HEAVY, distinct // SHARE))
    found: list[list[bytes]] = []
    for depth in range(DEPTH, REACH):
        own = words if not found else words.filter(_prefix(depth - 1).isin(found[-1]))
        heavy = [bytes(r["p"]) for r in own.groupBy(_prefix(depth).alias("p")).count().filter(F.col("count") > most).collect()]
        if not heavy:
            break
        found.append(heavy)
    return found


def _heavy_nodes(words: DataFrame, heavy: list[list[bytes]]) -> dict[bytes, dict[int, int]]:
    """The trie's nodes at heavy prefixes: at most 256 symbols each."""
    nodes: dict[bytes, dict[int, int]] = {}
    for prefixes in heavy:
        depth = len(prefixes[0])
        here = words.filter((F.col("c") > 0) & _prefix(depth).isin(prefixes))
        for r in here.groupBy(_prefix(depth).alias("p"), F.substring(F.concat("word", F.lit(b" ")), depth + 1, 1).alias("s")).agg(F.sum("c").alias("c")).collect():
            nodes.setdefault(bytes(r["p"]), {})[bytes(r["s"])[0]] = r["c"]
    return nodes


def _shards(words: DataFrame, heavy: list[list[bytes]]) -> DataFrame:
    """cut, word, c: words of the same cut (a short word's space included) lie together in one partition."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _prefix(DEPTH + len(heavy))
    for prefixes in reversed(heavy):
        depth = len(prefixes[0])
        cut = F.when(_prefix(depth).isin(prefixes), cut).otherwise(_prefix(depth))
    return words.withColumn("cut", cut).repartition(n, "cut").sortWithinPartitions("cut", "word").select("cut", "word", "c")


def _whole_cuts(batches):
    """Words and counts of sorted rows, in lists of GROUP and more that end where a cut does."""
    words: list[tuple[bytes, int]] = []
    last = None
    for b in batches:
        cuts, rows = b["cut"].to_pylist(), list(zip(b["word"].to_pylist(), b["c"].to_pylist(), strict=True))
        if len(words) >= GROUP:
            to = next((i for i, cut in enumerate(cuts) if cut != last), len(cuts))
            words += rows[:to]
            if to < len(rows):
                yield words
                words = rows[to:]
        else:
            words += rows
        last = cuts[-1] if cuts else last
    if words:
        yield words


def _escape_stats(shards: DataFrame, upper: dict, heavy: frozenset[bytes]) -> dict:
    schema = "n int, d int, total bigint, novel bigint"

    def run(batches):
        import pyarrow as pa

        into: dict = defaultdict(lambda: [0, 0])
        for words in _whole_cuts(batches):
            Shard(words, heavy).left_out(into)
        keys = list(into)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([into[k][0] for k in keys], pa.int64()), pa.array([into[k][1] for k in keys], pa.int64())], names=["n", "d", "total", "novel"])

    into: dict = defaultdict(lambda: [0, 0])
    for r in shards.mapInArrow(run, schema).groupBy("n", "d").agg(F.sum("total").alias("total"), F.sum("novel").alias("novel")).collect():
        into[r["n"], r["d"]] = [r["total"], r["novel"]]
    for node in upper.values():
        left_out(list(node.values()), into)
    return {k: tuple(v) for k, v in into.items()}


def _scored_words(shards: DataFrame, model: Broadcast) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        upper, short_tables, stats, heavy = model.value
        short, escapes = Short(short_tables), Escapes(stats)
        for words in _whole_cuts(batches):
            shard = Shard(words, heavy)
            lp = shard.logps(upper, short, escapes)
            for at in range(0, len(words), 50_000):
                to = at + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(shard.words[at:to], pa.binary()), pa.array(shard.c[at:to]), pa.array(lp[at:to])], names=["word", "c", "lp"])

    return shards.mapInArrow(run, "word binary, c bigint, lp double")


def _least_count(words: DataFrame, most: int) -> int:
    """The least count c such that at most `most` words occur c times or more, from the histogram of counts.

    No partition sends its own best words to the driver, so what arrives there doesn't grow with their number.
    """
    order = Window.orderBy(F.desc("c"))
    histogram = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    found = histogram.filter(F.col("upto") <= most).agg(F.min("c")).first()[0]
    return max(1, found) if found is not None else 1 << 62


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, adapt: float = ADAPT, lead: float = LEAD) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, distinct_tokens, base_score, score.

    held: whether a row is held out of training. score is the log10 probability of the text under the
    trained and adapting model, base_score the smoothed unigram one; A-Z count as lower case. A null or empty text is
    one end. Ids may be null or repeated; repeated rows count as often in training and score alike. Without training rows
    nothing is known, base_score is 0 (all tokens share probability 1), and every symbol is equally likely. Very long
    texts and words are scored whole: memory grows with a text's tokens. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "lm")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    counted = scratch.table(_word_counts(source.select("text", "held")))
    words = counted.filter("kind = 0").select("word", "c")
    crossing: dict[bytes, dict[int, int]] = {}
    for r in counted.filter("kind = 1").collect():  # at most one row for each three-byte string
        key = bytes(r["word"])
        crossing.setdefault(key[:2], {})[key[2] if len(key) > 2 else END] = r["c"]
    ends = source.filter("not held").count()
    total, distinct, every = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first()
    total, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)

    upper, short = _small_tables(words)
    if ends:
        upper.setdefault(b"", {})[END] = ends
        for ctx in (b"", b" "):
            short.setdefault(ctx, {})[END] = ends
    by_depth = _heavy(words, every)
    upper |= _heavy_nodes(words, by_depth)
    heavy = frozenset(p for prefixes in by_depth for p in prefixes)
    shards = _shards(words, by_depth)
    stats = _escape_stats(shards, upper, heavy)
    scored = scratch.table(_scored_words(shards, spark.sparkContext.broadcast((upper, short, stats, heavy))))
    root = root_probabilities(upper, Short(short), Escapes(stats))

    least = _least_count(scored, head)
    top = {bytes(r["word"]): (r["c"], r["lp"]) for r in scored.filter(F.col("c") >= least).collect()}  # `head` rows at most
    at_hand = spark.sparkContext.broadcast((top, crossing, root))
    spread = math.log10(total + 0.1 * (distinct + 1))

    def start():
        known, tables, root = at_hand.value
        first = Crossing(tables, root)
        base = lambda c: math.log10(c + 0.1) - spread
        lgamma, e10 = math.lgamma, math.log(10)
        table = {w: (c > 0, base(c), lp + math.log10(adapt), adapt * 10**lp) for w, (c, lp) in known.items()}
        own_root = adapt * root

        def work(batch):
            out: dict[str, list] = {k: [] for k in ("n", "known", "base", "lp", "tail", "tf")}
            texts = list(map(words_of, batch["text"]))
            text, place, context, symbol = leads(texts)
            # How many tokens of the text before had the same first symbol.
            order = np.argsort(text * (END + 1) + symbol, kind="stable")
            group = np.concatenate([[True], np.diff((text * (END + 1) + symbol)[order]) != 0])
            starts = np.flatnonzero(group)
            sizes = np.diff(np.append(starts, len(order)))
            earlier = np.empty(len(order), np.int64)
            earlier[order] = np.arange(len(order)) - np.repeat(starts, sizes)
            begun = np.bincount(text, np.log10((earlier + lead * first(context, symbol)) / (place + lead)), len(texts))
            # Less what the words' own terms hold of their first symbols: K * root rising by ones.
            for t, s, k in zip(text[order[starts]].tolist(), symbol[order[starts]].tolist(), sizes.tolist(), strict=True):
                if s != END:
                    begun[t] -= (math.log(own_root[s]) + lgamma(own_root[s] + k) - lgamma(own_root[s] + 1)) / e10
            for words, lp in zip(texts, begun.tolist(), strict=True):
                n_known, b, tail, tf = int(ends > 0), base(ends), [], []
                for w, c in Counter(words).items():
                    if (hit := table.get(w)) is not None:
                        n_known += c * hit[0]
                        b += c * hit[1]
                        # A rare word's share may underflow to 0: its first occurrence goes by logarithm, later ones by one more.
                        lp += hit[2] if c == 1 else hit[2] + (lgamma(hit[3] + c) - lgamma(hit[3] + 1)) / e10
                    else:
                        tail.append(w)
                        tf.append(c)
                for k, v in zip(out, (len(words) + 1, n_known, b, lp, tail, tf), strict=True):
                    out[k].append(v)
            return {"rid": batch["rid"], "id": batch["id"], "held": batch["held"]} | out

        return work

    numbered = source.withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.table(map_batches(numbered, start, "rid bigint, id bigint, held boolean, n bigint, known bigint, base double, lp double, tail array<binary>, tf array<int>"))
    tail = rows.select("rid", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("rid", F.col("t.tail").alias("word"), "t.tf")
    own = F.col("own")  # ADAPT * p: the first of tf equal tokens has log10 own, the next ones log10 (own + 1), ...
    again = F.when(F.col("tf") > 1, F.aggregate(F.sequence(F.lit(1), F.col("tf") - 1), F.lit(0.0), lambda a, j: a + F.log10(own + j))).otherwise(0.0)
    found = tail.join(scored, "word").withColumn("own", F.pow(F.lit(10.0), F.col("lp")) * adapt).withColumn("lp", F.col("lp") + math.log10(adapt) + again).groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - spread)).alias("base2"), F.sum("lp").alias("lp2")
    )
    return rows.drop("tail", "tf").join(found, "rid", "left").select(
        "id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.lit(distinct).cast("long").alias("distinct_tokens"), (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), (F.col("lp") + F.coalesce("lp2", F.lit(0.0))).alias("score"),
    )
