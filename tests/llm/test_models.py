"""Language model, toxicity, mixing and pieces."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from tests.llm.helpers import EXTRA, ODD, SCHEMA, frame
from tidewatch.llm import language_model as lm
from tidewatch.llm import mixing, pieces, toxicity
from tidewatch.llm.text import words_of
from tidewatch.sources.runtime import ship_package


def brute_lm(train, texts, adapt=lm.ADAPT, lead=lm.LEAD):
    """Scores from one trie in one dict, token by token."""
    words, ends = Counter(w for t in train for w in words_of(t)), len(train)
    nodes, short = {}, {}
    for w, c in words.items():
        s, led = w + b" ", b"  "[:1] + w + b" "
        for i in range(len(s)):
            nodes.setdefault(s[:i], Counter())[s[i]] += c
        for i in range(1, len(led)):
            for k in range(min(2, i) + 1):
                short.setdefault(led[i - k : i], Counter())[led[i]] += c
    if ends:
        nodes.setdefault(b"", Counter())[lm.END] += ends
        for ctx in (b"", b" "):
            short.setdefault(ctx, Counter())[lm.END] += ends
    over = {}  # the end of the word before, to the first symbols after it
    for t in train:
        before = b"  "
        for w in [*words_of(t), None]:
            for ctx in (before, before[1:]):
                over.setdefault(ctx, Counter())[lm.END if w is None else w[0]] += 1
            before = (b" " + w)[-2:] if w else b""
    stats = {}
    for node in nodes.values():
        for s, c in node.items():
            left = dict(node)
            left[s] -= 1
            left = {k: v for k, v in left.items() if v}
            if left:
                cell = stats.setdefault(lm.node_class(sum(left.values()), len(left)), [0, 0])
                cell[0] += c
                cell[1] += c * (s not in left)

    def escape(node):
        total, novel = stats.get(lm.node_class(sum(node.values()), len(node)), (0, 0))
        return (novel + 0.5) / (total + 1) if total >= 20 else len(node) / (sum(node.values()) + len(node))

    def low(symbol, context, out):
        p, out = 1.0, set(out)
        for k in (2, 1, 0):
            node = short.get(context[len(context) - k :] if k else b"") if len(context) >= k else None
            left = {s: c for s, c in (node or {}).items() if s not in out}
            if left:
                n = sum(left.values()) + len(left)
                if symbol in left:
                    return p * left[symbol] / n
                p *= len(left) / n
                out |= set(node)
        return p / (257 - len(out))

    def token(symbols):
        p, at = 1.0, b""
        on = True
        for s in symbols:
            node = nodes.get(at) if on else None
            context = (b" " + at)[-2:]
            if node is None:
                p *= low(s, context, ())
            elif s in node:
                p *= (1 - escape(node)) * node[s] / sum(node.values())
            else:
                p *= escape(node) * low(s, context, node)
                on = False
            at += bytes([s]) if s < 256 else b""
        return p

    roots = [token([s]) for s in range(257)]
    assert sum(roots) == pytest.approx(1)

    def begins(s, before):
        p = roots
        for ctx in (before[1:], before):
            node = over.get(ctx, {})
            left = sum(p[x] for x in range(257) if x not in node)
            n, d = sum(node.values()), len(node)
            p = [node[x] / (n + d) if x in node else p[x] / left * (d / (n + d) if d else 1) for x in range(257)]
        assert sum(p) == pytest.approx(1)
        return p[s]

    memo = {}
    out = []
    for t in texts:
        seen, firsts, score, before = Counter(), Counter(), 0.0, b"  "
        tokens = [*words_of(t), None]
        for i, w in enumerate(tokens):
            s = lm.END if w is None else w[0]
            if (s, before) not in memo:
                memo[s, before] = begins(s, before)
            score += math.log10((firsts[s] + lead * memo[s, before]) / (i + lead))
            if w is not None:
                score += math.log10((seen[w] + adapt * token(w + b" ")) / (firsts[s] + adapt * roots[s]))
                before = (b" " + w)[-2:]
            seen[w] += 1
            firsts[s] += 1
        out.append(score)
    return words, ends, out


@pytest.mark.parametrize(("head", "heavy"), [(0, 1), (3, 1 << 12), (1000, 5)])
def test_language_model(spark, head, heavy, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_HEAVY", heavy)
    monkeypatch.setattr(lm, "SHARE", 10**9)
    r = random.Random(9)
    texts = [" ".join("".join(r.choice(["th", "er", "an", "é", "x"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 40))) for _ in range(60)] + ODD[:9] + ["zzz unseen Words"]
    df = frame(spark, texts)
    got = {x["id"]: x for x in lm.score_texts(df, F.col("doc_id") % 3 == 0, head=head).collect()}
    words, ends, scores = brute_lm([t for i, t in enumerate(texts) if i % 3], texts)
    n, v = sum(words.values()) + ends, len(words) + 1
    for i, t in enumerate(texts):
        own, x = words_of(t), got[i]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(words[w] for w in own), ends])
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (i % 3 == 0, len(own) + 1, sum(words[w] > 0 for w in own) + 1, n)
        assert x["base_score"] == pytest.approx(base) and x["score"] == pytest.approx(scores[i], rel=1e-6)


def test_language_model_sums_to_one():
    upper = {b"": {97: 3, 98: 1}, b"a": {32: 2, 97: 1}, b"b": {32: 1}}
    short = lm.Short({b"": {97: 5, 98: 1, 32: 4}, b" ": {97: 3, 98: 1}, b"a": {32: 3, 97: 1}})
    for out in ((), {97}, {97, 32}):
        assert sum(10 ** short.logp(s, b" a", out) for s in range(257) if s not in out) == pytest.approx(1)
    assert upper


@pytest.mark.parametrize("head", [0, 1000])
@pytest.mark.parametrize("letters", [1000, 3000])
def test_language_model_of_repeated_long_words(spark, head, letters):
    """The probability of such a word is below the least float."""
    r = random.Random(21)
    w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters))
    texts = ["some plain words"] * 20 + [f"{w} {w}", f"{w}x {w}x {w}x"]
    got = lm.score_texts(frame(spark, texts), F.col("doc_id") == 21, head=head).orderBy("id").collect()
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    assert got[21]["n_known"] == 1 and got[21]["score"] < got[0]["score"]


def test_language_model_reads_order(spark):
    """The same words in another order score otherwise: contexts reach over spaces."""
    texts = ["ab ba ab ba ab ba"] * 30 + ["ab ba ab ba ab ba", "ba ba ba ab ab ab"]
    got = [x["score"] for x in lm.score_texts(frame(spark, texts), F.col("doc_id") >= 30).orderBy("id").collect()]
    assert got[30] > got[31] + 0.5


def test_language_model_beats_unigrams(spark):
    """On held-out texts, though the unigram base gives every unknown word one share and this model spells it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    score, base = lm.score_texts(docs, held).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_language_model_odd(spark):
    got = lm.score_texts(frame(spark, extra=EXTRA), F.col("doc_id") % 10 == 0).collect()
    assert len(got) == len(ODD) + len(EXTRA) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(frame(spark, []).limit(0), F.lit(False)).count() == 0
    nobody = lm.score_texts(frame(spark, ["a b", None]), F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nobody)


def brute_segments(scores):
    """Maximal segments by definition: the best one, then those to its left and right."""
    best = None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[a:b])
        if s > 0 and (best is None or s > best[0] + 1e-12 or abs(s - best[0]) <= 1e-12 and b - a < best[2] - best[1]):
            best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return brute_segments(scores[:a]) + [(a, b - 1, s)] + [(x + b, y + b, v) for x, y, v in brute_segments(scores[b:])]


def test_segments():
    r = random.Random(10)
    for _ in range(300):
        scores = [r.choice([-3.5, -1.25, -0.5, None, None, 0.75, 2.125, 4.0625]) for _ in range(r.randint(1, 14))]
        at = [i for i, s in enumerate(scores) if s is not None]
        got = toxicity.segments([scores[i] for i in at], at, -0.3)
        want = brute_segments([-0.3 if s is None else s for s in scores])
        assert sum(v for *_, v in got) == pytest.approx(sum(v for *_, v in want))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def labelled(spark, n=600, seed=12):
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        y = int(r.random() < 0.3)
        words = ["".join(r.choice(["th", "er", "an", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        if y:
            for _ in range(max(2, len(words) // 20)):
                words[r.randrange(len(words))] = r.choice(["grumf", "blarg", "vexling" + r.choice(["a", "o", "u"]), "Snork,"])
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


def test_toxicity(spark):
    texts, labels = labelled(spark)
    table = spark.createDataFrame([(i, y, y) for i, y in enumerate(labels)] + [(None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id bigint, toxic int, quality int")
    got = {r["id"]: r for r in toxicity.toxicity(frame(spark, texts, EXTRA), table.filter("doc_id % 3 != 1 or doc_id is null")).collect()}
    held = [i for i in range(len(texts)) if i % 3 == 1]
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    hit = next(i for i in held if labels[i] and got[i]["segments"])
    words = toxicity.tokens_of(texts[hit])
    assert all(words[s["first"]] and words[s["last"]] for s in got[hit]["segments"])


def brute_toxicity(train, texts):
    """Scores from counts in one place; segments by definition."""
    tox = toxicity
    n, d = {0: 0, 1: 0}, {0: 0, 1: 0}
    tokens, within = ({0: Counter(), 1: Counter()} for _ in range(2))
    units = lambda w: [w, *(w.decode()[:k].encode() + b"*" for k in (7, 6, 5, 4, 3) if len(w.decode()) > k)]
    for t, y in train:
        words = [w.strip(b".,;:!?\"'()[]{}<>*%&#$|-_=+~^/\\`") for w in words_of(t)]
        n[y] += len(words)
        d[y] += 1
        own = Counter(u for w in words for u in units(w))
        tokens[y].update(own)
        within[y].update(own.keys())

    def odds(a, b, prior, one, zero):
        mean = prior * (a + b) / (one + zero)
        x, z = a + mean, b + mean
        return math.log(x / max(one + prior - x, 0.5)) - math.log(z / max(zero + prior - z, 0.5)), x, z

    scores, silent = {}, set()
    for u in tokens[0].keys() | tokens[1].keys():
        da, db = within[1][u], within[0][u]
        if da + db < 8:
            continue
        o, _, _ = odds(tokens[1][u], tokens[0][u], 10_000.0, n[1], n[0])
        z, x, v = odds(da, db, 50.0, d[1], d[0])
        if abs(z / math.sqrt(1 / x + 1 / v)) >= 4:
            scores[u] = max(-3.0, min(6.0, o))
        else:
            silent.add(u)

    def marks(t):
        out = []
        for w in (w.strip(b".,;:!?\"'()[]{}<>*%&#$|-_=+~^/\\`") for w in words_of(t)):
            known = next((u for u in units(w) if u in scores or u in silent), None)
            out.append(scores.get(known))
        return out

    bare = {y: 0.5 + sum(sum(s is None for s in marks(t)) for t, k in train if k == y) for y in (0, 1)}
    gap = min(-0.005, math.log(bare[1] / (n[1] + 1)) - math.log(bare[0] / (n[0] + 1)))
    found = lambda t: [v for *_, v in brute_segments([gap if s is None else s for s in marks(t)])]
    clean = [(math.log(len(words_of(t)) + 1), max(found(t), default=0.0)) for t, y in train if not y]
    x, s = np.array([a for a, _ in clean]), np.array([b for _, b in clean])
    slope = max(0.0, ((x - x.mean()) * (s - s.mean())).mean() / ((x - x.mean()) ** 2).mean())
    scale = max(0.5, (s - slope * x).std() * math.sqrt(6) / math.pi)
    location = (s - slope * x).mean() - 0.5772 * scale

    def evidence(t):
        logs = [-math.log10(max(1 - math.exp(-math.exp(-(v - location - slope * math.log(len(words_of(t)) + 1)) / scale)), 1e-30)) for v in found(t)]
        return max(max(logs), sum(x for x in logs if x >= 3)) if logs else 0.0

    e, y = np.minimum([evidence(t) for t, _ in train], 30.0), np.array([k for _, k in train])
    a = b = 0.0
    for _ in range(200):  # Newton on the same penalised likelihood, written out for two numbers
        p = 1 / (1 + np.exp(-(a + b * e)))
        w = p * (1 - p)
        g0, g1 = (y - p).sum() - 0.01 * a, ((y - p) * e).sum() - 0.01 * b
        h00, h01, h11 = w.sum() + 0.01, (w * e).sum(), (w * e * e).sum() + 0.01
        a, b = a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01**2), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01**2)
    return [1 / (1 + math.exp(-(a + b * evidence(t)))) for t in texts]


def test_toxicity_by_brute_force(spark):
    texts, labels = labelled(spark, 150, 31)
    texts = [" ".join(t.split()[:25]) for t in texts] + ["", "grumf", "Snork, blarg. grumf"]
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id bigint, toxic int")
    got = {r["id"]: r["score"] for r in toxicity.toxicity(frame(spark, texts), table).collect()}
    want = brute_toxicity(sorted(set(zip(texts, labels, strict=False))), texts)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(frame(spark, extra=EXTRA), none).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(frame(spark, []).limit(0), none).count() == 0


def brute_targets(sizes, cap=3):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight, full, total = {s: i % 3 + 1 for i, s in enumerate(order)}, set(), sum(sizes.values())
    while True:
        rest, shares = total - sum(cap * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / shares for s in order}
        new = {s for s in order if target[s] > cap * sizes[s] * (1 + 1e-12) and s not in full}
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, None: 7, "é": 300, "Z": 1}, {"x": 4}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_mix(spark):
    r = random.Random(13)
    data = [(i, " ".join(["w"] * r.choice([1, 5, 20, 80, 200])), "en", r.choice(["a", "a", "a", "a", "b", "c", "d", None]), 0, 1, "k", "n", 1) for i in range(800)]
    df = spark.createDataFrame(data, SCHEMA)
    first, again = (sorted(map(tuple, mixing.mix(x).select("id", "size", "copies", "taken", "target", "source_size").collect())) for x in (df, df.repartition(7)))
    assert first == again
    sizes, taken = Counter(), Counter()
    by_id = {d[0]: d for d in data}
    for i, size, copies, words, _, _ in first:
        assert size == len(by_id[i][1].split()) and words == size * copies and 0 <= copies <= 3
        sizes[by_id[i][3]] += size
        taken[by_id[i][3]] += words
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 0.01 * t + 1


def test_mix_by_brute_force(spark):
    """Rates, rounding, the choice of offsets and corrections, on rows in one place."""
    r = random.Random(41)
    data = [(i, " ".join(["w"] * int(r.paretovariate(0.7) * 3 % 900)), "en", r.choice(["a", "a", "a", "b", "c", "d", None]), 0, 1, "k", "n", 1) for i in range(500)]
    df = spark.createDataFrame([*data, (500, "one size only " * 4, "en", "e", 0, 1, "k", "n", 1), (501, "another of twelve words " * 3, "en", "e", 0, 1, "k", "n", 1)], SCHEMA)
    hashes = {x["doc_id"]: x["h"] for x in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    by_source = {}
    for x in mixing.mix(df).collect():
        by_source.setdefault(x["source"], []).append(x)
    targets = brute_targets({s: sum(x["size"] for x in rows) for s, rows in by_source.items()})
    for source, rows in by_source.items():
        rows.sort(key=lambda x: (-x["size"], hashes[x["id"]], x["id"]))
        target = targets[source]
        # Rates meet the target before rounding; documents of one length band have one rate.
        assert sum(x["rate"] * x["size"] for x in rows) == pytest.approx(target) and all(x["target"] == pytest.approx(target) and x["rate"] <= 3 for x in rows)
        assert len({(band_of(x["size"]), x["rate"]) for x in rows if x["size"]}) == len({band_of(x["size"]) for x in rows if x["size"]})
        units = [math.floor(x["rate"] * (1 << 20) + 0.5) for x in rows]
        upto = list(itertools.accumulate(units))
        tries = []
        for k in range(64):
            o = k * (1 << 20) // 64
            copies = [(u + o >> 20) - (u - n + o >> 20) for u, n in zip(upto, units, strict=True)]
            tries.append((abs(sum(c * x["size"] for c, x in zip(copies, rows, strict=True)) - rows[0]["target"]), o, copies))
        copies = min(tries)[2]
        for _ in range(3):
            gap = rows[0]["target"] - sum(c * x["size"] for c, x in zip(copies, rows, strict=True))
            able = [(abs(abs(gap) - x["size"]), hashes[x["id"]], x["id"], i) for i, (c, x) in enumerate(zip(copies, rows, strict=True)) if (c < 3 if gap > 0 else c > 0)]
            able = [x for x in able if x[0] < abs(gap)]
            if able:
                copies[min(able)[3]] += 1 if gap > 0 else -1
        assert copies == [x["copies"] for x in rows]


def test_mix_odd(spark):
    got = mixing.mix(frame(spark, extra=EXTRA)).collect()
    assert len(got) == len(ODD) + len(EXTRA) and all(x["taken"] <= 3 * x["size"] for x in got)
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0
    assert [x["copies"] for x in mixing.mix(frame(spark, [None, ""])).collect()] == [1, 1]


def band_of(size):
    return min(mixing.BANDS - 1, (max(size, 1).bit_length() - 1) // 2)


def balanced(spark, cells, goals):
    """Rates by (source, band) and the multipliers."""
    levels, mu = mixing.balance(spark.createDataFrame([(s, b, n) for (s, b), n in cells.items()], "source string, band int, size bigint"), spark.createDataFrame(list(goals.items()), "source string, target double"))
    level = {r["source"]: r["level"] for r in levels.collect()}
    return {(s, b): min(3.0, level[s] * math.exp(mu[b])) for s, b in cells}, mu


@pytest.mark.parametrize(("goals", "most"), [({"a": 900.0, "b": 2400.0, None: 1700.0}, 0.8), ({"a": 200.0, "b": 3000.0, None: 1800.0}, 1.0), ({"a": 4400.0, "b": 500.0, None: 100.0}, 0.8)])
def test_balance_is_the_optimum(spark, goals, most):
    """The conditions of the optimum: targets are met, tilts are products up to the cap, and each band misses its share by its penalty. A constant rate meets the first alone. Where a source is at its cap, shares can move little."""
    cells = {("a", 0): 100, ("a", 3): 1500, ("a", 5): 400, ("b", 0): 700, ("b", 3): 300, (None, 3): 500, (None, 5): 1500}
    rates, mu = balanced(spark, cells, goals)
    total, size = sum(goals.values()), sum(cells.values())
    for s, target in goals.items():
        assert sum(rates[c] * n for c, n in cells.items() if c[0] == s) == pytest.approx(target)
    off, flat = 0.0, 0.0
    for b in (0, 3, 5):
        wanted = sum(n for c, n in cells.items() if c[1] == b) * total / size
        got = sum(rates[c] * n for c, n in cells.items() if c[1] == b)
        assert got - wanted + mixing.PENALTY * wanted * mu[b] == pytest.approx(0, abs=1e-6 * total)
        off += abs(got - wanted)
        flat += abs(sum(goals[c[0]] / sum(m for d, m in cells.items() if d[0] == c[0]) * n for c, n in cells.items() if c[1] == b) - wanted)
    free = [s for s in goals if all(rates[c] < 3 for c in cells if c[0] == s)]
    ratio = {s: rates[s, 3] / rates[s, 5] for s in free if (s, 5) in cells and (s, 3) in cells}
    assert all(x == pytest.approx(math.exp(mu[3] - mu[5])) for x in ratio.values())
    assert off < most * flat and len({round(rates[c], 6) for c in cells if c[0] == "a"}) > 1


def test_balance_of_targets_that_shares_cannot_meet(spark):
    """A band that only one source has, and a source at its cap: targets are met all the same."""
    rates, _ = balanced(spark, {("a", 2): 100, ("b", 6): 900}, {"a": 300.0, "b": 700.0})
    assert rates == {("a", 2): pytest.approx(3), ("b", 6): pytest.approx(700 / 900)}
    rates, _ = balanced(spark, {("a", 2): 100, ("a", 6): 50, ("b", 6): 900}, {"a": 450.0, "b": 600.0})
    assert rates["a", 2] == rates["a", 6] == pytest.approx(3)
    levels, mu = mixing.balance(spark.createDataFrame([], "source string, band int, size bigint"), spark.createDataFrame([("x", 0.0)], "source string, target double"))
    assert levels.count() == 0 and mu == [0.0] * mixing.BANDS


def test_bands(spark):
    sizes = [0, 1, 3, 4, 15, 16, 63, 64, 16383, 16384, 10**9]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(mixing.band(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in got] == [band_of(n) for n in sizes] == [0, 0, 0, 1, 1, 2, 2, 3, 6, 7, 7]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.MODEL)


def slow_paths(v, unit, best):
    s = unit.replace(" ", "▁")
    at = [[] for _ in range(len(s) + 1)]
    at[0] = [(0.0, ())]
    for i in range(len(s)):
        here = sorted(at[i], key=lambda x: -x[0])[:best]
        for j in range(i + 1, min(len(s), i + pieces.LONGEST) + 1):
            if s[i:j] in v.logp and "▁" not in unit[i:j]:
                at[j] += [(x + v.logp[s[i:j]], t + (v.ids[s[i:j]],)) for x, t in here]
        if s[i] not in v.logp or unit[i] == "▁":
            raw = unit[i].encode()
            at[i + 1] += [(x - pieces.BYTE_COST * len(raw), t + tuple(v.byte_ids[b] for b in raw)) for x, t in here]
    return sorted(at[-1], key=lambda x: -x[0])[:best]


def test_lattices(encoder):
    r = random.Random(15)
    for _ in range(120):
        n = r.randint(1, 14)
        units = ["".join(r.choice(" theringaoné▁😀\n1*") for _ in range(n)) for _ in range(3)]
        logs, sizes, ids = encoder.vocabulary.paths(units, 4)
        at = 0
        for u, row, size in zip(units, logs, sizes, strict=True):
            want = slow_paths(encoder.vocabulary, u, 4)
            assert (~np.isneginf(row)).sum() == len(want)
            for x, k in zip(row, size, strict=True):
                if k:
                    assert encoder.vocabulary.decode(ids[at : at + k].tolist()) == u
                at += k
            assert np.allclose([x for x, k in zip(row, size, strict=True) if k], [x for x, _ in want], atol=1e-2)


def test_encode_decode(encoder):
    texts = [t or "" for t in ODD] + ["▁ literal", "a퟿b", "  two  spaces "]
    for row, t in zip(encoder.encode(texts, list(range(len(texts)))), texts, strict=True):
        decode = encoder.vocabulary.decode
        assert decode(row["best"].tolist()) == t
        assert all(decode(ids.tolist()) == t for ids, _, _ in row["samples"])
        assert len({ids.tobytes() for ids, _, _ in row["samples"]}) == len(row["samples"])
        assert all(0 <= q <= 1 for *_, q in row["samples"])


def test_every_piece_is_used(encoder):
    """Each piece of the model is one unit's lattice edge, alone and with words around it, however long it is or what it joins."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    assert set(encoder.vocabulary.ids.values()) == set(plain)
    scored = [i for i in plain if model.get_score(i) > -1e8]
    assert scored == sorted(scored, key=lambda i: -model.get_score(i))
    for i in plain:
        text = model.id_to_piece(i).replace("▁", " ")
        assert len(pieces.UNIT.findall(text)) == 1, text
        for around in (f"a\n{text}\na", f"a{text} b", f"1{text}1"):
            ends = set(itertools.accumulate(map(len, pieces.UNIT.findall(around))))
            at = around.index(text)
            assert not ends & set(range(at + 1, at + len(text))), around
    texts = [" international", "Configuration", " " * 16 + "x", "a" + " " * 4 + "_b", "x;\r\n", "m²."]
    rows = encoder.encode(texts, list(range(len(texts))))
    got = [[encoder.vocabulary.text[i] for i in row["best"]] for row in rows]
    assert [len(p) for p in got[:2]] == [1, 1] and "▁" * 16 in got[2] and any(len(p) > 1 and set(p) == {"▁"} for p in got[3]) and ";\r" in got[4] and "²." in got[5]
    assert ["".join(map(str, p)) for p in got[:3]] == [t.replace(" ", "▁") for t in texts[:3]]


def all_paths(v, unit):
    s, at = unit.replace(" ", "▁"), [[(0.0, ())]] + [[] for _ in unit]
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in v.ids:
                at[j] += [(x + v.logp[s[i:j]], (*t, v.ids[s[i:j]])) for x, t in at[i]]
    whole = math.log(sum(math.exp(x) for x, _ in at[-1]))
    return {t: x - whole for x, t in at[-1]}


@pytest.mark.parametrize("best", [1, 2, 4])
def test_whole_lattices_are_sampled(best):
    """Every segmentation of every unit has its probability, however many are listed; draws are without replacement."""
    e, text, rounds = pieces.Encoder(pieces.MODEL, samples=3, best=best), "xqzthere is", 4000
    one, two = (all_paths(e.vocabulary, u) for u in pieces.UNIT.findall(text))
    p = {a + b: x + y for a, x in one.items() for b, y in two.items()}
    assert len(one) > 20 and len(two) > 3
    first, second, weight = Counter(), Counter(), 0.0
    for row in e.encode([text] * rounds, list(range(rounds))):
        ids = [tuple(a.tolist()) for a, _, _ in row["samples"]]
        assert len(set(ids)) == 3
        first[ids[0]] += 1
        second[ids[1]] += 1
        for t, (_, lp, q) in zip(ids, row["samples"], strict=True):
            assert lp == pytest.approx(p[t], abs=1e-6)
            weight += math.exp(p[t]) / q
    assert max(abs(first[t] / rounds - math.exp(x)) for t, x in p.items()) < 0.03
    want = {t: sum(math.exp(a + x) / -math.expm1(a) for s, a in p.items() if s != t) for t, x in p.items()}
    assert max(abs(second[t] / rounds - x) for t, x in want.items()) < 0.03
    assert weight / rounds == pytest.approx(1, abs=0.05)
    rare = set(p) - {a + b for a in sorted(one, key=one.get)[-4:] for b in sorted(two, key=two.get)[-4:]}
    assert sum(first[t] for t in rare) / rounds == pytest.approx(sum(math.exp(p[t]) for t in rare), abs=0.01)
    assert sum(first[t] for t in rare) > 0
    # All of them, and no more, where more are asked for than there are.
    few = pieces.Encoder(pieces.MODEL, samples=10_000, best=best).encode([" is"], [1])[0]["samples"]
    assert {tuple(a.tolist()) for a, _, _ in few} == set(all_paths(e.vocabulary, " is")) and all(q == 1 for *_, q in few) and len(few) == len(all_paths(e.vocabulary, " is"))


def test_draw_without_replacement():
    logs = np.log(np.array([[0.5, 0.3, 0.2], [0.7, 0.3, 1e-300], [0.6, 0.4, 1e-300]]))
    logs[1:, 2] = -np.inf
    p = {c: math.exp(sum(logs[i, x] for i, x in enumerate(c))) for c in itertools.product(range(3), range(2), range(2))}
    rng, first, pair, weight, rounds = np.random.default_rng(0), Counter(), Counter(), Counter(), 12000
    for _ in range(rounds):
        drawn = pieces.draw(logs, 3, rng)
        c = [tuple(x.tolist()) for x, _, _ in drawn]
        assert len(set(c)) == 3
        first[c[0]] += 1
        pair[c[0], c[1]] += 1
        for (_, lp, q), x in zip(drawn, c, strict=True):
            assert lp == pytest.approx(math.log(p[x]))
            weight[x] += p[x] / q  # inclusion scores make these sums unbiased
    assert max(abs(first[c] / rounds - p[c]) for c in p) < 0.02
    assert max(abs(pair[a, b] / rounds - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.015
    assert sum(weight.values()) / rounds == pytest.approx(1, abs=0.03)
    assert len(pieces.draw(logs[1:], 10, rng)) == 4 and pieces.draw(logs[1:], 10, rng)[0][2] == 1.0
    assert len(pieces.draw(np.array([[0.0, -np.inf]]), 3, rng)) == 1


def test_texts_drawn_together_or_alone(encoder, monkeypatch):
    """What a text gets doesn't depend on the texts it is drawn with."""
    r = random.Random(7)
    texts = ["", *("".join(r.choice(["qz", "there", " ", "is", "12", "-", "\n", "é"]) for _ in range(r.randint(0, 300))) for _ in range(40)), ""]
    look = lambda rows: [(row["units"], row["best_logp"], row["best"].tolist(), [(a.tolist(), lp, q) for a, lp, q in row["samples"]]) for row in rows]
    alone = [look(encoder.encode([t], [i]))[0] for i, t in enumerate(texts)]
    for together in (1, 100, 1 << 20):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        assert look(encoder.encode(texts, list(range(len(texts))))) == alone
        assert look(pieces.Encoder(pieces.MODEL).encode(texts[::-1], list(range(len(texts)))[::-1])) == alone[::-1]
    assert alone[0] == (0, 0.0, [], [([], 0.0, 1.0)])


def test_units_met_often_stay(monkeypatch):
    """Units that are met again and again are not found anew when there are too many to keep."""
    monkeypatch.setattr(pieces, "KEPT", 60)
    e, asked, find = pieces.Encoder(pieces.MODEL), Counter(), pieces.Vocabulary.paths_and_mass
    monkeypatch.setattr(e.vocabulary, "paths_and_mass", lambda units, *more: asked.update(units) or find(e.vocabulary, units, *more))
    often = " there is xqzthere always"
    for i in range(12):
        text = often + "".join(f" x{chr(97 + i)}{chr(97 + j)}" for j in range(26)) + often
        row = e.encode([text], [i])[0]
        assert e.vocabulary.decode(row["best"]) == text and all(e.vocabulary.decode(ids) == text for ids, _, _ in row["samples"])
        assert len(e.units) <= 60 + 30
    assert set(asked[u] for u in pieces.UNIT.findall(often)) == {1}


def test_decode_bytes(encoder):
    v = encoder.vocabulary
    assert v.decode([v.byte_ids[0], v.byte_ids[0xC3], v.byte_ids[0xA9]]) == "\0é" and v.decode([]) == ""
    with pytest.raises(UnicodeDecodeError):
        v.decode([v.byte_ids[0xFF]])


def test_a_worker_keeps_its_encoder(spark):
    """The vocabulary is read once in each Python worker, not in each task."""
    ship_package(spark)
    spark.sparkContext.addFile(pieces.MODEL)
    name = pieces.MODEL.rsplit("/", 1)[-1]

    def look(_):
        yield os.getpid(), id(pieces.worker_encoder(SparkFiles.get(name), 3, 4, 1.0))

    seen = spark.sparkContext.parallelize(range(16), 16).mapPartitions(look).collect()
    assert len(seen) == 16 and len(set(seen)) == len({pid for pid, _ in seen}) < 16


def test_pieces_on_odd_rows(spark):
    encoded = pieces.encode(frame(spark, extra=EXTRA)).cache()
    assert encoded.count() == len(ODD) + len(EXTRA) and encoded.filter("not round_trip").count() == 0
    texts = {r["id"]: r["text"] for r in pieces.decode(encoded.filter("id is not null")).collect()}
    assert texts == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encode(frame(spark, []).limit(0)).count() == 0
    again = {r["id"]: r["samples"] for r in pieces.encode(frame(spark).repartition(3)).collect()}
    assert all(again[r["id"]] == r["samples"] for r in encoded.filter("id is not null").collect())


def test_word_counts_match_pattern(spark):
    df = frame(spark)
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(ODD)}


def test_shard_equals_word_by_word():
    """Arrays by level give what the trie in a dict gives, long words and unseen ones included."""
    r = random.Random(16)
    words = {}
    for _ in range(900):
        w = "".join(r.choice(["th", "er", "an", "é", "x", "\0", "ing"]) for _ in range(r.randint(1, 5))).encode()
        words[w] = r.choice([0, 1, 1, 2, 7, 40])
    base = b"longword" * 4
    words |= {base + bytes([97 + i % 3]) * (i % 9 + 1): i % 4 for i in range(20)} | {base[:32]: 2, base[:33]: 1, base[:31]: 0, b"a": 3, b"b": 0}
    train = {w: c for w, c in words.items() if c}
    upper, short = {}, {}
    for w, c in train.items():
        s, led = w + b" ", b" " + w + b" "
        for i in range(min(lm.DEPTH, len(s))):
            upper.setdefault(s[:i], Counter())[s[i]] += c
        for i in range(1, len(led)):
            for k in range(min(2, i) + 1):
                short.setdefault(led[i - k : i], Counter())[led[i]] += c
    shards = {}
    for w, c in words.items():
        shards.setdefault((w + b" ")[: lm.DEPTH], []).append((w, c))
    for group in ([x for v in shards.values() for x in v], max(shards.values(), key=len)):
        nodes = lm.deep_nodes(group)
        want, got = ({} for _ in range(2))
        stats, plain = lm.defaultdict(lambda: [0, 0]), lm.defaultdict(lambda: [0, 0])
        lm.Shard(group).left_out(stats)
        for node in nodes.values():
            lm.left_out(list(node.values()), plain)
        assert {k: v for k, v in stats.items() if v[0]} == {k: v for k, v in plain.items() if v[0]}
        escapes = lm.Escapes({k: tuple(v) for k, v in plain.items()})
        shard = lm.Shard(group)
        got = dict(zip(shard.words, shard.logps(upper, lm.Short(short), escapes), strict=True))
        want = {w: lm.word_logp(w, nodes, upper, {}, lm.Short(short), escapes) for w, _ in group}
        assert got == {w: pytest.approx(x) for w, x in want.items()}
    assert all(lm.node_classes(np.array([x]))[0] == lm.node_class(x, 1)[0] for x in range(0, 5000))
