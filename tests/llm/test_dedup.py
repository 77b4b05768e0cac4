"""Exact, near and line dedup against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EXTRA, ODD, frame, rows
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.line_dedup import LineRuns, dropped_keys, line_dedup
from tidewatch.llm.near_dedup import MinMax, WordHashes, cell_links, near_dedup, shingles, similar
from tidewatch.llm.text import words_of

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}


@pytest.mark.parametrize("block", [3, 4096])
def test_exact(spark, block):
    texts = ODD + ["abcabcabd", "abcabcabd ", "abcabcab", "abc abc abd", "abcabcabdabc"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(frame(spark, texts), block=block).collect()}
    assert got == brute_exact(list(enumerate(texts)))


def test_exact_with_clashing_keys(spark):
    """Keys too short at first: names are drawn again with another seed until no two blocks clash."""
    texts = [chr(97 + i) * 3 for i in range(12)] + ["aaa"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(frame(spark, texts), block=4, key_bits=9).collect()}
    assert got == brute_exact(list(enumerate(texts)))


def test_exact_odd_rows(spark):
    got = exact_dedup(frame(spark, extra=EXTRA)).collect()
    assert len(got) == len(ODD) + len(EXTRA)
    group = [r for r in got if r["text_sha256"] == hashlib.sha256(WS.sub("", ODD[4]).encode()).hexdigest()]
    assert len(group) == 4 and {r["keep_id"] for r in group} == {4} and sum(r["kept"] for r in group) == 1
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 5 and sum(r["kept"] for r in empty) == 1 and {r["keep_id"] for r in empty} == {2}
    assert exact_dedup(frame(spark, []).limit(0)).count() == 0


def brute_lines(pairs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(i, owner.get(key(line), i))
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    r = random.Random(5)
    pool = [f"shared line number {i}" for i in range(12)] + ["short", " ÉTOILE line one ", "étoile line one", "ÉTOILE LINE ONE"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 8))) for _ in range(40)] + ODD
    df = frame(spark, texts, EXTRA)
    got = sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in line_dedup(df, batches=batches, fanout=fanout).collect()), key=repr)
    assert got == brute_lines([(x["doc_id"], x["text"]) for x in df.collect()])


def test_runs_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(4):
        lines = spark.createDataFrame([(b * 10 + i, i + b, 0) for i in range(3)], "id bigint, h1 bigint, h2 bigint")
        lost = sorted(x["h1"] for x in dropped_keys(lines, runs).collect())
        assert lost == ([] if b == 0 else [b, b + 1])
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.all().count() == runs.all().distinct().count() == 6
    assert line_dedup(frame(spark, []).limit(0)).count() == 0


def test_many_lines(spark):
    """Two texts of 20,000 lines, every third of them shared; rows that share an id lose lines by their own text."""
    one = [f"line of some length {i}" for i in range(20_000)]
    two = [f"line of some length {i}" if i % 3 == 0 else f"other line of some length {i}" for i in range(20_000)]
    texts = [(1, "\n".join(one)), (2, "\n".join(two)), (3, "\n".join(two)), (3, "line of some length 7\nshort\nanother text entirely"), (3, "line of some length 7\nshort\nanother text entirely")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in line_dedup(df).collect())
    assert got == sorted(brute_lines(texts))



def brute_near(pairs):
    sets = {i: frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := words_of(t)) else frozenset() for i, t in pairs}
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(r, words, share):
    return [r.choice("uvwxyz") * r.randint(2, 9) if r.random() < share else w for w in words]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_near(spark, rounds):
    r = random.Random(11)
    texts = list(ODD)
    for _ in range(6):
        base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(r.randint(60, 300))]
        texts += [" ".join(edited(r, base, share)) for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.2) for _ in range(3)]
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    texts += [passage + " " + " ".join("".join(r.choice("klmnop") for _ in range(5)) for _ in range(30)) for _ in range(20)]
    texts += [" ".join(texts[-1].split()), texts[-1].upper().lower()]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup(frame(spark, texts), rounds=rounds).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_odd_rows(spark):
    got = near_dedup(frame(spark, extra=EXTRA)).collect()
    assert len(got) == len(ODD) + len(EXTRA)
    assert all(x["component_id"] is None and x["kept"] for x in got if x["doc_id"] is None)
    assert near_dedup(frame(spark, []).limit(0)).count() == 0
    assert near_dedup(frame(spark, [None, "", " "])).filter("kept and component_id = doc_id and n_shingles = 0").count() == 3


def test_minmax_estimates_jaccard():
    import numpy as np

    r = np.random.default_rng(1)
    m = MinMax(rows=8, bands=250)
    for share in (0.2, 0.5, 0.9):
        both = r.integers(0, 1 << 63, int(1000 * share)).astype(np.uint64)
        a, b = (np.concatenate([both, r.integers(0, 1 << 63, 1000 - len(both)).astype(np.uint64)]) for _ in range(2))
        jaccard = len(both) / (2000 - len(both))
        va, vb = m.values(a), m.values(b)
        half = len(va) // 2
        for part in (slice(0, half), slice(half, None)):
            assert abs((va[part] == vb[part]).mean() - jaccard) < 0.06


def test_cell_links_span():
    import numpy as np

    r = random.Random(2)
    base = list(range(100))
    sets = [np.array(sorted(set(base) - {r.randrange(100)}), np.uint64) for _ in range(9)] + [np.array(range(500, 560), np.uint64)]
    links = cell_links(sets, None, 85)
    assert len(links) == 8 and all(9 not in x for x in links)
    assert {i for i, _ in cell_links(sets[:4], sets[4:], 85)} and all(j >= 4 for _, j in cell_links(sets[:4], sets[4:], 85))
    assert similar(sets[0], sets[1]) and not similar(sets[0], sets[9])
    assert len(shingles("a b", WordHashes())) == 1 and len(shingles(" ", WordHashes())) == 0


def test_helpers_have_ids():
    assert [x[0] for x in rows()] == list(range(len(ODD)))
    assert F is not None
