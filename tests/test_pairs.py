"""Bags of terms in chunks and pairs of documents by blocks, against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import bags, pairs, similarity
from tidewatch.sources.runtime import Scratch

WORDS = ["alpha", "beta", "gamma", "delta", "robot", "bank", "court", "drone", "the", "größe"]


def texts(n, seed=7, most=9):
    r = random.Random(seed)
    return [(i * 3, " ".join(r.choice(WORDS) for _ in range(r.randint(0, most)))) for i in range(n)]


def counted(rows):
    """Terms by id; rows of one id are put together, bigrams stay within a row."""
    out = {}
    for i, t in rows:
        w = [x for x in (t or "").split() if x != "the"]
        out.setdefault(i, Counter()).update(w + [f"{a}_{b}" for a, b in itertools.pairwise(w)])
    return {i: c for i, c in out.items() if c}


def weighed(rows):
    tf = counted(rows)
    df = Counter(t for c in tf.values() for t in c)
    w = {i: {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in tf.items()}
    return {i: {t: x / math.sqrt(sum(y * y for y in c.values())) for t, x in c.items()} for i, c in w.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string").repartition(3)


ODD = [(900, None), (901, ""), (None, "alpha beta"), (902, "alpha beta robot"), (902, "robot gamma alpha")]


@pytest.mark.parametrize("most", [None, 4])
def test_top_terms(spark, most):
    rows = texts(60) + ODD
    table = Scratch(spark, "t").table(bags.bags(frame(spark, rows), "id", "text", most))
    got = {(r["id"], r["rank"]): (r["term"], round(r["v"], 9)) for r in bags.top_terms(table, len(rows), 3).collect()}
    want = {}
    for i, v in weighed(rows).items():
        for k, (t, x) in enumerate(sorted(v.items(), key=lambda p: (-round(p[1], 9), p[0]))[:3], 1):
            want[i, k] = (t, round(x, 9))
    assert got == want
    assert table.filter("slice is not null").select("chunk").distinct().count() > (1 if most else 0)


def test_terms_are_not_shuffled_by_document(spark):
    """A chunk's documents share its list of terms: what meets by term has a row for each chunk and term, not for each document."""
    rows = [(i, "alpha beta gamma delta") for i in range(500)]
    table = Scratch(spark, "t").table(bags.bags(spark.createDataFrame(rows, "id bigint, text string").coalesce(1), "id", "text"))
    known = bags.shared_terms(table).collect()
    assert len(known) <= 7 and sorted(x for r in known for x in bags._unpack(bytes(r["held"]), 3)[0][1]) == [500] * 7
    assert sorted((r["term"], r["n"]) for r in bags.chunk_terms(table).collect())[0] == ("alpha", 500)


@pytest.mark.parametrize("block", [2048, 7])
def test_cosines_by_blocks(spark, block):
    rows = texts(80) + ODD
    vectors = bags.vectors(Scratch(spark, "t").table(bags.bags(frame(spark, rows), "id", "text", 9)), len(rows))
    v = {i: x for i, x in weighed(rows).items() if i is not None}
    sims = {(a, b): sum(v[a].get(t, 0) * x for t, x in v[b].items()) for a, b in itertools.combinations(sorted(v), 2)}
    got = {(r["id1"], r["id2"]): r["sim"] for r in pairs.block_pairs(vectors, len(rows), 0.3, block=block).collect()}
    want = {k for k, s in sims.items() if s >= 0.3}
    assert got.keys() == want and all(abs(got[k] - sims[k]) < 1e-9 for k in got) and len(got) > 100
    some = pairs.block_pairs(vectors, len(rows), 0.3, new=vectors["id"] % 10 == 3, block=block).collect()
    assert sorted((r["id1"], r["id2"]) for r in some) == sorted(k for k in want if k[0] % 10 == 3 or k[1] % 10 == 3)


@pytest.mark.parametrize("block", [2048, 7])
def test_candidates_by_blocks(spark, block):
    """A key of all ids, ids without a vector, repeated keys and null ones; the counts are those of the pairs."""
    rows = texts(40) + [(900, None)]
    keys = [(i, f"k{i % 5}") for i, _ in rows] + [(0, "k0"), (None, "k0"), (3, None), (901, "k1")]
    parties = [(i, "all") for i, _ in rows if i % 2]
    made = bags.bags(frame(spark, rows), "id", "text", 9)
    vectors = bags.vectors(Scratch(spark, "t").table(made), len(rows))
    e, p = (spark.createDataFrame(x, "id bigint, key string") for x in (keys, parties))
    got = {(r["id1"], r["id2"]): (r["is_exact"], r["shared_parties"], round(r["sim"], 9)) for r in pairs.block_pairs(vectors, len(rows), 0.3, e, p, block=block).collect()}
    v, k, q = weighed(rows), dict(x for x in keys if None not in x), dict(parties)
    want = {}
    for a, b in itertools.combinations(sorted(i for i in set(v) | set(k) | set(q)), 2):
        found = (k.get(a, 1) == k.get(b, 2), a in q and b in q, round(sum(v.get(a, {}).get(t, 0) * x for t, x in v.get(b, {}).items()), 9))
        if found[0] or found[1] or found[2] >= 0.3:
            want[a, b] = found
    assert got == want
    n = pairs.block_pairs(vectors, len(rows), 0.3, e, p, counts=True, block=block).groupBy().sum().first()
    assert tuple(n) == (sum(x[0] for x in want.values()), sum(not x[0] for x in want.values()))


def test_no_row_for_a_candidate_is_shuffled(spark):
    """Between the blocks' table and the pairs there is no exchange, however many candidates there are."""
    rows = texts(30)
    vectors = bags.vectors(Scratch(spark, "t").table(bags.bags(frame(spark, rows), "id", "text")), len(rows))
    plan = pairs.block_pairs(vectors, len(rows), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "SortMergeJoin" not in plan


def test_product_of_dense_and_sparse_terms(monkeypatch):
    monkeypatch.setattr(pairs, "COLUMNS", 3)
    monkeypatch.setattr(pairs, "PRODUCTS", 10)
    r = np.random.default_rng(1)
    for n, m in ((40, 60), (1, 30)):
        held = [r.random((k, 50)) * (r.random((k, 50)) < np.linspace(0, 0.9, 50)) for k in (n, m)]
        sides = []
        for h in held:
            lists = [np.flatnonzero(x) * 1000 for x in h]
            sides.append(pairs.Incidence(pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), np.concatenate([h[i][x // 1000] for i, x in enumerate(lists)])))
        for dense in (1 / 256, 0.0, 2.0):
            monkeypatch.setattr(pairs, "DENSE", dense)
            assert np.allclose(pairs.product(*sides), held[0] @ held[1].T)
    empty = pairs.Incidence(pa.array([[], []], pa.list_(pa.int64())))
    assert pairs.product(empty, sides[1]).shape == (2, 30) and not pairs.product(empty, sides[1]).any()


def test_bags_and_vectors_agree_with_term_counts(spark):
    docs = frame(spark, texts(50))
    table = Scratch(spark, "t").table(bags.bags(docs, "id", "text", 6))
    got = {r["id"]: Counter(r["tfs"]) for r in bags.vectors(table, 50).collect()}
    shared = similarity.tfidf(similarity.term_counts(docs, "id", "text"), 50).filter("df > 1").count()
    assert sum(sum(c.values()) for c in got.values()) == shared


def test_names_survive_packing():
    r = random.Random(2)
    words = sorted({"".join(r.choice("abß") for _ in range(r.randint(0, 25))) for _ in range(400)}, key=str.encode)
    raw = [w.encode() for w in words]
    for some in (raw, raw[:1]):
        sizes, n = np.array([len(x) for x in some]), np.arange(len(some))
        local, counts, names = bags._held(bags._pack_names(n * 70_000, n + 1, sizes, np.frombuffer(b"".join(some), np.uint8)))
        assert [x.encode() for x in names.to_pylist()] == some and local.tolist() == (n * 70_000).tolist() and counts.tolist() == (n + 1).tolist()


def sparse(r, n, terms, heavy=0):
    """Rows of length 1 with few of the terms each; the first ones with those that all have."""
    m = r.random((n, terms)) * (r.random((n, terms)) < np.linspace(0.002, 0.3, terms))
    m[:heavy, -3:] += 3
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def incidence(m):
    lists = [np.flatnonzero(x) for x in m]
    return pairs.Incidence(pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), np.concatenate([m[i][x] for i, x in enumerate(lists)]))


@pytest.mark.parametrize("given", [{}, {"CROWDED": 2}, {"CROWDED": -1, "ROWS": 7}, {"RARE": 1 << 40}, {"RARE": 1}, {"SINGLE": 50, "PRODUCTS": 10, "CROWDED": 2}, {"PARTS": 1}])
def test_cells_that_reach_the_threshold(monkeypatch, given):
    for k, v in given.items():
        monkeypatch.setattr(pairs, k, v)
    r = np.random.default_rng(4)
    a, b = sparse(r, 90, 300, 10), sparse(r, 70, 300, 5)
    b[3] = a[30]
    want, also, within = a @ b.T, r.random((90, 70)) < 0.01, r.random((90, 70)) < 0.8
    for threshold in (0.05, 0.3, 0.9):
        for x, y in ((None, None), (also, None), (also, within), (None, within)):
            found = [c for part in pairs.alike(incidence(a), incidence(b), threshold, x, y) for c in zip(*part, strict=True)]
            hit = ((want >= threshold) | (False if x is None else x)) & (True if y is None else y)
            assert sorted((i, j) for i, j, _ in found) == sorted(zip(*np.nonzero(hit), strict=True)) and all(abs(s - want[i, j]) < 1e-12 for i, j, s in found)


def test_what_cannot_reach_the_threshold_is_not_multiplied():
    """Frequent terms are 0.4 of each vector's length, the rest is terms that two documents share."""
    r = np.random.default_rng(5)
    a, b = 0.4 * sparse(r, 400, 300), 0.4 * sparse(r, 500, 300)
    own = 0.9 * np.eye(400, 500)
    a, b = incidence(np.hstack([own[:, :400], a])), incidence(np.hstack([own.T, b]))
    assert np.count_nonzero(pairs.product(a, b)) > 0.9 * a.n * b.n
    assert np.argwhere(pairs.possible(a, b, *pairs._common(a, b), 0.2)).tolist() == [[k, k] for k in range(400)]


def test_blocks_are_packed_whole():
    """Documents without terms, keys of both kinds; what a block gives back is what was packed."""
    ints, kind = pa.list_(pa.int64()), pa.list_(pa.int32())
    docs = pa.table({"id": pa.array([5, -2, 9]), "norm": pa.array([2.0, 1.0, 4.0]), "terms": pa.array([[1 << 49, 3], [], [3]], ints), "tfs": pa.array([[2, 300], [], [1]], kind), "dfs": pa.array([[2, 2_000_000_000], [], [2_000_000_000]], kind), "exact": pa.array([[], [1 << 40], [1 << 40]], ints), "parties": pa.array([[], [], []], ints)})
    block = pairs.Block(pairs.pack_block(docs), 3_000_000_000)
    idf = lambda df: math.log(3_000_000_001 / (1 + df)) + 1
    assert block.ids.tolist() == [5, -2, 9] and block.terms.terms.tolist() == [3, 1 << 49] and block.terms.docs.tolist() == [0, 2, 0]
    assert np.allclose(block.terms.values, [150 * idf(2_000_000_000), idf(2_000_000_000) / 4, idf(2)])
    assert (block.keys[0].terms.tolist(), block.keys[0].docs.tolist(), len(block.keys[1].terms)) == ([1 << 40], [1, 2], 0)
