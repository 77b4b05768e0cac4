"""Vector codes against brute force in Python's own integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm.vector_codes import Codec, VantageTree, compress

SCHEMA = "vec_id bigint, embedding array<double>, label int, id bigint, v string, code string"


def brute(rows, parts, entries, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}
    width = len(kept[0][1]) // parts
    cut = {i: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def assign():
        return {i: [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for p, x in enumerate(xs)] for i, xs in cut.items()}

    for _ in range(rounds):
        members = defaultdict(list)
        for i, found in assign().items():
            for p, (_, e) in enumerate(found):
                members[p, e].append(cut[i][p])
        for (p, e), xs in members.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    found, by_label = assign(), defaultdict(int)
    for i, _, lab in kept:
        by_label[lab] += sum(d for d, _ in found[i])
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in found[i]), sum(d for d, _ in found[i]), by_label[lab], digest) for i, _, lab in kept}


def run(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame([(i, v, lab, 7, "v", "c") for i, v, lab in rows], schema).repartition(3)
    return [(r["id"], (r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in compress(df, **how).collect()]


def random_rows(n, length, seed=1, round_to=1):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(r.normal(0, 0.3, length), round_to)], [None, 0, 1, 1, 1][i % 5]) for i in r.permutation(n)]


@pytest.mark.parametrize(("n", "length", "parts", "entries"), [(120, 8, 4, 16), (5, 8, 4, 64), (70, 6, 2, 64)])
def test_codes(spark, n, length, parts, entries):
    """Components of one decimal give many equal parts, equal entries and equal distances."""
    rows = random_rows(n, length) + [(-9, None, 1), (-8, [None] * length, 1), (-7, [float("nan")] * length, None), (-6, [float("-inf")] + [0.0] * (length - 1), 0)]
    assert dict(run(spark, rows, parts=parts, entries=entries)) == brute(rows, parts, entries)


def test_odd_vectors(spark):
    """Other lengths and too large components have no code; very large whole numbers are exact; repeated rows count each."""
    rows = [(1, [1e9, -1e9], 0), (2, [1e9 + 1, 3.5], 0), (3, [1e12, -1e14], None), (3, [1e12, -1e14], None), (None, [0.1, 0.2], 5)]
    odd = [(4, [1.0], 0), (5, [], 0), (6, [1e300, 0.0], 0), (7, [None], 0)]
    got = run(spark, rows + odd, parts=2, entries=2)
    kept = {i: x for i, x in got}
    want = brute([(i, v, lab) for i, v, lab in [(10, *rows[0][1:]), (20, *rows[1][1:]), (30, *rows[2][1:]), (31, *rows[3][1:]), (99, *rows[4][1:])]], 2, 2)
    renamed = {10: 1, 20: 2, 30: 3, 99: None}
    for a, b in renamed.items():
        assert kept[b][:2] == (want[a][0], want[a][1] if want[a][1] < 1 << 63 else None)
        assert kept[b][3] == want[a][3]
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 3, 4, 5, 6]
    assert all(kept[i][:2] == (None, None) and kept[i][2] == kept[1][2] for i in (4, 5, 6))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 2)]) == []


def test_tree_is_exact():
    r = np.random.default_rng(3)
    for spread in (2, 50, 1 << 40):
        entries = r.integers(-spread, spread + 1, (64, 4))
        x = np.concatenate([r.integers(-spread, spread + 1, (500, 4)), entries])
        kind = object if spread > 1 << 30 else np.int64
        index, best = VantageTree(entries.astype(kind)).nearest(x.astype(kind))
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in x]
        assert [int(b) for b in best] == [min(row) for row in d]
        assert list(index) == [row.index(min(row)) for row in d]


def test_tree_leaves_out_entries():
    """Clustered entries: most of them are never compared."""
    r = np.random.default_rng(4)
    entries = (r.integers(0, 4, (64, 1)) * 100_000 + r.integers(-50, 51, (64, 4))).astype(np.int64)
    tree, seen = VantageTree(entries), [0]
    offer = tree._offer
    tree._offer = lambda e, rows: (seen.__setitem__(0, seen[0] + len(rows)), offer(e, rows))[1]
    x = entries[r.integers(0, 64, 1000)] + r.integers(-50, 51, (1000, 4))
    tree.nearest(x)
    assert seen[0] < 0.6 * 64 * len(x)


def test_parts_of_any_length():
    codec = Codec(np.arange(10).reshape(2, 5), 4)
    assert codec.bounds == [(0, 2), (2, 4), (4, 5), (5, 5)]
    codes, error = codec.assigned(np.arange(5).reshape(1, 5))
    assert codes.tolist() == [[0, 0, 0, 0]] and error.tolist() == [0]
