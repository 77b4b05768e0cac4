"""Substring dedup against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import EXTRA, ODD, frame
from tidewatch.llm.near_dedup import WordHashes
from tidewatch.llm.substrings import anchors, drop_repeats, prefix_length, repeats, windows_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text). Sorted (id, n_words, n_removed, kept)."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            if i is not None:
                key = tuple(ws[p : p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and least[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=repr)


def run(df, **how):
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in drop_repeats(df, **how).collect()), key=repr)


def passages(n, seed, vocabulary=30):
    """Texts of few words that share passages at many places; some are periods of one or two words."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "𝒳", "L" * 40]
    shared = [[r.choice(words) for _ in range(r.randrange(5, 40))] for _ in range(6)]
    texts = []
    for i in range(n):
        ws = [r.choice(words) for _ in range(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            ws[len(ws) // 2 : len(ws) // 2] = r.choice(shared)[r.randrange(0, 5) :]
        if i % 13 == 0:
            ws += ["the"] * r.randrange(0, 60) + ["a", "b"] * r.randrange(0, 20)
        texts.append(r.choice([" ", "\n", "  "]).join(ws))
    return texts


@pytest.mark.parametrize(("window", "most", "tree"), [(6, 2048, 8192), (12, 2048, 40), (12, 3, 2), (2, 1, 8192), (20, 20, 64)])
def test_repeats(spark, window, most, tree):
    """Small groups, hot ones in blocks and groups that are cut at the end of a round of trees give the same."""
    texts = passages(150, window)
    order = list(range(150))
    random.Random(1).shuffle(order)
    rows = [(i, t, "en", "s", 0, 7, "k", "n", 1) for i, t in zip(order, texts, strict=True)]
    df = spark.createDataFrame(rows, frame(spark, []).schema).repartition(5)
    got = run(df, window=window, most=most, tree=tree)
    assert got == brute([r[:2] for r in rows], window)
    assert sum(r[2] > 0 for r in got) > 20


def test_window_of_the_query(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [" ".join([*(word() for _ in range(40)), *passage[a:b], *(word() for _ in range(90))]) for a, b in [(0, 60), (0, 50), (5, 55), (10, 59), (0, 49), (3, 60)]]
    texts += [" ".join(passage), " ".join(passage[5:]), "x " * 3000, "y " + "x " * 2000]
    got = run(frame(spark, texts))
    assert got == brute(list(enumerate(texts)), 50)
    removed = {r[0]: r[2] for r in got}
    assert removed[1] == 50 and removed[2] == 50 and removed[3] == 0 and removed[4] == 0 and removed[9] == 2000


def test_odd_rows(spark):
    """Rows without an id, rows that repeat others, and rows that share an id but not a text."""
    long = " ".join(f"t{i}" for i in range(70))
    more = [(i, t, "en", "s", 0, 7, "k", "n", 1) for i, t in [(500, long), (500, long), (500, "z " + long), (501, long + " q"), (None, long), (502, "a b " + long)]]
    df = frame(spark, ODD, [*EXTRA, *more])
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], 50)
    assert run(df) == want
    assert run(df, most=1) == want


def test_empty(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [None, "", "a b"])) == [(0, 0, 0, ""), (1, 0, 0, ""), (2, 2, 0, "a b")]


def test_equal_windows_have_equal_anchors():
    hashes, window = WordHashes(), 12
    at = {}
    for text in passages(60, 3, vocabulary=4):
        words = words_of(text)
        found = windows_of(words, hashes, window)
        if found is None:
            continue
        covered = []
        for key, place, first, last in zip(*found, strict=True):
            for q in range(first, last + 1):
                covered.append(q)
                assert q <= place <= q + window - prefix_length(window)
                assert at.setdefault(tuple(words[q : q + window]), (place - q, key)) == (place - q, key)
        assert covered == list(range(len(words) - window + 1))


def test_anchors_are_leftmost_minima():
    x = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 5, 43):
        assert anchors(x, width).tolist() == [q + int(np.argmin(x[q : q + width])) for q in range(len(x) - width + 1)]


def test_trees():
    """Windows of four words around an anchor, for rows of two groups."""
    contexts = [b"p q a b c", b"p q a b d", b"q a b c", b"q a b d e", b"p q a b c"]
    found = repeats(np.array([1, 1, 1, 1, 2]), np.array([5, 6, 7, 8, 1]), np.array([2, 2, 1, 1, 2]), contexts, 4)
    assert found[:, :2].tolist() == [[False, False], [True, False], [True, False], [True, False], [False, False]]


def test_long_texts_take_linear_time():
    hashes, words = WordHashes(), [b"w%d" % (i % 977) for i in range(200_000)]
    assert len(windows_of(words, hashes, 50)[0]) < len(words) // 10
