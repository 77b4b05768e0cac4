"""Source divergence against brute force over all pairs of groups."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import EXTRA, ODD, frame
from tidewatch.llm.divergence import Tiles, shares, source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term string, n bigint, rank int"


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        every = sum((count[lang, s] for s in sources), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        far = lambda x, y: (x - y) * (x - y) // (x + y)
        ps, q = {s: p(count[lang, s]) for s in sources}, p(every)
        for s in sources:
            pairs = [(-sum(far(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-far(ps[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] > 0 and ps[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def texts(n, words, seed=2):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words - 2)] + ["Ünïcode", "𝒳y"]
    weights = 1 / np.arange(1, words + 1)
    return [" ".join(r.choice(vocabulary, int(r.integers(0, 40)), p=weights / weights.sum())) for _ in range(n)]


@pytest.mark.parametrize(("block", "width"), [(256, 128), (3, 2), (1, 1)])
def test_divergence(spark, block, width):
    """Tiles of any size give the same; some sources have no words, some languages no kept term."""
    rows = [(t, ["en", "de", None, "e"][i % 4 if i % 9 else 0], ["a", "b", None, "é", "Z"][(i * i) % 5]) for i, t in enumerate(texts(90, 40))]
    rows += [(None, "en", "empty"), ("123 ,,", "xx", "only"), ("", "xx", "two"), ("rare words", "yy", "q"), ("A" * 5000 + " the " * 5000, "en", "a")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in source_divergence(df, min_docs=4, top=3, block=block, width=width).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 4, 3)


def test_odd_rows(spark):
    df = frame(spark, ODD, EXTRA)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert {tuple(r) for r in source_divergence(df, min_docs=2).select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows, 2, 10)


def test_empty(spark):
    assert source_divergence(frame(spark, [])).collect() == []


def test_terms():
    for t in [*[x for x in ODD if x], "".join(map(chr, range(1, 0x250))), "İSTANBUL Straße ﬁ"]:
        assert [w.decode() for w in terms_of(t)] == TERM.findall(t.translate(LOWER))


def test_shares_are_exact():
    r = np.random.default_rng(5)
    for most in (10, 10**6, 9 * 10**15):
        size = r.integers(2, most, 500)
        count = np.minimum(r.integers(0, most, 500), size - 2)
        assert shares(count, size).tolist() == [1 + 10**9 * (int(c) + 2) // int(s) for c, s in zip(count, size, strict=True)]


def test_tiles_add_up():
    """One tile of all terms, and tiles of single terms, give the same matrix and heaps."""
    kind = pa.struct([("term", pa.string()), ("rank", pa.int32()), ("n", pa.int64()), ("lang_n", pa.int64())])
    cells = [{"term": f"t{t}", "rank": g, "n": (g + 1) * (t + 1) % 7, "lang_n": 9 + t} for g in range(3) for t in range(5)]
    sizes = [np.array([30, 40, 50])]
    whole, parts = Tiles(2, 128), Tiles(2, 128)
    whole.add("x", 0, 0, 5, sizes, 100, [pa.array(cells, kind)])
    for t in range(5):
        parts.add("x", 0, 0, 1, sizes, 100, [pa.array([c for c in cells if c["term"] == f"t{t}"], kind)])
    assert sorted(whole.taken().to_pylist(), key=str) == sorted(parts.taken().to_pylist(), key=str)
