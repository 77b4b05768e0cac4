"""Leader clusters and links over shared keys against brute force."""

import difflib
import random
from collections import defaultdict

import pytest

from tidewatch.operators.leaders import leader_clusters
from tidewatch.operators.links import link_counts, partners
from tidewatch.sources import adapters

RECORDS = "id bigint, title string, summary string, parties array<string>, digest string, leader bigint"


def likeness(new, old):
    a, b = (set((r[2] or "").lower().split()) for r in (new, old))
    p, q = ({x.lower() for x in r[3] or () if x is not None} for r in (new, old))
    ratio = difflib.SequenceMatcher(None, (new[1] or "").lower(), (old[1] or "").lower()).ratio()
    return ratio * 0.5 + len(a & b) / float(max(len(a | b), 1)) * 0.35 + (0.15 if p & q else 0.0)


def brute_leaders(rows):
    leaders, out = [], {}
    for r in sorted(rows, key=lambda r: r[0]):
        found = next((x for x in leaders if likeness(r, x) >= 0.52), None)
        if found is None:
            leaders.append(r)
        out[r[0]] = (found or r)[0]
    return out


def led(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORDS).repartition(3)
    return sorted((r["id"], r["leader"]) for r in leader_clusters(df, **how).collect())


def reports(n, seed):
    r = random.Random(seed)
    words = ["robot", "Bank", "outage", "leak", "model", "court", "drone", "the", "of", "é", "fails", "again", "chatbot", "lawsuit"]
    parties = ["Acme", "acme", "Globex", "Initech", "Hooli", "Umbrella", "Stark"]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randrange(a, b)))
    return [(i, some(0, 9), some(0, 14), [r.choice(parties) for _ in range(r.randrange(0, 3))]) for i in range(n)]


@pytest.mark.parametrize(("block", "largest"), [(1024, 4096), (3, 7), (1, 1)])
def test_leaders(spark, block, largest):
    """Blocks of any size give the same leaders. Single-record blocks only on few records: each costs a round."""
    rows = reports(300 if block > 100 else 80 if block > 1 else 12, block)
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 12, 2)]
    got = led(spark, rows, block=block, largest=largest)
    assert dict(got) == brute_leaders(rows)
    assert len({x for _, x in got}) < len(rows)


def test_leaders_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "", []), (3, "same", None, None), (4, "same", None, None), (5, "only", "", ["P"]), (6, "only", "", ["p", None]), (7, "t" * 3000, "w " * 500, ["Q"]), (8, "t" * 2999, "w", ["q"])]
    assert led(spark, rows) == sorted(brute_leaders(rows).items())
    assert led(spark, []) == []
    same = [(9, "a b c", "a b c", ["z"])] * 3 + [(None, "a b c", "a b c", ["z"]), (None, "unlike anything", "else", [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in same], RECORDS)
    assert sorted(((r["id"], r["leader"]) for r in leader_clusters(df).collect()), key=str) == [(9, 9)] * 3 + [(None, 9), (None, None)]
    with pytest.raises(ValueError):
        leader_clusters(df, threshold=0.5)


def test_leaders_of_all_incidents(spark):
    inc = adapters.incidents(spark, "/root/testdata/sf0.001")
    rows = inc.selectExpr("key AS id", "title", "summary", "affected_parties AS parties")
    assert {r["id"]: r["leader"] for r in leader_clusters(rows, block=16).collect()} == brute_leaders([tuple(r) for r in rows.collect()])


def brute_links(rows):
    holders, partners_of = defaultdict(set), defaultdict(set)
    for i, k in rows:
        if i is not None and k is not None:
            holders[k].add(i)
    for ids in holders.values():
        for i in ids:
            partners_of[i] |= ids - {i}
    return {i: len(v) for i, v in partners_of.items()}


@pytest.mark.parametrize("block", [512, 4, 1])
def test_links(spark, block):
    r = random.Random(block)
    rows = [(r.randrange(120), r.choice("abcdefghijk") + str(r.randrange(6))) for _ in range(260)] + [(i, "hot") for i in range(0, 120, 3)] + [(500, "alone"), (None, "hot"), (7, None), (3, "hot")]
    df = spark.createDataFrame(rows, "id bigint, key string").repartition(3)
    got = link_counts(df, block=block).collect()
    assert {x["id"]: x["links"] for x in got} == brute_links(rows) and len(got) == len({x["id"] for x in got})
    keys, holders = defaultdict(set), defaultdict(set)
    for i, k in rows:
        if i is not None and k is not None:
            keys[i].add(k)
            holders[k].add(i)
    shared = {i: frozenset(k for k in ks if len(holders[k]) > 1) for i, ks in keys.items()}
    assert all(x["class"] == (min(j for j in shared if shared[j] == shared[x["id"]]) if shared[x["id"]] else x["id"]) for x in got)
    assert link_counts(df.limit(0)).count() == 0


def test_links_of_a_hot_key(spark):
    """One key of 20,000 holders, who also share other keys by twos: 10,000 classes of the hot key, in 20 blocks."""
    df = spark.range(20_000).selectExpr("id", "explode(array('hot', concat('pair', id div 2), concat('ring', id % 9999), concat('own', id))) AS key")
    got = {r["id"]: r["links"] for r in link_counts(df).collect()}
    assert len(got) == 20_000 and set(got.values()) == {19_999}
    apart = spark.range(20_000).selectExpr("id", "explode(array('hot' || (id % 2), concat('pair', id div 2))) AS key")
    assert {r["links"] for r in link_counts(apart).collect()} == {10_000}


def test_partners():
    a = [{"class": 1, "size": 2, "keys": ["a", "k"]}, {"class": 2, "size": 3, "keys": ["k"]}]
    b = [{"class": 3, "size": 5, "keys": ["a", "k"]}]
    assert partners("k", a, None) == [(1, 3), (2, 2)]
    assert partners("k", a, b) == [(1, 0), (2, 5), (3, 3)]
    assert partners("a", a[:1], b) == [(1, 5), (3, 2)]
