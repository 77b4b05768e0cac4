"""Rules, filters, components, consolidation, sync, sources and streams on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.text import word_jaccard
from tidewatch.operators import aggregate, classify, cluster, explore, graph, rules, similarity, sync
from tidewatch.operators.components import connected_components
from tidewatch.sources import connectors
from tidewatch.streaming import ingest


@pytest.mark.parametrize(("text", "severity", "usd", "how"), [
    ("lost $3 million, later $1.5 billion", "low", 1500000000, "explicit_confirmed"),
    ("$1,200 million lawsuit", "high", 4500000, "statutory_formula"),
    ("user killed", "low", 12500000, "vsl_benchmark"),
    ("bank outage", "low", 280000, "regulatory_turnover"),
    ("phishing wave", "critical", 6800000, "empirical_estimate"),
    ("rogue agent", "high", 2500000, "cyber_breach_report"),
    ("model drift", "medium", 850000, "empirical_estimate"),
    ("model drift", "low", 350000, "empirical_estimate"),
    ("model drift", "unknown", 350000, "empirical_estimate"),
])
def test_damage(spark, text, severity, usd, how):
    a, b = rules.damage(F.col("t"), F.col("s"))
    assert tuple(spark.createDataFrame([(text, severity)], "t string, s string").select(a, b).first()) == (usd, how)


def record(spark, **values):
    names = ["title", "summary", "full_text", "root_cause_category", "system_classification", "harm_type", "primary_purpose", "impact_scope", "severity"]
    ddl = ", ".join(f"{n} string" for n in names) + ", financial_damage_usd bigint"
    return spark.createDataFrame([tuple(values.get(n) for n in names) + (values.get("usd"),)], ddl)


def test_classifiers(spark):
    nist = lambda **v: record(spark, **v).select(rules.nist_function()).first()[0]
    assert [nist(title="Security review"), nist(summary="latest release"), nist(summary="hack"), nist()] == ["GOVERN", "MEASURE", "MANAGE", "MAP"]
    iso = lambda **v: record(spark, **v).select(rules.iso_category()).first()[0]
    assert [iso(primary_purpose="recruitment_hr"), iso(summary="traded"), iso(summary="exploit"), iso()] == ["Internal_Governance", "Data_&_Resources", "Operational_Security", "System_Impact"]
    scope = lambda **v: record(spark, **v).select(rules.impact_scope()).first()[0]
    assert scope(summary="first half of 2025") == scope(impact_scope="cumulative_macro_trend") == "cumulative_macro_trend"
    assert scope(summary="x") == "discrete_incident"


def test_damage_policies(spark):
    row = lambda p, usd: tuple(rules.enriched(record(spark, title="x", summary="hack", full_text="killed", severity="low", usd=usd), p).select("damage_rule", "damage_method").first())
    assert row("always", 7) == (12500000, "vsl_benchmark")
    assert row("ingest", 7) == (7, "explicit_confirmed")
    assert row("ingest", 0) == (450000, "cyber_breach_report")
    assert row("backfill", 7) == (7, None)
    assert row("backfill", None) == (12500000, "vsl_benchmark")


def test_search_is_literal(spark):
    df = spark.createDataFrame([("100% sure", "", ["Acme"]), ("100 sure", "", ["x_y"])], "title string, summary string, affected_parties array<string>")
    assert df.filter(explore.matches("100%")).count() == 1
    assert df.filter(explore.matches("X_Y")).count() == 1


def test_natsec_unknown_matches_neither(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "natsec_impact boolean")
    assert [df.filter(explore.predicate(natsec=v)).count() for v in ("yes", "no", "all")] == [1, 1, 3]


def test_components(spark):
    assert {(r[0], r[1]) for r in connected_components(spark.createDataFrame([(0, 2), (1, 2)], "src bigint, dst bigint")).collect()} == {(0, 0), (1, 0), (2, 0)}
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    got = {x[0]: x[1] for x in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_consolidate(spark):
    rows = [(1, 5, "aa", ["http://www.e.com/a"], ["p"], 1), (2, 9, "bb", ["https://e.com/a/", "https://e.com/b"], ["q", "p"], 1)]
    df = spark.createDataFrame(rows, "id bigint, usd bigint, summary string, urls array<string>, parties array<string>, cluster bigint")
    for part in (df, df.orderBy(F.desc("id"))):
        r = cluster.consolidate(part, "id", "usd", "summary", "urls", "parties").first()
        assert (r["usd"], r["summary"], r["urls"], r["parties"]) == (9, "aa", ["http://www.e.com/a", "https://e.com/b"], ["p", "q"])


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "id bigint, t string")
    pairs = similarity.cosine_pairs(similarity.tfidf(similarity.term_counts(docs, "id", "t"), 2), 0.2).collect()
    assert [round(p["sim"], 4) for p in pairs] == [0.2020]


def test_prefix_filter_is_exact(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg"]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    v = similarity.tfidf(similarity.term_counts(spark.createDataFrame(docs, "id bigint, t string"), "id", "t"), 60).cache()
    rows = {}
    for x in v.collect():
        rows.setdefault(x["id"], {})[x["term"]] = x["v"]
    for t in (0.2, 0.5, 0.9):
        want = {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if sum(rows[a].get(k, 0) * w for k, w in rows[b].items()) >= t + 1e-9}
        got = {(p["id1"], p["id2"]) for p in similarity.cosine_pairs(v, t).collect()}
        assert want <= got and len(got - want) <= 3


def test_sync(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string")
    assert sorted(map(tuple, sync.upsert(a, b, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert [r["k"] for r in sync.mirror_deletions(a, b, "k").collect()] == [1]
    assert sync.mirror_deletions(a, b.limit(0), "k").count() == 0
    twice = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, "x")], "k bigint, o bigint, v string")
    assert sorted((r["k"], r["v"]) for r in sync.first_per_id(twice, "k", "o").collect()) == [(1, "first"), (2, "x")]


def test_graph_repair(spark):
    df = spark.createDataFrame([("e1", 1), (None, 2), ("e1", 3)], "edge_id string, seq bigint")
    assert [r["fixed_id"] for r in graph.repaired_ids(df).orderBy("seq").collect()] == ["e1", "EDGE-R2", "EDGE-R3"]


def test_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, title string")
    assert [r["is_ai_incident"] for r in classify.gate(df).collect()] == [False, False]
    calls = []

    def broken(batch):
        calls.append(1)
        raise ValueError("429 quota exceeded")

    good = lambda batch: [{"is_ai_incident": x["title"] == "a", "confidence": 0.9, "rejection_reason": ""} for x in batch]
    assert sorted((r["k"], r["is_ai_incident"]) for r in classify.gate(df, good).collect()) == [(1, True), (2, False)]
    assert classify.retrying([broken, good], attempts=2, wait=0)([{"title": "a"}])[0]["is_ai_incident"] and len(calls) == 2
    assert classify.retrying([broken, good], attempts=2, wait=0, again=lambda e: False)([{"title": "a"}])[0]["is_ai_incident"] and len(calls) == 3  # other failures go to the next model at once
    same = lambda batch: [{"is_same_incident": True, "confidence": c["k"] / 2, "reasoning": ""} for c in batch]
    assert sorted((r["k"], r["matched"]) for r in classify.verdicts(df, same).collect()) == [(1, False), (2, True)]


def test_mode_ties_and_empty(spark):
    df = spark.createDataFrame([("x", 2), ("y", 1), ("x", 3), ("y", 4)], "d string, o bigint")
    assert aggregate.top_value(df, "d", F.col("o")).first()[0] == "y"
    assert aggregate.top_value(df.limit(0), "d", F.col("o")).first()[0] == "N/A"


def test_feed_and_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(f"<item><title>T{i} - Pub</title><link>l{i}</link><pubDate>Thu, 13 Aug 2026 07:00:00 GMT</pubDate><description>d</description></item>" for i in range(5)) + "</channel></rss>")
    got = connectors.read_feed(spark, str(tmp_path / "f.xml"), 3).collect()
    assert len(got) == 3 and got[0]["title"] == "T0" and str(got[0]["pub_date_clean"]) == "2026-08-13"
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    df = connectors.read_json_array(spark, str(tmp_path / "a.json"))
    assert df.count() == 2
    connectors.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert connectors.pooled(df, spark.createDataFrame([(1,)], "b bigint")).columns == ["a", "b"]
    assert connectors.live_or_static(df.limit(0), df).count() == 2
    df.write.parquet(str(tmp_path / "t"))
    new = spark.createDataFrame([(2,), (3,)], "a bigint")
    assert spark.read.parquet(connectors.upsert_parquet(spark, str(tmp_path / "t"), new, "a")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    rows = spark.range(200).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)).cast("timestamp_ntz").alias("ts"), F.element_at(F.array(*map(F.lit, ["view", "click", "purchase"])), (F.col("id") % 3 + 1).cast("int")).alias("event_type"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.read_events(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = ingest.merged(spark, str(tmp_path / "out"))
    want = sync.funnel(rows.withColumn("day", F.col("ts").cast("date")), "day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_plans(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 5).alias("g"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = df.filter("g = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(g), EqualTo(g,3)]" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_word_jaccard(spark):
    assert spark.createDataFrame([("A b", "b c")], "x string, y string").select(word_jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3)
