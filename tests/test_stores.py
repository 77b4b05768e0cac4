"""Stored tables, labels, indexes and streams: changes, increments and repeats give what a full run gives."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators import similarity, sync, term_index
from tidewatch.operators.components import ComponentStore, connected_components
from tidewatch.operators.pairs import block_pairs
from tidewatch.operators.term_index import TermIndex
from tidewatch.sources.tables import KeyedTable
from tidewatch.streaming import ingest

ROWS = "k bigint, v string, o bigint"


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def buckets_of(paths):
    return {int(p.split("bucket=")[1].split("/")[0]) for p in paths}


def test_changes_leave_other_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(ROWS), "k", 8)
    assert t.read().count() == 0 and t.delete(spark.createDataFrame([(1,)], "k bigint")) in ([], t.touched(spark.createDataFrame([(1,)], "k bigint")))
    rows = {i: (i, f"v{i}", 0) for i in range(200)}
    t.upsert(spark.createDataFrame(list(rows.values()), ROWS))
    before = files(t.path)
    change = [(3, "new", 1), (500, "more", 1)]
    touched = t.upsert(spark.createDataFrame(change, ROWS))
    rows |= {r[0]: r for r in change}
    after = files(t.path)
    assert 1 <= len(touched) <= 2
    assert {p: m for p, m in before.items() if buckets_of([p]) - set(touched)} == {p: m for p, m in after.items() if buckets_of([p]) - set(touched)}
    assert sorted(map(tuple, t.read().collect())) == sorted(rows.values())
    t.upsert(spark.createDataFrame(change, ROWS))  # again: nothing more
    assert sorted(map(tuple, t.read().collect())) == sorted(rows.values())
    plan = t.read([touched[0]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert t.upsert(spark.createDataFrame([], ROWS)) == []
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1, "a", 0), (1, "b", 0)], ROWS))


def test_partitions_that_lose_all_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(ROWS), "k", 4)
    t.upsert(spark.createDataFrame([(i, None, i) for i in range(30)] + [(None, "no key", 0)], ROWS))
    assert t.read().count() == 31
    t.delete(spark.createDataFrame([(i,) for i in range(30)] * 2, "x bigint"))
    assert [tuple(r) for r in t.read().collect()] == [(None, "no key", 0)]
    assert len(buckets_of(files(t.path))) == 1


def test_greater_order_stays(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(ROWS), "k", 4, order="o")
    changes = [(i % 7, f"v{i}", i) for i in range(40)]
    random.Random(2).shuffle(changes)
    for at in range(0, 40, 9):
        t.upsert(spark.createDataFrame(changes[at : at + 9], ROWS))
    t.upsert(spark.createDataFrame(changes[:9], ROWS))
    assert sorted(map(tuple, t.read().collect())) == [(k, f"v{max(i for i in range(40) if i % 7 == k)}", max(i for i in range(40) if i % 7 == k)) for k in range(7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_batches(spark, tmp_path, seed):
    """Any split and order of an edge list, a long chain among it, gives the labels of one run."""
    r = random.Random(seed)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(70)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400), (None, 3)]
    r.shuffle(edges)
    cuts = sorted(r.sample(range(len(edges)), 3))
    store = ComponentStore(spark, str(tmp_path / "labels"), 8)
    parts = [edges[a:b] for a, b in itertools.pairwise([0, *cuts, len(edges)])]
    for part in [*parts, parts[1]]:
        store.merge(spark.createDataFrame(part, "src bigint, dst bigint"))
    want = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))


def test_merge_touches_what_it_meets(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path / "labels"), 16)
    store.merge(spark.createDataFrame([(i * 10, i * 10 + 1) for i in range(100)], "src bigint, dst bigint"))
    before = files(store.labels.path)
    touched = store.merge(spark.createDataFrame([(0, 990)], "src bigint, dst bigint"))
    after = files(store.labels.path)
    assert len(touched) <= 2 and {p for p in before if p not in after} == {p for p in before if buckets_of([p]) <= set(touched)}
    assert store.read().filter("component = 0").count() == 4
    assert store.merge(spark.createDataFrame([], "src bigint, dst bigint")) == []


def test_index_by_batches(spark, tmp_path):
    """Probes of two batches give the pairs of a full run that have a document in the batch; a repeated batch replaces itself."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "robot", "bank", "court", "drone"]) for _ in range(r.randint(0, 9)))) for i in range(70)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "id bigint, text string")
    index = TermIndex(spark, str(tmp_path / "index"), block=5)
    index.add(df.filter("id < 50"), 0)
    index.add(df.filter("id >= 50"), 1)
    index.add(df.filter("id >= 50"), 1)
    vectors = similarity.tfidf(similarity.term_counts(df, "id", "text"), df.count())
    full = {(p["id1"], p["id2"]): p["sim"] for p in similarity.cosine_pairs(vectors, 0.3).collect()}
    near = lambda found, want: found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    probed = lambda b: {(p["id1"], p["id2"]): p["sim"] for p in index.probe(b, 0.3).collect()}
    old, new = probed(0), probed(1)
    assert near(new, {k: v for k, v in full.items() if k[1] >= 50}) and near(old | new, full) and len(full) > 50
    assert index.postings().selectExpr("max(size(docs)) AS n").first()["n"] < 70


def test_no_vector_is_shuffled_for_its_batch(spark, tmp_path, monkeypatch):
    """The probe knows a document's batch by its chunk."""
    index, plans = TermIndex(spark, str(tmp_path / "index"), block=2), []
    for batch in (0, 1):
        index.add(spark.createDataFrame([(10 * batch + i, f"alpha beta word{i}") for i in range(5)], "id bigint, text string"), batch)

    def seen(given, *args, **named):
        plans.append(given._jdf.queryExecution().executedPlan().toString())
        return block_pairs(given, *args, **named)

    monkeypatch.setattr(term_index, "block_pairs", seen)
    assert {(p["id1"], p["id2"]) for p in index.probe(1, 0.9).collect()} == {(i, 10 + i) for i in range(5)}
    joins = [x for x in plans[0].splitlines() if "Join [" in x]
    assert joins and all("Join [chunk#" in x or "Join [batch#" in x for x in joins)


def test_a_batch_that_is_cut_off(spark, tmp_path):
    """The first run dies after its second batch was written, before that is recorded; the next run repeats it."""
    schema = "k bigint, event_type string, o bigint, ts timestamp"
    rows = spark.range(120).selectExpr("id % 13 AS k", "element_at(array('view', 'click', 'purchase'), cast(id % 3 + 1 AS int)) AS event_type", "id AS o", "timestamp_seconds(1704067200 + id * 7200) AS ts")
    for i in range(4):
        rows.filter(f"o % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(schema), "k", 4, order="o")
    stream = lambda: ingest.read_events(spark, str(tmp_path / "in"), schema)
    seen = []

    def dies(number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("lost")

    where = str(tmp_path / "counts"), str(tmp_path / "cp")
    with pytest.raises(Exception, match="lost"):
        ingest.keep_latest(stream(), t, *where, after=dies)
    ingest.keep_latest(stream(), t, *where, after=dies)
    assert seen == [0, 1, 1, 2, 3]
    assert sorted((r["k"], r["o"]) for r in t.read().collect()) == [(k, max(i for i in range(120) if i % 13 == k)) for k in range(13)]
    want = sync.funnel(rows.withColumn("day", F.col("ts").cast("date")), "day")
    assert sorted(map(tuple, ingest.merged(spark, where[0]).collect())) == sorted(map(tuple, want.collect()))


def test_stream_without_repeats(spark, tmp_path):
    """Repeats within the watermark go, also across batches and runs; final days of the funnel equal those of a batch."""
    schema = "k bigint, event_type string, ts timestamp"
    rows = spark.range(60).selectExpr("id AS k", "if(id % 2 = 0, 'view', 'click') AS event_type", "timestamp_seconds(1704067200 + id * 10800) AS ts")
    for part in (rows.filter("k < 30"), rows.filter("k >= 20 AND k < 45"), rows.filter("k >= 45 OR k = 44")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once = ingest.once(ingest.read_events(spark, str(tmp_path / "in"), schema), "k")
    out = lambda: once.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    out()
    rows.filter("k = 59").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
    days = ingest.daily_funnel(ingest.read_events(spark, str(tmp_path / "in"), schema), "1 day")
    days.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).format("parquet").outputMode("append").start(str(tmp_path / "days")).awaitTermination()
    every = spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("day", F.col("ts").cast("date"))
    want = {r["day"]: tuple(r) for r in sync.funnel(every, "day").collect()}
    got = spark.read.parquet(str(tmp_path / "days")).collect()
    assert got and all(want[r["day"]] == tuple(r) for r in got) and len(got) < len(want)
