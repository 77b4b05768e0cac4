"""The pipeline's stages and the contracts of its queries on small tables."""

import os

import pytest

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.helpers import EXTRA, frame
from tidewatch.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    spark_rows, sql_rows = compare(spark, duck(DATA), QUERIES[name], ORACLES[name], DATA)
    assert spark_rows == sql_rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and now
        if name != "mixing":
            assert len(now) == len(set(now))
        ids = set(now)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.filter("not round_trip").count() == 0


def test_dropped_ids(spark):
    """Rows go by id, whichever the filter lets pass; rows without an id stay; an id stays if one of its rows is kept."""
    docs = frame(spark, [f"text {i}" for i in range(500)], EXTRA)
    found = spark.createDataFrame([(i, i % 3 != 0) for i in range(500)] + [(3, True), (None, False), (10_000, False)], "doc_id bigint, kept boolean")
    left = corpus_pipeline._without(docs, corpus_pipeline._dropped(found))
    assert left.columns == docs.columns
    want = [r["doc_id"] for r in docs.collect() if r["doc_id"] is None or r["doc_id"] % 3 or r["doc_id"] == 3]
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, want))
    nothing = docs.limit(0)
    assert corpus_pipeline._without(nothing, corpus_pipeline._dropped(found)).count() == 0
    assert corpus_pipeline._without(docs, found.limit(0).select("doc_id")).count() == docs.count()


def test_contract_columns(spark):
    want = {
        "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op2_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op10_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    }
    for name, columns in want.items():
        got = QUERIES[name](spark, DATA)
        assert set(columns) <= set(got.columns), name


def test_stages_on_odd_rows(spark):
    """No id, repeated rows, null and empty texts, and columns whose names the operators use."""
    docs = frame(spark, extra=EXTRA)
    nobody = docs.filter("doc_id is null").count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, DATA)
            assert out.columns == docs.columns
            if given is docs:
                assert out.filter("doc_id is null").count() == nobody
                kept = out
            else:
                assert out.count() == 0
    exact = corpus_pipeline.drop_copies(spark, docs, DATA)
    assert exact.filter("doc_id in (4, 6)").count() == 1 and exact.filter("text is null and doc_id is not null").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() == kept.count()


def test_near_stage_threshold(spark):
    """Pairs between 0.80 and 0.85 are near copies for the stage; pairs under 0.80 aren't."""

    def pair(k, cut):
        """100 words, and their first ones: 96 shingles and 96 - cut of them."""
        words = [f"w{k}x{i}" for i in range(100)]
        return [" ".join(words), " ".join(words[: 100 - cut])]

    cuts = [15, 16, 17, 18, 19, 20, 24]
    texts = [t for k, cut in enumerate(cuts) for t in pair(k, cut)]
    docs = frame(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert kept == {2 * k for k in range(len(cuts))} | {2 * k + 1 for k, cut in enumerate(cuts) if 100 * (96 - cut) < 80 * 96}
    assert (1 - (corpus_pipeline.NEAR_PERCENT / 100) ** corpus_pipeline.NEAR_ROWS) ** corpus_pipeline.NEAR_BANDS < 2e-6


def test_stages_keep_clashing_columns(spark):
    """Names that the stages or their operators might use go through unchanged."""
    names = ["gone", "kept_id", "normalised", "taken_copies", "taken_id", "kept", "size", "component_id", "predicted"]
    docs = frame(spark, extra=EXTRA[2:])
    for name in names:
        if name not in docs.columns:
            docs = docs.selectExpr("*", f"concat('{name}', doc_id) AS {name}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.filter(" OR ".join(f"{n} != concat('{n}', doc_id)" for n in names)).count() == 0 and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
