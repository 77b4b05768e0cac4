"""The thin queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.divergence import source_divergence
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.fingerprints import fingerprint_with_next
from tidewatch.llm.language_model import score_texts
from tidewatch.llm.line_dedup import line_dedup
from tidewatch.llm.mixing import mix
from tidewatch.llm.near_dedup import near_dedup
from tidewatch.llm.pieces import encode
from tidewatch.llm.pii import KINDS as PII_KINDS
from tidewatch.llm.pii import find_pii
from tidewatch.llm.secrets import KINDS as SECRET_KINDS
from tidewatch.llm.secrets import find_secrets
from tidewatch.llm.substrings import drop_repeats
from tidewatch.llm.toxicity import toxicity
from tidewatch.llm.vector_codes import compress
from tidewatch.sources.runtime import table


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The digest columns of a table with base and spans: counts by base kind, then the joined spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *(c for c in found.columns if c not in ("id", "base", "spans")))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS[:3])


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def learned_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: a third is held out by crc32 of the id's text."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), learned_labels(table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", "predicted", "segments")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_pii(table(spark, sf_dir, "documents")), PII_KINDS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, sha256(t) AS text_sha256, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.doc_id, k.line, k.pos, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _op11_sql(rounds: int = 2) -> str:
    """Parts as rows; a round is an assignment of all parts and a mean of each entry's."""
    nearest = "SELECT vec_id, part, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e := e)) AS b FROM p JOIN c{0} USING (part) GROUP BY vec_id, part"
    mean = """SELECT c{0}.part, c{0}.e, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN (SELECT part, e, list(v ORDER BY i) AS c FROM (
  SELECT part, b.e AS e, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM (SELECT part, b, x, unnest(range(1, len(x) + 1)) AS i FROM a{0}) GROUP BY ALL) GROUP BY ALL) m ON m.part = c{0}.part AND m.e = c{0}.e"""
    steps = "".join(f"a{r} AS MATERIALIZED ({nearest.format(r)}),\nc{r + 1} AS MATERIALIZED ({mean.format(r)}),\n" for r in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
q AS (SELECT vec_id, v, unnest(range(0, 16)) AS part FROM k),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM q),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64),
{steps}a{rounds} AS MATERIALIZED ({nearest.format(rounds)}),
o AS (SELECT vec_id, string_agg(lower(printf('%02x', b.e)), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), h
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(ws[p : p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, p FROM w JOIN m USING (h) WHERE doc_id > least),
x AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
c AS (SELECT x.doc_id, x.p, x.word, coalesce(g.p >= x.p - 49, false) AS gone FROM x ASOF LEFT JOIN g ON x.doc_id = g.doc_id AND x.p >= g.p),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT *, row_number() OVER () AS rid FROM d),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM r),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, any_value(v.v) AS v, coalesce(sum(c.n), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS MATERIALIZED (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // (z.n + 2 * z.v) AS BIGINT) AS p FROM z JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + CAST(1000000000 * CAST(k.n + 2 AS HUGEINT) // (v.n + 2 * v.v) AS BIGINT) AS p FROM k JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.p) * (p.p - q.p) // (p.p + q.p) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.p)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 10
"""


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_model": op2_language_model,
    "op3_fingerprints": op3_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_pieces": op6_pieces,
    "op7_near_dedup": op7_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op10_line_dedup": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_substring_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
