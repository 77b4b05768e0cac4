"""Named queries over the driver's tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions import addresses, answers, dates, display, geo, html, money, text
from tidewatch.operators import aggregate, bags, classify, cluster, components, explore, graph, harvest, leaders, links, pairs, rules, similarity, sync, term_index
from tidewatch.plans import oracle_parts as Q
from tidewatch.sources import adapters, connectors, days, tables
from tidewatch.sources.keywords import boolean_search, load_keywords, phrases_in
from tidewatch.sources.runtime import Scratch, table
from tidewatch.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str = "date"):
    return F.col(c).cast("string").alias(c)


def last_days(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Incidents of the last n days, counted from the latest date: a literal, so that the filter reaches the scan."""
    latest = adapters.latest_date(spark, sf_dir)
    return adapters.incidents(spark, sf_dir).filter(F.col("date") >= F.date_sub(F.lit(latest), n - 1))


_LAST30 = "SELECT * FROM inc WHERE date >= (SELECT max(date) FROM inc) - INTERVAL 29 DAY"
_MACRO = "coalesce(impact_scope = 'cumulative_macro_trend' OR financial_damage_usd >= 5000000000, false)"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""WITH {Q.INCIDENTS}, d AS ({_LAST30}),
m AS (SELECT harm_domain FROM (SELECT harm_domain, count(*) AS n, min(struct_pack(a := -financial_damage_usd, b := incident_id)) AS f FROM d GROUP BY 1) ORDER BY n DESC, f LIMIT 1)
SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, CAST(coalesce(sum(financial_damage_usd) FILTER (NOT {_MACRO}), 0) AS BIGINT) AS discrete_usd,
  CAST(coalesce(sum(financial_damage_usd) FILTER ({_MACRO}), 0) AS BIGINT) AS macro_usd, (SELECT count(DISTINCT p) FROM (SELECT unnest(affected_parties) AS p FROM d)) AS parties,
  coalesce((SELECT harm_domain FROM m), 'N/A') AS top_harm_domain FROM d""")
def briefing_kpis(spark, sf_dir):
    return aggregate.briefing(last_days(spark, sf_dir, 30))


@query(f"""WITH {Q.INCIDENTS}, d AS ({_LAST30}) SELECT incident_id, severity, financial_damage_usd, row_number() OVER (ORDER BY {_RANK} DESC, incident_id) AS position FROM d""")
def briefing_ranked(spark, sf_dir):
    return explore.numbered(last_days(spark, sf_dir, 30), "severity", "severity", "financial_damage_usd").select("incident_id", "severity", "financial_damage_usd", "position")


@query(f"""WITH {Q.INCIDENTS}, d AS ({_LAST30}) SELECT incident_id, upper(severity) || ' — ' || title || ': ' || summary || ' (' ||
  CASE WHEN impact_scope = 'cumulative_macro_trend' THEN '[Macro Industry Trend]' ELSE '[Discrete Event]' END || ' Est. Impact: ' ||
  CASE WHEN financial_damage_usd > 0 THEN '$' || format('{{:,}}', financial_damage_usd) || ' USD' ELSE 'N/A' END || ')' AS line FROM d""")
def briefing_text(spark, sf_dir):
    return last_days(spark, sf_dir, 30).select("incident_id", explore.briefing_line().alias("line"))


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, title FROM inc WHERE contains(lower(title), 'lawsuit') OR contains(lower(summary), 'lawsuit') OR len(list_filter(affected_parties, lambda p: contains(lower(p), 'lawsuit'))) > 0""")
def explorer_search(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter(explore.predicate(search="LAWSUIT")).select("incident_id", "title")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license, version 2.0')")
def document_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license, version 2.0"))).select("doc_id", "n_chars")


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, severity FROM inc WHERE severity = 'critical' AND verification_status = 'confirmed' AND list_contains(geographic_scope, 'ASIA')
  AND coalesce(nullif(impact_scope, ''), 'discrete_incident') = 'discrete_incident' AND financial_damage_usd >= 1000000 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def explorer_multi_filter(spark, sf_dir):
    p = explore.predicate(severity="critical", status="confirmed", country="ASIA", scope=S.DISCRETE_SCOPE, damage="1m", start="1996-01-01", end="2000-12-31")
    return adapters.incidents(spark, sf_dir).filter(p).select("incident_id", "severity")


_FILTERS = [
    ("system", "system_classification = 'autonomous_agent'", {"system": "autonomous_agent"}),
    ("intent", "intent = 'intentional_misuse'", {"intent": "intentional_misuse"}),
    ("eu_tier", "eu_ai_act_tier = 'high_risk'", {"eu_tier": "high_risk"}),
    ("nist", "nist_ai_rmf_function = 'MAP'", {"nist": "MAP"}),
    ("iso", "iso_42001_category = 'System_Impact'", {"iso": "System_Impact"}),
    ("purpose", "primary_purpose = 'recruitment_hr'", {"purpose": "recruitment_hr"}),
    ("natsec_yes", "natsec_impact", {"natsec": "yes"}),
    ("natsec_no", "NOT natsec_impact", {"natsec": "no"}),
    ("source", "coalesce(nullif(source_type, ''), 'google_news_rss') = 'google_news_rss'", {"source": "google_news_rss"}),
    ("lifecycle", "lifecycle_phase = 'decommissioning'", {"lifecycle": "decommissioning"}),
    ("harm_domain", "harm_domain = 'property'", {"harm_domain": "property"}),
    ("harm_type", "harm_type = 'misinformation'", {"harm_type": "misinformation"}),
    ("root_cause", "root_cause_category = 'human'", {"root_cause": "human"}),
    ("temporality", "temporality = 'latent'", {"temporality": "latent"}),
    ("damage_any", "financial_damage_usd > 0", {"damage": "any"}),
    ("damage_10m", "financial_damage_usd >= 10000000", {"damage": "10m"}),
]


@query(f"WITH {Q.INCIDENTS} SELECT " + ", ".join(f"count(*) FILTER ({sql}) AS n_{n}" for n, sql, _ in _FILTERS) + " FROM inc")
def explorer_filters(spark, sf_dir):
    """Every single filter at once, in one pass."""
    return adapters.incidents(spark, sf_dir).agg(*(F.count_if(explore.predicate(**p)).alias(f"n_{n}") for n, _, p in _FILTERS))


def _sort(by: str, key: str, direction: str):
    sql = f"WITH {Q.INCIDENTS} SELECT incident_id, row_number() OVER (ORDER BY {key} {direction}, incident_id) AS position FROM inc"

    def f(spark, sf_dir):
        return explore.numbered(adapters.incidents(spark, sf_dir), by).select("incident_id", "position")

    f.__name__ = f"explorer_sort_{by}"
    query(sql)(f)


for _by, _key, _way in [
    ("date_desc", "date", "DESC"), ("date_asc", "date", "ASC"), ("entity_asc", "lower(coalesce(affected_parties[1], title))", "ASC"), ("entity_desc", "lower(coalesce(affected_parties[1], title))", "DESC"),
    ("severity_desc", _RANK, "DESC"), ("severity_asc", _RANK, "ASC"), ("damage_desc", "financial_damage_usd", "DESC"), ("damage_asc", "financial_damage_usd", "ASC"), ("confidence_desc", "coalesce(nullif(confidence_severity, 0), 1.0)", "DESC"),
]:
    _sort(_by, _key, _way)

_CSV = ["incident_id", "CAST(date AS VARCHAR)", "replace(title, '\"', '\"\"')", "severity", "coalesce(nullif(impact_scope, ''), 'discrete_incident')", None, "array_to_string(geographic_scope, '; ')", "system_classification", "lifecycle_phase", "primary_purpose", "intent", "harm_domain", "harm_type", "root_cause_category", "eu_ai_act_tier", "nist_ai_rmf_function", "iso_42001_category", "CASE WHEN natsec_impact THEN 'Yes' ELSE 'No' END", "verification_status", "source_urls[1]"]


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, " + " || ',' || ".join("CAST(financial_damage_usd AS VARCHAR)" if c is None else f"'\"' || coalesce({c}, '') || '\"'" for c in _CSV) + " AS line FROM inc")
def explorer_csv_rows(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select("incident_id", explore.csv_line().alias("line"))


_FIELDS = """incident_id title summary full_text date verification_status severity source_type financial_damage_usd impact_scope system_classification lifecycle_phase root_cause_category
harm_domain temporality intent primary_purpose harm_type eu_ai_act_tier nist_ai_rmf_function iso_42001_category natsec_impact confidence_severity geographic_scope affected_parties source_urls""".split()


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, CAST(to_json({{" + ", ".join(f"'{c}': {c}" for c in _FIELDS) + "}) AS VARCHAR) AS line FROM inc")
def explorer_json_rows(spark, sf_dir):
    """All fields of every record, unknown ones as null."""
    return adapters.incidents(spark, sf_dir).select("incident_id", F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}).alias("line"))


_DIMS = ["severity", "harm_domain", "system_classification"]


@query(f"WITH {Q.INCIDENTS} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM inc GROUP BY {d}" for d in _DIMS))
def counts_by_dimension(spark, sf_dir):
    return aggregate.counts_by(adapters.incidents(spark, sf_dir), *_DIMS)


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, harm_domain FROM inc WHERE lower(replace(harm_domain, '_', ' ')) = 'systemic integrity'")
def drilldown(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter(explore.drilldown("harm_domain", "Systemic_Integrity")).select("incident_id", "harm_domain")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS (SELECT CAST(unnest(generate_series(min(date), max(date) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM d), c AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(s.date AS VARCHAR) AS date, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (date)")
def date_spine_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    until = orders.agg(F.date_sub(F.max("date"), 1)).first()[0]
    spine = dates.spine(orders, "date", F.lit(until))
    return spine.join(orders.groupBy("date").agg(F.count(F.lit(1)).alias("n")), "date", "left").select(day(), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {Q.INCIDENTS}, m AS (SELECT max(date) AS m FROM inc) SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, count(*) FILTER (date > m - INTERVAL 7 DAY) AS n7 FROM inc, m WHERE date > m - INTERVAL 30 DAY GROUP BY 1")
def preset_windows(spark, sf_dir):
    latest = Window.partitionBy()
    days = last_days(spark, sf_dir, 30).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return days.select(day(), "n", F.when(F.col("date") > F.date_sub(F.max("date").over(latest), 7), F.col("n")).otherwise(0).alias("n7"))  # 30 rows


@query(f"WITH {Q.INCIDENTS} SELECT DISTINCT unnest(geographic_scope) AS country FROM inc")
def distinct_countries(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select(F.explode("geographic_scope").alias("country")).distinct()


_GAZ = "gaz AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n, _, _ in S.REGIONS) + ") AS t(region_key, region_name))"


@query(f"WITH {Q.INCIDENTS}, {_GAZ}, x AS (SELECT DISTINCT incident_id, severity, financial_damage_usd, lower(trim(g)) AS region_key FROM (SELECT *, unnest(geographic_scope) AS g FROM inc)) SELECT region_key, region_name, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, CAST(sum(financial_damage_usd) AS BIGINT) AS usd FROM x JOIN gaz USING (region_key) GROUP BY ALL")
def geo_rollup(spark, sf_dir):
    return aggregate.by_region(adapters.incidents(spark, sf_dir), geo.gazetteer(spark))


@query(f"WITH {Q.INCIDENTS} SELECT incident_id FROM inc WHERE len(list_filter(geographic_scope, lambda s: lower(trim(s)) IN ('france', 'uk'))) > 0")
def geo_filter(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter(aggregate.in_region("UK", "France")).select("incident_id")


def _cluster_sql(where: str, tone: str, size: int) -> str:
    return rf"""WITH {Q.RECORDS}, f AS (SELECT DATE_, u, source, tone, nullif(regexp_extract(lower(u), '/([^/]+)[/]?$', 1), '') AS slug FROM rec WHERE {where} AND tone < {tone})
SELECT slug, min(DATE_) AS first_published, min(u) AS example_url, count(*) AS number_of_reports, array_to_string(list_sort(list(DISTINCT source))[:5], ',') AS reported_by_samples,
  sign(sum(CAST(round(tone * 100) AS BIGINT))) * ((2 * abs(sum(CAST(round(tone * 100) AS BIGINT))) + count(*)) // (2 * count(*))) / 100.0 AS avg_tone FROM f WHERE slug IS NOT NULL GROUP BY slug ORDER BY number_of_reports DESC, first_published DESC, slug LIMIT {size}"""


_K = load_keywords()
_IN = lambda c, words: rf"regexp_matches({c}, '\b({'|'.join(words)})\b')"
_NOT = f"NOT {_IN('lower(u)', _K['exclude_url_terms'])}"


def _strung(df: DataFrame) -> DataFrame:
    return df.withColumn("reported_by_samples", F.array_join("reported_by_samples", ","))


@query(_cluster_sql(f"day >= (SELECT max(day) FROM rec) - INTERVAL 5 DAY AND ({_IN('lower(u)', _K['url_entities'])} OR {_IN('''lower(coalesce(orgs, ''))''', _K['organizations'])}) AND ({_IN('lower(u)', _K['incident_keywords'])} OR {_IN('''lower(coalesce(themes, ''))''', _K['gdelt_themes'])}) AND {_NOT}", "-1.0", 50))
def news_clusters(spark, sf_dir):
    records = adapters.records(spark, sf_dir)
    latest = records.agg(F.max("day")).first()[0]
    return _strung(aggregate.news_clusters(records, _K, F.col("day") >= F.date_sub(F.lit(latest), 5), -1.0, 50))


@query(ORACLES["news_clusters"])
def news_clusters_by_day(spark, sf_dir):
    """The clusters of news_clusters from a stored table in partitions by day, of which the window's are read, within a ceiling of bytes."""
    root = Scratch(spark, "records").root
    records = adapters.records(spark, sf_dir)
    days.write_days(records.repartition("day"), root, "day")
    latest = days.latest_day(spark, root)
    window = days.read_days(spark, root, records.schema, "day", latest - timedelta(days=5), latest, 50 << 30)
    return _strung(aggregate.news_clusters(window, _K, None, -1.0, 50))


@query(_cluster_sql(f"day >= (SELECT max(day) FROM rec) - INTERVAL 2 DAY AND {_IN('lower(u)', _K['url_entities'])} AND {_IN('lower(u)', _K['incident_keywords'])} AND {_NOT}", "-3.0", 50))
def news_clusters_by_url(spark, sf_dir):
    records = adapters.records(spark, sf_dir)
    latest = records.agg(F.max("day")).first()[0]
    return _strung(aggregate.news_clusters(records, _K, F.col("day") >= F.date_sub(F.lit(latest), 2), -3.0, 50, url_only=True))


@query(f"SELECT page_id, {Q.norm_url('url')} AS norm FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url(F.col("url")).alias("norm"))


@query(f"WITH n AS (SELECT page_id, {Q.norm_url('url')} AS norm FROM pages) SELECT a.page_id AS id1, b.page_id AS id2 FROM n a JOIN n b ON a.norm = b.norm AND a.page_id < b.page_id AND a.norm <> ''")
def url_exact_pairs(spark, sf_dir):
    keys = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.normalize_url(F.col("url")).alias("key")).filter("key <> ''")
    return similarity.key_pairs(keys)


@query(f"SELECT doc_id, {Q.norm_text('text')} AS norm FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


def _sanitize_sql(c: str, most: int) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    for p in S.INJECTIONS:
        t = f"regexp_replace({t}, '(?i){p}', '{S.REDACTED}', 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    return rf"substring(trim(regexp_replace({t}, '\s+', ' ', 'g')), 1, {most})"


@query(f"SELECT page_id, {_sanitize_sql('html', 4000)} AS clean FROM pages")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("html")).alias("clean"))


@query(f"WITH {Q.tfidf('documents', 'doc_id', 'text')} SELECT id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM tf GROUP BY id")
def tokenize_counts(spark, sf_dir):
    return similarity.term_totals(table(spark, sf_dir, "documents"), "doc_id", "text")


_P = r"list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<header\b.*?</header>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?is)<aside\b.*?</aside>', ' ', 'g'), '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda p: length(p) > 35)"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, len({_P}) AS paragraphs, length(array_to_string({_P}, ' ')) > 150 AS enough FROM pages")
def html_title_paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), text.html_paragraphs(F.col("html")).alias("p"))
    return p.select("page_id", "title", F.size("p").cast("long").alias("paragraphs"), (F.length(F.array_join("p", " ")) > 150).alias("enough"))


@query()
def page_texts(spark, sf_dir):
    """Titles and texts of all pages by a tokenizer; the regular expressions of html_title_paragraphs know neither entities nor comments nor unclosed elements."""
    return html.page_texts(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", F.size("paragraphs").cast("long").alias("paragraphs"), "full_text")


@query(f"WITH {Q.tfidf('documents', 'doc_id', 'text')}, r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, term) AS rank, round(v, 4) AS v FROM vec) SELECT id, term, rank, v FROM r WHERE rank <= 3")
def tfidf_top_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = Scratch(spark, "bags").table(bags.bags(docs, "doc_id", "text"))
    return bags.top_terms(held, docs.count(), 3).select("id", "term", "rank", F.round("v", 4).alias("v"))


@query(f"WITH {Q.tfidf('documents', 'doc_id', 'text')} SELECT a.id AS id1, b.id AS id2, round(sum(a.v * b.v), 4) AS sim FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.v * b.v) >= 0.20")
def cosine_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scratch, n = Scratch(spark, "bags"), docs.count()
    held = scratch.table(bags.bags(docs, "doc_id", "text"))
    found = pairs.block_pairs(bags.vectors(held, n), n, 0.20)
    scratch.drop(held)
    return found.select("id1", "id2", F.round("sim", 4).alias("sim"))


@query(f"WITH {Q.tfidf('documents', 'doc_id', 'text')} SELECT a.id AS id1, b.id AS id2, round(sum(a.v * b.v), 4) AS sim FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id WHERE a.id % 10 = 3 OR b.id % 10 = 3 GROUP BY ALL HAVING sum(a.v * b.v) >= 0.20")
def new_report_pairs(spark, sf_dir):
    """A tenth of the documents as a run's new reports, held against the stored index of all."""
    docs = table(spark, sf_dir, "documents")
    index = term_index.TermIndex(spark, Scratch(spark, "term_index").root)
    new = F.coalesce(F.col("doc_id") % 10 == 3, F.lit(False))
    index.add(docs.filter(~new), 0, "doc_id")
    index.add(docs.filter(new), 1, "doc_id")
    return index.probe(1, 0.20).select("id1", "id2", F.round("sim", 4).alias("sim"))


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("id"), "url", text.html_title(F.col("html")).alias("title"), F.array("url").alias("urls"), (F.col("page_id") % 97).cast("long").alias("usd"), F.array(F.regexp_extract("url", r"://([^/?#]+)", 1)).alias("parties"))


_PAGES = rf"p AS (SELECT page_id AS id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, page_id % 97 AS usd, regexp_extract(url, '://([^/?#]+)', 1) AS party FROM pages)"
_KEYS = f"k AS (SELECT id, 'u:' || {Q.norm_url('url')} AS key FROM p UNION SELECT id, 't:' || {Q.norm_text('title')} FROM p), k2 AS (SELECT * FROM k WHERE key NOT IN ('u:', 't:'))"


@query(f"WITH RECURSIVE {_PAGES}, {_KEYS}, m AS (SELECT key, min(id) AS f FROM k2 GROUP BY key), e AS (SELECT DISTINCT id AS a, f AS b FROM k2 JOIN m USING (key) UNION SELECT DISTINCT f, id FROM k2 JOIN m USING (key)), r AS (SELECT id, id AS c FROM p UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id")
def exact_dedup_components(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    edges = similarity.key_edges(similarity.exact_keys(pages, "id", F.col("urls"), F.col("title")))
    return cluster.membership(pages, edges, "id").select("id", "cluster")


@query(ORACLES["exact_dedup_components"])
def components_by_increments(spark, sf_dir):
    """The clusters of exact_dedup_components from four batches of links, each merged into the stored labels."""
    pages = _pages(spark, sf_dir)
    edges = Scratch(spark, "edges").table(similarity.key_edges(similarity.exact_keys(pages, "id", F.col("urls"), F.col("title"))))
    store = components.ComponentStore(spark, Scratch(spark, "labels").root)
    for i in range(4):
        store.merge(edges.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(4)) == i))
    found = store.read()
    return pages.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


@query(f"WITH RECURSIVE {_PAGES}, {_KEYS}, m AS (SELECT key, min(id) AS f FROM k2 GROUP BY key), e AS (SELECT DISTINCT id AS a, f AS b FROM k2 JOIN m USING (key) UNION SELECT DISTINCT f, id FROM k2 JOIN m USING (key)), r AS (SELECT id, id AS c FROM p UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id), c AS (SELECT id, min(c) AS cluster FROM r GROUP BY id), pc AS (SELECT *, {Q.norm_url('url')} AS norm FROM p JOIN c USING (id)), u AS (SELECT cluster, norm, arg_min(url, id) AS url, min(id) AS f FROM pc GROUP BY ALL) SELECT cluster, count(*) AS members, max(usd) AS usd, arg_max(title, struct_pack(n := length(title), f := -id)) AS summary, array_to_string(list_sort(list(DISTINCT party)), ',') AS parties, (SELECT string_agg(url, ' ' ORDER BY f) FROM u WHERE u.cluster = pc.cluster) AS urls FROM pc GROUP BY cluster")
def consolidate(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    edges = similarity.key_edges(similarity.exact_keys(pages, "id", F.col("urls"), F.col("title")))
    merged = cluster.consolidate(cluster.membership(pages, edges, "id"), "id", "usd", "title", "urls", "parties")
    return merged.select("cluster", "members", "usd", "summary", F.array_join("parties", ",").alias("parties"), F.array_join("urls", " ").alias("urls"))


def _candidates(spark, sf_dir, counts=False):
    """Pairs of pages that share a URL or title, a party, or are alike, with the cosine however they became a pair."""
    pages = _pages(spark, sf_dir)
    exact = similarity.exact_keys(pages, "id", F.col("urls"), F.col("title"))
    parties = similarity.party_keys(pages, "id", "parties")
    corpus = pages.select("id", similarity.corpus_text(F.col("title"), F.lit(""), F.col("parties"), F.array().cast("array<string>")).alias("body"))
    scratch, n = Scratch(spark, "bags"), corpus.count()
    held = scratch.table(bags.bags(corpus, "id", "body"))
    found = pairs.block_pairs(bags.vectors(held, n), n, 0.20, exact, parties, counts=counts)
    scratch.drop(held)
    return found


@query(f"WITH {_PAGES}, {_KEYS}, x AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM k2 a JOIN k2 b ON a.key = b.key AND a.id < b.id), y AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM p a JOIN p b ON lower(trim(a.party)) = lower(trim(b.party)) AND a.id < b.id), pt AS (SELECT id, title || ' ' || title || ' ' || party AS body FROM p), {Q.tfidf('pt', 'id', 'body')}, s AS (SELECT a.id AS id1, b.id AS id2, sum(a.v * b.v) AS sim FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id GROUP BY ALL), u AS (SELECT id1, id2 FROM x UNION SELECT id1, id2 FROM y UNION SELECT id1, id2 FROM s WHERE sim >= 0.20) SELECT u.id1, u.id2, x.id1 IS NOT NULL AS is_exact, y.id1 IS NOT NULL AS shared_parties, round(coalesce(sim, 0), 4) AS similarity FROM u LEFT JOIN x ON x.id1 = u.id1 AND x.id2 = u.id2 LEFT JOIN y ON y.id1 = u.id1 AND y.id2 = u.id2 LEFT JOIN s ON s.id1 = u.id1 AND s.id2 = u.id2")
def candidate_pairs(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    return found.select("id1", "id2", "is_exact", "shared_parties", F.round("sim", 4).alias("similarity"))


_PAIRED = "SELECT a.id, b.id AS other FROM {0} a JOIN {0} b ON a.key = b.key AND a.id <> b.id"


@query(f"WITH {_PAGES}, {_KEYS}, y AS (SELECT id, lower(trim(party)) AS key FROM p WHERE party <> ''), e AS ({_PAIRED.format('k2')}), h AS ({_PAIRED.format('y')}), n AS (SELECT id, count(DISTINCT other) AS n FROM e GROUP BY id), m AS (SELECT id, count(DISTINCT other) AS n FROM h GROUP BY id), u AS (SELECT id, count(DISTINCT other) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM h) GROUP BY id) SELECT p.id, coalesce(n.n, 0) AS exact_links, coalesce(m.n, 0) AS party_links, coalesce(u.n, 0) AS links FROM p LEFT JOIN n ON p.id = n.id LEFT JOIN m ON p.id = m.id LEFT JOIN u ON p.id = u.id")
def key_links(spark, sf_dir):
    """With how many pages each shares an exact key, a party, or either: what candidate_pairs lists, in a row for each page."""
    pages = _pages(spark, sf_dir)
    exact = similarity.exact_keys(pages, "id", F.col("urls"), F.col("title"))
    parties = similarity.party_keys(pages, "id", "parties").filter("key <> ''").withColumn("key", F.concat(F.lit("p:"), "key"))
    out = pages.select("id")
    for name, keys in (("exact_links", exact), ("party_links", parties), ("links", exact.unionByName(parties))):
        out = out.join(links.link_counts(keys).select("id", F.col("links").alias(name)), "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("exact_links", "party_links", "links")))


@query("SELECT id1, id2, similarity, is_exact AS matched FROM (" + ORACLES["candidate_pairs"] + ")")
def pair_verdicts(spark, sf_dir):
    """Candidate pairs with the verdict of the model: none is there, so only exact pairs match."""
    found = classify.verdicts(candidate_pairs(spark, sf_dir))
    return found.select("id1", "id2", "similarity", (F.col("matched") | F.col("is_exact")).alias("matched"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '\s+'), lambda w: w <> ''))"
_A, _B = _WORDS.format("text"), _WORDS.format("before")


@query(f"WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, round(len(list_intersect({_A}, {_B})) / greatest(len(list_distinct(list_concat({_A}, {_B}))), 1), 6) AS jaccard FROM t")
def word_jaccard(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("before", before)
    return turns.select("conv_id", "turn", F.round(text.word_jaccard(F.col("text"), F.col("before")), 6).alias("jaccard"))


_T = "lower(title || ' ' || summary || ' ' || full_text)"


def _damage_sql() -> str:
    at = "CASE severity WHEN 'critical' THEN {} WHEN 'high' THEN {} ELSE {} END"
    money_ = lambda w: f"try_cast(nullif(regexp_extract({_T}, '\\$([0-9]+(?:\\.[0-9]+)?)\\s*{w}', 1), '') AS DOUBLE)"
    first = f"WHEN {money_('billion')} IS NOT NULL THEN CAST({money_('billion')} * 1e9 AS BIGINT) WHEN {money_('million')} IS NOT NULL THEN CAST({money_('million')} * 1e6 AS BIGINT)"
    usd = " ".join(f"WHEN {Q.any_of(_T, w)} THEN {at.format(c, h, o)}" for w, c, h, o, _ in S.DAMAGE_RULES)
    how = " ".join(f"WHEN {Q.any_of(_T, w)} THEN '{n}'" for w, _, _, _, n in S.DAMAGE_RULES)
    last = "CASE severity WHEN 'critical' THEN 5000000 WHEN 'high' THEN 2500000 WHEN 'medium' THEN 850000 ELSE 350000 END"
    return f"CAST(CASE {first} {usd} ELSE {last} END AS BIGINT) AS damage_rule, CASE WHEN {money_('billion')} IS NOT NULL OR {money_('million')} IS NOT NULL THEN 'explicit_confirmed' {how} ELSE 'empirical_estimate' END AS damage_method"


_a = Q.any_of
_RULES = f"""SELECT incident_id,
  CASE WHEN contains(root_cause_category, 'governance') OR {_a('lower(summary)', ['policy', 'legal'])} OR {_a('lower(title)', ['court', 'fcc', 'sec'])} THEN 'GOVERN'
    WHEN {_a('lower(summary)', ['cyber', 'hack', 'breach'])} OR {_a('system_classification', ['agent', 'autonomous'])} THEN 'MANAGE'
    WHEN {_a('root_cause_category', ['model', 'data'])} OR contains(harm_type, 'bias') OR {_a('lower(summary)', ['hallucination', 'test'])} THEN 'MEASURE' ELSE 'MAP' END AS nist_rule,
  CASE WHEN {_a('lower(summary)', ['cyber', 'hack', 'breach', 'vulnerability', 'exploit'])} THEN 'Operational_Security'
    WHEN {_a('harm_type', ['privacy', 'copyright'])} OR contains(root_cause_category, 'data') OR {_a('lower(summary)', ['secret', 'trade'])} THEN 'Data_&_Resources'
    WHEN contains(root_cause_category, 'governance') OR contains(lower(title), 'court') OR {_a('lower(summary)', ['lawsuit', 'dismissal'])} OR contains(primary_purpose, 'hr') THEN 'Internal_Governance' ELSE 'System_Impact' END AS iso_rule,
  CASE WHEN impact_scope = 'cumulative_macro_trend' OR {_a(_T, S.MACRO_WORDS)} THEN 'cumulative_macro_trend' ELSE 'discrete_incident' END AS scope_rule, {_damage_sql()} FROM inc"""


@query(f"WITH {Q.INCIDENTS} {_RULES}")
def enrich_rules(spark, sf_dir):
    return rules.enriched(adapters.incidents(spark, sf_dir)).select("incident_id", "nist_rule", "iso_rule", "scope_rule", "damage_rule", "damage_method")


@query(f"WITH {Q.INCIDENTS}, r AS ({_RULES}) SELECT damage_method, count(*) AS n, CAST(sum(damage_rule) AS BIGINT) AS usd FROM r GROUP BY 1")
def dataset_totals(spark, sf_dir):
    return rules.enriched(adapters.incidents(spark, sf_dir)).groupBy("damage_method").agg(F.count(F.lit(1)).alias("n"), F.sum("damage_rule").cast("long").alias("usd"))


@query(f"WITH {Q.INCIDENTS}, {Q.EDGES} SELECT seq, source_key, target_key, relation_type FROM edges WHERE source_key IN (SELECT key FROM inc WHERE severity IN ('critical', 'high', 'medium')) AND target_key IN (SELECT key FROM inc WHERE severity IN ('critical', 'high', 'medium')) AND relation_type <> 'lawsuit_action'")
def edge_subgraph(spark, sf_dir):
    nodes = adapters.incidents(spark, sf_dir).filter(F.col("severity").isin("critical", "high", "medium"))
    kept = adapters.edges(spark, sf_dir).filter(F.lower("relation_type") != "lawsuit_action")
    return graph.induced(kept, nodes).select("seq", "source_key", "target_key", "relation_type")


@query(f"WITH {Q.EDGES}, n AS (SELECT source_key AS node, target_key AS other FROM edges UNION ALL SELECT target_key, source_key FROM edges) SELECT node, count(*) AS degree, count(DISTINCT other) AS others FROM n GROUP BY node")
def node_degrees(spark, sf_dir):
    return graph.degrees(adapters.edges(spark, sf_dir))


@query(f"WITH {Q.INCIDENTS}, {Q.EDGES}, n AS (SELECT source_key AS node, target_key AS other, relation_type FROM edges UNION ALL SELECT target_key, source_key, relation_type FROM edges) SELECT node, other, relation_type, title AS other_title FROM n JOIN inc ON key = other")
def neighbours(spark, sf_dir):
    titles = adapters.incidents(spark, sf_dir).select(F.col("key").alias("other"), F.col("title").alias("other_title"))
    return graph.neighbours(adapters.edges(spark, sf_dir)).join(titles, "other").select("node", "other", "relation_type", "other_title")


@query(f"WITH {Q.INCIDENTS}, c AS (SELECT coalesce(eu_ai_act_tier, 'unclassified') AS tier, count(*) AS n FROM inc GROUP BY 1) SELECT tier, n, 25 + least(3 * n, 25) AS size FROM c")
def contract_by_tier(spark, sf_dir):
    return graph.contracted(adapters.incidents(spark, sf_dir).select(F.coalesce("eu_ai_act_tier", F.lit("unclassified")).alias("tier")), "tier")


@query(f"WITH {Q.INCIDENTS}, {Q.EDGES} SELECT a.severity AS source, b.severity AS target, count(*) AS n FROM edges JOIN inc a ON a.key = source_key JOIN inc b ON b.key = target_key GROUP BY ALL")
def contract_edges(spark, sf_dir):
    return graph.contracted_edges(adapters.edges(spark, sf_dir), adapters.incidents(spark, sf_dir), "severity")


@query(f"WITH {Q.EDGES}, s AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY seq) AS rn FROM edges) SELECT seq, CASE WHEN edge_id IS NOT NULL AND rn = 1 THEN edge_id ELSE 'EDGE-R' || seq END AS fixed_id, relation_type, coalesce(description, '') AS description, CAST(coalesce(nullif(confidence, 0), 0.9) AS DOUBLE) AS confidence FROM s")
def edge_repair(spark, sf_dir):
    return graph.with_defaults(graph.repaired_ids(adapters.edges(spark, sf_dir))).select("seq", "fixed_id", "relation_type", "description", F.col("confidence").cast("double").alias("confidence"))


_SRC = "SELECT key, incident_id, title || ' (revised)' AS title FROM inc WHERE key % 3 = 0"


@query(f"WITH {Q.INCIDENTS} {_SRC} UNION ALL SELECT key, incident_id, title FROM inc WHERE key % 2 = 0 AND key % 3 <> 0")
def upsert_merge(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir).select("key", "incident_id", "title")
    return sync.upsert(inc.filter("key % 2 = 0"), inc.filter("key % 3 = 0").withColumn("title", F.concat("title", F.lit(" (revised)"))), "key")


@query(f"WITH {Q.INCIDENTS} SELECT key, incident_id, CASE WHEN key % 3 = 0 AND key < 3000 THEN title || ' (revised)' ELSE title END AS title FROM inc WHERE key % 7 <> 1")
def table_changes(spark, sf_dir):
    """A stored table of all incidents after an upsert of some and a delete of others; only touched partitions are rewritten."""
    inc = adapters.incidents(spark, sf_dir).select("key", "incident_id", "title")
    stored = tables.KeyedTable(spark, Scratch(spark, "incidents").root, inc.schema, "key", 16)
    stored.upsert(inc.filter("key % 4 <> 0"))
    stored.upsert(inc.filter("key % 4 = 0"))
    stored.upsert(inc.filter("key % 3 = 0 AND key < 3000").withColumn("title", F.concat("title", F.lit(" (revised)"))))
    stored.delete(inc.filter("key % 7 = 1").select("key"))
    return stored.read()


@query(f"WITH {Q.INCIDENTS} SELECT incident_id FROM inc WHERE key % 2 = 0 AND key % 3 <> 0")
def mirror_delete(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir).select("key", "incident_id")
    return sync.mirror_deletions(inc.filter("key % 2 = 0"), inc.filter("key % 3 = 0"), "incident_id")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_per_id(spark, sf_dir):
    return sync.first_per_id(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"WITH {Q.INCIDENTS}, a AS (SELECT * FROM inc WHERE key % 2 = 0), b AS (SELECT * FROM inc WHERE key % 3 = 0) SELECT incident_id FROM b WHERE source_urls[1] NOT IN (SELECT source_urls[1] FROM a)")
def append_unseen(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir)
    return sync.unseen_by_url(inc.filter("key % 2 = 0"), inc.filter("key % 3 = 0"), "source_urls").select("incident_id")


@query(f"WITH {Q.INCIDENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY key) AS rn FROM inc) SELECT key, 'INC-' || strftime(date, '%Y%m%d') || '-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS surrogate_id FROM n")
def surrogate_ids(spark, sf_dir):
    return sync.surrogate_ids(adapters.incidents(spark, sf_dir), "date", "key").select("key", "surrogate_id")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, coalesce(nullif(eu_ai_act_tier, ''), 'unclassified') AS eu_ai_act_tier, coalesce(nullif(intent, ''), 'unintentional_failure') AS intent, coalesce(nullif(impact_scope, ''), 'discrete_incident') AS impact_scope, harm_domain, financial_damage_usd FROM inc")
def nested_round_trip(spark, sf_dir):
    flat = sync.flattened(sync.nested(adapters.incidents(spark, sf_dir)))
    return flat.select("incident_id", "eu_ai_act_tier", "intent", "impact_scope", "harm_domain", "financial_damage_usd")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, CASE WHEN key % 4 = 0 THEN 'extracted' ELSE intent END AS intent FROM inc")
def fill_extracted(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir)
    fresh = inc.select("incident_id", F.when(F.col("key") % 4 == 0, "extracted").otherwise("").alias("intent"))
    return sync.filled(inc.select("incident_id", "intent"), fresh, "incident_id", ["intent"])


@query(f"WITH {Q.INCIDENTS} SELECT incident_id FROM inc WHERE intent IS NULL OR eu_ai_act_tier IS NULL")
def incomplete_rows(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter(F.col("intent").isNull() | F.col("eu_ai_act_tier").isNull()).select("incident_id")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'view') AS rss, count(*) FILTER (event_type = 'click') AS gdelt, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS passed FROM events GROUP BY 1")
def funnel_daily(spark, sf_dir):
    return sync.funnel(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "day").withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    """The events as a stream: each user's last one in a stored table."""
    events = table(spark, sf_dir, "events")
    scratch = Scratch(spark, "stream")
    stored = tables.KeyedTable(spark, f"{scratch.root}/users", events.select("user_id", "event_type", "event_id").schema, "user_id", 16, order="event_id")
    # A pattern, so that a table of one file and one of many are both read.
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event[s].parquet")
    ingest.keep_latest(source, stored, f"{scratch.root}/counts", f"{scratch.root}/checkpoint")
    return stored.read()


@query(f"WITH {Q.INCIDENTS}, p AS (SELECT incident_id, row_number() OVER (ORDER BY date DESC, incident_id) AS position FROM inc) SELECT *, lag(incident_id) OVER (ORDER BY position) AS prev_id, lead(incident_id) OVER (ORDER BY position) AS next_id FROM p")
def prev_next(spark, sf_dir):
    return explore.numbered(adapters.incidents(spark, sf_dir), "date_desc").select("incident_id", "position", "prev_id", "next_id")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, financial_damage_usd FROM inc WHERE financial_damage_usd = 0 OR contains(incident_id, '060')")
def zero_damage_audit(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter((F.coalesce("financial_damage_usd", F.lit(0)) == 0) | F.col("incident_id").contains("060")).select("incident_id", "financial_damage_usd")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, false AS is_ai_incident, CAST(0 AS DOUBLE) AS confidence FROM inc")
def gate_without_model(spark, sf_dir):
    return classify.gate(adapters.incidents(spark, sf_dir).select("incident_id", "title")).select("incident_id", "is_ai_incident", "confidence")


_D = "CAST(financial_damage_usd AS DECIMAL(20, 2))"


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, CASE WHEN financial_damage_usd <= 0 THEN 'N/A' WHEN financial_damage_usd >= 1000000000 THEN '$' || CAST(CAST((financial_damage_usd + 5000000) // 10000000 AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2)) || 'B'
  WHEN financial_damage_usd >= 1000000 THEN '$' || CAST(CAST((financial_damage_usd + 5000) // 10000 AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2)) || 'M' WHEN financial_damage_usd >= 1000 THEN '$' || ((financial_damage_usd + 500) // 1000) || 'K' ELSE '$' || financial_damage_usd END AS damage FROM inc""")
def damage_display(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select("incident_id", money.damage_text(F.col("financial_damage_usd")).alias("damage"))


@query(f"WITH {Q.INCIDENTS}, r AS (SELECT incident_id, upper(replace(system_classification, '_', ' ')) AS t FROM inc) SELECT incident_id, CASE WHEN length(t) > 28 THEN substring(t, 1, 25) || '...' ELSE t END AS label FROM r")
def display_labels(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select("incident_id", text.label(F.col("system_classification")).alias("label"))


_NOT_PUBLIC = "(0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225480), (3221225483, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4294967295)"


@query(f"WITH n AS (SELECT event_id, (event_id * 2654435761 + user_id) % 4294967296 AS n FROM events), s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN n WHEN event_id % 3 = 1 THEN 3221225344 + n % 1024 ELSE 2886729728 - 500 + n % 1000 END AS n FROM n) SELECT event_id, n, NOT EXISTS (SELECT 1 FROM (VALUES {_NOT_PUBLIC}) AS r(lo, hi) WHERE s.n BETWEEN r.lo AND r.hi) AS safe FROM s")
def address_classes(spark, sf_dir):
    """Addresses drawn from the events, over all of the range and near its special parts, in dotted, whole, hexadecimal and mapped forms."""
    n = F.expr("(event_id * 2654435761 + user_id) % 4294967296")
    k = F.col("event_id") % 3
    drawn = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, n).when(k == 1, 3221225344 + n % 1024).otherwise(F.lit(2886729728 - 500) + n % 1000).cast("long").alias("n"))
    octet = lambda i: F.shiftright("n", 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string")
    dotted = F.concat_ws(".", *(octet(i) for i in range(4)))
    forms = F.when(F.col("event_id") % 4 == 0, dotted).when(F.col("event_id") % 4 == 1, F.col("n").cast("string")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("0x"), F.hex("n"))).otherwise(F.concat(F.lit("[::ffff:"), dotted, F.lit("]")))
    return drawn.select("event_id", "n", addresses.safe_public_url(F.concat(F.lit("http://"), forms, F.lit(":8080/x"))).alias("safe"))


@query(r"SELECT page_id, url, NOT (h = '' OR h IN ('localhost', '127.0.0.1', '::1', '[::1]', '0.0.0.0')) AND NOT regexp_matches(h, '^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS safe, CASE WHEN regexp_matches(lower(url), '^https?://') THEN url ELSE '#' END AS shown FROM (SELECT *, lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)")
def safe_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", addresses.safe_public_url(F.col("url")).alias("safe"), text.external_url(F.col("url")).alias("shown"))


@query(f"WITH {Q.INCIDENTS}, l AS (SELECT key // 4 AS grp, * FROM inc), g AS (SELECT grp, CAST(min(date) AS VARCHAR) AS date, max(financial_damage_usd) AS usd, arg_min(full_text, key) AS text, string_agg(array_to_string(list_append(source_urls, 'https://mirror.example.org/' || key // 2), ' '), ' ' ORDER BY key) AS every FROM l GROUP BY grp), u AS (SELECT grp, unnest(string_split(every, ' ')) AS url, generate_subscripts(string_split(every, ' '), 1) AS i FROM g), f AS (SELECT grp, url, min(i) AS i FROM u GROUP BY ALL), s AS (SELECT grp, string_agg(url, ' ' ORDER BY i) AS urls FROM f GROUP BY grp) SELECT grp, date, usd, text, urls FROM g JOIN s USING (grp)")
def fuzzy_merge(spark, sf_dir):
    grouped = adapters.incidents(spark, sf_dir).withColumn("grp", F.expr("key div 4"))
    grouped = grouped.withColumn("source_urls", F.array_append("source_urls", F.concat(F.lit("https://mirror.example.org/"), F.expr("key div 2").cast("string"))))
    return cluster.fuzzy_merge(grouped, "grp", "key").select("grp", day(), "usd", "text", F.array_join("urls", " ").alias("urls"))


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, CASE severity WHEN 'critical' THEN '#ef4444' WHEN 'high' THEN '#f97316' WHEN 'medium' THEN '#eab308' ELSE '#3b82f6' END AS colour,
  CASE severity WHEN 'critical' THEN 22 WHEN 'high' THEN 18 ELSE 14 END AS size, CASE WHEN length(title) > 28 THEN substring(title, 1, 25) || '...' ELSE title END AS label,
  regexp_replace(coalesce(eu_ai_act_tier, 'limited_risk'), '^([^_]*)_', '\\1 ') AS tier, array_to_string(geographic_scope, ', ') AS countries FROM inc""")
def graph_nodes(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select(
        "incident_id", display.node_colour(F.col("severity")).alias("colour"), display.node_size(F.col("severity")).alias("size"), display.node_label(F.col("title")).alias("label"),
        display.table_tier(F.col("eu_ai_act_tier")).alias("tier"), display.table_countries(F.col("geographic_scope")).alias("countries"),
    )


@query(f"WITH {Q.EDGES} SELECT seq, replace(relation_type, '_', ' ') AS label, relation_type IN ('lawsuit_action', 'regulatory_action') AS dashed FROM edges")
def graph_edges(spark, sf_dir):
    return adapters.edges(spark, sf_dir).select("seq", display.edge_label(F.col("relation_type")).alias("label"), display.edge_dashed(F.col("relation_type")).alias("dashed"))


_BADGE = "CASE damage_method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.BADGES.items()) + f" ELSE '{display.LOWER_BOUND}' END"


@query(f"WITH {Q.INCIDENTS}, r AS ({_RULES}) SELECT incident_id, {_BADGE} AS badge FROM r")
def valuation_badges(spark, sf_dir):
    return rules.enriched(adapters.incidents(spark, sf_dir)).select("incident_id", display.badge(F.col("damage_method")).alias("badge"))


@query("""WITH b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events), e AS (SELECT event_id, CAST(ts AS DATE) AS d, lo, hi FROM events, b),
s AS (SELECT event_id, greatest(lo, least(hi, d - 7)) AS a, greatest(lo, least(hi, d + 7)) AS b, lo, hi FROM e)
SELECT event_id, CAST(a AS VARCHAR) AS from_day, CAST(b AS VARCHAR) AS to_day, round(100.0 * date_diff('day', lo, a) / nullif(date_diff('day', lo, hi), 0), 6) AS from_share, round(100.0 * date_diff('day', lo, b) / nullif(date_diff('day', lo, hi), 0), 6) AS to_share FROM s""")
def slider_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("d"))
    bounds = events.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    e = events.crossJoin(F.broadcast(bounds))  # one row
    a, b = dates.clamped_handles(F.date_sub("d", 7), F.date_add("d", 7), F.col("lo"), F.col("hi"))
    e = e.select("event_id", a.alias("a"), b.alias("b"), "lo", "hi")
    x, y = dates.window_share(F.col("a"), F.col("b"), F.col("lo"), F.col("hi"))
    return e.select("event_id", F.col("a").cast("string").alias("from_day"), F.col("b").cast("string").alias("to_day"), F.round(x, 6).alias("from_share"), F.round(y, 6).alias("to_share"))


@query(r"""WITH u AS (SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(parts[-1], '^[0-9]+$') AND len(parts) > 1 THEN parts[-2] ELSE parts[-1] END AS slug FROM u)
SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(slug, '[-_]'), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS search_title FROM s""")
def search_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", harvest.searches(F.col("url"))[0].alias("search_title"))


@query(r"""WITH t AS (SELECT url, html AS full_text FROM pages WHERE page_id % 2 = 0), a AS (SELECT page_id, 0 AS rank, url FROM pages
UNION ALL SELECT page_id, 1, 'https://www.mirror.example' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) FROM pages WHERE length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) > 5),
m AS (SELECT 'https://www.mirror.example' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS url, min(html) AS full_text FROM pages GROUP BY 1), f AS (SELECT url, min(full_text) AS full_text FROM (SELECT * FROM t UNION ALL SELECT * FROM m) GROUP BY url)
SELECT page_id, length(arg_min(full_text, rank)) AS n_chars, min(rank) AS rank FROM a JOIN f USING (url) WHERE coalesce(full_text, '') <> '' GROUP BY page_id""")
def fetch_fallbacks(spark, sf_dir):
    """Every other page answers at its own address, all of them at a mirror."""
    pages = table(spark, sf_dir, "pages").withColumn("domains", F.array(F.lit("mirror.example")))
    at_mirror = text.alternate_url(F.lit("www.mirror.example"), F.col("url"))
    own, mirror = pages.filter("page_id % 2 = 0").select("url", F.col("html").alias("full_text")), pages.select(at_mirror.alias("url"), F.col("html").alias("full_text"))
    fetched = own.unionByName(mirror).groupBy("url").agg(F.min("full_text").alias("full_text"))
    found = harvest.first_text(harvest.attempts(pages, "page_id", "url", "domains"), fetched, "page_id")
    return found.select("page_id", F.length("full_text").cast("long").alias("n_chars"), "rank")


@query(_cluster_sql(f"({_IN('lower(u)', _K['url_entities'])} OR {_IN('lower(orgs)', _K['organizations'])}) AND ({_IN('lower(u)', _K['incident_keywords'])} OR {_IN('lower(themes)', _K['gdelt_themes'])}) AND {_NOT}", "-1.0", 50).replace("SELECT slug, min(DATE_)", "SELECT 'Event (' || count(*) || ' reports): ' || replace(split_part(min(u), '/', -1), '-', ' ') AS title, min(u) AS link, count(*) AS number_of_reports, min(DATE_)").replace("min(DATE_) AS first_published, min(u) AS example_url, count(*) AS number_of_reports, array", "min(DATE_) AS first_published, array"))
def cluster_articles(spark, sf_dir):
    clusters = aggregate.news_clusters(adapters.records(spark, sf_dir), _K, None, -1.0, 50)
    made = harvest.cluster_articles(clusters).select("title", "link", "number_of_reports")
    rest = clusters.select(F.col("example_url").alias("link"), "first_published", F.array_join("reported_by_samples", ",").alias("reported_by_samples"), "avg_tone")
    return made.join(rest, "link")


@query("""SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS from_number, CAST(CAST(ts AS DATE) AS VARCHAR) AS from_feed,
CAST(CASE WHEN event_id % 3 = 0 THEN DATE '2024-01-15' WHEN CAST(ts AS DATE) > DATE '2024-01-15' THEN DATE '2023-12-31' ELSE CAST(ts AS DATE) END AS VARCHAR) AS sanitized FROM events""")
def event_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    as_of = F.lit("2024-01-15").cast("date")
    published = F.when(F.col("event_id") % 3 != 0, F.lit("2023-12-31").cast("date"))
    written = F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.date_format("ts", "yyyy-M-d"))
    return e.select(
        "event_id", dates.numeric_date(F.date_format("ts", "yyyyMMddHHmmss").cast("long")).cast("string").alias("from_number"),
        dates.feed_date(F.concat(F.lit("Xxx, "), F.date_format("ts", "dd MMM yyyy"))).cast("string").alias("from_feed"), dates.sanitize_date(written, published, as_of).cast("string").alias("sanitized"),
    )


@query(f"""SELECT before, after, before - after AS merged, exact_matches, model_calls FROM (SELECT count(*) AS before, count(DISTINCT cluster) AS after FROM ({ORACLES["exact_dedup_components"]})),
(SELECT count(*) FILTER (is_exact) AS exact_matches, count(*) FILTER (NOT is_exact) AS model_calls FROM ({ORACLES["candidate_pairs"]}))""")
def dedup_telemetry(spark, sf_dir):
    """Reports before and after merging, candidate pairs that matched exactly, and those that a model would be asked about."""
    found = exact_dedup_components(spark, sf_dir).agg(F.count(F.lit(1)).alias("before"), F.count_distinct("cluster").alias("after"))
    counted = _candidates(spark, sf_dir, counts=True).agg(F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_matches"), F.coalesce(F.sum("others"), F.lit(0)).alias("model_calls"))
    return found.withColumn("merged", F.col("before") - F.col("after")).crossJoin(counted)  # one row each


@query("WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n7 FROM d")
def rolling_week(spark, sf_dir):
    """Incidents of the last seven days by day; each day counts for itself and the six that follow, so no task sees all days."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spread = per.select(F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), F.col("n").alias("m"))
    return per.join(spread, "day").groupBy("day", "n").agg(F.sum("m").alias("n7")).withColumn("day", F.col("day").cast("string"))


def _led(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir)
    return leaders.leader_clusters(inc.select(F.col("key").alias("id"), "title", "summary", F.col("affected_parties").alias("parties")))


@query()
def leader_clusters(spark, sf_dir):
    """Every incident with the first earlier one that leads a cluster and that it resembles, or itself."""
    return _led(spark, sf_dir)


@query()
def leader_merge(spark, sf_dir):
    """The clusters of leader_clusters merged into one record each."""
    members = adapters.incidents(spark, sf_dir).join(_led(spark, sf_dir), F.col("key") == F.col("id")).drop("id")
    return cluster.fuzzy_merge(members, "leader", "key").select("leader", day(), "usd", "text", F.array_join("urls", " ").alias("urls"))


_ENT = r"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '\b([a-z0-9_-]{{3,}})\b', 1), lambda w: NOT list_contains({}, w))))"


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, array_to_string({_ENT.format(Q._list(S.ENTITY_STOPWORDS))}, ' ') AS entities FROM inc")
def key_entities(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select("incident_id", F.array_join(text.key_entities(F.col("title")), " ").alias("entities"))


@query(f"WITH {Q.INCIDENTS}, w AS (SELECT incident_id, title, list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains(['and', 'the', 'for', 'over', 'with', 'from', 'report'], lower(w)))[1:7] AS ws FROM inc) SELECT incident_id, replace(CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE title END, ' ', '%20') AS query FROM w")
def short_queries(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).select("incident_id", text.short_query(F.col("title")).alias("query"))


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, {Q.norm_text("title || ' ' || title || ' ' || summary || ' ' || array_to_string(affected_parties, ' ') || ' ' || array_to_string(geographic_scope, ' ')")} AS corpus FROM inc")
def corpus_texts(spark, sf_dir):
    parts = (F.col(c) for c in ("title", "summary", "affected_parties", "geographic_scope"))
    return adapters.incidents(spark, sf_dir).select("incident_id", similarity.corpus_text(*parts).alias("corpus"))


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, CASE WHEN key % 4 = 0 OR year(date) IN (1996, 1997) THEN '1999-09-09' ELSE CAST(date AS VARCHAR) END AS guarded, CASE WHEN key % 4 = 0 THEN '2026-08-14' ELSE CAST(date AS VARCHAR) END AS coerced FROM inc")
def guarded_dates(spark, sf_dir):
    """Years 1996 and 1997 stand for those in which an extracted date isn't believed."""
    written = F.when(F.col("key") % 4 == 0, "").otherwise(F.col("date").cast("string"))
    believed = F.when(F.year("date").isin(1996, 1997), F.concat(F.lit("2023"), F.substring(written, 5, 6))).otherwise(written)
    guarded = dates.stale_guard(F.when(written != "", believed).otherwise(written), F.lit("1999-09-09"))
    return adapters.incidents(spark, sf_dir).select("incident_id", guarded.alias("guarded"), dates.coerced_date(written).alias("coerced"))


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, title FROM inc WHERE severity = 'high' AND (contains(lower(title), 'nation_1') OR contains(lower(incident_id), 'nation_1') OR len(list_filter(affected_parties, lambda p: contains(lower(p), 'nation_1'))) > 0)")
def graph_search(spark, sf_dir):
    return adapters.incidents(spark, sf_dir).filter(explore.graph_matches("NATION_1", "high")).select("incident_id", "title")


@query(f"WITH {Q.INCIDENTS}, {Q.EDGES}, n AS (SELECT DISTINCT key FROM inc WHERE severity = 'critical') SELECT source_key, target_key, relation_type FROM edges WHERE source_key IN (FROM n) AND target_key IN (FROM n) AND relation_type = '{S.RELATIONS[0]}'")
def edges_of_relation(spark, sf_dir):
    """The graph view's edges: both ends shown and one relation."""
    shown = adapters.incidents(spark, sf_dir).filter(explore.graph_matches("", "critical"))
    return graph.induced(adapters.edges(spark, sf_dir).filter(F.col("relation_type") == S.RELATIONS[0]), shown).select("source_key", "target_key", "relation_type")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, title, severity, CAST(date AS VARCHAR) AS date FROM inc WHERE incident_id = (SELECT min(incident_id) FROM inc)")
def incident_by_id(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir)
    wanted = inc.agg(F.min("incident_id")).first()[0]
    return inc.filter(F.col("incident_id") == wanted).select("incident_id", "title", "severity", day())


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, array_to_string(geographic_scope[1:2], ', ') AS places, coalesce(affected_parties[1], 'N/A') AS party FROM inc")
def card_heads(spark, sf_dir):
    """What a card of the list shows: the first two places and the first party."""
    return adapters.incidents(spark, sf_dir).select("incident_id", F.array_join(F.slice("geographic_scope", 1, 2), ", ").alias("places"), F.coalesce(F.try_element_at("affected_parties", F.lit(1)), F.lit("N/A")).alias("party"))


@query(f"WITH {Q.INCIDENTS}, y AS (SELECT CAST(max(date) - INTERVAL 1 DAY AS DATE) AS d FROM inc) SELECT incident_id, severity FROM inc, y WHERE date = d")
def yesterdays(spark, sf_dir):
    """The default window: the day before today, which is the latest date here."""
    latest = adapters.latest_date(spark, sf_dir)
    return adapters.incidents(spark, sf_dir).filter(F.col("date") == dates.yesterday(F.lit(latest))).select("incident_id", "severity")


_ANSWER = "'{\"harm_domain\": \"' || harm_domain || '\", \"financial_damage_usd\": ' || financial_damage_usd || ', \"nested\": {\"ok\": true}}'"
_RAW = f"CASE key % 6 WHEN 0 THEN {_ANSWER} WHEN 1 THEN '```json' || chr(10) || {_ANSWER} || chr(10) || '```' WHEN 2 THEN '[' || {_ANSWER} || ', 1]' WHEN 3 THEN '```' || chr(10) || '[' || {_ANSWER} || ']' || chr(10) || '```' WHEN 4 THEN substring({_ANSWER}, 1, 30) ELSE 'I cannot say' END"


@query(f"WITH {Q.INCIDENTS}, r AS (SELECT incident_id, key, {_RAW} AS raw FROM inc), c AS (SELECT incident_id, key, trim(regexp_replace(regexp_replace(trim(raw), '^```(json)?\\s*', ''), '\\s*```$', '')) AS t FROM r), j AS (SELECT incident_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM c), o AS (SELECT incident_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]') ELSE j END AS j FROM j) SELECT incident_id, json_extract_string(j, '$.harm_domain') AS harm_domain, CAST(json_extract_string(j, '$.financial_damage_usd') AS BIGINT) AS usd, CAST(json_extract_string(j, '$.nested.ok') AS BOOLEAN) AS ok, j IS NOT NULL AS parsed FROM o")
def parsed_answers(spark, sf_dir):
    """A model's answers about the incidents as models give them: plain, fenced, in a list, cut off, or not JSON at all."""
    raw = adapters.incidents(spark, sf_dir).select("incident_id", F.expr(_RAW).alias("raw"))
    found = raw.select("incident_id", F.explode_outer(F.array(answers.answer(F.col("raw")))).alias("a"))
    return found.select("incident_id", answers.field("a", "harm_domain", "string").alias("harm_domain"), answers.field("a", "financial_damage_usd", "bigint").alias("usd"), answers.field("a", "nested.ok", "boolean").alias("ok"), F.col("a").isNotNull().alias("parsed"))


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, CAST(NULL AS VARCHAR) AS harm_domain, CAST(NULL AS BIGINT) AS financial_damage_usd FROM inc")
def extraction_without_model(spark, sf_dir):
    found = classify.extract(adapters.incidents(spark, sf_dir).select("incident_id", F.col("full_text").alias("text")))
    return found.select("incident_id", "harm_domain", "financial_damage_usd")


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, coalesce(nullif(source_type, ''), 'google_news_rss') AS source_type, coalesce(financial_damage_usd, 0) AS financial_damage_usd,
  coalesce(CASE WHEN key % 3 <> 0 THEN lifecycle_phase END, 'operation_and_monitoring') AS lifecycle_phase, coalesce(CASE WHEN key % 4 <> 0 THEN system_classification END, 'general_purpose_model') AS system_classification,
  harm_domain, temporality, coalesce(impact_scope, 'discrete_incident') AS impact_scope, intent FROM inc""")
def records_on_read(spark, sf_dir):
    """A column, else the taxonomy's field, else the default."""
    inc = adapters.incidents(spark, sf_dir).withColumn("lifecycle_phase", F.when(F.col("key") % 3 != 0, F.col("lifecycle_phase"))).withColumn("system_classification", F.when(F.col("key") % 4 != 0, F.col("system_classification")))
    rows = sync.table_rows(inc).withColumn("source_type", F.when(F.col("source_type") == "gdelt", F.col("source_type")))
    return sync.on_read(rows).select("incident_id", "source_type", "financial_damage_usd", "lifecycle_phase", "system_classification", "harm_domain", "temporality", "impact_scope", "intent")


@query("""WITH days AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS total FROM events GROUP BY 1)
SELECT day, CASE WHEN day = (SELECT min(day) FROM days) THEN 0 ELSE total END AS total FROM days""")
def telemetry_upsert(spark, sf_dir):
    """Days' counts written over those that stood there before; a day that isn't written again keeps its count."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("total"))
    first = days.agg(F.min("day")).first()[0]
    before = days.withColumn("total", F.lit(0).cast("long"))
    return sync.upsert(before, days.filter(F.col("day") != first), "day").select("day", "total")


@query(f"WITH {Q.INCIDENTS} SELECT incident_id, severity FROM inc WHERE key % 5 <> 0")
def point_delete(spark, sf_dir):
    inc = adapters.incidents(spark, sf_dir)
    return sync.without(inc, inc.filter("key % 5 = 0").select("incident_id"), "incident_id").select("incident_id", "severity")


@query("""WITH n AS (SELECT max(page_id) + 1 AS n FROM pages), i AS (SELECT page_id, unnest(range(0, 7)) AS pos FROM pages), l AS (SELECT page_id, pos, (page_id + 3 * pos + 1) % n AS target FROM i, n WHERE pos < 5),
h AS (SELECT l.page_id, min(pos) AS pos FROM l JOIN pages p ON p.page_id = target WHERE target % 4 = 0 GROUP BY 1) SELECT page_id, pos FROM h""")
def search_fallback(spark, sf_dir):
    """Pages that can't be fetched themselves: a search gives seven links, of which the first five are tried and every fourth page has text."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://search.example.org/"), F.col("page_id").cast("string")).alias("url"))
    n = pages.agg(F.max("page_id") + 1).first()[0] or 1
    links = pages.select("page_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("page_id") + 3 * i + 1) % n)).alias("pos", "target"))
    items = links.select("page_id", "pos", F.concat(F.lit("https://search.example.org/"), F.col("target").cast("string")).alias("link"))
    own = pages.select("page_id", F.lit(0).alias("rank"), F.concat("url", F.lit("/gone")).alias("url"))
    fetched = pages.filter("page_id % 4 = 0").select("url", F.lit("text").alias("full_text"))
    found = harvest.first_text(harvest.with_search(own, items, "page_id"), fetched, "page_id")
    return found.select("page_id", (F.col("rank") - (1 << 20)).cast("long").alias("pos"))


def _damage_policy(policy: str) -> str:
    found = _damage_sql().replace(_T, "lower(title || ' ' || summary)") if policy == "ingest" else _damage_sql()
    stated = "'explicit_confirmed'" if policy == "ingest" else "NULL"
    return f"""r AS (SELECT incident_id, financial_damage_usd AS now, {found} FROM inc) SELECT incident_id, CASE WHEN coalesce(now, 0) <= 0 THEN damage_rule ELSE now END AS damage_rule,
  CASE WHEN coalesce(now, 0) <= 0 THEN damage_method ELSE {stated} END AS damage_method FROM r"""


@query(f"WITH {Q.INCIDENTS}, {_damage_policy('ingest')}")
def damage_at_ingest(spark, sf_dir):
    """Damage as new reports get it: estimated from title and summary where none is stated."""
    return rules.enriched(adapters.incidents(spark, sf_dir), "ingest").select("incident_id", "damage_rule", "damage_method")


@query(f"WITH {Q.INCIDENTS}, {_damage_policy('backfill')}")
def damage_backfill(spark, sf_dir):
    """Damage as stored reports get it: only what is missing or 0 is filled."""
    return rules.enriched(adapters.incidents(spark, sf_dir), "backfill").select("incident_id", "damage_rule", "damage_method")


@query(f"""WITH {Q.INCIDENTS}, s AS (SELECT incident_id, CASE WHEN key % 4 IN (2, 3) THEN ['Global'] ELSE list_filter(list_transform(geographic_scope, lambda x: trim(x)), lambda x: x <> '') END AS scope FROM inc)
SELECT incident_id, array_to_string(scope, '|') AS scope FROM s""")
def scopes_read(spark, sf_dir):
    """Scopes held as a JSON array, a comma list, null or nothing, read as arrays."""
    held = F.when(F.col("key") % 4 == 0, F.to_json("geographic_scope")).when(F.col("key") % 4 == 1, F.array_join("geographic_scope", ",")).when(F.col("key") % 4 == 3, "")
    return adapters.incidents(spark, sf_dir).select("incident_id", F.array_join(geo.scope_array(held), "|").alias("scope"))


@query("""WITH b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events), e AS (SELECT event_id, CAST(ts AS DATE) AS d, lo, hi FROM events, b)
SELECT event_id, CAST(greatest(lo, least(hi, d + 3)) AS VARCHAR) AS from_day, CAST(greatest(lo, least(hi, d + 17)) AS VARCHAR) AS to_day FROM e""")
def stepped_windows(spark, sf_dir):
    """Windows of a week to each side of an event, moved on by ten days within the bounds of all events."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("d"))
    e = events.crossJoin(F.broadcast(events.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))))  # one row
    a, b = dates.step_window(F.date_sub("d", 7), F.date_add("d", 7), 10, F.col("lo"), F.col("hi"))
    return e.select("event_id", a.cast("string").alias("from_day"), b.cast("string").alias("to_day"))


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, regexp_replace(coalesce(eu_ai_act_tier, 'limited_risk'), '_', ' ') AS tier, array_to_string(geographic_scope, ', ') AS countries,
  CASE WHEN key % 4 = 0 THEN 'MAP' ELSE nist_ai_rmf_function END AS nist, CASE WHEN key % 5 = 0 THEN 'System_Impact' ELSE iso_42001_category END AS iso, coalesce(intent, 'N/A') AS intent FROM inc""")
def detail_fields(spark, sf_dir):
    """What a report's details show, with defaults for what it lacks."""
    inc = adapters.incidents(spark, sf_dir)
    nist, iso = F.when(F.col("key") % 4 != 0, F.col("nist_ai_rmf_function")), F.when(F.col("key") % 5 == 0, "").otherwise(F.col("iso_42001_category"))
    return inc.select(
        "incident_id", display.table_tier(F.col("eu_ai_act_tier")).alias("tier"), display.table_countries(F.col("geographic_scope")).alias("countries"),
        display.detail_default(nist, "nist").alias("nist"), display.detail_default(iso, "iso").alias("iso"), display.detail_default(F.col("intent"), "intent").alias("intent"),
    )


@query(f"""WITH {Q.INCIDENTS} SELECT incident_id, concat_ws('; ', CASE WHEN key % 3 <> 0 THEN 'Severity: ' || severity END, 'Eu Tier: ' || replace(eu_ai_act_tier, '_', ' '),
  CASE WHEN key % 2 = 0 THEN 'Search: ' || replace(harm_type, '_', ' ') END) AS chips FROM inc""")
def filter_chips(spark, sf_dir):
    """Labels of the filters that would find a report; those left at 'all', empty or null have none."""
    severity, search = F.when(F.col("key") % 3 == 0, "all").otherwise(F.col("severity")), F.when(F.col("key") % 2 == 0, F.col("harm_type")).otherwise("")
    chips = display.chips(severity=severity, eu_tier=F.col("eu_ai_act_tier"), search=search)
    return adapters.incidents(spark, sf_dir).select("incident_id", F.array_join(chips, "; ").alias("chips"))


_RSS = load_keywords(section="rss")
_HELD = "list_filter({}, lambda p: contains(' ' || words || ' ', ' ' || lower(p) || ' '))"


@query(f"""WITH {Q.RECORDS}, w AS (SELECT DISTINCT u, lower(replace(regexp_extract(u, '([^/]*)$', 1), '-', ' ')) AS words FROM rec),
f AS (SELECT u, {_HELD.format(Q._list(_RSS['subjects']))} AS s, {_HELD.format(Q._list(_RSS['incidents']))} AS i FROM w)
SELECT u AS url, '("' || array_to_string(s, '" OR "') || '") AND ("' || array_to_string(i, '" OR "') || '")' AS search FROM f WHERE len(s) > 0 AND len(i) > 0""")
def record_searches(spark, sf_dir):
    """The news search that would find each record: subjects and incidents that the last segment of its URL names."""
    words = F.lower(F.replace(F.regexp_extract("url", "([^/]*)$", 1), F.lit("-"), F.lit(" ")))
    urls = adapters.records(spark, sf_dir).select(F.col("DocumentIdentifier").alias("url")).distinct()
    # What explode_outer gives is computed once.
    once = lambda c: F.explode_outer(F.array(c))
    held = urls.select("url", once(words).alias("words")).select("url", "words", once(phrases_in(F.col("words"), _RSS["subjects"])).alias("subjects"))
    held = held.filter(F.size("subjects") > 0).select("url", "subjects", once(phrases_in(F.col("words"), _RSS["incidents"])).alias("incidents"))
    return held.filter(F.size("incidents") > 0).select("url", boolean_search(F.col("subjects"), F.col("incidents")).alias("search"))


def _files(spark, name: str, contents: DataFrame) -> str:
    """A folder with one text file for each row."""
    where = f"{Scratch(spark, name).root}/files"
    contents.write.option("maxRecordsPerFile", 1).text(where)
    return where


_FEED = 200  # pages in a feed or an array


def _in_files(pages: DataFrame, item, before: str, between: str, after: str) -> DataFrame:
    """One row for each _FEED page ids: their items in order of id."""
    held = pages.groupBy(F.expr(f"id div {_FEED}")).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("items"))
    return held.select(F.concat(F.lit(before), F.array_join("items.item", between), F.lit(after)).alias("value"))


@query(f"""WITH {_PAGES}, f AS (SELECT id, url, trim(title || ' - ' || party) AS title FROM p)
SELECT url AS link, regexp_replace(title, ' - [^-]+$', '') AS title, CAST(DATE '2026-01-01' + CAST(id % 300 AS INTEGER) AS VARCHAR) AS date, CAST(row_number() OVER (PARTITION BY id // {_FEED} ORDER BY id) - 1 AS INTEGER) AS position FROM f""")
def feed_articles(spark, sf_dir):
    """Pages as items of RSS files, read back as articles with their place in the file."""
    plain = lambda c: F.regexp_replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    published = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 300).cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(
        F.lit("<item><title>"), plain(F.concat("title", F.lit(" - "), F.col("parties")[0])), F.lit("</title><link>"), plain(F.col("url")),
        F.lit("</link><pubDate>"), published, F.lit(" 07:00:00 GMT</pubDate></item>"),
    )
    items = connectors.feed_items(spark, _files(spark, "feeds", _in_files(_pages(spark, sf_dir), item, "<rss><channel>", "", "</channel></rss>")))
    return items.select("link", text.feed_title(F.col("title")).alias("title"), dates.feed_date(F.col("pubDate")).cast("string").alias("date"), "position")


@query(f"WITH {_PAGES} SELECT id, url, title, usd FROM p")
def json_arrays_read(spark, sf_dir):
    """Pages written as files that hold one JSON array each, and read back."""
    array = _in_files(_pages(spark, sf_dir), F.to_json(F.struct("id", "url", "title", "usd")), "[", ",", "]")
    return connectors.read_json_array(spark, _files(spark, "arrays", array), "id bigint, url string, title string, usd bigint")


@query(f"""WITH {_PAGES}, {Q.RECORDS}, h AS (SELECT url AS link, title, NULL AS source, NULL AS tone FROM p UNION ALL SELECT u, NULL, source, tone FROM rec)
SELECT coalesce(source, 'pages') AS source, count(*) AS reports, count(DISTINCT link) AS links, count(title) AS titles, count(tone) AS tones FROM h GROUP BY 1""")
def pooled_harvests(spark, sf_dir):
    """Pages and event records as one harvest, by source; columns that one lacks are null."""
    articles = _pages(spark, sf_dir).select(F.col("url").alias("link"), "title")
    records = adapters.records(spark, sf_dir).select(F.col("DocumentIdentifier").alias("link"), F.col("SourceCommonName").alias("source"), F.split("V2Tone", ",")[0].alias("tone"))
    every = connectors.pooled(articles, records).groupBy(F.coalesce("source", F.lit("pages")).alias("source"))
    return every.agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("link").alias("links"), F.count("title").alias("titles"), F.count("tone").alias("tones"))
