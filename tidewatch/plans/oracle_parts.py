"""The adapters of tidewatch.sources.adapters as SQL common table expressions, for the side-by-side checks."""

from __future__ import annotations

from tidewatch import schemas as S
from tidewatch.sources.adapters import HAPPENINGS, SUBJECTS


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"({_list(values)})[({index}) + 1]"


INCIDENTS = f"""
sup AS (SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
raw AS (SELECT o_orderkey AS k, *, o_orderpriority || ' report from ' || n_name AS title, c_name || ': ' || {_pick(S.PHRASES, f'o_orderkey % {len(S.PHRASES)}')} AS summary
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN sup ON o_orderkey = l_orderkey),
inc AS (SELECT k AS key, 'INC-' || strftime(o_orderdate, '%Y%m%d') || '-' || k AS incident_id, title, summary, title || '. ' || summary AS full_text,
  CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'alleged' ELSE 'disputed' END AS verification_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'google_news_rss' ELSE 'gdelt' END AS source_type,
  CASE WHEN k % 7 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) * ([1, 10, 100, 1000, 10000, 100000])[(k % 6) + 1] END AS financial_damage_usd,
  CASE WHEN k % 11 = 0 THEN 'cumulative_macro_trend' WHEN k % 5 = 0 THEN NULL ELSE 'discrete_incident' END AS impact_scope,
  {_pick(S.SYSTEMS, 'length(c_mktsegment) % 5')} AS system_classification, {_pick(S.LIFECYCLES, 'k % 5')} AS lifecycle_phase, {_pick(S.ROOT_CAUSES, 'k % 6')} AS root_cause_category,
  {_pick(S.HARM_DOMAINS, 'k % 7')} AS harm_domain, {_pick(S.TEMPORALITIES, 'k % 3')} AS temporality, CASE WHEN k % 9 <> 0 THEN {_pick(S.INTENTS, 'k % 2')} END AS intent,
  {_pick(S.PURPOSES, 'k % 9')} AS primary_purpose, {_pick(S.HARM_TYPES, 'k % 8')} AS harm_type, CASE WHEN k % 10 <> 0 THEN {_pick(S.EU_TIERS, 'k % 4')} END AS eu_ai_act_tier,
  {_pick(S.NIST, 'k % 4')} AS nist_ai_rmf_function, {_pick(S.ISO, 'k % 4')} AS iso_42001_category, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS natsec_impact,
  CASE WHEN k % 13 <> 0 THEN (k % 100) / 100.0 END AS confidence_severity, [CASE WHEN n_nationkey % 2 = 0 THEN ['UK', ' United Kingdom ', 'usa', 'France', 'EU', 'Germany', 'Japan ', 'china', 'India', 'Brazil', 'United States', 'Atlantis', 'South Korea'][n_nationkey // 2 % 13 + 1] ELSE n_name END, r_name] AS geographic_scope,
  CASE WHEN k % 2 = 0 THEN list_concat([c_name], coalesce(suppliers, CAST([] AS VARCHAR[]))) ELSE coalesce(suppliers, CAST([] AS VARCHAR[])) END AS affected_parties,
  ['https://news.example.com/' || lower(replace(n_name, ' ', '-')) || '/' || k] AS source_urls
  FROM raw)
"""

EDGES = f"""
eo AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
edges AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'EDGE-DUP' ELSE 'EDGE-' || o_orderkey END AS edge_id, prev AS source_key,
  CASE WHEN o_orderkey % 23 = 0 THEN -o_orderkey ELSE o_orderkey END AS target_key, {_pick(S.RELATIONS, 'o_orderkey % 5')} AS relation_type,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'linked' END AS description, CASE WHEN o_orderkey % 6 = 0 THEN 0.0 WHEN o_orderkey % 8 = 1 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS confidence, o_orderkey AS seq
  FROM eo WHERE prev IS NOT NULL)
"""

RECORDS = f"""
np AS (SELECT max(page_id) + 1 AS n FROM pages),
rec AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS DATE_, url || '/' || {_pick(SUBJECTS, f'event_id % {len(SUBJECTS)}')} || '-' || {_pick(HAPPENINGS, f'event_id // 7 % {len(HAPPENINGS)}')} AS u, event_type || '.example.org' AS source, CAST(printf('%.2f', 5.0 - value % 10) AS DOUBLE) AS tone,
  CASE event_id % 3 WHEN 0 THEN 'OpenAI;Acme' WHEN 1 THEN 'Acme' END AS orgs, CASE event_id % 2 WHEN 0 THEN 'CYBER_ATTACK;TAX' ELSE 'TAX' END AS themes, CAST(ts AS DATE) AS day
  FROM events, np JOIN pages ON page_id = event_id % n)
"""


def norm_text(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_url(c: str) -> str:
    bare = f"regexp_replace(trim(coalesce({c}, '')), '#.*$', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"
    pairs = f"list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT list_contains({_list(S.TRACKING)}, lower(split_part(p, '=', 1))))"
    kept = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: x.p), '&')"
    return f"CASE WHEN {scheme} = '' THEN trim(coalesce({c}, '')) ELSE (CASE {scheme} WHEN 'http' THEN 'https' ELSE {scheme} END) || '://' || {host} || {path} || (CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END) END"


def tokens(c: str) -> str:
    return f"list_filter(string_split({norm_text(c)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({_list(S.STOPWORDS)}, w))"


def tfidf(source: str, id_col: str, text_col: str) -> str:
    return f"""
w AS (SELECT {id_col} AS id, {tokens(text_col)} AS w FROM {source}),
terms AS (SELECT id, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || '_' || x[2]))) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT id, term, df, tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS wt FROM tf JOIN df USING (term)),
vec AS (SELECT id, term, df, wt / sqrt(sum(wt * wt) OVER (PARTITION BY id)) AS v FROM wt)
"""


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
