"""From clusters and pages to articles: titles by template, texts by a chain of attempts, search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text


def cluster_articles(clusters: DataFrame) -> DataFrame:
    """Articles from clusters of event records, titled by number of reports and URL."""
    n = F.col("number_of_reports").cast("string")
    title = F.concat(F.lit("Event ("), n, F.lit(" reports): "), F.replace(F.substring_index("example_url", "/", -1), F.lit("-"), F.lit(" ")))
    about = F.concat(F.lit("Clustered event ("), n, F.lit(" reports across "), F.array_join("reported_by_samples", ", "), F.lit(") | Avg Tone: "), F.format_string("%.2f", "avg_tone"))
    return clusters.select(title.alias("title"), F.col("example_url").alias("link"), about.alias("description"), F.lit("gdelt").alias("source_type"), "number_of_reports")


def attempts(pages: DataFrame, key: str, url: str, domains: str) -> DataFrame:
    """(key, rank, url): the page itself, then its path at each alternate domain if the path is long enough."""
    own = pages.select(key, F.lit(0).alias("rank"), F.col(url).alias("url"))
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    other = pages.filter(F.length(path) > 5).select(key, url, F.posexplode(domains).alias("pos", "domain")).filter(F.trim("domain") != "")
    return own.unionByName(other.select(key, (F.col("pos") + 1).alias("rank"), text.alternate_url(F.concat(F.lit("www."), F.trim("domain")), F.col(url)).alias("url")))


def first_text(tried: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """The text of each page's first attempt that gave one. fetched: url, full_text."""
    got = tried.join(fetched.filter(F.coalesce("full_text", F.lit("")) != ""), "url")
    return got.groupBy(key).agg(F.min_by("full_text", "rank").alias("full_text"), F.min("rank").alias("rank"))


def with_search(tried: DataFrame, items: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The attempts, and after them the first links that a search gave. items: key, pos (from 0), link."""
    last = 1 << 20  # beyond every alternate domain
    found = items.filter(F.col("pos") < most).select(key, (F.col("pos") + last).alias("rank"), F.col("link").alias("url"))
    return tried.unionByName(found)


def searches(url: Column) -> tuple[Column, Column]:
    """A search title from a URL, and the short query made from it."""
    title = text.slug_query(url)
    return title, text.short_query(title)
