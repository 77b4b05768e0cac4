"""Text and URL expressions, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import schemas as S

BLANKS = r"[ \t\n\r\x0b\x0c]"


def or_else(c: Column, default: Column | str) -> Column:
    """Null and '' both fall through to the default."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def normalize_text(c: Column) -> Column:
    """Lower case, signs to spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_url(c: Column) -> Column:
    """https, host in lower case without www., no final slashes, no tracking parameters, the rest sorted by name, no fragment.

    Parameters without a value go, repeated ones keep their order. Escapes are left as they are. Null and '' give ''.
    """
    u = F.trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(u, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    ignored = F.array(*map(F.lit, S.TRACKING))
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.array_contains(ignored, F.lower(F.substring_index(p, "=", 1))))
    placed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    kept = F.array_join(F.transform(F.array_sort(placed), lambda x: x["p"]), "&")
    whole = F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(u == "", "").when(scheme == "", u).otherwise(whole)


def url_slug(c: Column) -> Column:
    """The last segment of a URL in lower case, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(c), r"/([^/]+)[/]?$", 1), F.lit(""))


def content_words(c: Column) -> Column:
    """Words of more than two letters that aren't stopwords, in order."""
    return F.filter(F.split(normalize_text(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(S.STOPWORDS))


def with_bigrams(words: Column) -> Column:
    """words (a materialised column) and their bigrams a_b."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)))


def sanitize(c: Column, most: int = 4000) -> Column:
    """Without tags and control characters, planted instructions redacted, blanks squeezed, at most so many characters."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    t = reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p, S.REDACTED), S.INJECTIONS, t)
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def feed_title(c: Column) -> Column:
    """A feed's title without the publisher after the last ' - '."""
    return F.regexp_replace(c, " - [^-]+$", "")


def slug_query(url: Column) -> Column:
    """A search title from the last segment of a URL, or from the one before if the last is a number."""
    parts = F.filter(F.transform(F.split(url, "/"), lambda p: F.trim(p)), lambda p: p != "")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    slug = F.when(last.rlike("^[0-9]+$") & before.isNotNull(), before).otherwise(last)
    words = F.filter(F.split(slug, "[-_]"), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def short_query(title: Column) -> Column:
    """At most seven words of more than two letters, without stopwords, URL-encoded; the whole title if none is left."""
    stop = F.array(*map(F.lit, S.QUERY_STOPWORDS))
    words = F.filter(F.split(title, r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)))
    return F.replace(F.url_encode(F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 7), " ")).otherwise(title)), F.lit("+"), F.lit("%20"))


def key_entities(c: Column) -> Column:
    """Distinct words of three signs and more without stopwords, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b([a-z0-9_-]{3,})\b"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, S.ENTITY_STOPWORDS))))


def unfenced_json(c: Column) -> Column:
    """A model's answer without code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(json)?\s*", ""), r"\s*```$", ""))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def html_paragraphs(c: Column, longer_than: int = 35) -> Column:
    """Texts of p elements outside scripts, styles, navigation, headers, footers and asides, longer than so many characters."""
    body = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", " "), r"\s+", " "))), lambda p: F.length(p) > longer_than)


def alternate_url(domain: Column, url: Column) -> Column:
    """The same path at another domain."""
    return F.concat(F.lit("https://"), domain, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def external_url(c: Column) -> Column:
    return F.when(F.lower(c).rlike("^https?://"), c).otherwise("#")


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words between blanks, in lower case."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def label(c: Column) -> Column:
    """For display: spaces for underscores, upper case, 28 characters at most."""
    t = F.upper(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.when(F.length(t) > 28, F.concat(F.substring(t, 1, 25), F.lit("..."))).otherwise(t)
