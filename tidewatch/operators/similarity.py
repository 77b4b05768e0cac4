"""TF-IDF vectors, cosine pairs, exact matches and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.functions.text import content_words, normalize_text, normalize_url, with_bigrams


def corpus_text(title: Column, summary: Column, parties: Column, scope: Column) -> Column:
    """The title twice, the summary, the parties and the places."""
    return normalize_text(F.concat_ws(" ", title, title, F.coalesce(summary, F.lit("")), F.array_join(parties, " "), F.array_join(scope, " ")))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of words and bigrams. explode_outer keeps the token expression from being copied into a filter."""
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array(content_words(F.col(text_col)))).alias("w"))
    terms = words.select("id", F.explode_outer(with_bigrams(F.col("w"))).alias("term")).filter("term is not null")
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_totals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, tokens): distinct and all words and bigrams, counted in the row. Texts without any have no row.

    What explode_outer gives is computed once; without it the filter below would hold copies of the token expression."""
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array(content_words(F.col(text_col)))).alias("w"))
    made = words.select("id", F.explode_outer(F.array(with_bigrams(F.col("w")))).alias("t"))
    return made.select("id", F.size(F.array_distinct("t")).cast("long").alias("terms"), F.size("t").cast("long").alias("tokens")).filter("tokens > 0")


def tfidf(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """(id, term, df, v): weights tf * (ln((1 + N) / (1 + df)) + 1), each document's vector of length 1."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    weighed = counts.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # a document's own terms
    return weighed.select("id", "term", "df", (F.col("w") / norm).alias("v"))


def top_terms(vectors: DataFrame, k: int) -> DataFrame:
    """Each document's k heaviest terms."""
    order = Window.partitionBy("id").orderBy(F.round("v", 9).desc(), "term")
    return vectors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, sim) of pairs with a cosine of the threshold or more; exact, by prefix filtering.

    Terms are ordered from rare to frequent. If what follows a document's prefix has a norm below the
    threshold, two documents that reach it share a term of both prefixes: the rarest that they share.
    """
    back = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = vectors.withColumn("rest", F.sqrt(F.sum(F.col("v") * F.col("v")).over(back)))
    prefix = tail.filter(F.col("rest") >= threshold * (1 - 1e-9)).select("id", "term")
    candidates = prefix.alias("a").join(prefix.alias("b"), (F.col("a.term") == F.col("b.term")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()
    return pair_cosines(candidates, vectors).filter(F.col("sim") >= threshold)


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id1, id2, sim) of those pairs that share a term."""
    left = pairs.join(vectors.select(F.col("id").alias("id1"), "term", F.col("v").alias("v1")), "id1")
    both = left.join(vectors.select(F.col("id").alias("id2"), "term", F.col("v").alias("v2")), ["id2", "term"])
    return both.groupBy("id1", "id2").agg(F.sum(F.col("v1") * F.col("v2")).alias("sim"))


def exact_keys(docs: DataFrame, id_col: str, urls: Column, title: Column) -> DataFrame:
    """(id, key): a key for every normalised URL and for the normalised title."""
    keys = F.concat(F.transform(urls, lambda u: F.concat(F.lit("u:"), normalize_url(u))), F.array(F.concat(F.lit("t:"), normalize_text(title))))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(keys)).alias("key")).filter(~F.col("key").isin("u:", "t:"))


def key_edges(keys: DataFrame) -> DataFrame:
    """Each holder of a key linked to the smallest one: the same components as all pairs, one row for each holder."""
    first = keys.groupBy("key").agg(F.min("id").alias("dst"))
    return keys.join(first, "key").filter(F.col("id") > F.col("dst")).select(F.col("id").alias("src"), "dst").distinct()


def key_pairs(keys: DataFrame) -> DataFrame:
    """(id1, id2) of all pairs that share a key; for keys that few share."""
    return keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def party_keys(docs: DataFrame, id_col: str, parties: str) -> DataFrame:
    """(id, key) of the parties that aren't general."""
    names = F.transform(parties, lambda p: F.trim(F.lower(p)))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_except(names, F.array(*map(F.lit, S.GENERIC_PARTIES)))).alias("key"))
