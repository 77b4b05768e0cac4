"""Rule classifiers: first match wins, words are looked for as substrings of lower-cased text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas as S


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def has_any(text: Column, words: list[str]) -> Column:
    """One alternation, not one scan for each word; the words hold no signs of patterns but dots and blanks."""
    return text.rlike("|".join(w.replace("%", "[%]") for w in words))


def nist_function() -> Column:
    title, summary, rc, system, harm = (_low(c) for c in ("title", "summary", "root_cause_category", "system_classification", "harm_type"))
    return (
        F.when(rc.contains("governance") | has_any(summary, ["policy", "legal"]) | has_any(title, ["court", "fcc", "sec"]), "GOVERN")
        .when(has_any(summary, ["cyber", "hack", "breach"]) | has_any(system, ["agent", "autonomous"]), "MANAGE")
        .when(has_any(rc, ["model", "data"]) | harm.contains("bias") | has_any(summary, ["hallucination", "test"]), "MEASURE")
        .otherwise("MAP")
    )


def iso_category() -> Column:
    title, summary, rc, harm, purpose = (_low(c) for c in ("title", "summary", "root_cause_category", "harm_type", "primary_purpose"))
    return (
        F.when(has_any(summary, ["cyber", "hack", "breach", "vulnerability", "exploit"]), "Operational_Security")
        .when(has_any(harm, ["privacy", "copyright"]) | rc.contains("data") | has_any(summary, ["secret", "trade"]), "Data_&_Resources")
        .when(rc.contains("governance") | title.contains("court") | has_any(summary, ["lawsuit", "dismissal"]) | purpose.contains("hr"), "Internal_Governance")
        .otherwise("System_Impact")
    )


def corpus(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def impact_scope(existing: str = "impact_scope") -> Column:
    """A macro scope stays; words of a macro trend make one; all else is discrete."""
    return F.when((F.col(existing) == S.MACRO_SCOPE) | has_any(corpus("title", "summary", "full_text"), S.MACRO_WORDS), S.MACRO_SCOPE).otherwise(S.DISCRETE_SCOPE)


def damage(text: Column, severity: Column) -> tuple[Column, Column]:
    """Financial damage and how it was found. A stated billion beats a million wherever they stand."""
    found = damage_found(text, severity)
    return found["usd"], found["how"]


def damage_found(text: Column, severity: Column) -> Column:
    """Both answers of damage in one struct."""

    amount = lambda word: F.regexp_extract(text, r"\$([0-9]+(?:\.[0-9]+)?)\s*" + word, 1).try_cast("double")
    by = lambda c, h, o: F.when(severity == "critical", c).when(severity == "high", h).otherwise(o)
    billion, million = amount("billion"), amount("million")
    # One chain of both answers, so that the text is searched once.
    both = lambda usd, how: F.struct(usd.cast("long").alias("usd"), F.lit(how).alias("how"))
    found = F.when(billion.isNotNull(), both(billion * 1e9, "explicit_confirmed")).when(million.isNotNull(), both(million * 1e6, "explicit_confirmed"))
    for words, critical, high, other, name in S.DAMAGE_RULES:
        found = found.when(has_any(text, words), both(by(critical, high, other), name))
    last = F.when(severity == "critical", 5_000_000).when(severity == "high", 2_500_000).when(severity == "medium", 850_000).otherwise(350_000)
    return found.otherwise(both(last, "empirical_estimate"))


def enriched(df: DataFrame, policy: str = "always") -> DataFrame:
    """df with NIST, ISO, scope and damage by rule.

    policy: 'always' overwrites the damage; 'ingest' estimates from title and summary where it isn't
    positive and else calls it explicit; 'backfill' only fills what is missing or 0.
    """
    text = corpus("title", "summary") if policy == "ingest" else corpus("title", "summary", "full_text")
    # What explode_outer gives is computed once, though two columns are taken from it.
    held = f"found_{uuid.uuid4().hex}"
    columns = df.columns
    df = df.withColumn(held, F.explode_outer(F.array(damage_found(text, F.coalesce("severity", F.lit("medium"))))))
    usd, how = F.col(f"{held}.usd"), F.col(f"{held}.how")
    now = F.col("financial_damage_usd")
    missing = F.coalesce(now, F.lit(0)) <= 0
    if policy == "ingest":
        usd, how = F.when(missing, usd).otherwise(now), F.when(missing, how).otherwise("explicit_confirmed")
    elif policy == "backfill":
        usd, how = F.when(missing, usd).otherwise(now), F.when(missing, how)
    return df.select(*columns, nist_function().alias("nist_rule"), iso_category().alias("iso_rule"), impact_scope().alias("scope_rule"), usd.alias("damage_rule"), how.alias("damage_method"))
