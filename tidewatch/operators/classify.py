"""Places for external models: gate, taxonomy and pair verdicts, with what holds when there is none.

A model is a function on batches of dicts. Without one the answers are fixed: nothing passes the gate,
no taxonomy is extracted, no pair is the same.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.text import sanitize
from tidewatch.sources.runtime import Scratch
from tidewatch.sources.tables import KeyedTable

Model = Callable[[list[dict]], list[dict]]

GATE = "is_ai_incident boolean, confidence double, rejection_reason string"
VERDICT = "is_same_incident boolean, confidence double, reasoning string"
#: What a model extracts from a report.
EXTRACTED = (
    "title string, summary string, date string, verification_status string, lifecycle_phase string, system_classification string, intent string, primary_purpose string, root_cause_category string, "
    "root_cause_subtype string, failure_mode string, harm_domain string, harm_type string, impact_scope string, financial_damage_usd bigint, eu_ai_act_tier string, nist_ai_rmf_function string, "
    "iso_42001_category string, natsec_impact boolean, temporality string, severity string, geographic_scope array<string>, affected_parties array<string>, confidence_scores map<string,double>"
)
TITLE_CAP, GATE_CAP, EXTRACT_CAP = 300, 4000, 6000  # characters that a model gets to see
QUOTA = ("429", "quota", "resource_exhausted", "rate limit")


def over_quota(e: Exception) -> bool:
    return any(sign in str(e).lower() for sign in QUOTA)


def retrying(models: list[Model], attempts: int = 3, wait: float = 2.0, again: Callable[[Exception], bool] = over_quota) -> Model:
    """Models in order of preference: the last good one first, each tried a few times with growing waits where `again` says so, else left for the next."""
    state = {"at": 0}

    def call(batch: list[dict]) -> list[dict]:
        failure: Exception | None = None
        for step in range(len(models)):
            at = (state["at"] + step) % len(models)
            for n in range(attempts):
                try:
                    out = models[at](batch)
                    state["at"] = at
                    return out
                except Exception as e:  # noqa: BLE001 - any failure of an external service
                    failure = e
                    if not again(e):
                        break
                    time.sleep(wait * (n + 1))
        raise RuntimeError("no model answered") from failure

    return call


def applied(df: DataFrame, model: Model | None, ddl: str, otherwise: dict) -> DataFrame:
    """df with the model's columns; `otherwise` where there is no model."""
    fields = StructType.fromDDL(ddl)
    if model is None:
        return df.select("*", *(F.lit(otherwise.get(f.name)).cast(f.dataType).alias(f.name) for f in fields))
    names = [f.name for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = model(frame.to_dict("records"))
            yield frame.assign(**{n: [a.get(n) for a in answers] for n in names})

    return df.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, {ddl}")


_ASKED = "ask string, answer string, error string, done int"


def stored(df: DataFrame, model: Model, ddl: str, path: str, seen: list[str], waves: int = 4, chunk: int = 8) -> DataFrame:
    """df with the model's columns and `error`, from answers kept in a table by what the model saw (the columns `seen`).

    Only what has no answer there is asked, each content once however many rows hold it. Questions go in waves, each of which is stored before the next, so a lost job or executor
    costs one wave at most. A model that fails leaves its questions with the error and null columns; the next call asks them again.
    """
    spark = df.sparkSession
    table = KeyedTable(spark, path, StructType.fromDDL(_ASKED), "ask", order="done")
    scratch = Scratch(spark, "asked")
    asked = df.withColumn("ask", F.sha2(F.to_json(F.struct(*seen), {"ignoreNullFields": "false"}), 256))
    questions = scratch.table(asked.select("ask", *seen).dropDuplicates(["ask"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), chunk):
                part = frame.iloc[at : at + chunk]
                try:
                    answers, error = model(part[seen].to_dict("records")), None
                    if len(answers) != len(part):
                        raise ValueError(f"{len(answers)} answers to {len(part)} questions")
                except Exception as e:  # noqa: BLE001 - any failure of an external service
                    answers, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"ask": part["ask"], "answer": [None if a is None else json.dumps(a) for a in answers], "error": error, "done": [int(a is not None) for a in answers]})

    for wave in range(waves):
        missing = questions.filter(F.pmod(F.xxhash64("ask"), F.lit(waves)) == wave).join(table.read().filter("done = 1").select("ask"), "ask", "left_anti")
        found = scratch.table(missing.mapInPandas(run, _ASKED))  # written before it is used, so nothing is asked twice
        table.upsert(found)
        scratch.drop(found)
    names = [f.name for f in StructType.fromDDL(ddl)]
    answers = table.read().select(F.col("ask").alias("asked"), F.from_json("answer", ddl).alias("found"), "error")
    return asked.join(answers, F.col("ask") == F.col("asked"), "left").select(*df.columns, *(F.col(f"found.{n}").alias(n) for n in names), "error")


def capped(df: DataFrame, text_cap: int) -> DataFrame:
    """df with the beginnings of title and text that a model gets to see, sanitised, as shown_title and shown_text."""
    shown = {f"shown_{c}": sanitize(F.col(c), most) for c, most in (("title", TITLE_CAP), ("text", text_cap)) if c in df.columns}
    return df.withColumns(shown) if shown else df


def _shown(df: DataFrame) -> list[str]:
    return [c for c in ("shown_title", "shown_text") if c in df.columns]


def gate(df: DataFrame, model: Model | None = None, store: str | None = None) -> DataFrame:
    """df with the gate's answer; with the path of a store, answers are kept there and the column `error` tells which are missing."""
    shown = capped(df, GATE_CAP)
    if model is not None and store is not None:
        return stored(shown, model, GATE, store, _shown(shown)).drop("shown_title", "shown_text")
    found = applied(shown, model, GATE, {"is_ai_incident": False, "confidence": 0.0, "rejection_reason": "no model"})
    return found.drop("shown_title", "shown_text")


def extract(df: DataFrame, model: Model | None = None, store: str | None = None) -> DataFrame:
    """df with the taxonomy that a model finds in each report; all null without one. Columns of df by those names give way. store: as for gate."""
    names = [f.name for f in StructType.fromDDL(EXTRACTED)]
    shown = capped(df, EXTRACT_CAP)
    shown = shown.drop(*(c for c in df.columns if c in names))
    if model is not None and store is not None:
        return stored(shown, model, EXTRACTED, store, _shown(shown)).drop("shown_title", "shown_text")
    return applied(shown, model, EXTRACTED, {}).drop("shown_title", "shown_text")


def verdicts(pairs: DataFrame, model: Model | None = None, least: float = 0.7, store: str | None = None) -> DataFrame:
    """pairs with matched: the same event with at least that confidence. store: as for gate."""
    if model is not None and store is not None:
        out = stored(pairs, model, VERDICT, store, pairs.columns)
        return out.withColumn("matched", F.coalesce(F.col("is_same_incident") & (F.col("confidence") >= least), F.lit(False)))
    out = applied(pairs, model, VERDICT, {"is_same_incident": False, "confidence": 0.0, "reasoning": ""})
    return out.withColumn("matched", F.col("is_same_incident") & (F.col("confidence") >= least))
