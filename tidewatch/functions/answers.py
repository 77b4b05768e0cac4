"""Models' answers as variants: parsed once, read by path, null where there is nothing to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import unfenced_json


def answer(raw: Column) -> Column:
    """The object in a model's answer, without code fences; of a list its first element. Null if it isn't JSON, is cut off or empty."""
    parsed = F.try_parse_json(unfenced_json(raw))
    listed = F.schema_of_variant(parsed).startswith("ARRAY")
    return F.when(listed, F.try_variant_get(parsed, "$[0]", "variant")).otherwise(parsed)


def field(name: str, path: str, kind: str) -> Column:
    """A field of the answer in column `name`, null where it lacks the field or holds something that doesn't fit the type."""
    return F.try_variant_get(F.col(name), f"$.{path}", kind)
