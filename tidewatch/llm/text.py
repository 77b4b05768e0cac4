"""Column expressions and byte helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only. Pure ASCII strings take the fast lower(); others keep their non-ASCII letters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def hash128(c: Column, seed: int = 0) -> tuple[Column, Column]:
    """Two chained 64-bit hashes of one string."""
    return F.xxhash64(F.lit(seed), c), F.xxhash64(F.lit(-1 - seed), c, F.lit(seed))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and exactly the white space of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
