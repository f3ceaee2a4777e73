"""Column expressions and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The white space that separates words, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores in front until no column has that name (Spark compares without case)."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def require(df: DataFrame, *columns: str) -> None:
    """A readable error for a missing or ambiguous input column."""
    names = [c.lower() for c in df.columns]
    for c in columns:
        if names.count(c.lower()) != 1:
            raise ValueError(f"column {c!r} must appear exactly once in {df.columns}")
