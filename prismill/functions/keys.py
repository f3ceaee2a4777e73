"""Hash expressions: buckets, reproducible order, prompt keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_bucket(text: Column, buckets: int) -> Column:
    """The 128-bit MD5 number modulo `buckets`, folded in four 32-bit pieces so that it fits a bigint."""
    digest = F.md5(text.cast("string").cast("binary"))
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        piece = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * 4294967296 + piece) % buckets
    return rest


def shuffle_key(*keys: Column, seed: int = 42) -> Column:
    """A reproducible random order: the same rows get the same place under any partitioning."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def prompt_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit(":"), F.lower(F.trim(prompt))).cast("binary"), 256)
