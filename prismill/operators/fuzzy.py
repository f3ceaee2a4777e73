"""Bringing misspelt categories together.

Distinct values are taken from the most to the least frequent. A value joins the earliest leader whose text
(lower case, trimmed) has a matching-blocks ratio of at least the threshold; without one it becomes a leader.

Only candidates are compared, and none is missed. With M matched of L characters of both texts, a ratio of t
means 2M >= tL. Two neighbouring matching blocks have an unmatched character between them, so there are at
most 1 + L - 2M blocks and the texts share at least M - (1 + L - 2M) >= (1.5t - 1)L - 1 character pairs. A
text therefore meets each partner in the rarest of its pairs, all but as many as must be shared with the
shortest possible partner, and one. Where the bound says nothing (very short texts, low thresholds) single
characters take the place of pairs: M of them are shared.

Leaders are elected in parallel. In each block (the texts with one pair of characters) the first few
undecided texts are looked at; a text that is among them in all its blocks has all its earlier undecided
candidates there, and leads if none of them matches. New leaders then meet the texts of their blocks, and
those that match are decided. A family of near copies, however large, goes with its leader in one round and
is never joined with itself; blocks of many texts are split over tasks.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from prismill.operators.shapes import lookup
from prismill.session import durable

#: Undecided texts of a block that are looked at in the first round; doubled in each round.
HEADS = 64
#: Texts of a block that one task compares with the block's leaders.
PART = 4096


def similar(leader: str, text: str, threshold: float) -> bool:
    """Whether the matching-blocks ratio reaches the threshold; a cheap upper bound comes first."""
    matcher = SequenceMatcher(None, leader, text)
    return matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold


def _blocks(forms: DataFrame, threshold: float) -> DataFrame:
    """(id, size, token, part, parts): the blocks in which a text meets every possible partner."""
    reach = (2 - threshold) / threshold
    size = F.col("size")

    def must_share(length: Column) -> Column:
        return F.ceil((1.5 * threshold - 1) * 2 / (2 - threshold) * length - 1 - 1e-9)

    # The longest text whose pairs may all be missing from a partner; its partners use single characters as well.
    slope = (3 * threshold - 2) / (2 - threshold)
    short = 1 / slope + 1e-6 if slope > 1e-9 else None
    with_pairs = F.lit(False) if short is None else size > short
    with_signs = F.lit(True) if short is None else size <= short * reach
    pairs = forms.where(with_pairs).select("id", "size", (size - must_share(size)).alias("prefix"), F.explode(F.sequence(F.lit(1), size - 1)).alias("at"), "form", F.lit(2).alias("n"))
    need = F.ceil(size * threshold / (2 - threshold) - 1e-9)
    signs = forms.where(with_signs & (size > 0)).select("id", "size", (size - need + 1).alias("prefix"), F.explode(F.sequence(F.lit(1), size)).alias("at"), "form", F.lit(1).alias("n"))
    grams = pairs.unionByName(signs).select("id", "size", "prefix", F.expr("substring(form, at, n)").alias("gram"))
    times = grams.groupBy("id", "size", "prefix", "gram").agg(F.count(F.lit(1)).alias("times"))
    # A repeated pair counts as often as both texts have it: its first, second, ... occurrence are different tokens.
    turns = times.select("id", "size", "prefix", "gram", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("turn"))
    tokens = durable(turns.select("id", "size", "prefix", F.struct("gram", "turn").alias("token")))
    spread = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("id", F.length("token.gram")).orderBy("n", "token")
    rare = tokens.join(spread, "token").withColumn("place", F.row_number().over(order)).where("place <= prefix")
    parts = F.ceil(F.col("n") / PART).cast("int")
    return rare.select("id", "size", "token", F.pmod(F.hash("id"), parts).alias("part"), parts.alias("parts"))


def fit_groups(df: DataFrame, column: str, threshold: float = 0.8, heads: int = HEADS) -> DataFrame:
    """(value, canonical) for every distinct value; nulls have no row. An empty text leads itself.

    A token and two numbers are kept for each character of a distinct text, so texts should be names rather
    than documents; very long ones cost in proportion to their length.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.withColumn("form", F.lower(F.trim("value"))))
    best = counts.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
    # Numbers along the sorted texts keep their order; the checkpoint keeps them.
    forms = durable(best.orderBy("best.rank", "best.value").select(F.monotonically_increasing_id().alias("id"), "form", F.length("form").alias("size"), F.col("best.value").alias("value")))
    blocks = durable(_blocks(forms, threshold))

    @F.pandas_udf(BooleanType())
    def matches(leaders: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([similar(a, b, threshold) for a, b in zip(leaders, texts, strict=True)], dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (lead, id) whose texts are similar."""
        lengths = F.least("lead_size", "size") * 2 >= threshold * (F.col("lead_size") + F.col("size")) - 1e-9
        close = pairs.where((F.col("lead") < F.col("id")) & lengths).select("lead", "id").distinct()
        texts = close.join(forms.select(F.col("id").alias("lead"), F.col("form").alias("lead_form")), "lead").join(forms.select("id", "form"), "id")
        return texts.where(matches("lead_form", "form")).select("lead", "id")

    undecided = forms.join(blocks.groupBy("id").agg(F.count(F.lit(1)).alias("n_blocks")), "id").select("id", "n_blocks")
    undecided = durable(undecided)
    led = None
    while not undecided.isEmpty():
        live = blocks.join(undecided, "id")
        first = live.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("id"))).where(F.col("place") <= heads)
        first = durable(first.select("id", "size", "token", "n_blocks"))
        in_front = first.groupBy("id", "n_blocks").agg(F.count(F.lit(1)).alias("n")).where("n = n_blocks").select("id")
        ahead = first.select(F.col("id").alias("lead"), F.col("size").alias("lead_size"), "token")
        held = verified(first.join(in_front, "id", "left_semi").join(ahead, "token")).select("id")
        leaders = durable(in_front.join(held, "id", "left_anti"))
        # A decided text may still find an earlier leader, so it meets the leaders before its own.
        others = blocks.join(leaders, "id", "left_anti")
        if led is not None:
            others = others.join(led, "id", "left").select("id", "size", "token", "part", F.col("lead").alias("own"))
        else:
            others = others.select("id", "size", "token", "part", F.lit(None).cast("bigint").alias("own"))
        called = blocks.join(leaders, "id", "left_semi").select(F.col("id").alias("lead"), F.col("size").alias("lead_size"), "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        new = verified(others.join(called, ["token", "part"]).where(F.col("own").isNull() | (F.col("lead") < F.col("own"))))
        new = new.unionByName(leaders.select(F.col("id").alias("lead"), "id"))
        led = durable((new if led is None else new.unionByName(led)).groupBy("id").agg(F.min("lead").alias("lead")))
        undecided = durable(undecided.join(led, "id", "left_anti"))
        heads *= 2
    if led is None:
        return counts.select("value", F.col("value").alias("canonical"))
    # A text without a block (an empty one) leads itself.
    names = forms.join(led, "id", "left").select("form", F.coalesce("lead", "id").alias("lead"))
    canonical = names.join(forms.select(F.col("id").alias("lead"), F.col("value").alias("canonical")), "lead")
    return counts.join(canonical, "form").select("value", "canonical")


def standardize(df: DataFrame, column: str, threshold: float = 0.8, heads: int = HEADS) -> DataFrame:
    """The column with every value replaced by the most frequent member of its group."""
    changed = fit_groups(df, column, threshold, heads).where("value <> canonical").withColumnRenamed("value", column)
    found = lookup(df, changed, column, "canonical", F.col(column))
    return found.select(*[F.col("canonical").alias(c) if c == column else F.col(c) for c in df.columns])
