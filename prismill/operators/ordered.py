"""Totals, positions and carried values over a global order, without a one-task window.

A window without PARTITION BY, or with one hot key, sorts everything in one task. Here each row finds its slice of the global
order (group, order) by a binary search among splitters, so that also a single huge group spreads over many tasks. What a
slice needs to know of those before it is one row per (group, slice), which enters the slice's window as its first row.
Nothing is written and no job runs before the result is asked for: splitters come from a scalar subquery, and the totals read
the order columns and the summed columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType, VariantType

SLICE, FLAG, TIE = "__slice", "__flag", "__tie"
# Distinct places that the splitters are taken from (expected, drawn by hash), and most slices.
SAMPLED, MOST_SLICES = 4096, 1024


def sliced(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """`df` with the slice of each row in `__slice`: slices ascend along (partition_by, order_by) and hold similar numbers of rows.

    `slices` is rounded up to a power of two; by default the session's shuffle partitions decide. `order_by` should end in a
    unique key: only then can a value that holds a third of all rows be split. `df` must give the same rows each time it is
    read, as the splitters, the totals and the rows are read apart.
    """
    wanted = min(MOST_SLICES, slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = max(0, (wanted - 1).bit_length())
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate((*partition_by, *order_by))])
    if not steps:
        return df.withColumn(SLICE, F.lit(0))
    rows = df.select(F.count(F.lit(1))).scalar()
    drawn = F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < F.floor(F.lit(float(SAMPLED << 30)) / F.greatest(rows, F.lit(1)))
    ranked = df.select(place.alias("p")).where(drawn).distinct().agg(F.array_sort(F.collect_list("p")).alias("s"))
    starts = F.transform(F.sequence(F.lit(0), F.lit((1 << steps) - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / (1 << steps)).cast("int")))
    splitters = ranked.select(starts.alias("s")).scalar()
    found = df.withColumns({"__splitters": splitters, "__place": place, SLICE: F.lit(0)})
    # Widths of the search, halved each time: the slice is the last one that starts at or before the row. A column per step is compiled, a lambda is not.
    for width in (1 << i for i in reversed(range(steps))):
        at = F.col(SLICE) + width
        found = found.withColumn(SLICE, F.when(F.get("__splitters", at) <= F.col("__place"), at).otherwise(F.col(SLICE)))
    return found.drop("__splitters", "__place")


def _with_first_rows(rows: DataFrame, first: DataFrame, flag: int) -> DataFrame:
    """Rows and the one row per slice that speaks for the slices before (or behind) it, told apart by `__flag`."""
    return rows.withColumn(FLAG, F.lit(1)).unionByName(first.withColumn(FLAG, F.lit(flag)), allowMissingColumns=True)


def cumulate(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    index: str | None = None,
    slices: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add a 1-based position `index`, inclusive running totals `sums`, and the whole group's `totals` (name: which sum).

    >>> cumulate(df, ["day", "id"], ["region"], sums={"so_far": F.col("amount")}, index="position")
    """
    sums = dict(sums or {})
    if index:
        sums[index] = F.lit(1).cast("bigint")
    inputs = {name: f"__in_{i}" for i, name in enumerate(sums)}
    rows = sliced(df.select("*", *[expr.alias(inputs[name]) for name, expr in sums.items()]), order_by, partition_by, slices)
    before = Window.partitionBy(*partition_by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    summed = rows.groupBy(SLICE, *partition_by).agg(*[F.sum(c).alias(c) for c in inputs.values()])
    wide = {c: summed.schema[c].dataType for c in inputs.values()}
    whole = {name: F.sum(inputs[of]).over(Window.partitionBy(*partition_by)).alias(f"__all_{inputs[of]}_{name}") for name, of in (totals or {}).items()}
    first = summed.select(SLICE, *partition_by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(wide[c]).alias(c) for c in inputs.values()], *whole.values())
    # Sums are wider than what is summed: both sides of the union take the sum's type.
    rows = rows.withColumns({c: F.col(c).cast(wide[c]) for c in inputs.values() if kinds[c] != wide[c]})
    inside = Window.partitionBy(SLICE, *partition_by).orderBy(FLAG, *order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in inputs.items()}
    running |= {name: F.first(f"__all_{inputs[of]}_{name}").over(inside) for name, of in (totals or {}).items()}
    both = _with_first_rows(rows, first, 0).select(*df.columns, FLAG, *[value.alias(f"__out_{i}") for i, value in enumerate(running.values())])
    return both.where(F.col(FLAG) == 1).select(*df.columns, *[F.col(f"__out_{i}").alias(name) for i, name in enumerate(running)])


def carry(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    forward: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Replace nulls in `columns` by the nearest earlier (or later) value in the given order."""
    held = {c: f"__held_{i}" for i, c in enumerate(columns)}
    rows = sliced(df.withColumns({h: F.col(c) for c, h in held.items()}), order_by, partition_by, slices)
    nearest = F.max_by if forward else F.min_by
    edges = rows.groupBy(SLICE, *partition_by).agg(*[nearest(F.col(h), F.when(F.col(h).isNotNull(), F.struct(*order_by))).alias(h) for h in held.values()])
    if forward:
        outside, pick, flag = Window.partitionBy(*partition_by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1), F.last, 0
        inside = Window.partitionBy(SLICE, *partition_by).orderBy(FLAG, *order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        outside, pick, flag = Window.partitionBy(*partition_by).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing), F.first, 2
        inside = Window.partitionBy(SLICE, *partition_by).orderBy(FLAG, *order_by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = edges.select(SLICE, *partition_by, *[pick(h, ignorenulls=True).over(outside).alias(h) for h in held.values()])
    both = _with_first_rows(rows, first, flag)
    filled = both.select(*[c for c in df.columns], FLAG, *[pick(h, ignorenulls=True).over(inside).alias(f"{h}_filled") for h in held.values()])
    return filled.where(F.col(FLAG) == 1).select(*[F.col(f"{held[c]}_filled").alias(c) if c in held else F.col(c) for c in df.columns])


def ntile(df: DataFrame, order_by: Sequence[str], buckets: int, name: str = "bucket") -> DataFrame:
    """SQL NTILE over the whole frame: the first `rows % buckets` buckets hold one row more."""
    numbered = cumulate(df, order_by, index="__position")
    rows = df.select(F.count(F.lit(1))).scalar()
    return numbered.withColumn(name, bucket_at(F.col("__position"), rows, buckets)).drop("__position")


def bucket_at(position: Column, rows: Column, buckets: int) -> Column:
    """The NTILE bucket of a 1-based position among `rows` rows."""
    base = F.floor(rows / F.lit(buckets)).cast("bigint")
    extra = rows % F.lit(buckets)
    before = position - 1
    long_part = extra * (base + 1)
    bucket = F.when(before < long_part, F.floor(before / (base + 1)) + 1).otherwise(
        extra + F.floor((before - long_part) / F.greatest(base, F.lit(1))) + 1
    )
    return bucket.cast("int")


def previous_gap(df: DataFrame, order_by: str, partition_by: Sequence[str] = (), name: str = "gap") -> DataFrame:
    """Distance to the previous row along one numeric order column; null in the first row.

    A slice begins with the last value of those before it. Rows of equal value are told apart by a hash of the whole row, so
    a hot value spreads over slices; which of its rows comes first doesn't change a gap.
    """
    hashed = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    rows = sliced(df.withColumn(TIE, F.xxhash64(*hashed)).withColumn("__value", F.col(order_by)), [order_by, TIE], partition_by)
    outside = Window.partitionBy(*partition_by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(SLICE, *partition_by).agg(F.max("__value").alias("__value")).select(SLICE, *partition_by, F.max("__value").over(outside).alias("__value"))
    inside = Window.partitionBy(SLICE, *partition_by).orderBy(FLAG, "__value")
    gaps = _with_first_rows(rows, first, 0).select(*df.columns, FLAG, (F.col("__value") - F.lag("__value").over(inside)).alias("__gap"))
    return gaps.where(F.col(FLAG) == 1).select(*df.columns, F.col("__gap").alias(name))
