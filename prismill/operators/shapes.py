"""Query shapes of business analytics: filters, date ranges, grouped and ranked totals, growth, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.functions.dates import month_text
from prismill.operators.ordered import cumulate
from prismill.session import durable

AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


def metric_query(
    df: DataFrame,
    measure: str | None = None,
    agg: str | None = None,
    dims: Sequence[str] = (),
    filters: Sequence[tuple[str, str, object]] = (),
    fields: Sequence[str] = (),
    order: str | None = None,
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """A declared metric as a frame: aggregate of `measure` by `dims`, or a listing of `fields` when `agg` is None."""
    operations = {
        "=": Column.__eq__,
        "!=": Column.__ne__,
        ">": Column.__gt__,
        ">=": Column.__ge__,
        "<": Column.__lt__,
        "<=": Column.__le__,
    }
    for column, operation, value in filters:
        df = df.where(operations[operation](F.col(column), F.lit(value)))
    if agg:
        value = F.count(F.lit(1)) if measure is None else AGGREGATES[agg](measure)
        name = agg if measure is None else f"{agg}_{measure}"
        df = df.groupBy(*dims).agg(value.alias(name)) if dims else df.agg(value.alias(name))
        order = order or name
    elif fields:
        df = df.select(*fields)
        limit = limit or 10
    if limit is not None and order:
        keys = [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(c) for c in df.columns if c != order]]
        df = df.orderBy(*keys)
    return df if limit is None else df.limit(limit)


def last_months(df: DataFrame, date: str, months: int) -> DataFrame:
    """Rows of the last months counted from the newest date in the data, not from the clock."""
    newest = df.select(F.max(date)).scalar()
    return df.where(F.col(date) >= F.add_months(newest, -months))


def recent_totals(df: DataFrame, dims: Sequence[str], date: str, measure: str, months: int) -> DataFrame:
    """Monthly totals of the last months in the data. The rows are read once: totals per day are kept, and both
    the newest date and the cut come from them."""
    daily = durable(df.groupBy(*dims, date).agg(F.sum(measure).alias("total"), F.count(F.lit(1)).alias("n_rows")))
    recent = last_months(daily, date, months)
    return recent.groupBy(*dims, month_text(F.col(date)).alias("month")).agg(F.sum("total").alias("total"), F.sum("n_rows").alias("n_rows"))


def as_of_range(df: DataFrame, date: str, as_of: str, span: str) -> DataFrame:
    """Rows in a range that ends at `as_of`: last_month, last_3_months, last_year, this_year, month_to_date."""
    end = F.lit(as_of).cast("date")
    start = {
        "last_month": F.add_months(end, -1),
        "last_3_months": F.add_months(end, -3),
        "last_year": F.add_months(end, -12),
        "this_year": F.trunc(end, "year"),
        "month_to_date": F.trunc(end, "month"),
    }[span]
    return df.where(F.col(date).between(start, end) if span == "month_to_date" else F.col(date) >= start)


def totals_by(df: DataFrame, dims: Sequence[str | Column], measure: str) -> DataFrame:
    return df.groupBy(*dims).agg(F.sum(measure).alias("total"), F.count(F.lit(1)).alias("n_rows"))


def totals_by_month(df: DataFrame, date: str, measure: str) -> DataFrame:
    return totals_by(df, [month_text(F.col(date)).alias("month")], measure)


def busy_groups(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more rows than a bound, for a semi join."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select(key)


def totals_of_busy(df: DataFrame, key: str, dims: Sequence[str], measure: str, more_than: int) -> DataFrame:
    """Totals by `dims` over the keys with more rows than a bound, in one pass: the window runs over the few
    (key, dims) totals instead of joining the rows with a second scan of themselves."""
    partial = df.groupBy(key, *dims).agg(F.sum(measure).alias("total"), F.count(F.lit(1)).alias("n_rows"))
    counted = partial.withColumn("__rows", F.sum("n_rows").over(Window.partitionBy(key))).where(F.col("__rows") > more_than)
    return counted.groupBy(*dims).agg(F.sum("total").alias("total"), F.sum("n_rows").alias("n_rows"))


def year_pivot(df: DataFrame, dims: Sequence[str], date: str, measure: str, years: Sequence[int]) -> DataFrame:
    """One column per year by conditional sums: one pass, no pivot shuffle per value."""
    sums = [F.sum(F.when(F.year(date) == y, F.col(measure)).otherwise(0.0)).alias(f"total_{y}") for y in years]
    return df.groupBy(*dims).agg(*sums)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; the total comes from the grouped rows, whose shuffle is shared."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.select(F.sum(F.when(F.col(column).isNotNull(), F.col("n")))).scalar()
    return counted.withColumn("share", F.when(F.col(column).isNotNull(), F.try_divide(F.col("n").cast("double"), total)))


def top_per_group(totals: DataFrame, group: str, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n largest rows of each group. Spark keeps n per group on the map side before it shuffles."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), *ties)
    return totals.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def ranked(totals: DataFrame, group: str, by: str) -> DataFrame:
    """Adds rank, dense_rank and at_or_above (rows of the group with at least this value), largest first, nulls last.

    Each distinct value of a group is counted once and the counts accumulate over slices, so that a group with
    most of the rows is not sorted in one task. The totals are kept, as sums of doubles computed twice need not be equal.
    """
    totals = durable(totals)
    values = totals.groupBy(F.col(group).alias("__group"), F.col(by).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    values = values.withColumn("__last", F.col("__value").isNull()).withColumn("__down", -F.col("__value"))
    placed = cumulate(values, ["__last", "__down"], ["__group"], sums={"at_or_above": F.col("__n")}, index="dense_rank")
    same = totals[group].eqNullSafe(placed["__group"]) & totals[by].eqNullSafe(placed["__value"])
    return totals.join(placed, same).select(
        *totals.columns,
        (F.col("at_or_above") - F.col("__n") + 1).cast("int").alias("rank"),
        F.col("dense_rank").cast("int").alias("dense_rank"),
        "at_or_above",
    )


def at_least_as_large(totals: DataFrame, group: str, by: str, n: int) -> DataFrame:
    """Rows with at most n rows of the same group at or above them: what a correlated count tells, without pairs."""
    return ranked(totals, group, by).where(F.col("at_or_above") <= n).drop("rank", "dense_rank")


def running_total(df: DataFrame, order_by: Sequence[str], measure: str, partition_by: Sequence[str] = ()) -> DataFrame:
    return cumulate(df, order_by, partition_by, sums={"running_total": F.col(measure)})


def yearly_growth(df: DataFrame, group: str, date: str, measure: str) -> DataFrame:
    """Total per group and year with its change against the year before; null where that year has no rows."""
    yearly = df.groupBy(group, F.year(date).alias("year")).agg(F.sum(measure).alias("total"))
    order = Window.partitionBy(group).orderBy("year")
    before = F.when(F.lag("year").over(order) == F.col("year") - 1, F.lag("total").over(order))
    return yearly.select(group, "year", "total", (F.try_divide(F.col("total") - before, before) * 100.0).alias("growth_pct"))


def first_or_last_group(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """The group with the highest and the one with the lowest total; ties go to the smaller name."""
    totals = df.groupBy(dim).agg(F.sum(measure).alias("total"))
    return totals.agg(
        F.min(F.struct((-F.col("total")).alias("t"), dim))[dim].alias("highest"),
        F.min(F.struct(F.col("total").alias("t"), dim))[dim].alias("lowest"),
    )


def identical_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that occur in both frames, over their common columns; nulls equal nulls."""
    common = [c for c in left.columns if c in right.columns]
    return left.select(*common).intersect(right.select(*common))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the frame lacks, from the schema alone."""
    return [c for c in required if c not in df.columns]


def lookup(df: DataFrame, stats: DataFrame, key: str, value: str, default: Column | None = None, name: str | None = None) -> DataFrame:
    """Left join of a fitted statistic; unseen keys get `default`. The planner broadcasts `stats` when its size is known to be small."""
    name = name or value
    right = stats.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    joined = df.join(right, df[key] == right["__key"], "left")
    found = F.col("__value") if default is None else F.coalesce(F.col("__value"), default)
    return joined.select(*df.columns, found.alias(name))
