"""Two-sample distance, least squares, rank correlation, independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prismill.functions.distributions import chi_square_p, correlation_p, kolmogorov_p
from prismill.functions.numbers import pearson
from prismill.operators.ordered import cumulate


def counted_values(df: DataFrame, columns: Sequence[str], **counts: Column) -> DataFrame:
    """(column_name, value, counts...) of each distinct number of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select("*", F.explode(cells).alias("__cell")).where("__cell.value IS NOT NULL")
    return long.groupBy(F.col("__cell.column_name").alias("column_name"), F.col("__cell.value").alias("value")).agg(*[c.alias(name) for name, c in counts.items()])


def two_sample_distance(df: DataFrame, columns: Sequence[str], in_first: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of each column between the rows where `in_first` holds and the others.

    Each distinct value is counted once per side; the cumulative shares run over range-partitioned values.
    Returns (column_name, n_first, n_second, distance, p_value).
    """
    sides = df.select(*columns, in_first.alias("__first"))
    return distance_of_counts(counted_values(sides, columns, a=F.count_if("__first"), b=F.count_if(~F.col("__first"))))


def distance_of_counts(counts: DataFrame) -> DataFrame:
    """The same from (column_name, value, a, b): how often each side has each value."""
    running = cumulate(counts, ["value"], ["column_name"], sums={"ca": F.col("a"), "cb": F.col("b")})
    totals = running.groupBy("column_name").agg(F.max("ca").alias("n_first"), F.max("cb").alias("n_second"))
    gap = F.abs(F.try_divide(F.col("ca").cast("double"), F.col("n_first")) - F.try_divide(F.col("cb").cast("double"), F.col("n_second")))
    widest = running.join(totals, "column_name").groupBy("column_name", "n_first", "n_second").agg(F.max(gap).alias("distance"))
    return widest.withColumn("p_value", kolmogorov_p(F.col("distance"), F.col("n_first"), F.col("n_second")))


def least_squares(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, slope, intercept, r, r_squared, p_value) of y on x; nulls where x does not vary."""
    both = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    fitted = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    )
    return fitted.select(
        *by,
        "n",
        "slope",
        (F.col("mean_y") - F.col("slope") * F.col("mean_x")).alias("intercept"),
        "r",
        (F.col("r") * F.col("r")).alias("r_squared"),
        correlation_p(F.col("r"), F.col("n")).alias("p_value"),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, r) for every unordered pair, from one aggregate; rows with a gap in a pair are left out of that pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(cells).alias("cell")).select("cell.*")


def average_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """(value, rank) for every distinct value: the mean of the positions its copies take."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    running = cumulate(counts, ["value"], sums={"upto": F.col("n")})
    return running.select("value", (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two columns over the rows where both are present."""
    both = df.select(a, b).dropna()
    pairs = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ranks_a = average_ranks(both, a, "rank_a").withColumnRenamed("value", a)
    ranks_b = average_ranks(both, b, "rank_b").withColumnRenamed("value", b)
    ranked = pairs.join(ranks_a, a).join(ranks_b, b)
    n, x, y = F.col("n"), F.col("rank_a"), F.col("rank_b")
    sums = ranked.agg(
        F.sum(n).alias("n"),
        F.sum(n * x).alias("x"),
        F.sum(n * y).alias("y"),
        F.sum(n * x * x).alias("xx"),
        F.sum(n * y * y).alias("yy"),
        F.sum(n * x * y).alias("xy"),
    )
    n, x, y = F.col("n").cast("double"), F.col("x"), F.col("y")
    spread = F.sqrt((F.col("xx") - x * x / n) * (F.col("yy") - y * y / n))
    return sums.select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.try_divide(F.col("xy") - x * y / n, spread).alias("rho"))


def independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value of two categorical columns.

    Cells that do not occur add their expected count; their sum is n minus the expected counts of the cells that do.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("column_total"))
    total = cells.select(F.sum("n")).scalar()
    expected = F.col("row_total").cast("double") * F.col("column_total") / total
    joined = cells.join(rows, a).join(columns, b).withColumn("expected", expected)
    summed = joined.agg(
        (F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")) + F.max(total) - F.sum("expected")).alias("statistic"),
        ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("degrees"),
    )
    return summed.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("degrees").cast("double")))
