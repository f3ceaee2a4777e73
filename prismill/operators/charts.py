"""The data behind charts; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from prismill.functions.keys import shuffle_key
from prismill.functions.numbers import numeric_columns, pearson, percent
from prismill.operators.profiling import is_numeric, per_column
from prismill.operators.quantiles import fit_quantiles, quantiles
from prismill.operators.statistics import least_squares
from prismill.session import durable

TIME_WORDS = ("date", "time", "year", "month", "day")


def chart_choice(df: DataFrame) -> DataFrame:
    """(chart, n_rows): line, bar, barh, histogram or pie for a frame of a first column and its values."""
    first, second = df.columns[0], df.columns[1] if len(df.columns) > 1 else None
    kind = df.schema[first].dataType
    is_time = any(word in first.lower() for word in TIME_WORDS) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
    # Whether there are more than ten first values is all that counts, so that counting stops at eleven.
    many = df.where(F.col(first).isNotNull()).select(first).distinct().limit(11).count() > 10
    digits = F.coalesce(F.min(first).cast("string").rlike("[0-9]"), F.lit(False)) if is_time else F.lit(False)
    n = F.col("n_rows")
    by_size = F.when(n > 20, "histogram").when(n > 5, "bar").otherwise("pie") if second and is_numeric(df, second) else F.lit("bar")
    chart = F.when(F.col("is_time") & (n > 7), "line").when(F.col("is_time"), "bar").when(F.lit(many), "barh").otherwise(by_size)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), digits.alias("is_time")).select(chart.alias("chart"), "n_rows")


def line_points(df: DataFrame, x: str, series: Sequence[str] | None = None) -> DataFrame:
    """(x, series, value) for every numeric column."""
    series = list(series or numeric_columns(df, [x]))
    wide = df.select(x, *[F.col(c).cast("double").alias(c) for c in series])
    return wide.unpivot([x], series, "series", "value")


def bar_values(df: DataFrame, x: str, y: Sequence[str], top: int = 50) -> DataFrame:
    """The bars with the largest first value, long over the series."""
    kept = df.orderBy(F.col(y[0]).desc(), x).limit(top)
    return line_points(kept, x, y)


def pie_slices(df: DataFrame, x: str, y: str, slices: int = 10) -> DataFrame:
    """(slice, value, pct): with more than `slices` rows the smallest ones together as Other.

    The kept rows come from a bounded sort; only the others are summed.
    """
    rows = df.select(F.col(x).cast("string").alias("slice"), F.col(y).cast("double").alias("value"))
    # Kept as they are, since sums of doubles computed anew may order near ties differently.
    top = durable(rows.orderBy(F.col("value").desc(), "slice").limit(slices + 1))
    w = Window.orderBy(F.col("value").desc(), "slice")
    # At most slices + 1 rows reach this window.
    placed = top.withColumn("position", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = placed.where((F.col("n") <= slices) | (F.col("position") < slices)).select("slice", "value")
    rest = rows.agg(F.sum("value").alias("total")).select(F.lit("Other").alias("slice"), (F.col("total") - kept.select(F.sum("value")).scalar()).alias("value"))
    more = rest.where(top.select(F.count(F.lit(1))).scalar() > slices)
    total = rows.select(F.sum("value")).scalar()
    return kept.unionByName(more).select("slice", "value", percent(F.col("value"), total).alias("pct"))


def stacked_areas(df: DataFrame, x: str, series: Sequence[str]) -> DataFrame:
    """(x, series, lower, upper): each series on top of the ones before it."""
    bands, below = [], F.lit(0.0)
    for c in series:
        above = below + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        bands.append(F.struct(F.lit(c).alias("series"), below.alias("lower"), above.alias("upper")))
        below = above
    return df.select(x, F.explode(F.array(*bands)).alias("band")).select(x, "band.*")


def scatter_points(df: DataFrame, x: str, y: str, key: str, points: int | None = None) -> DataFrame:
    """All points, or a reproducible sample of `points`, with the least-squares line over all rows as `fitted`."""
    fit = least_squares(df, x, y).select(F.struct("slope", "intercept").alias("f")).scalar()
    shown = df.select(key, x, y)
    if points is not None:
        shown = shown.orderBy(shuffle_key(F.col(key)), key).limit(points)
    return shown.select(key, x, y, (fit["slope"] * F.col(x) + fit["intercept"]).alias("fitted"))


def heatmap_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, column, r) of the whole correlation matrix, each pair measured once."""
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for row, column in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(row).alias("row"), F.lit(column).alias("column"), F.col(f"r_{i}").alias("r")))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def box_values(df: DataFrame, category: str, y: str, top: int = 50) -> DataFrame:
    """(category, q1, median, q3, lower_whisker, upper_whisker, n_outside) of the categories with the largest sums."""
    kept = df.groupBy(category).agg(F.sum(y).alias("s")).orderBy(F.col("s").desc(), category).limit(top).select(category)
    rows = df.select(category, y).join(kept, category, "left_semi")
    q = F.col("quantiles")
    boxes = quantiles(rows, [y], [0.25, 0.5, 0.75], [category]).select(
        category, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[2] - q[0]).alias("range")
    )
    v = F.col(y)
    inside = v.between(F.col("q1") - 1.5 * F.col("range"), F.col("q3") + 1.5 * F.col("range"))
    return rows.join(boxes, category).groupBy(category, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("lower_whisker"), F.max(F.when(inside, v)).alias("upper_whisker"), F.count_if(~inside).alias("n_outside")
    )


def histogram(df: DataFrame, column: str, density: bool = False, most_bins: int = 50) -> DataFrame:
    """(bin, lower, upper, n or density) with the width of Freedman and Diaconis, from the deviation when the
    quartiles coincide, and ten bins when nothing varies. Empty bins are left out."""
    facts = per_column(
        df, [column], {"n": lambda c: F.count(c), "low": lambda c: F.min(c).cast("double"), "high": lambda c: F.max(c).cast("double"), "std": lambda c: F.stddev_pop(c)}
    ).first()
    n, low, high = facts["n"], facts["low"], facts["high"]
    bins = 10
    if n:
        q1, q3 = fit_quantiles(df, [column], [0.25, 0.75])[column]
        spread = (q3 - q1) or facts["std"]
        if spread:
            width = 2 * spread / n ** (1 / 3)
            bins = max(1, min(most_bins, -int(-(high - low) // width)))
    else:
        low = high = 0.0
    step = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = [(F.lit(low) + F.col("bin") * step).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * step).alias("upper")]
    height = (F.col("n") / (F.lit(float(n or 1)) * step)).alias("density") if density else F.col("n")
    return counts.select("bin", *edges, height)
