"""Numeric expressions: moments, correlation, money text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def date_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def sample_skewness(c: Column) -> Column:
    """Bias-adjusted skewness; null for fewer than three values or no spread."""
    n = F.count(c)
    factor = F.try_divide(F.sqrt((n * (n - 1)).cast("double")), (n - 2).cast("double"))
    return F.when((n > 2) & (F.stddev_pop(c) > 0), factor * F.skewness(c))


def sample_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis; null for fewer than four values or no spread."""
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when((n > 3) & (F.stddev_pop(c) > 0), factor * ((n + 1) * F.kurtosis(c) + 6))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both sides are present; null where one side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return share(part, whole) * 100.0


def money_text(amount: Column) -> Column:
    """$1.2M above a million, $3.4K above a thousand, whole dollars below."""
    return (
        F.when(amount > 1_000_000, F.concat(F.lit("$"), F.format_string("%.1f", amount / 1_000_000), F.lit("M")))
        .when(amount > 1_000, F.concat(F.lit("$"), F.format_string("%.1f", amount / 1_000), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_number(amount, 0)))
    )


def denull_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column; done once at load, after which only null means missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
