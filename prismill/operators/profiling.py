"""Read-only reports on a frame. All columns share one aggregate; the wide row becomes one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from prismill.functions.dates import parse_date
from prismill.functions.numbers import (
    date_columns,
    money_text,
    numeric_columns,
    percent,
    sample_skewness,
    share,
    string_columns,
)
from prismill.operators.quantiles import fit_quantiles
from prismill.sources.readers import read_file

# One generated aggregate stays well below the JVM method limits up to about this many expressions.
EXPRESSIONS_PER_JOB = 200

# Name parts that mark a column as the money or volume column of a table.
VALUE_WORDS = (
    "sales", "revenue", "amount", "price", "total", "cost",
    "value", "payment", "income", "profit", "spend", "purchase",
)


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(column_name, measures...) from a single scan; each measure maps a column to an aggregate."""
    width = max(1, EXPRESSIONS_PER_JOB // max(1, len(measures)))
    parts = []
    for start in range(0, len(columns), width):
        chunk = columns[start : start + width]
        wide = df.agg(*[f(F.col(c)).alias(f"{m}_{i}") for i, c in enumerate(chunk) for m, f in measures.items()])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(chunk)])
        parts.append(wide.select(F.explode(cells).alias("cell")).select("cell.*"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage of each column."""
    measures = {"n_missing": lambda c: F.count_if(c.isNull()), "pct_missing": lambda c: percent(F.count_if(c.isNull()), F.count(F.lit(1)))}
    return per_column(df, df.columns, measures)


def missing_summary(df: DataFrame) -> DataFrame:
    """Cells, missing cells, completeness and rows with any missing value, in one row."""
    gaps = [F.col(c).isNull().cast("bigint") for c in df.columns]
    in_row = sum(gaps[1:], gaps[0])
    cells = F.count(F.lit(1)) * len(df.columns)
    missing = F.coalesce(F.sum(in_row), F.lit(0))
    return df.agg(
        cells.alias("total_cells"),
        missing.alias("total_missing"),
        percent(missing, cells).alias("pct_missing"),
        percent(cells - missing, cells).alias("completeness_pct"),
        F.count_if(in_row > 0).alias("rows_with_missing"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(column_name, n_distinct). Exact counts go through one grouped pass over (column, value) instead of
    the row expansion that several COUNT(DISTINCT) in one aggregate cause."""
    if not exact:
        return per_column(df, columns, {"n_distinct": F.approx_count_distinct})
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    pairs = df.select(F.explode(cells).alias("cell")).select("cell.column_name", "cell.value").distinct()
    return pairs.groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def validate_frame(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column with the findings all_missing, mostly_missing (above 50 %) and single_valued."""
    facts = missing_report(df).join(distinct_counts(df, df.columns, exact), "column_name")
    rows = df.select(F.count(F.lit(1))).scalar()
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return facts.select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "n_missing",
        "n_distinct",
        (rows == 0).alias("frame_is_empty"),
        ((rows > 0) & (F.col("n_missing") == rows)).alias("all_missing"),
        F.coalesce(F.col("pct_missing") > 50, F.lit(False)).alias("mostly_missing"),
        (F.col("n_distinct") == 1).alias("single_valued"),
    )


def duplicate_names(df: DataFrame) -> list[str]:
    """Column names that occur more than once; from the schema alone."""
    return sorted({c for c in df.columns if df.columns.count(c) > 1})


def semantic_types(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, semantic_type, n_distinct, n_missing): numerical, categorical_numeric, datetime,
    datetime_string, categorical, text, boolean or unknown."""
    numeric, text, dates = numeric_columns(df), string_columns(df), date_columns(df)
    flags = [c for c, kind in df.dtypes if kind == "boolean"]
    kinds = F.create_map(
        *[
            F.lit(x)
            for c in df.columns
            for x in (c, "number" if c in numeric else "text" if c in text else "datetime" if c in dates else "boolean" if c in flags else "unknown")
        ]
    )
    measures = {"n_missing": lambda c: F.count_if(c.isNull()), "n_rows": lambda c: F.count(F.lit(1))}
    facts = per_column(df, df.columns, measures).join(distinct_counts(df, df.columns, exact), "column_name")
    # Only columns whose smallest and largest value parse can consist of dates; the others skip the costly check of every value.
    ends = [(parse_date(F.min(c)).isNotNull() & parse_date(F.max(c)).isNotNull()).alias(c) for c in text]
    likely = [c for c, fits in df.agg(*ends).first().asDict().items() if fits] if text else []
    if likely:
        parsed = {"all_dates": lambda c: (F.count(c) > 0) & (F.count_if(c.isNotNull() & parse_date(c).isNull()) == 0)}
        facts = facts.join(per_column(df, likely, parsed), "column_name", "left")
    else:
        facts = facts.withColumn("all_dates", F.lit(False))
    kind, spread = kinds[F.col("column_name")], share(F.col("n_distinct"), F.col("n_rows"))
    label = (
        F.when((kind == "number") & (F.col("n_distinct") <= 10) & (spread < 0.05), "categorical_numeric")
        .when(kind == "number", "numerical")
        .when((kind == "text") & F.col("all_dates"), "datetime_string")
        .when((kind == "text") & (spread < 0.05), "categorical")
        .otherwise(kind)
    )
    return facts.select("column_name", label.alias("semantic_type"), "n_distinct", "n_missing")


def schema_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Columns per semantic type with their names and missing cells."""
    return semantic_types(df, exact).groupBy("semantic_type").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("columns"),
        F.sum("n_missing").alias("n_missing"),
    )


def duplicate_report(df: DataFrame, subset: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct rows and extra copies over all or some columns."""
    copies = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return copies.agg(
        rows.alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique"),
        (rows - F.count(F.lit(1))).alias("n_duplicates"),
        percent(rows - F.count(F.lit(1)), rows).alias("pct_duplicates"),
    )


def fit_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 1.5, sample_deviation: bool = True) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column. iqr: quartiles -+ factor * range; zscore: mean -+ factor * deviation;
    percentile: the (1 - factor) and factor quantiles, e.g. factor=0.99."""
    if method == "iqr":
        return {c: (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in fit_quantiles(df, columns, [0.25, 0.75]).items()}
    if method == "percentile":
        return {c: (a, b) for c, (a, b) in fit_quantiles(df, columns, [1 - factor, factor]).items()}
    if method != "zscore":
        raise ValueError(f"unknown outlier method {method!r}")
    spread = F.stddev_samp if sample_deviation else F.stddev_pop
    facts = per_column(df, columns, {"mean": lambda c: F.avg(c), "spread": lambda c: spread(c)}).collect()
    return {r["column_name"]: (r["mean"] - factor * r["spread"], r["mean"] + factor * r["spread"]) for r in facts if r["spread"] is not None}


def outlier_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Bounds and number of values strictly outside, all columns in one scan."""
    limits = {c: F.create_map(*[F.lit(x) for c, b in bounds.items() for x in (c, float(b[i]))]) for i, c in enumerate(("lower", "upper"))}
    wide = df.agg(
        *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"n_{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())],
        F.count(F.lit(1)).alias("rows"),
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n_outliers")) for i, c in enumerate(bounds)])
    return wide.select(F.explode(cells).alias("cell"), "rows").select(
        "cell.column_name",
        limits["lower"][F.col("cell.column_name")].alias("lower"),
        limits["upper"][F.col("cell.column_name")].alias("upper"),
        "cell.n_outliers",
        percent(F.col("cell.n_outliers"), F.col("rows")).alias("pct_outliers"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, skew, extremes and median of each numeric column."""
    columns = list(columns or numeric_columns(df))
    measures = {
        "n_values": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "skew": lambda c: sample_skewness(c.cast("double")),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    medians = fit_quantiles(df, columns, [0.5])
    known = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(medians[c][0] if c in medians else None).cast("double") for c in columns]))
    return per_column(df, columns, measures).withColumn("median", F.element_at(known, F.col("column_name")))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The n most frequent values of each string column with cardinality; ties in value order."""
    columns = list(columns or string_columns(df))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    cardinality = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    top = counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    return top.join(cardinality, "column_name")


def value_column(df: DataFrame) -> str | None:
    """The column a total is shown for: the first numeric one with a telling name, else the one with the largest sum."""
    numeric = numeric_columns(df)
    for c in numeric:
        if any(word in c.lower() for word in VALUE_WORDS):
            return c
    if not numeric:
        return None
    sums = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in numeric]).first()
    return max(numeric, key=lambda c: sums[c] if sums[c] is not None else float("-inf"))


def label_of(column: str) -> Column:
    return F.initcap(F.lit(column.replace("_", " ")))


def _span_text(days: Column) -> Column:
    return (
        F.when(days > 365, F.concat(F.format_string("%.1f", days / 365.0), F.lit(" years")))
        .when(days > 30, F.concat(F.format_string("%.0f", days / 30.0), F.lit(" months")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def kpi_cards(df: DataFrame) -> DataFrame:
    """Cards (card, label, value): rows, total of the value column, widest category, date span or completeness.

    The widest category is chosen by sketch; its shown count is exact.
    """
    value, text, dates = value_column(df), string_columns(df), date_columns(df)
    measures = [F.format_number(F.count(F.lit(1)), 0).alias("total_rows")]
    cards = [("total_rows", F.lit("Total Records"))]
    if value:
        measures.append(money_text(F.sum(F.col(value).cast("double"))).alias("numeric_summary"))
        cards.append(("numeric_summary", F.concat(F.lit("Total "), label_of(value))))
    else:
        measures.append(F.lit(str(len(df.columns))).alias("columns"))
        cards.append(("columns", F.lit("Total Columns")))
    if text:
        sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in text]).first() if len(text) > 1 else None
        widest = max(text, key=lambda c: sizes[c]) if sizes else text[0]
        measures.append(F.format_number(F.count_distinct(widest), 0).alias("diversity"))
        cards.append(("diversity", F.concat(F.lit("Unique "), label_of(widest))))
    else:
        measures.append(F.lit("0").alias("text_fields"))
        cards.append(("text_fields", F.lit("Text Fields")))
    if dates:
        days = F.datediff(F.max(dates[0]).cast("date"), F.min(dates[0]).cast("date"))
        measures.append(_span_text(days).alias("date_range"))
        cards.append(("date_range", F.lit("Date Range")))
    else:
        filled = [F.count(c) for c in df.columns]
        complete = percent(sum(filled[1:], filled[0]), F.count(F.lit(1)) * len(df.columns))
        measures.append(F.concat(F.format_string("%.1f", complete), F.lit("%")).alias("completeness"))
        cards.append(("completeness", F.lit("Data Completeness")))
    cells = F.array(*[F.struct(F.lit(c).alias("card"), label.alias("label"), F.col(c).alias("value")) for c, label in cards])
    return df.agg(*measures).select(F.explode(cells).alias("cell")).select("cell.*")


def metadata_cards(df: DataFrame) -> DataFrame:
    """Cards that need the schema and a row count only."""
    counts = {
        "numeric_columns": len(numeric_columns(df)),
        "text_columns": len(string_columns(df)),
        "date_columns": len(date_columns(df)),
        "total_columns": len(df.columns),
    }
    cells = F.array(
        F.struct(F.lit("total_rows").alias("card"), F.col("n").cast("bigint").alias("value")),
        *[F.struct(F.lit(k).alias("card"), F.lit(v).cast("bigint").alias("value")) for k, v in counts.items()],
    )
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(cells).alias("cell")).select("cell.*")


def characteristics(df: DataFrame) -> DataFrame:
    """(column_name, type_class, sample_value) with the smallest value as the sample."""
    classes = {c: "numeric" for c in numeric_columns(df)} | {c: "categorical" for c in string_columns(df)} | {c: "date" for c in date_columns(df)}
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, classes.get(c, "other"))])
    sampled = per_column(df, df.columns, {"sample_value": lambda c: F.min(c).cast("string")})
    return sampled.select("column_name", kinds[F.col("column_name")].alias("type_class"), "sample_value")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


@dataclass(frozen=True)
class FileProfile:
    rows: DataFrame
    rejects: DataFrame
    findings: DataFrame
    types: DataFrame


def profile_file(spark: SparkSession, path: str, schema: T.StructType | None = None, exact: bool = True) -> FileProfile:
    """Load, validate and classify a file in one call; everything but the schema stays lazy."""
    loaded = read_file(spark, path, schema)
    return FileProfile(loaded.rows, loaded.rejects, validate_frame(loaded.rows, exact), semantic_types(loaded.rows, exact))
