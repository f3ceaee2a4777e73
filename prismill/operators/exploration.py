"""Exploratory reports: imbalance, leakage, cardinality, time patterns, interactions, distributions, target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prismill.functions.numbers import numeric_columns, pearson, percent, sample_kurtosis, sample_skewness, share, string_columns
from prismill.operators.ordered import cumulate, previous_gap
from prismill.operators.profiling import distinct_counts, fit_bounds, is_numeric, numeric_profile, outlier_report, per_column
from prismill.operators.quantiles import quantiles
from prismill.operators.statistics import correlation_pairs, least_squares, two_sample_distance

# Name parts that tell of knowledge from after the event.
FUTURE_WORDS = ("approved", "result", "outcome", "status", "decision", "final", "completed", "confirmed", "verified")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n, pct) of the non-null target values."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.select("class", "n", percent(F.col("n"), total).alias("pct"))


def class_imbalance(df: DataFrame, target: str, threshold: float = 0.2) -> DataFrame:
    """Smallest and largest class, their ratio, whether the smallest is below the threshold, and how severe that is."""
    counts = class_counts(df, target)
    facts = counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min(F.struct("n", "class"))["class"].alias("minority_class"),
        F.min(F.struct((-F.col("n")).alias("m"), "class"))["class"].alias("majority_class"),
        percent(F.min("n"), F.sum("n")).alias("minority_pct"),
        share(F.max("n"), F.min("n")).alias("imbalance_ratio"),
    )
    pct = F.col("minority_pct")
    severity = F.when(pct < 5, "severe").when(pct < 20, "moderate").otherwise("mild")
    low = pct < threshold * 100
    advice = (
        F.when(low & (pct < 5), F.array(F.lit("smote"), F.lit("class_weights")))
        .when(low & (pct < 20), F.array(F.lit("class_weights"), F.lit("stratified_sampling")))
        .when(low, F.array(F.lit("stratified_folds")))
        .otherwise(F.array().cast("array<string>"))
    )
    return facts.select("*", low.alias("is_imbalanced"), severity.alias("severity"), F.array_join(advice, ",").alias("advice"))


def leakage(df: DataFrame, target: str, threshold: float = 0.95, words: Sequence[str] = FUTURE_WORDS) -> DataFrame:
    """(column_name, kind, correlation, keyword): columns that follow the target too closely or are named after it."""
    spark = df.sparkSession
    named = [(c, next(w for w in words if w in c.lower())) for c in df.columns if c != target and any(w in c.lower() for w in words)]
    by_name = spark.createDataFrame([(c, "future_keyword", None, w) for c, w in named], "column_name string, kind string, correlation double, keyword string")
    numeric = numeric_columns(df, [target])
    if not numeric or not is_numeric(df, target):
        return by_name
    r = per_column(df, numeric, {"correlation": lambda c: pearson(c, F.col(target))})
    close = r.where(F.abs("correlation") >= threshold).select(
        "column_name", F.lit("high_correlation").alias("kind"), "correlation", F.lit(None).cast("string").alias("keyword")
    )
    return close.unionByName(by_name.join(close.select("column_name"), "column_name", "left_anti"))


def high_cardinality(df: DataFrame, threshold: int = 50, exact: bool = True) -> DataFrame:
    """String columns with at least `threshold` values and the encoding they call for."""
    found = distinct_counts(df, string_columns(df), exact).where(F.col("n_distinct") >= threshold)
    rows = df.select(F.count(F.lit(1))).scalar()
    advice = F.when(F.col("n_distinct") > 50, "target_encoding").otherwise("one_hot")
    return found.select("column_name", "n_distinct", percent(F.col("n_distinct"), rows).alias("pct_unique"), advice.alias("encoding"))


def trend(df: DataFrame, date: str, value: str, key: str) -> DataFrame:
    """Least squares of the value on the position in time order, with strength and direction."""
    rows = cumulate(df.select(date, key, value), [date, key], index="__position")
    fit = least_squares(rows.withColumn("__position", F.col("__position") - 1), "__position", value)
    r = F.abs("r")
    return fit.select(
        "n",
        "slope",
        "r_squared",
        "p_value",
        F.when(r > 0.7, "strong").when(r > 0.4, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        (r > 0.4).alias("detected"),
    )


def seasonality(df: DataFrame, date: str, value: str) -> DataFrame:
    """Variation of the mean per calendar month; needs three months, seasonal above 0.2."""
    monthly = df.groupBy(F.month(date).alias("month")).agg(F.avg(value).alias("mean"))
    variation = F.when(F.avg("mean") == 0, 0.0).otherwise(F.try_divide(F.stddev_samp("mean"), F.avg("mean")))
    facts = monthly.agg(F.count("mean").alias("n_months"), variation.alias("variation"))
    return facts.select("n_months", "variation", ((F.col("n_months") >= 3) & (F.col("variation") > 0.2)).alias("detected"))


def drift(df: DataFrame, date: str, value: str, key: str) -> DataFrame:
    """Distance between the first and the second half of the rows in time order, with the change of the mean."""
    rows = cumulate(df.select(date, key, value), [date, key], index="__position")
    n = df.select(F.count(F.lit(1))).scalar()
    halves = rows.withColumn("__first", F.col("__position") <= F.floor(n / 2))
    distance = two_sample_distance(halves, [value], F.col("__first"))
    before, after = F.avg(F.when(F.col("__first"), F.col(value))), F.avg(F.when(~F.col("__first"), F.col(value)))
    means = halves.agg((F.try_divide(after - before, before) * 100).alias("mean_change_pct"), F.lit(value).alias("column_name"))
    enough = (F.col("n_first") > 30) & (F.col("n_second") > 30)
    return distance.join(means, "column_name").select("*", (enough & (F.col("p_value") < 0.05)).alias("detected"))


def interactions(df: DataFrame, target: str, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """Products and ratios of the columns that follow the target best, compared with their better parent.

    One aggregate ranks the columns, a second one measures all derived pairs.
    """
    columns = list(columns or numeric_columns(df, [target]))
    facts = per_column(df, columns, {"r": lambda c: F.abs(pearson(c, F.col(target))), "zeros": lambda c: F.count_if((c == 0) | c.isNull())}).collect()
    strength = {r["column_name"]: r["r"] or 0.0 for r in facts}
    zero_free = {r["column_name"] for r in facts if r["zeros"] == 0}
    best = sorted(columns, key=lambda c: (-strength[c], c))[:10]
    derived: list[tuple[str, str, str, Column]] = []
    for i, a in enumerate(best):
        for b in best[i + 1 :]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            derived.append((a, b, "multiply", x * y))
            if b in zero_free:
                derived.append((a, b, "divide", F.try_divide(x, y)))
    wide = df.agg(*[F.abs(pearson(expr, F.col(target))).alias(f"r_{i}") for i, (*_, expr) in enumerate(derived)])
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_1"),
                F.lit(b).alias("feature_2"),
                F.lit(op).alias("operation"),
                F.lit(max(strength[a], strength[b])).alias("best_single"),
                F.col(f"r_{i}").alias("correlation"),
            )
            for i, (a, b, op, _) in enumerate(derived)
        ]
    )
    found = wide.select(F.explode(cells).alias("cell")).select("cell.*").where("correlation IS NOT NULL")
    better = F.col("correlation") > F.col("best_single") * 1.1
    gain = F.when(better, F.try_divide(F.col("correlation") - F.col("best_single"), F.col("best_single")) * 100)
    ranked = found.select("*", better.alias("promising"), gain.alias("improvement_pct"))
    return ranked.orderBy(F.col("correlation").desc(), "feature_1", "feature_2", "operation").limit(top)


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shape class of each numeric column and the transformation it calls for."""
    columns = list(columns or numeric_columns(df))
    facts = per_column(
        df,
        columns,
        {
            "skew": lambda c: sample_skewness(c.cast("double")),
            "kurtosis": lambda c: sample_kurtosis(c.cast("double")),
            "zero_share": lambda c: share(F.count_if(c == 0), F.count(c)),
        },
    )
    s, k = F.col("skew"), F.col("kurtosis")
    kind = (
        F.when(F.col("zero_share") > 0.3, "zero_inflated")
        .when(F.abs(s) > 1, "highly_skewed")
        .when(F.abs(s) > 0.5, "moderately_skewed")
        .when(F.abs(k) > 3, "heavy_tailed")
        .when(F.abs(s) < 0.5, "normal")
        .otherwise("other")
    )
    advice = (
        F.when((kind == "highly_skewed") & (s > 0), "log").when(kind == "highly_skewed", "sqrt").when(kind == "zero_inflated", "log1p").otherwise("none")
    )
    return facts.select("column_name", "skew", "kurtosis", "zero_share", kind.alias("distribution"), advice.alias("transformation"))


def jarque_bera(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Normality statistic from population moments, with its asymptotic p-value exp(-x/2)."""
    measures = {
        "statistic": lambda c: F.count(c) / 6.0 * (F.pow(F.skewness(c), 2) + F.pow(F.kurtosis(c), 2) / 4.0),
    }
    return per_column(df, columns, measures).select("column_name", "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def category_balance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the most frequent value per string column; balanced below 0.7."""
    columns = list(columns or string_columns(df))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"), share(F.max("n"), F.sum("n")).alias("top_share"))
    return top.select("column_name", "n_distinct", "top_share", (F.col("top_share") < 0.7).alias("is_balanced"))


def continuity(df: DataFrame, date: str) -> DataFrame:
    """First, last, median and widest gap in seconds between distinct times; gaps when the widest exceeds five medians."""
    from prismill.functions.dates import epoch_seconds

    times = df.where(F.col(date).isNotNull()).select(epoch_seconds(F.col(date)).alias("at")).distinct()
    gaps = previous_gap(times, "at").where("gap IS NOT NULL")
    median = quantiles(gaps, ["gap"], [0.5]).select(F.col("quantiles")[0]).scalar()
    span = gaps.agg(F.count(F.lit(1)).alias("n_gaps"), F.max("gap").alias("max_gap"))
    return span.select("n_gaps", median.alias("median_gap"), "max_gap", (F.col("max_gap") > 5 * median).alias("has_gaps"))


def task_type(df: DataFrame, target: str, classes: int = 20) -> str:
    """classification for text or few distinct values, else regression; stops counting after `classes` + 1 values."""
    if not is_numeric(df, target):
        return "classification"
    few = df.where(F.col(target).isNotNull()).select(target).distinct().limit(classes + 1).count()
    return "classification" if few <= classes else "regression"


def target_profile(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """Regression: statistics with the share of outliers. Classification: class counts with balance and advice."""
    task = task or task_type(df, target)
    if task == "regression":
        stats = numeric_profile(df, [target])
        outside = outlier_report(df.where(F.col(target).isNotNull()), fit_bounds(df, [target])).select("column_name", "n_outliers", "pct_outliers")
        advice = F.when(F.col("pct_outliers") > 5, "robust_scaling").otherwise("none")
        return stats.join(outside, "column_name").select("*", advice.alias("advice"))
    counts = class_counts(df, target)
    smallest = counts.select(F.min("pct")).scalar()
    advice = F.when(smallest < 5, "resample").when(smallest < 20, "class_weights").otherwise("none")
    return counts.select("class", "n", "pct", (smallest > 20).alias("is_balanced"), advice.alias("advice"))


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    return correlation_pairs(df, list(columns or numeric_columns(df))).where(F.abs("r") > threshold)
