"""Cleaning: imputation, duplicates, outliers, types, rules, text, dates, column drops.

A `fit_*` call reads the data once and returns a small object of plain values; its `transform` is a lazy
projection or filter that also works on other frames and on streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from prismill.functions.dates import DATE_LAYOUTS, parse_date
from prismill.functions.numbers import numeric_columns, share, string_columns
from prismill.operators.ordered import carry
from prismill.operators.profiling import fit_bounds, missing_report, outlier_report, per_column
from prismill.operators.quantiles import fit_quantiles

# Mis-decoded two-byte sequences and the letters they stand for.
MOJIBAKE = {
    "Ã©": "é", "Ã¨": "è", "Ã ": "à", "Ã¢": "â",
    "Ã´": "ô", "Ã»": "û", "Ã§": "ç", "Ã«": "ë",
}

# Every character that Unicode counts as white space, which `\s` alone does not cover.
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# --- imputation -------------------------------------------------------------------------------------------


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column, ties to the smallest. Values are counted in a grouped pass."""
    if not columns:
        return {}
    numeric = set(numeric_columns(df))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
                F.col(c).cast("string").alias("text"),
            )
            for c in columns
        ]
    )
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("text IS NOT NULL").groupBy("column_name", "number", "text").agg((-F.count(F.lit(1))).alias("rank"))
    best = counts.groupBy("column_name").agg(F.min(F.struct("rank", "number", "text")).alias("best")).collect()
    return {r["column_name"]: r["best"]["number"] if r["column_name"] in numeric else r["best"]["text"] for r in best}


@dataclass(frozen=True)
class Imputer:
    strategies: dict[str, str]
    values: dict[str, object]
    order_by: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        drop = [c for c, s in self.strategies.items() if s == "drop"]
        if drop:
            df = df.dropna("any", subset=drop)
        types = {f.name: f.dataType for f in df.schema.fields}
        df = df.select(
            *[F.coalesce(F.col(c), F.lit(self.values[c]).cast(types[c])).alias(c) if self.values.get(c) is not None else F.col(c) for c in df.columns]
        )
        for strategy, forward in (("forward_fill", True), ("backward_fill", False)):
            moved = [c for c, s in self.strategies.items() if s == strategy]
            if moved:
                df = carry(df, moved, self.order_by, forward=forward)
        return df

    def report(self, df: DataFrame) -> DataFrame:
        """(column_name, strategy, fill_value, n_filled) against the frame before imputation."""
        named = F.create_map(*[F.lit(x) for c, s in self.strategies.items() for x in (c, s)])
        filled = F.create_map(*[F.lit(x) for c in self.strategies for x in (c, None if self.values.get(c) is None else str(self.values[c]))])
        return missing_report(df.select(*self.strategies)).where("n_missing > 0").select(
            "column_name",
            named[F.col("column_name")].alias("strategy"),
            filled[F.col("column_name")].alias("fill_value"),
            F.col("n_missing").alias("n_filled"),
        )


def fit_imputer(
    df: DataFrame,
    strategies: dict[str, str] | None = None,
    numeric: str = "median",
    other: str = "mode",
    constant: str = "MISSING",
    order_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> Imputer:
    """mean, median, mode, zero, constant, forward_fill, backward_fill or drop per column; anything else is `auto`."""
    known = {"mean", "median", "mode", "zero", "constant", "forward_fill", "backward_fill", "drop"}
    numbers = set(numeric_columns(df))
    chosen = {}
    for c in columns or df.columns:
        wanted = (strategies or {}).get(c, "auto")
        default = numeric if c in numbers else other
        chosen[c] = wanted if wanted in known else default
        if c not in numbers and chosen[c] in ("mean", "median", "zero"):
            chosen[c] = "mode"
    if any(s.endswith("_fill") for s in chosen.values()) and not order_by:
        raise ValueError("forward_fill and backward_fill need order_by")
    values: dict[str, object] = {}
    means = [c for c, s in chosen.items() if s == "mean"]
    if means:
        values |= df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    medians = [c for c, s in chosen.items() if s == "median"]
    if medians:
        values |= {c: q[0] for c, q in fit_quantiles(df, medians, [0.5]).items()}
    values |= fit_modes(df, [c for c, s in chosen.items() if s == "mode"])
    values |= {c: 0 if s == "zero" else constant for c, s in chosen.items() if s in ("zero", "constant")}
    return Imputer(chosen, values, tuple(order_by))


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


# --- duplicates -------------------------------------------------------------------------------------------


def remove_duplicates(df: DataFrame, subset: Sequence[str] = (), keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key (`first` or `last` in the given order), or only keys without copies (`none`).

    The kept row is an aggregate of row structs, so copies are reduced before the shuffle and a key with a
    third of all rows costs no task more than others.
    """
    keys = list(subset or df.columns)
    rest = [c for c in df.columns if c not in keys]
    if keep in ("first", "last") and not rest:
        return df.dropDuplicates(keys)
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)], F.lit(0).alias("end"))
    pick = F.max(packed) if keep == "last" else F.min(packed)
    grouped = df.groupBy(*keys).agg(pick.alias("__row"), F.count(F.lit(1)).alias("__n"))
    if keep == "none":
        grouped = grouped.where("__n = 1")
    return grouped.select(*[F.col(f"__row.r{rest.index(c)}").alias(c) if c in rest else F.col(c) for c in df.columns])


# --- outliers ---------------------------------------------------------------------------------------------


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their bounds become the bound; nulls stay."""

    def limited(c: str) -> Column:
        lo, hi = bounds[c]
        return F.when(F.col(c) < lo, F.lit(lo)).when(F.col(c) > hi, F.lit(hi)).otherwise(F.col(c)).alias(c)

    return df.select(*[limited(c) if c in bounds else F.col(c) for c in df.columns])


def remove_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with every value inside its bounds or null, by one filter."""
    keep = F.lit(True)
    for c, (lo, hi) in bounds.items():
        keep = keep & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.where(keep)


def remove_outliers_in_turn(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Column after column with bounds refitted on the rows that are left; one job per column."""
    for c in columns:
        df = remove_outliers(df, fit_bounds(df, [c], method, factor))
    return df


# --- types ------------------------------------------------------------------------------------------------


def fit_date_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    """String columns of which more than the threshold of the non-null values parse as dates."""
    text = string_columns(df)
    if not text:
        return []
    parsed = per_column(df, text, {"parsed": lambda c: share(F.count(parse_date(c)), F.count(c))})
    return [r["column_name"] for r in parsed.where(F.col("parsed") > threshold).collect()]


def convert_types(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """int, float, str, category, datetime or bool per column; text that does not fit becomes null.

    The second result lists columns that the frame lacks.
    """
    casts = {
        "int": lambda c: c.try_cast("bigint"),
        "float": lambda c: c.try_cast("double"),
        "str": lambda c: c.cast("string"),
        "category": lambda c: c.cast("string"),
        "datetime": lambda c: F.try_to_timestamp(c.cast("string")),
        "bool": lambda c: c.try_cast("boolean"),
    }
    unknown = set(types.values()) - set(casts)
    if unknown:
        raise ValueError(f"unknown types {sorted(unknown)}")
    absent = [c for c in types if c not in df.columns]
    return df.select(*[casts[types[c]](F.col(c)).alias(c) if c in types else F.col(c) for c in df.columns]), absent


def chart_frame(df: DataFrame) -> DataFrame:
    """Types for plotting: a first column named after a date becomes a date, text that is numeric anywhere
    becomes double, and rows with a missing number are left out. Needs two columns or more."""
    if len(df.columns) < 2:
        raise ValueError("a chart needs two columns or more")
    first = df.columns[0]
    is_date = any(word in first.lower() for word in ("date", "time", "year", "month", "day"))
    text = [c for c in string_columns(df) if c != first or not is_date]
    numeric_text = []
    if text:
        hits = per_column(df, text, {"hits": lambda c: F.count(c.try_cast("double"))}).collect()
        numeric_text = [r["column_name"] for r in hits if r["hits"] > 0]
    typed = df.select(
        *[
            parse_date(F.col(c)).alias(c)
            if c == first and is_date and isinstance(df.schema[c].dataType, T.StringType)
            else F.col(c).try_cast("double").alias(c)
            if c in numeric_text
            else F.col(c)
            for c in df.columns
        ]
    )
    return typed.dropna("any", subset=numeric_columns(typed) or None)


# --- rules ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    column: str
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple = ()

    def broken(self) -> Column:
        """True for a value that breaks the rule; a null breaks only a list of allowed values."""
        c = F.col(self.column)
        if self.allowed:
            return ~F.coalesce(c.isin(*self.allowed), F.lit(False))
        found = F.lit(False)
        if self.minimum is not None:
            found = found | (c < self.minimum)
        if self.maximum is not None:
            found = found | (c > self.maximum)
        return F.coalesce(found, F.lit(False))


def rules_by_name(df: DataFrame, substring_age: bool = False) -> list[Rule]:
    """Rules from column names, the first that fits: age 0..120, price/amount/cost/salary from 0, percent/pct/rate 0..100.

    The age rule looks at the last word of the name only, so that `account_age_days` or `percentage` are left alone.
    """
    rules = []
    for c in numeric_columns(df):
        name = c.lower()
        if ("age" in name) if substring_age else name.split("_")[-1] == "age":
            rules.append(Rule(c, 0, 120))
        elif any(word in name for word in ("price", "amount", "cost", "salary")):
            rules.append(Rule(c, 0))
        elif any(word in name for word in ("percent", "pct", "rate")):
            rules.append(Rule(c, 0, 100))
    return rules


def invalid_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Offending rows per rule, and as `(any)` the rows that break at least one."""
    broken = [r.broken() for r in rules]
    any_broken = F.lit(False)
    for b in broken:
        any_broken = any_broken | b
    wide = df.agg(*[F.count_if(b).alias(f"n_{i}") for i, b in enumerate(broken)], F.count_if(any_broken).alias("n_any"))
    cells = [F.struct(F.lit(r.column).alias("column_name"), F.col(f"n_{i}").alias("n_invalid")) for i, r in enumerate(rules)]
    cells.append(F.struct(F.lit("(any)").alias("column_name"), F.col("n_any").alias("n_invalid")))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def remove_invalid(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    keep = F.lit(True)
    for r in rules:
        keep = keep & ~r.broken()
    return df.where(keep)


# --- text and dates ---------------------------------------------------------------------------------------


def clean_text(c: Column) -> Column:
    """Trimmed, without tags, mis-decoded letters repaired, runs of white space to one blank. Null stays null.

    Character lists are trimmed and translated, which costs a fraction of the same sets in a regular expression;
    the rarer repairs run only on texts that hold their first character.
    """
    c = F.btrim(c, F.lit(WHITE_CHARACTERS))
    c = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^\n]*?>", "")).otherwise(c)
    repaired = c
    for wrong, right in MOJIBAKE.items():
        repaired = F.replace(repaired, F.lit(wrong), F.lit(right))
    c = F.when(F.contains(c, F.lit("Ã")), repaired).otherwise(c)
    return F.regexp_replace(F.translate(c, WHITE_CHARACTERS, " " * len(WHITE_CHARACTERS)), " {2,}", " ")


def fit_text_columns(df: DataFrame, minimum_mean_length: int = 10) -> list[str]:
    text = string_columns(df)
    if not text:
        return []
    lengths = per_column(df, text, {"mean_length": lambda c: F.avg(F.length(c))}).collect()
    return [r["column_name"] for r in lengths if r["mean_length"] is not None and r["mean_length"] >= minimum_mean_length]


def clean_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[clean_text(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def standardize_dates(df: DataFrame, columns: Sequence[str], layouts: Sequence[str] = DATE_LAYOUTS, output: str = "yyyy-MM-dd") -> DataFrame:
    """Text dates in one layout; text that fits none of the layouts becomes null."""
    return df.select(*[F.date_format(parse_date(F.col(c), layouts), output).alias(c) if c in columns else F.col(c) for c in df.columns])


def date_report(df: DataFrame, columns: Sequence[str], layouts: Sequence[str] = DATE_LAYOUTS) -> DataFrame:
    measures = {"n_values": lambda c: F.count(c), "n_invalid": lambda c: F.count_if(c.isNotNull() & parse_date(c, layouts).isNull())}
    return per_column(df, columns, measures)


# --- columns ----------------------------------------------------------------------------------------------


def high_null_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    found = missing_report(df).where(F.col("pct_missing") >= threshold * 100).collect()
    return [r["column_name"] for r in found]


def dominance_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, dominant_value, n_dominant, dominant_share) of the non-null values; all-null columns are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns or df.columns])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("top"), F.sum("n").alias("total"))
    return top.select(
        "column_name",
        F.col("top.value").alias("dominant_value"),
        (-F.col("top.m")).alias("n_dominant"),
        share(-F.col("top.m"), F.col("total")).alias("dominant_share"),
    )


def low_variance_columns(df: DataFrame, threshold: float = 0.95) -> list[str]:
    return [r["column_name"] for r in dominance_report(df).where(F.col("dominant_share") >= threshold).collect()]


# --- compositions -----------------------------------------------------------------------------------------


@dataclass
class Audit:
    """What was done to a frame, step by step, as a queryable table."""

    steps: list[Row] = field(default_factory=list)

    def add(self, step: str, action: str, column: str | None = None, affected: int | None = None) -> None:
        self.steps.append(Row(step=len(self.steps) + 1, name=step, action=action, column_name=column, affected=affected))

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "step int, name string, action string, column_name string, affected bigint"
        return spark.createDataFrame([tuple(s) for s in self.steps], schema)


def clean(
    df: DataFrame,
    strategies: dict[str, str] | None = None,
    subset: Sequence[str] = (),
    order_by: Sequence[str] = (),
    outliers: str | None = None,
    rules: Sequence[Rule] | None = (),
    null_threshold: float | None = None,
    dominance_threshold: float | None = None,
    protect: Sequence[str] = (),
    count: bool = False,
) -> tuple[DataFrame, Audit]:
    """Impute, de-duplicate, then as asked: handle outliers (clip or remove), drop invalid rows, mostly empty and
    nearly constant columns. `rules=None` derives rules from names. Fits run as they are needed; the frame stays lazy.
    With `count` the audit also tells how many cells or rows each step touched, at the price of a pass per step."""
    audit = Audit()
    imputer = fit_imputer(df, strategies, order_by=order_by)
    gaps = {r["column_name"]: r["n_missing"] for r in missing_report(df).collect()} if count else {}
    df = imputer.transform(df)
    for c, s in imputer.strategies.items():
        audit.add("impute", s, c, gaps.get(c))

    def removed(before: DataFrame, after: DataFrame) -> int | None:
        return before.count() - after.count() if count else None

    once = remove_duplicates(df, subset, "first", order_by)
    audit.add("duplicates", "keep_first", affected=removed(df, once))
    df = once
    if outliers:
        bounds = fit_bounds(df, [c for c in numeric_columns(df) if c not in protect])
        found = {r["column_name"]: r["n_outliers"] for r in outlier_report(df, bounds).collect()} if count and bounds else {}
        df = clip(df, bounds) if outliers in ("clip", "cap") else remove_outliers(df, bounds)
        for c in bounds:
            audit.add("outliers", outliers, c, found.get(c))
    rules = rules_by_name(df) if rules is None else rules
    if rules:
        broken = {r["column_name"]: r["n_invalid"] for r in invalid_report(df, rules).collect()} if count else {}
        df = remove_invalid(df, rules)
        for r in rules:
            audit.add("invalid", "remove", r.column, broken.get(r.column))
    for step, threshold, find in (("high_null", null_threshold, high_null_columns), ("low_variance", dominance_threshold, low_variance_columns)):
        if threshold is not None:
            gone = [c for c in find(df, threshold) if c not in protect]
            df = df.drop(*gone)
            for c in gone:
                audit.add(step, "drop_column", c)
    return df, audit
