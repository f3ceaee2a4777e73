"""Feature engineering: encodings, bins, products, ratios, dates, group statistics, text weights.

Fits belong on the training rows; the fitted object then applies to any frame with the same columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from prismill.functions.dates import epoch_seconds
from prismill.functions.keys import md5_bucket
from prismill.functions.numbers import numeric_columns, pearson, share, string_columns
from prismill.operators.ordered import cumulate
from prismill.operators.profiling import distinct_counts, per_column
from prismill.operators.quantiles import fit_quantiles
from prismill.operators.shapes import lookup
from prismill.session import durable

# Most columns that one column becomes.
MOST_FLAGS = 1000
# A word: two letters, digits or underscores or more, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


# --- encodings --------------------------------------------------------------------------------------------


def encoding_method(cardinality: int, has_target: bool) -> str:
    if cardinality < 10:
        return "one_hot"
    if cardinality <= 50:
        return "target" if has_target else "frequency"
    return "hash" if cardinality <= 1000 else "frequency"


@dataclass(frozen=True)
class Encoder:
    """How one column is encoded. `stats` is a frame (value, code) for target, frequency and label codes and for vectors."""

    column: str
    method: str
    cardinality: int = 0
    categories: tuple[str, ...] = ()
    stats: DataFrame | None = None
    default: float | None = None
    buckets: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.column
        kept = [x for x in df.columns if x != c]
        if self.method == "one_hot":
            flags = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in self.categories[1:]]
            return df.select(*kept, *flags)
        if self.method == "hash":
            text = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
            return df.select(*kept, md5_bucket(text, self.buckets).alias(f"{c}_hash"))
        if self.method == "one_hot_vector":
            return self._vectors(df, kept)
        name = {"target": f"{c}_target_enc", "label": f"{c}_label"}.get(self.method, f"{c}_freq")
        default = None if self.default is None else F.lit(self.default)
        return lookup(df, self.stats.withColumnRenamed("value", c), c, "code", default, name).select(*kept, name)


    def _vectors(self, df: DataFrame, kept: list[str]) -> DataFrame:
        name, index = f"{self.column}_vec", f"__{self.column}_index"
        found = lookup(df, self.stats.withColumnRenamed("value", self.column), self.column, "code", F.lit(1), index)
        # The encoder leaves out the last slot: there go the first category, nulls and values that were not seen.
        slot = F.when(F.col(index) > 1, F.col(index) - 2).otherwise(F.lit(self.cardinality - 1)).cast("double")
        sized = found.select(*kept, slot.alias(index)).withMetadata(index, {"ml_attr": {"type": "nominal", "num_vals": max(2, self.cardinality)}})
        return OneHotEncoder(inputCols=[index], outputCols=[name]).fit(sized).transform(sized).select(*kept, name)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of a column, numbered from 1 in their order, as a stored table of any size."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return durable(cumulate(values, ["value"], index="code").select("value", F.col("code").cast("int").alias("code")))


def fit_encoder(df: DataFrame, column: str, method: str, target: str | None = None, cardinality: int | None = None) -> Encoder:
    """Learn an encoding: one_hot (a column each, at most MOST_FLAGS values), one_hot_vector (one sparse vector, any number of
    values), label (numbers from 1 in the order of the values), target, frequency or hash. Null has no label and no flag.
    """
    present = df.where(F.col(column).isNotNull())
    if method == "one_hot":
        categories = tuple(sorted(r[0] for r in present.select(column).distinct().limit(MOST_FLAGS + 1).collect()))
        if len(categories) > MOST_FLAGS:
            raise ValueError(f"{column} has more than {MOST_FLAGS} values; use one_hot_vector")
        return Encoder(column, method, len(categories), categories)
    if method in ("label", "one_hot_vector"):
        stats = dictionary(df, column)
        return Encoder(column, method, stats.count(), stats=stats)
    if method == "target":
        stats = present.groupBy(F.col(column).alias("value")).agg(F.avg(target).alias("code"))
        return Encoder(column, method, cardinality or 0, stats=stats, default=stats.agg(F.avg("code")).first()[0])
    if method == "frequency":
        stats = present.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        total = stats.select(F.sum("n")).scalar()
        # A null keeps a null code, except where the column has so many values that rare ones count as zero.
        default = 0.0 if cardinality is not None and cardinality > 1000 else None
        return Encoder(column, method, cardinality or 0, stats=stats.select("value", share(F.col("n"), total).alias("code")), default=default)
    if method == "hash":
        if cardinality is None:
            cardinality = present.select(F.count_distinct(column)).first()[0]
        return Encoder(column, method, cardinality, buckets=max(1, min(100, cardinality // 10)))
    raise ValueError(f"unknown encoding {method!r}")


def fit_encoders(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> list[Encoder]:
    """One encoder per string column, the method chosen by the number of distinct values."""
    columns = list(columns or string_columns(df, [target] if target else []))
    if not columns:
        return []
    sizes = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, columns).collect()}
    return [fit_encoder(df, c, encoding_method(sizes[c], target is not None), target, sizes[c]) for c in columns]


def encode(df: DataFrame, encoders: Sequence[Encoder]) -> DataFrame:
    for e in encoders:
        df = e.transform(df)
    return df


# --- numbers ----------------------------------------------------------------------------------------------


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, max_inputs: int = 10) -> DataFrame:
    """Products of two and more of the columns up to the degree, named poly_a, poly_a_b, ... (with repetition).

    Outside of 2 to `max_inputs` columns it raises: the number of products grows with the power of the degree.
    """
    if not 2 <= len(columns) <= max_inputs:
        raise ValueError(f"{len(columns)} columns; polynomial features need 2 to {max_inputs}")
    products = []
    for d in range(2, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, d):
            value = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                value = value * F.col(c)
            products.append(value.alias("poly_" + "_".join(combo)))
    return df.select("*", *products)


@dataclass(frozen=True)
class Bins:
    column: str
    edges: tuple[float, ...]
    width: float | None = None

    def label(self) -> Column:
        """0-based bin, right-closed, the first one closed on both sides; outside the edges null."""
        c, lo, hi = F.col(self.column), self.edges[0], self.edges[-1]
        if self.width is not None:
            raw = F.when(F.lit(self.width == 0.0), F.lit(0)).otherwise(F.ceil((c - lo) / F.lit(self.width or 1.0)) - 1)
            inside = F.least(F.greatest(raw, F.lit(0)), F.lit(len(self.edges) - 2))
        else:
            inside = F.lit(None).cast("int")
            for i in reversed(range(len(self.edges) - 1)):
                inside = F.when(c <= self.edges[i + 1], i).otherwise(inside)
        return F.when(c.between(lo, hi), inside).cast("int")

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        return df.withColumn(name or f"{self.column}_bin", self.label())


def fit_bins(df: DataFrame, column: str, n: int = 4, method: str = "quantile") -> Bins:
    if method == "quantile":
        quartiles = fit_quantiles(df, [column], [i / n for i in range(n + 1)])[column]
        return Bins(column, tuple(sorted(set(quartiles))))
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = (high - low) / n
    return Bins(column, tuple(low + i * width for i in range(n)) + (high,), width)


def ratio_features(df: DataFrame, target: str, threshold: float = 0.3, columns: Sequence[str] | None = None) -> DataFrame:
    """a_per_b for pairs that both follow the target, where b is never zero."""
    columns = list(columns or numeric_columns(df, [target]))
    facts = per_column(df, columns, {"r": lambda c: F.abs(pearson(c, F.col(target))), "zeros": lambda c: F.count_if(c == 0)}).collect()
    strong = {r["column_name"] for r in facts if (r["r"] or 0.0) > threshold}
    never_zero = {r["column_name"] for r in facts if r["zeros"] == 0}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if a in strong and b in strong and b in never_zero]
    return df.select("*", *[F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}_per_{b}") for a, b in pairs])


def transformed(c: Column, how: str) -> Column:
    """log (above 0), log1p (above -1), sqrt (from 0) or none; null outside the domain."""
    return {
        "log": F.when(c > 0, F.log(c)),
        "log1p": F.when(c > -1, F.log1p(c)),
        "sqrt": F.when(c >= 0, F.sqrt(c)),
        "none": c,
    }[how]


# --- dates, groups, gaps ----------------------------------------------------------------------------------


def date_features(df: DataFrame, column: str, first_day: str | None = None) -> DataFrame:
    """Sixteen calendar features. `first_day` is the origin of days_since; by default the earliest date in the frame."""
    d = F.col(column)
    day = d.cast("date")
    origin = F.lit(first_day).cast("date") if first_day else df.select(F.min(column)).scalar().cast("date")
    month, weekday = F.month(d), F.weekday(d)
    quarter_end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    turn = 2 * math.pi
    parts = {
        "year": F.year(d),
        "month": month,
        "day": F.day(d),
        "dayofweek": weekday,
        "hour": F.hour(d.cast("timestamp_ntz")),
        "quarter": F.quarter(d),
        "week": F.weekofyear(d),
        "is_month_start": (F.day(d) == 1).cast("int"),
        "is_month_end": (day == F.last_day(day)).cast("int"),
        "is_quarter_end": (day == quarter_end).cast("int"),
        "is_weekend": (weekday >= 5).cast("int"),
        "days_since": F.datediff(day, origin),
        "month_sin": F.sin(month * (turn / 12)),
        "month_cos": F.cos(month * (turn / 12)),
        "dayofweek_sin": F.sin(weekday * (turn / 7)),
        "dayofweek_cos": F.cos(weekday * (turn / 7)),
    }
    return df.select("*", *[v.alias(f"{column}_{k}") for k, v in parts.items()])


def group_statistics(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Row count, mean and sum per group joined to each row.

    Grouping first lets each task pre-aggregate; a window would sort a hot group in one task instead.
    """
    aggregates = [F.count(F.lit(1)).alias(f"{group}_count")]
    for v in values:
        aggregates += [F.avg(v).alias(f"{group}_{v}_mean"), F.sum(v).alias(f"{group}_{v}_sum")]
    stats = df.groupBy(F.col(group).alias("__group")).agg(*aggregates)
    return df.join(stats, df[group] == stats["__group"], "left").drop("__group")


def missing_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """c_was_missing for each column with gaps. Call before imputation."""
    columns = list(columns or df.columns)
    gaps = per_column(df, columns, {"n": lambda c: F.count_if(c.isNull())}).where("n > 0").collect()
    wanted = {r["column_name"] for r in gaps}
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_was_missing") for c in columns if c in wanted])


# --- text -------------------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def text_features(df: DataFrame, column: str) -> DataFrame:
    return df.select("*", F.length(column).alias(f"{column}_length"), F.size(words(F.col(column))).alias(f"{column}_words"))


def term_counts(df: DataFrame, key: str, column: str, max_terms: int | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, term, n) of the terms that occur most often in the whole frame, ties in term order."""
    terms = df.select(key, F.explode(words(F.col(column))).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(*stop_words))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    if max_terms is None:
        return counts
    # A second scan, but a small shuffle: terms combine on the map side, and the semi join below then filters
    # the words before they are counted per key, so that only pairs of the vocabulary are shuffled at all.
    vocabulary = terms.groupBy("term").agg(F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "term").limit(max_terms)
    return counts.join(vocabulary.select("term"), "term", "left_semi")


def term_weights(df: DataFrame, key: str, column: str, max_terms: int | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, term, weight): count times ln((1 + rows) / (1 + rows with the term)) + 1, scaled to length one per key."""
    counts = term_counts(df, key, column, max_terms, stop_words)
    rows = df.select(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.col("n") * (F.log((1 + rows) / (1 + F.col("n_rows"))) + 1)
    raw = counts.join(spread, "term").select(key, "term", weight.alias("raw"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", F.try_divide(F.col("raw"), F.col("norm")).alias("weight"))


def text_method(df: DataFrame, column: str) -> str:
    """tfidf for texts of more than 20 words on average, else count."""
    mean = df.agg(F.avg(F.size(F.split(F.trim(column), r"\s+")))).first()[0]
    return "tfidf" if mean is not None and mean > 20 else "count"


def seconds_since(column: str, origin: str) -> Column:
    return epoch_seconds(F.col(column)) - epoch_seconds(F.lit(origin))
