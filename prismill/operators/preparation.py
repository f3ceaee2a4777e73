"""Splits, folds, scaling, balancing, selection and split checks.

Random choices order rows by a hash of their key, so that the same rows come out under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from prismill.functions.keys import shuffle_key
from prismill.functions.numbers import numeric_columns, percent, sample_skewness, share
from prismill.operators.exploration import task_type
from prismill.operators.neighbours import nearest, tomek_links
from prismill.operators.ordered import bucket_at, cumulate, ntile
from prismill.operators.profiling import fit_bounds, outlier_report, per_column
from prismill.operators.quantiles import fit_quantiles
from prismill.operators.shapes import identical_rows
from prismill.operators.statistics import two_sample_distance
from prismill.session import durable

ORDER = "__order"


def _rows(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def _label(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train").alias("part")


def _parted(numbered: DataFrame, columns: Sequence[str], is_test: Column, n_before_train: Column, position: str | None) -> DataFrame:
    """The part and, if `position` names a column, each training row's 1-based place among those of its group."""
    place = [F.when(~is_test, F.col(ORDER) - n_before_train).alias(position)] if position else []
    return numbered.select(*columns, _label(is_test), *place)


# --- splits -----------------------------------------------------------------------------------------------


def time_split(df: DataFrame, date: str, key: str, test_size: float = 0.2, position: str | None = None) -> DataFrame:
    """The first int(n * (1 - test_size)) rows in time order train, the rest test."""
    cut = F.floor(_rows(df) * F.lit(1 - test_size))
    return _parted(cumulate(df, [date, key], index=ORDER), df.columns, F.col(ORDER) > cut, F.lit(0), position)


def group_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups to test: the first int(groups * test_size) in hash order."""
    groups = df.select(group).distinct().withColumn("__hash", shuffle_key(F.col(group), seed=seed))
    numbered = cumulate(groups, ["__hash", group], index=ORDER)
    chosen = numbered.where(F.col(ORDER) <= F.floor(_rows(groups) * F.lit(test_size))).select(F.col(group).alias("__group"))
    joined = df.join(chosen, df[group].eqNullSafe(chosen["__group"]), "left")
    return joined.select(*df.columns, _label(F.col("__group").isNotNull()))


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42, position: str | None = None) -> DataFrame:
    """The same share of every class to test, rounded to the nearest row."""
    hashed = df.withColumn("__hash", shuffle_key(F.col(key), seed=seed))
    numbered = cumulate(hashed, ["__hash", key], [target], index=ORDER)
    sizes = df.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    joined = numbered.join(sizes, numbered[target].eqNullSafe(sizes["__class"]))
    n_test = F.floor(F.col("__n") * test_size + 0.5)
    return _parted(joined, df.columns, F.col(ORDER) <= n_test, n_test, position)


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, position: str | None = None) -> DataFrame:
    hashed = df.withColumn("__hash", shuffle_key(F.col(key), seed=seed))
    numbered = cumulate(hashed, ["__hash", key], index=ORDER)
    n_test = F.ceil(_rows(df) * F.lit(test_size))
    return _parted(numbered, df.columns, F.col(ORDER) <= n_test, n_test, position)


def has_repeated_groups(df: DataFrame, group: str) -> bool:
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).first()
    return counts["g"] < counts["n"] * 0.8


def split(
    df: DataFrame,
    target: str,
    key: str,
    test_size: float = 0.2,
    date: str | None = None,
    group: str | None = None,
    seed: int = 42,
    position: str | None = None,
) -> tuple[DataFrame, str]:
    """A column `part` and the strategy: by time, by group (when groups repeat), by class, or at random.

    `position` names a column for the order the rows were split in, which `folds` can go on with; null where there is none.
    """
    if date:
        return time_split(df, date, key, test_size, position), "time_based"
    if group and has_repeated_groups(df, group):
        parts = group_split(df, group, test_size, seed)
        return parts.withColumn(position, F.lit(None).cast("bigint")) if position else parts, "group_based"
    if task_type(df, target) == "classification":
        return stratified_split(df, target, key, test_size, seed, position), "stratified"
    return random_split(df, key, test_size, seed, position), "random"


# --- folds ------------------------------------------------------------------------------------------------


def fold_strategy(df: DataFrame, target: str, date: str | None = None, group: str | None = None, k: int = 5) -> str:
    if date:
        return "time"
    if group and df.select(group).distinct().limit(k).count() >= k:
        return "group"
    if task_type(df, target) == "classification":
        return "stratified"
    return "random"


def folds(
    df: DataFrame,
    strategy: str,
    key: str,
    k: int = 5,
    target: str | None = None,
    date: str | None = None,
    group: str | None = None,
    seed: int = 42,
    position: str | None = None,
) -> DataFrame:
    """A column `fold`. time: 0..k, where fold i > 0 is tested on models of all earlier folds; else 0..k-1.

    `position` names a column that holds the rows' places in this strategy's order already, as `split` leaves it: nothing is sorted then.
    """
    if position and strategy != "group":
        found = bucket_at(F.col(position), _rows(df), k + 1) - 1 if strategy == "time" else (F.col(position) - 1) % k
        return df.withColumn("fold", found.cast("int")).drop(position)
    if strategy == "time":
        return ntile(df, [date, key], k + 1, "fold").withColumn("fold", F.col("fold") - 1)
    if strategy == "group":
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string"), F.lit(seed)), F.lit(k)).cast("int"))
    hashed = df.withColumn("__hash", shuffle_key(F.col(key), seed=seed))
    by = [target] if strategy == "stratified" else []
    numbered = cumulate(hashed, ["__hash", key], by, index=ORDER)
    return numbered.select(*df.columns, ((F.col(ORDER) - 1) % k).cast("int").alias("fold"))


# --- scaling ----------------------------------------------------------------------------------------------


def scaler_choice(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: do any columns have more than 5 % outliers, skew above 1, negatives; and the scaler that calls for."""
    columns = list(columns or numeric_columns(df))
    outside = outlier_report(df, fit_bounds(df, columns)).select("column_name", "n_outliers")
    facts = per_column(
        df, columns, {"skew": lambda c: sample_skewness(c.cast("double")), "negatives": lambda c: F.count_if(c < 0), "n": lambda c: F.count(c)}
    ).join(outside, "column_name")
    flags = facts.agg(
        F.coalesce(F.bool_or(share(F.col("n_outliers"), F.col("n")) > 0.05), F.lit(False)).alias("has_outliers"),
        F.coalesce(F.bool_or(F.abs("skew") > 1), F.lit(False)).alias("is_skewed"),
        F.coalesce(F.bool_or(F.col("negatives") > 0), F.lit(False)).alias("has_negatives"),
    )
    outliers, skewed = F.col("has_outliers"), F.col("is_skewed")
    choice = (
        F.when(outliers & skewed, "robust")
        .when(skewed & ~F.col("has_negatives"), "yeo_johnson")
        .when(outliers, "robust")
        .when(~skewed, "standard")
        .otherwise("minmax")
    )
    return flags.withColumn("scaler", choice)


@dataclass(frozen=True)
class Scaler:
    """Shift and scale per column, after a power transform where `powers` names one."""

    shifts: dict[str, tuple[float, float]]
    powers: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            center, scale = self.shifts[c]
            base = yeo_johnson(F.col(c).cast("double"), self.powers[c]) if c in self.powers else F.col(c)
            return ((base - center) / (scale or 1.0)).alias(c)

        return df.select(*[scaled(c) if c in self.shifts else F.col(c) for c in df.columns])


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> Scaler:
    """standard (population deviation), minmax, robust (median and quartile range) or yeo_johnson."""
    if kind == "robust":
        q = fit_quantiles(df, columns, [0.25, 0.5, 0.75])
        return Scaler({c: (m, b - a) for c, (a, m, b) in q.items()}, {})
    powers = fit_powers(df, columns) if kind == "yeo_johnson" else {}
    frame = df.select(*[yeo_johnson(F.col(c).cast("double"), powers[c]).alias(c) if c in powers else F.col(c) for c in columns])
    measures = {"mean": F.avg, "std": F.stddev_pop, "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    facts = {r["column_name"]: r for r in per_column(frame, columns, measures).collect()}
    if kind == "minmax":
        return Scaler({c: (r["min"], r["max"] - r["min"]) for c, r in facts.items() if r["min"] is not None}, {})
    return Scaler({c: (r["mean"], r["std"]) for c, r in facts.items() if r["mean"] is not None}, powers)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(power) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, power) - 1) / power
    other = 2 - power
    negative = F.greatest(-x, F.lit(0.0))
    down = -F.log1p(negative) if abs(other) < 1e-12 else -(F.pow(negative + 1, other) - 1) / other
    return F.when(x >= 0, up).when(x < 0, down)


def fit_powers(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The power of highest likelihood per column: a coarse grid, then two finer ones; one aggregate each."""
    grid = {c: [i / 4 for i in range(-16, 17)] for c in columns}
    best: dict[str, float] = {}
    for step in (0.25, 0.025, 0.0025):
        measures = []
        for c in columns:
            x = F.col(c).cast("double")
            jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
            for i, power in enumerate(grid[c]):
                spread = F.var_pop(yeo_johnson(x, power))
                likelihood = F.when(spread > 0, -F.count(x) / 2.0 * F.log(spread) + (power - 1) * jacobian)
                measures.append((c, power, likelihood.alias(f"l_{len(measures)}")))
        found: dict[str, tuple[float, float]] = {}
        for start in range(0, len(measures), 100):
            chunk = measures[start : start + 100]
            for (c, power, _), value in zip(chunk, df.agg(*[m for _, _, m in chunk]).first()):
                if value is not None and (c not in found or value > found[c][0]):
                    found[c] = (value, power)
        best = {c: found[c][1] if c in found else 1.0 for c in columns}
        grid = {c: [best[c] + i * step / 10 for i in range(-10, 11)] for c in columns}
    return best


# --- balance ----------------------------------------------------------------------------------------------


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with weight n / (classes * class size). A missing target is no class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("f")).scalar()
    return counts.select("class", "n", F.try_divide(facts["rows"].cast("double"), facts["classes"] * F.col("n")).alias("weight"))


def add_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(F.col("class").alias("__class"), F.col("weight").alias(name))
    return df.join(weights, df[target] == weights["__class"], "left").drop("__class")


def balance_strategy(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    pct = percent(F.min("n"), F.sum("n"))
    choice = F.when(pct >= 40, "none").when(pct >= 30, "class_weights").when(pct >= 15, "smote").otherwise("smote_tomek")
    return counts.agg(pct.alias("minority_pct"), choice.alias("strategy"))


def oversample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Rows of smaller classes repeated until every class is as large as the largest; `copy` numbers the repeats."""
    hashed = df.withColumn("__hash", shuffle_key(F.col(key), seed=seed))
    numbered = cumulate(hashed, ["__hash", key], [target], index=ORDER)
    sizes = df.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.select(F.max("__n")).scalar()
    joined = numbered.join(sizes, numbered[target].eqNullSafe(sizes["__class"]))
    copies = F.floor(largest / F.col("__n")) + (F.col(ORDER) <= largest % F.col("__n")).cast("int")
    return joined.select(*df.columns, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("copy"))


def undersample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest one has, chosen by hash."""
    hashed = df.withColumn("__hash", shuffle_key(F.col(key), seed=seed))
    numbered = cumulate(hashed, ["__hash", key], [target], index=ORDER)
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).select(F.min("n")).scalar()
    return numbered.where(F.col(ORDER) <= smallest).select(*df.columns)


def _draw(*keys: Column, seed: int) -> Column:
    """A reproducible whole number below 2^32."""
    return F.conv(F.substring(shuffle_key(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def smote(df: DataFrame, target: str, minority: object, columns: Sequence[str], key: str, copies: int, k: int = 5, seed: int = 42) -> DataFrame:
    """`copies` synthetic rows per minority row, each on the line to one of its k nearest minority rows.

    A minority row with a gap in `columns`, or without another one beside it, has no synthetic rows.
    """
    points = df.where(F.col(target) == F.lit(minority)).select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    near = nearest(points, points, key, len(columns), k, skip_self=True).where(F.size("near") > 0)
    made = near.select(key, "x", "near", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    pick = F.pmod(_draw(F.col(key), F.col("copy"), seed=seed), F.size("near")).cast("int")
    u = _draw(F.col(key), F.col("copy"), seed=seed + 1) / F.lit(float(1 << 32))
    mixed = made.select(key, "copy", F.zip_with("x", F.col("near")[pick]["y"], lambda a, b: a + u * (b - a)).alias("z"))
    return mixed.select(F.col(key).alias("source_key"), "copy", F.lit(minority).alias(target), *[F.col("z")[i].alias(c) for i, c in enumerate(columns)])


def balance(df: DataFrame, target: str, columns: Sequence[str], key: str, strategy: str | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """(key as text, target, columns..., weight, synthetic): `df` after the strategy that `balance_strategy` names, or `strategy`.

    * none: every row, weight 1. class_weights: every row with its class's weight.
    * smote: smaller classes get synthetic rows until they are as large as the largest; the rest of a division goes to
      the rows first by hash. smote_tomek: then both rows of every Tomek link go.
    * Rows with a null target are left out. A class without neighbours to draw from stays as it is.
    """
    strategy = strategy or balance_strategy(df, target).first()["strategy"]
    known = df.where(F.col(target).isNotNull())
    shaped = known.select(F.col(key).cast("string").alias(key), target, *[F.col(c).cast("double").alias(c) for c in columns])
    if strategy == "none":
        return shaped.withColumns({"weight": F.lit(1.0), "synthetic": F.lit(False)})
    if strategy == "class_weights":
        return add_class_weights(shaped, target).withColumn("synthetic", F.lit(False))
    if strategy not in ("smote", "smote_tomek"):
        raise ValueError(f"no balancing strategy {strategy!r}")
    sizes = [(r[0], r["n"]) for r in known.groupBy(target).agg(F.count(F.lit(1)).alias("n")).orderBy("n", target).collect()]
    out = shaped.withColumn("synthetic", F.lit(False))
    for value, n in sizes[:-1]:
        each, rest = divmod(sizes[-1][1] - n, n)
        if not each and not rest:
            continue
        members = known.where(F.col(target) == F.lit(value))
        placed = cumulate(members.select(key, shuffle_key(F.col(key), seed=seed).alias("__hash")), ["__hash", key], index=ORDER)
        made = smote(members, target, value, columns, key, each + bool(rest), k, seed)
        if rest:
            late = placed.where(F.col(ORDER) > rest).select(F.col(key).alias("source_key"), F.lit(each).alias("copy"))
            made = made.join(late, ["source_key", "copy"], "left_anti")
        named = F.concat_ws("#", F.col("source_key").cast("string"), (F.col("copy") + 1).cast("string")).alias(key)
        out = out.unionByName(made.select(named, F.col(target).cast(shaped.schema[target].dataType).alias(target), *columns, F.lit(True).alias("synthetic")))
    if strategy == "smote_tomek":
        out = durable(out)
        links = durable(tomek_links(out, target, columns, key))
        ends = links.select(key).unionAll(links.select(F.col("other").alias(key)))
        out = out.join(ends, key, "left_anti")
    return out.select(key, target, *columns, F.lit(1.0).alias("weight"), "synthetic")


# --- selection and checks ---------------------------------------------------------------------------------


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """(column_name, mutual_information) in nats between quantile bins of each column and the target values.

    With `target_bins` the target is a number and cut at its quantiles too. A grid shows some information where there is
    none; there the expected excess, (cells - column bins - target bins + 1) / 2 rows over the occupied ones, is taken
    off, down to 0. All columns are counted in one aggregate.
    """

    def inner(columns: Sequence[str], n: int) -> dict[str, list[float]]:
        return {c: sorted(set(q[1:-1])) for c, q in fit_quantiles(df, columns, [i / n for i in range(n + 1)]).items()}

    edges = inner(columns, bins)
    if target_bins:
        edges |= inner([target], target_bins)

    def binned(c: str) -> Column:
        found = F.lit(len(edges.get(c, [])))
        for i, edge in reversed(list(enumerate(edges.get(c, [])))):
            found = F.when(F.col(c) <= edge, i).otherwise(found)
        return F.when(F.col(c).isNotNull(), found)

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), binned(c).alias("bin")) for c in columns])
    y = binned(target) if target_bins else F.col(target)
    counts = df.select(y.alias("y"), F.explode(cells).alias("cell")).select("y", "cell.*").dropna().groupBy("column_name", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy
    n = F.col("n").cast("double")
    # A column has at most bins * classes cells; the windows run over these counts, not over rows.
    shares = counts.select(
        "column_name",
        "bin",
        "y",
        n.alias("n"),
        F.sum(n).over(w("column_name")).alias("total"),
        F.sum(n).over(w("column_name", "bin")).alias("bin_total"),
        F.sum(n).over(w("column_name", "y")).alias("y_total"),
    )
    part = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("bin_total") * F.col("y_total")))
    found = F.sum(part)
    if target_bins:
        excess = (F.count(F.lit(1)) - F.count_distinct("bin") - F.count_distinct("y") + 1) / (2 * F.max("total"))
        found = F.greatest(found - excess, F.lit(0.0))
    return shares.groupBy("column_name").agg(found.alias("mutual_information"))


def validate_split(train: DataFrame, test: DataFrame, columns: Sequence[str], p_limit: float = 0.05) -> DataFrame:
    """(check, column_name, passed, detail): rows present, same columns, no gaps or infinities, no shared rows,
    and per numeric column no distribution shift (a warning)."""
    spark = train.sparkSession
    numeric = [c for c in columns if isinstance(train.schema[c].dataType, T.NumericType)]
    width = [("same_columns", None, train.columns == test.columns, float(len(set(train.columns) ^ set(test.columns))))]
    report = spark.createDataFrame(width, "check string, column_name string, passed boolean, detail double")

    def bad(df: DataFrame) -> Column:
        found = F.lit(False)
        for c in columns:
            found = found | F.col(c).isNull()
            if c in numeric:
                v = F.col(c).cast("double")
                found = found | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
        return F.count_if(found)

    for name, df in (("train", train), ("test", test)):
        facts = df.agg(F.count(F.lit(1)).alias("n"), bad(df).alias("bad"))
        checks = F.array(
            F.struct(F.lit(f"{name}_not_empty").alias("check"), (F.col("n") > 0).alias("passed"), F.col("n").cast("double").alias("detail")),
            F.struct(F.lit(f"{name}_finite").alias("check"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("double").alias("detail")),
        )
        report = report.unionByName(facts.select(F.explode(checks).alias("c")).select("c.check", F.lit(None).cast("string").alias("column_name"), "c.passed", "c.detail"))
    shared = identical_rows(train.select(*columns), test.select(*columns)).agg(F.count(F.lit(1)).alias("n"))
    report = report.unionByName(
        shared.select(F.lit("no_shared_rows").alias("check"), F.lit(None).cast("string").alias("column_name"), (F.col("n") == 0).alias("passed"), F.col("n").cast("double").alias("detail"))
    )
    if numeric:
        both = train.select(*numeric, F.lit(True).alias("__train")).unionByName(test.select(*numeric, F.lit(False).alias("__train")))
        shift = two_sample_distance(both, numeric, F.col("__train"))
        report = report.unionByName(
            shift.select(F.lit("same_distribution").alias("check"), "column_name", (F.col("p_value") >= p_limit).alias("passed"), F.col("distance").alias("detail"))
        )
    return report
