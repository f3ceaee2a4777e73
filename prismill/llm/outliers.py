"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and source a minimum-covariance-determinant fit
(several starts, concentration steps until the determinant no longer falls, the smallest one stays) estimates centre and
scatter of the well-behaved part; texts whose Mahalanobis distance is beyond a cutoff are rejected. The steps are grouped sums over the vectors: a hot source is pre-aggregated by
every task, and only one small row per group travels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.llm.text import require
from prismill.session import durable

# The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words")
# Smallest standard deviation of each feature: a statistic that hardly varies in a group must not turn a trifle into an outlier.
LEAST = (0.5, 0.35, 0.25, 0.10, 0.08)
KEPT_SHARE, LEAST_ROWS = 0.75, 50
# Cells of the grid that the starts are read from, per unit of the inverse hyperbolic sine of a feature.
GRID = 64
# All starts take SHORT_STEPS, the BEST of them go on until the logarithm of the determinant falls by less than SETTLED.
SHORT_STEPS, BEST, SETTLED, MOST_STEPS = 2, 2, 1e-3, 100
# Share of a normal distribution beyond the cutoff.
TAIL = 2e-5


def chi_square(x: float, p: int) -> float:
    """Distribution function of chi-squared with p degrees of freedom, by its power series."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, p) < share:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, p) < share else (low, mid)
    return high


@lru_cache
def consistency(share: float, p: int) -> float:
    """What the scatter of the nearest `share` of normal rows has to be multiplied by to be that of all."""
    return share / chi_square(chi_square_quantile(share, p), p + 2)


CUTOFF = chi_square_quantile(1 - TAIL, len(FEATURES))


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """The five whole-text counts; words are runs of non-blanks."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(joined.count(c) for c in SYMBOLS)
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, last = Counter(windows), -1
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, last)
                    last = i + 3
    return n, chars, symbols, again, repeated


def measured(docs: DataFrame, id_col: str, text_col: str, by: tuple[str, ...]) -> DataFrame:
    """(id, g0, g1, ..., statistics) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(by)], F.col(text_col).cast("string").alias("text"))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            stats = [statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.large_binary())]
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)] or [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *STATS])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, schema + "".join(f", {s} long" for s in STATS))


def features() -> list[Column]:
    """Transformed statistics: logarithms of counts, shares of words and lines."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.col("word_chars") / n,
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")) / 4,
        F.col("n_repeat_words") / n,
    ]


def distance(x: list[Column], centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; `inverse` is the inverse scatter, row by row."""
    d = [v - F.element_at(centre, i + 1) for i, v in enumerate(x)]
    p = len(x)
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + F.element_at(inverse, i * p + j + 1) * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def listed(values: np.ndarray) -> pa.Array:
    return pa.array([values.ravel().tolist()], pa.list_(pa.float64()))


def concentrated(table: pa.Table, keys: list[str]) -> pa.Table:
    """(keys, centre, inverse, size) of one group from its sums by distance step: the nearest KEPT_SHARE of the rows, of the
    step at the border a part. `size` is the logarithm of the determinant."""
    p, least = len(FEATURES), np.diag(np.square(LEAST))
    order = np.argsort(table["step"].to_numpy(), kind="stable")
    counts = table["c"].to_numpy()[order].astype(float)
    before = np.cumsum(counts) - counts
    n = KEPT_SHARE * counts.sum()
    share = np.clip((n - before) / counts, 0, 1)
    kept = lambda name: float(share @ table[name].to_numpy()[order])
    mean = np.array([kept(f"s{i}") for i in range(p)]) / n
    second = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            second[i, j] = second[j, i] = kept(f"q{i}_{j}") / n
    scatter = (second - np.outer(mean, mean)) * consistency(KEPT_SHARE, p)
    scatter += np.diag(np.maximum(np.diag(least) - np.diag(scatter), 0)) + 1e-9 * least
    first = {k: table[k].slice(0, 1) for k in keys}
    return pa.table({**first, "centre": listed(mean), "inverse": listed(np.linalg.inv(scatter)), "size": [float(np.linalg.slogdet(scatter)[1])]})


def started(table: pa.Table, keys: list[str]) -> pa.Table:
    """(keys, start, centre, inverse) of one group from how often each feature falls into each cell of a grid: the medians
    with the quartiles' scales, the shortest halves, the lower and the upper quartiles."""
    centres, scales = np.zeros((4, len(FEATURES))), np.zeros((4, len(FEATURES)))
    feature, cell, count = (table[c].to_numpy() for c in ("feature", "cell", "c"))
    for i, least in enumerate(LEAST):
        mine = np.flatnonzero(feature == i)
        mine = mine[np.argsort(cell[mine])]
        value, total = np.sinh((cell[mine] + 0.5) / GRID), np.cumsum(count[mine])
        low, mid, high = (value[np.searchsorted(total, q * total[-1])] for q in (0.25, 0.5, 0.75))
        # The shortest run of cells with half of the rows.
        ends = np.searchsorted(total, total - count[mine] + total[-1] / 2)
        ends, starts = ends[ends < len(value)], value[: np.count_nonzero(ends < len(value))]
        k = int(np.argmin(value[ends] - starts))
        centres[:, i] = mid, (starts[k] + value[ends[k]]) / 2, low, high
        scales[:, i] = np.maximum([(high - low) / 1.349, (value[ends[k]] - starts[k]) / 1.349, (mid - low) / 0.6745, (high - mid) / 0.6745], least)
    first = {k: table[k].take([0] * 4) for k in keys}
    inverse = [np.diag(1 / np.square(s)).ravel().tolist() for s in scales]
    return pa.table({**first, "start": pa.array(range(4), pa.int32()), "centre": pa.array(centres.tolist()), "inverse": pa.array(inverse)})


def with_fit(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the fit of their group; null keys match null keys."""
    named = fits.select(*[F.col(k).alias(f"f_{k}") for k in keys], *[c for c in fits.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"f_{k}"))
    return rows.join(named, match).drop(*[f"f_{k}" for k in keys])


def fit_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, inverse, size) by minimum covariance determinant, for groups of at least LEAST_ROWS rows.

    The starts come from counts on a grid, so that they don't depend on the layout. A step sums the rows by group, start and
    distance, in fine steps of its logarithm (at most some thousand sums per group and start, whatever its rows), and fits
    anew to the nearest KEPT_SHARE. A start ends when its determinant no longer falls; of all fits seen the one with the
    smallest determinant stays, ties to the first start.
    """
    p = len(FEATURES)
    x = [F.col(f"x{i}") for i in range(p)]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.floor(F.asinh(v) * GRID).cast("int").alias("cell")) for i, v in enumerate(x)])
    grid = rows.select(*keys, F.explode(cells).alias("at")).groupBy(*keys, "at.feature", "at.cell").agg(F.count(F.lit(1)).alias("c"))
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).drop("n")
    starts = with_fit(grid, large, keys).groupBy(*keys).applyInArrow(lambda t: started(t, keys), f"{kinds}, start int, centre array<double>, inverse array<double>")
    best = durable(starts.select("*", F.lit(float("inf")).alias("size"), F.lit(True).alias("falls")))
    named = [*keys, "start"]
    step = F.floor(F.log2(F.greatest(distance(x, F.col("centre"), F.col("inverse")), F.lit(1e-9))) * 32)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    schema = f"{kinds}, start int, centre array<double>, inverse array<double>, size double"
    for i in range(MOST_STEPS):
        if not best.where("falls").head(1):
            break
        moving = best.where("falls").select(*named, "centre", "inverse")
        by_step = with_fit(rows, moving, keys).groupBy(*named, step.alias("step")).agg(F.count(F.lit(1)).alias("c"), *sums)
        moved = by_step.groupBy(*named).applyInArrow(lambda table: concentrated(table, named), schema)
        # The fit before and the fit now: the smaller one stays, and a start goes on while it falls.
        both = best.withColumn("now", F.lit(False)).unionByName(moved.withColumns({"falls": F.lit(True), "now": F.lit(True)}))
        least = F.min_by(F.struct("centre", "inverse", "size"), F.struct("size", "now"))
        fall = F.max(F.when(~F.col("now"), F.col("size"))) - F.max(F.when(F.col("now"), F.col("size")))
        both = both.groupBy(*named).agg(least.alias("fit"), F.coalesce(fall > SETTLED, F.lit(False)).alias("falls")).select(*named, "fit.*", "falls")
        if i + 1 == SHORT_STEPS:
            # A handful of starts for each group.
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "start"))
            both = both.withColumn("place", place).where(F.col("place") <= BEST).drop("place")
        best = durable(both)
    fit = F.min_by(F.struct("centre", "inverse", "size"), F.struct("size", "start"))
    return durable(best.groupBy(*keys).agg(fit.alias("fit")).select(*keys, "fit.*"))


def reject_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """(id_col, the five statistics, base_failed, distance, kept) for each row.

    * base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. The fit leaves these out.
    * kept: passes the base rules, and its squared distance in its group is at most `cutoff`.
    * A group with fewer than LEAST_ROWS passing rows is judged by its first column (the language), or else by all rows; if
      these are too few as well, the base rules decide. Nulls in `by` are a group of their own.
    * Null and empty texts have no words and fail. Repeated rows count each. Other columns don't matter. No rows: no rows.

    The statistics are written once to the checkpoint folder.
    """
    require(docs, id_col, text_col, *by)
    keys = [f"g{i}" for i in range(len(by))]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measured(docs, id_col, text_col, by).withColumn("base_failed", failed)
    rows = durable(rows.select("*", *[f.alias(f"x{i}") for i, f in enumerate(features())]))
    good = rows.where("NOT base_failed")
    # Every row counts in its group, in its language and in the whole.
    levels = [keys, keys[:1], []] if len(keys) > 1 else [keys, []]
    placed = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in level else F.lit(None).cast("string")).alias(c) for c in keys]) for k, level in enumerate(levels)]))
    x = [f"x{i}" for i in range(len(FEATURES))]
    fits = fit_groups(good.select(placed.alias("at"), *x).select("at.*", *x), ["level", *keys])
    judged, found = rows, []
    for k, level in enumerate(levels[:-1]):
        named = fits.where(F.col("level") == k).select(*[F.col(c).alias(f"f{k}_{c}") for c in level], F.col("centre").alias(f"centre{k}"), F.col("inverse").alias(f"inverse{k}"))
        match = F.lit(True)
        for c in level:
            match = match & F.col(c).eqNullSafe(F.col(f"f{k}_{c}"))
        judged = judged.join(named, match, "left")
        found.append(distance([F.col(v) for v in x], F.col(f"centre{k}"), F.col(f"inverse{k}")))
    if whole := fits.where(F.col("level") == len(levels) - 1).first():
        literal = lambda values: F.array(*[F.lit(v) for v in values])
        found.append(distance([F.col(v) for v in x], literal(whole["centre"]), literal(whole["inverse"])))
    else:
        found.append(F.lit(None).cast("double"))
    judged = judged.withColumn("distance", F.coalesce(*found))
    return judged.select(F.col("id").alias(id_col), *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
