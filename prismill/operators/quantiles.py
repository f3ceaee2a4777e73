"""Exact interpolated quantiles of any number of columns.

For whole columns the order statistics are selected by histograms: each round counts the cells of every rank's bracket in one
scan and narrows the bracket to the smallest and largest value of the cell that holds the rank. Nothing is sorted and no row
is shuffled; what reaches the driver is a bounded number of cells. For groups the distinct values are counted and accumulated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from prismill.operators.ordered import cumulate

# Cells of all brackets together in a round, and values of a bracket that are read as they are.
CELLS, READ = 100_000, 2_000


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), nulls: bool = False) -> DataFrame:
    """(keep..., column_name, value) with values as double, nulls left out unless `nulls` asks for them."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.column_name", "cell.value")
    return rows if nulls else rows.where("value IS NOT NULL")


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, column_name) with the array `quantiles`, interpolated linearly between order statistics.

    Each value is counted once, the counts accumulate along the sorted values over many tasks, and the two order statistics
    around each rank are picked. A group or column without values keeps its row, with null quantiles: its nulls are counted
    as a value of no weight.
    """
    rows = long_form(df, columns, by, nulls=True)
    if not by:
        # A frame without rows has its columns all the same.
        names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
        rows = rows.unionByName(df.sparkSession.range(1).select(names, F.lit(None).cast("double").alias("value")))
    return _picked(rows, probabilities, by)


def sorted_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """As `quantiles`, without rows for groups and columns that have no values."""
    return _picked(long_form(df, columns, by), probabilities, by)


def _picked(rows: DataFrame, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    keys = [*by, "column_name"]
    counts = rows.groupBy(*keys, "value").agg(F.count("value").alias("n"))
    ranked = cumulate(counts, ["value"], keys, sums={"upto": F.col("n")}, totals={"total": "upto"})
    rank = {i: F.lit(float(p)) * (F.col("total") - 1) for i, p in enumerate(probabilities)}
    picks = []
    for i, at in rank.items():
        picks.append(F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"lo_{i}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"hi_{i}"))
    found = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    between = {i: F.col(f"lo_{i}") + (F.col(f"hi_{i}") - F.col(f"lo_{i}")) * (at - F.floor(at)) for i, at in rank.items()}
    # Two equal infinities have no difference.
    values = [F.when(F.col(f"lo_{i}") == F.col(f"hi_{i}"), F.col(f"lo_{i}")).otherwise(value) for i, value in between.items()]
    return found.select(*keys, F.array(*values).alias("quantiles"))


def fit_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """{column: [quantile, ...]} of whole columns. Columns without values are absent."""
    if not columns:
        return {}
    value = {c: F.col(c).cast("double") for c in columns}
    facts = df.agg(*[f(value[c]).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    span = {c: (facts[f"n_{i}"], facts[f"lo_{i}"], facts[f"hi_{i}"]) for i, c in enumerate(columns) if facts[f"n_{i}"]}
    if any(not math.isfinite(x) for _, lo, hi in span.values() for x in (lo, hi)):
        # Without a finite width a bracket has no cells.
        return {r["column_name"]: list(r["quantiles"]) for r in sorted_quantiles(df, columns, probabilities).collect()}
    wanted = {c: sorted({f(p * (span[c][0] - 1)) for p in probabilities for f in (math.floor, math.ceil)}) for c in span}
    found = select_ranks(df.select(*[value[c].alias(c) for c in span]), span, wanted) if span else {}
    out = {}
    for c, (n, _, _) in span.items():
        out[c] = []
        for p in probabilities:
            at = p * (n - 1)
            lo, hi = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def select_ranks(df: DataFrame, span: dict[str, tuple[int, float, float]], wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for 0-based ranks of double columns, given each column's (count, smallest, largest)."""
    found: dict[tuple[str, int], float] = {}
    # Brackets (column, lo, hi, values below, values inside, ranks inside); those of a column never overlap.
    open_brackets = [(c, lo, hi, 0, n, wanted[c]) for c, (n, lo, hi) in span.items()]
    while True:
        ready, left = [], []
        for c, lo, hi, below, n, ranks in open_brackets:
            ranks = [r for r in ranks if (c, r) not in found]
            for r in list(ranks):
                if lo == hi or r == below or r == below + n - 1:
                    found[c, r] = hi if r == below + n - 1 else lo
                    ranks.remove(r)
            if ranks:
                (ready if n <= READ else left).append((c, lo, hi, below, n, ranks))
        open_brackets = [*ready, *left]
        if not open_brackets:
            return found
        bins = max(16, CELLS // len(open_brackets))
        cells = {}
        for i, (c, lo, hi, _, n, _) in enumerate(open_brackets):
            v = F.col(c)
            # A bracket of few values is read as it is: each value is a cell. Halves keep a huge width finite.
            part = (v - lo) / (hi - lo) if math.isfinite(hi - lo) else (v / 2 - lo / 2) / (hi / 2 - lo / 2)
            share = F.least(F.floor(part * bins), F.lit(bins - 1)).cast("bigint")
            inside = F.struct(F.lit(i).alias("bracket"), (v if n <= READ else F.lit(None).cast("double")).alias("exact"), (F.lit(None).cast("bigint") if n <= READ else share).alias("cell"), v.alias("value"))
            cells[c] = (cells[c] if c in cells else F).when((v >= lo) & (v <= hi), inside)
        hit = df.select(F.explode(F.array(*cells.values())).alias("h")).where("h IS NOT NULL").select("h.*")
        counted = hit.groupBy("bracket", "exact", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        of: dict[int, list] = {}
        for r in counted:
            of.setdefault(r["bracket"], []).append((r["lo"], r["hi"], r["n"]))
        narrowed = []
        for i, (c, _, _, below, _, ranks) in enumerate(open_brackets):
            for lo, hi, n in sorted(of.get(i, [])):
                inside = [r for r in ranks if below <= r < below + n]
                if inside:
                    narrowed.append((c, lo, hi, below, n, inside))
                below += n
        open_brackets = narrowed
