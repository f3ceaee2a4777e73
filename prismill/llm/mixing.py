"""Sources mixed to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. Within a source the rates are an exponential
tilt of the document's size, bounded by the greatest number of copies, and the tilt solves the convex dual of the token
constraint of its source (calibration with a bounded distance). Newton's steps are distributed sums over the counted
(source, size) pairs, a table that grows with the distinct sizes, not with the documents. Rates become whole copies by
systematic rounding along the sizes, so a source misses its target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.llm.text import free_name, require, word_count
from prismill.session import durable

# A bucket of one (source, size) class holds about so many documents; only within a bucket documents are put in order.
BUCKET_ROWS = 4096
# Offsets tried for the systematic rounding of a source.
OFFSETS = 32


def targets(sources: DataFrame, weights: tuple[float, ...], most: int, rounds: int = 64) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights repeat along the sources by code point, null last. Targets share the sum of all sizes by weight; those above
    `most` times their source's size stop there, and what they leave is shared by the others, until none is above.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = durable(sources.withColumn("weight", weight).withColumn("fixed", F.lit(False)))
    n = table.count()
    for _ in range(rounds):
        left = table.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("fixed"), most * F.col("source_size"))), F.lit(0))).alias("size"),
            F.sum(F.when(~F.col("fixed"), F.col("weight"))).alias("weight"),
        ).first()
        share = (left["size"] or 0) / left["weight"] if left["weight"] else 0.0
        over = ~F.col("fixed") & (F.col("weight") * share > most * F.col("source_size"))
        if not table.where(over).head(1):
            break
        table = durable(table.withColumn("fixed", F.col("fixed") | over), n)
    else:
        raise RuntimeError("the targets did not settle")
    target = F.when(F.col("fixed"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(float(share)))
    return table.select("source", "source_size", "weight", target.alias("target"))


def tilted(tilt: Column, x: Column, most: int) -> Column:
    """The bounded exponential tilt: 1 at no tilt, towards 0 and `most` at the ends."""
    return F.lit(float(most)) / (F.lit(1.0) + F.lit(most - 1.0) * F.exp(F.greatest(F.least(-tilt * x, F.lit(700.0)), F.lit(-700.0))))


def solve_tilts(sizes: DataFrame, goals: DataFrame, most: int, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(source, source_size, target, mean, tilt): per source the tilt whose rates sum to the target.

    `sizes` is (source, size, n). Each round is one aggregate for all sources: a safeguarded Newton step on the dual's gradient,
    bisected where it leaves the bracket. Sources without words, or with a target they can only reach with `most` copies
    of everything, need no search.
    """
    means = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    n = goals.count()
    state = durable(
        goals.alias("g").join(means.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select(
            "g.source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
            (full | (F.col("source_size") == 0)).alias("done"),
            F.when(full, F.lit(1e9)).otherwise(F.lit(0.0)).alias("tilt"), F.lit(-1e12).alias("low"), F.lit(1e12).alias("high"),
        ),
        n,
    )
    x = F.col("size") / F.col("mean")
    rate = tilted(F.col("tilt"), x, most)
    gap, stride = F.col("reached") - F.col("target"), 1 + 2 * F.abs("tilt")
    low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    newton = F.col("tilt") - F.coalesce(F.greatest(F.least(gap / F.nullif(F.col("slope"), F.lit(0.0)), stride), -stride), F.signum(gap) * stride)
    moved = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
    for _ in range(rounds):
        if not state.where("NOT done").head(1):
            return state.select("source", "source_size", "target", "mean", "tilt")
        searched = state.where("NOT done").select(F.col("source").alias("src"), "mean", "tilt")
        sums = (
            sizes.join(searched, F.col("source").eqNullSafe(F.col("src")))
            .groupBy("src")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("reached"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"))
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("src")), "left")
        hit = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = durable(
            joined.select(
                "source", "source_size", "target", "mean",
                (F.col("done") | F.coalesce(hit, F.lit(False))).alias("done"),
                F.when(F.col("done") | F.coalesce(hit, F.lit(True)), F.col("tilt")).otherwise(moved).alias("tilt"),
                F.when(F.col("reached").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("reached").isNull(), F.col("high")).otherwise(high).alias("high"),
            ),
            n,
        )
    raise RuntimeError("the tilts did not settle")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
) -> DataFrame:
    """(id_col, row_hash, size, source, source_size, target, rate, copies) for each row of `docs`; `copies` is 0 to `most`.

    * Size: words of the text, 0 for null or empty text. Documents without words get their rate like others.
    * A null source is a source of its own, the last. Sources take weights by code point, repeating.
    * Ties and repeated rows: rows are told apart by a hash of id, text and source; equal rows share a bucket, where their order
      changes which of the equal rows is copied, but not how many.
    * Other columns don't matter. No rows: no rows. Reruns agree.
    """
    require(docs, id_col, text_col, source_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col), text, F.col(source_col).cast("string")).alias("h"))
    rows = durable(rows)
    n_rows = rows.count()
    sizes = durable(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), n_rows)
    goals = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size")), weights, most)
    tilts = solve_tilts(sizes, goals, most)

    # Buckets of bounded size inside each (source, size) class: a class may hold a third of all rows.
    classes = (
        sizes.join(tilts.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
        .withColumn("rate", tilted(F.col("tilt"), F.col("size") / F.col("mean"), most))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    )
    marked = rows.join(classes.drop("n", "mean", "tilt").withColumnRenamed("source", "src").withColumnRenamed("size", "cls"), F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("cls"))).drop("src", "cls")
    marked = marked.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    counts = durable(marked.groupBy("source", "size", "bucket", "rate").agg(F.count(F.lit(1)).alias("n")), n_rows)
    quota = quotas(counts, counts.count())
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "id"))
    placed = marked.withColumn("place", place).join(
        quota.select(F.col("source").alias("src"), F.col("size").alias("cls"), F.col("bucket").alias("bkt"), "extra"),
        F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("cls")) & (F.col("bucket") == F.col("bkt")),
    )
    copies = F.floor("rate").cast("bigint") + (F.col("place") <= F.col("extra")).cast("bigint")
    return placed.select(F.col("id").alias(id_col), F.col("h").alias("row_hash"), "size", "source", "source_size", "target", "rate", copies.alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix` says, with the same columns.

    Rows that repeat id, text and source are numbered on both sides, so each takes its own number of copies.
    """
    taken = mix(docs, id_col, text_col, source_col, **options)
    h, k, i = (free_name(docs.columns, n) for n in ("row_hash", "row_place", "row_id"))
    t_id, t_hash, t_place, t_copies = (free_name(docs.columns, n) for n in ("t_id", "t_hash", "t_place", "t_copies"))
    number = F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(1)))
    left = docs.withColumn(i, F.col(id_col)).withColumn(h, F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), F.col(source_col).cast("string"))).withColumn(k, number)
    right = taken.where("copies > 0").select(F.col(id_col).alias(t_id), F.col("row_hash").alias(t_hash), F.col("copies").alias(t_copies))
    right = right.withColumn(t_place, F.row_number().over(Window.partitionBy(t_id, t_hash).orderBy(F.desc(t_copies))))
    joined = left.join(right, F.col(i).eqNullSafe(F.col(t_id)) & (F.col(h) == F.col(t_hash)) & (F.col(k) == F.col(t_place)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(t_copies))).alias(k)).drop(k)


def quotas(counts: DataFrame, rows: int | None = None) -> DataFrame:
    """(source, size, bucket, extra): how many of a bucket's documents get one copy more than the whole part of the rate.

    Fractions are summed along (size, bucket) and cut at whole numbers: at every size the copies so far differ from the
    rates so far by less than one. Of OFFSETS first cuts each source takes the one that meets its target best. `rows` of `counts`.
    """
    part = F.col("rate") - F.floor("rate")
    along = Window.partitionBy("source").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = durable(counts.withColumn("whole", F.floor("rate")).withColumn("upto", F.sum(F.col("n") * part).over(along)).withColumn("here", F.col("n") * part), rows)

    def cut(offset: Column) -> Column:
        # Floating sums may stray by a hair: a bucket never gives more than it has.
        return F.least(F.greatest(F.floor(F.col("upto") + offset) - F.floor(F.col("upto") - F.col("here") + offset), F.lit(0)), F.col("n"))

    offsets = [F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)]
    misses = [F.abs(F.sum(F.col("size") * (cut(o) - F.col("here")))).alias(f"m{i}") for i, o in enumerate(offsets)]
    best = summed.groupBy("source").agg(*misses)
    ranked = F.array_min(F.array(*[F.struct(F.round(f"m{i}", 3).alias("miss"), o.alias("offset")) for i, o in enumerate(offsets)]))
    best = best.select(F.col("source").alias("src"), ranked["offset"].alias("offset"))
    return summed.join(best, F.col("source").eqNullSafe(F.col("src"))).select("source", "size", "bucket", cut(F.col("offset")).cast("bigint").alias("extra"))
