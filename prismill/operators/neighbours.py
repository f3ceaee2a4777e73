"""Exact nearest rows by a distributed k-d tree, and the links between classes that follow from them.

Leaves are cut by medians of a bounded sample and hold the points of a box; a leaf with many points is dealt to blocks. A
query is answered in its own leaf first, which bounds its kth distance, and then visits only those leaves whose box lies
nearer. The sample only decides where the cuts are: boxes are those of all points, so answers are exact. Equal points are one
point with its smallest keys, and equal queries one query, so that a hot point or query costs no more than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.session import durable

# Points that the cuts are fitted on, points aimed at per leaf, most leaves (their boxes are sent to every task).
SAMPLE, LEAF, MOST_LEAVES = 20_000, 2_048, 1_024
# Points of a block, queries that meet it in one task, queries of one distance matrix.
BLOCK, QUERIES, AT_ONCE = 4_096, 16_384, 256


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(pa.compute.list_flatten(column)).reshape(len(column), width)


def fit_cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, left, right) of a tree over the sample; a child below 0 is the leaf -1 - child."""
    nodes: list = []
    ends = 0
    stack = [(np.arange(len(sample)), leaves, None, 0)]
    while stack:
        rows, wanted, parent, side = stack.pop()
        values = sample[rows]
        spread = values.max(0) - values.min(0) if len(rows) else np.zeros(1)
        dimension = int(spread.argmax())
        at = None
        if wanted > 1 and spread[dimension] > 0:
            cut = float(np.median(values[:, dimension]))
            right = values[:, dimension] > cut
            if not right.any():
                # More than half of the points share the largest value.
                cut = float(values[:, dimension][values[:, dimension] < cut].max())
                right = values[:, dimension] > cut
            at = len(nodes)
            nodes.append([dimension, cut, 0, 0])
            stack += [(rows[~right], wanted // 2, at, 2), (rows[right], wanted - wanted // 2, at, 3)]
        else:
            ends += 1
            at = -ends
        if parent is not None:
            nodes[parent][side] = at
    return [tuple(n) for n in nodes]


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    if not nodes:
        return np.zeros(len(points), np.int32)
    dimension, cut, left, right = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    while len(rows):
        here = at[rows]
        at[rows] = np.where(points[rows, dimension[here]] > cut[here], right[here], left[here])
        rows = rows[at[rows] >= 0]
    return (-1 - at).astype(np.int32)


def first_points(table: pa.Table, width: int, k: int) -> pa.Table:
    """(x, y, keys, distance): for each query of a block its k nearest points, ties by their smallest key."""
    asks = pa.compute.is_valid(table["bound"])
    queries, points = table.filter(asks), table.filter(pa.compute.invert(asks))
    picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and points.num_rows:
        q, p, bound = vectors(queries["x"], width), vectors(points["x"], width), queries["bound"].to_numpy()
        smallest = pa.compute.list_element(points["keys"], 0)
        order = np.asarray(pa.compute.sort_indices(smallest))
        p = p[order]
        n = min(k, len(p))
        for at in range(0, len(q), AT_ONCE):
            part = q[at : at + AT_ONCE]
            distance = np.zeros((len(part), len(p)))
            # Summed dimension by dimension, as the SQL of the distance does.
            for d in range(width):
                gap = part[:, d, None] - p[None, :, d]
                distance += gap * gap
            kth = np.partition(distance, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero(distance <= np.minimum(kth, bound[at : at + AT_ONCE])[:, None])
            found = distance[i, j]
            # Points lie in the order of their smallest keys, so a stable sort breaks ties by it.
            ranked = np.lexsort((found, i))
            i, j, found = i[ranked], j[ranked], found[ranked]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            picked.append((i[keep] + at, order[j[keep]], found[keep]))
    i, j, found = (np.concatenate([c[n] for c in picked]) if picked else np.empty(0) for n in range(3))
    i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
    return pa.table({"x": queries["x"].take(i), "y": points["x"].take(j), "keys": points["keys"].take(j), "distance": pa.array(found, pa.float64())})


class Tree:
    """Distinct points in leaves and blocks, and the boxes of the leaves."""

    def __init__(self, points: DataFrame, key: str, width: int, keep: int):
        """`points` holds key and x. Of equal points the `keep` smallest keys are held."""
        self.width, self.kind = width, points.schema[key].dataType.simpleString()
        ranked = points.select("x", F.col(key).alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("k"))).where(F.col("r") <= keep)
        unique = durable(ranked.groupBy("x").agg(F.array_sort(F.collect_list("k")).alias("keys")))
        n = unique.count()
        step = max(1, math.ceil(n / SAMPLE))
        drawn = unique.where(F.pmod(F.xxhash64("x"), F.lit(step)) == 0).select("x").limit(2 * SAMPLE).collect()
        self.nodes = nodes = fit_cuts(np.array([r.x for r in drawn]).reshape(-1, width), max(1, min(MOST_LEAVES, math.ceil(n / LEAF))))

        def deal(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(vectors(batch.column("x"), width), nodes))], [*batch.schema.names, "leaf"])

        self.points = durable(unique.mapInArrow(deal, f"x array<double>, keys array<{self.kind}>, leaf int"))
        edges = [f(F.col("x")[d]).alias(f"{name}_{d}") for d in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
        # One row per leaf, at most MOST_LEAVES.
        boxes = {r["leaf"]: r for r in self.points.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *edges).collect()}
        self.ids = np.array(sorted(boxes), np.int32)
        self.low = np.array([[boxes[b][f"lo_{d}"] for d in range(width)] for b in self.ids]).reshape(-1, width)
        self.high = np.array([[boxes[b][f"hi_{d}"] for d in range(width)] for b in self.ids]).reshape(-1, width)
        self.blocks = np.array([math.ceil(boxes[b]["n"] / BLOCK) for b in self.ids], np.int32)

    def visit(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """(x, y, keys, distance) of queries (x, bound): in each leaf that may hold one of the k nearest, its k nearest points.

        `home` asks the leaf alone that the query lies in, otherwise all others.
        """
        nodes, ids, low, high, blocks, width = self.nodes, self.ids, self.low, self.high, self.blocks, self.width

        def route(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                q, bound = vectors(batch.column("x"), width), batch.column("bound").to_numpy()
                own = leaf_of(q, nodes)
                for at in range(0, len(q), 1024):
                    part = q[at : at + 1024]
                    near = np.zeros((len(part), len(ids)))
                    # Summed in the order of the distance itself, so it never exceeds that of a point in the box.
                    for d in range(width):
                        gap = np.maximum(np.maximum(low[None, :, d] - part[:, d, None], part[:, d, None] - high[None, :, d]), 0)
                        near += gap * gap
                    same = own[at : at + 1024, None] == ids[None, :]
                    i, b = np.nonzero(same if home else ~same & (near <= bound[at : at + 1024, None]))
                    taken = pa.array(i + at)
                    yield pa.RecordBatch.from_arrays([batch.column("x").take(taken), batch.column("bound").take(taken), pa.array(ids[b]), pa.array(blocks[b])], ["x", "bound", "leaf", "blocks"])

        routed = durable(queries.select("x", "bound").mapInArrow(route, "x array<double>, bound double, leaf int, blocks int"))
        chunks = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"), F.max("blocks").alias("blocks"))
        asked = routed.join(chunks.drop("blocks"), "leaf").withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
        asked = asked.select("x", F.lit(None).cast(f"array<{self.kind}>").alias("keys"), "bound", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk")
        held = self.points.join(chunks, "leaf").withColumn("block", F.pmod(F.xxhash64("x", F.lit(1)), F.col("blocks")).cast("int"))
        held = held.select("x", "keys", F.lit(None).cast("double").alias("bound"), "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        meets = asked.unionByName(held).groupBy("leaf", "block", "chunk")
        return meets.applyInArrow(lambda t: first_points(t, width, k), f"x array<double>, y array<double>, keys array<{self.kind}>, distance double")


def nearest(queries: DataFrame, points: DataFrame, key: str, width: int, k: int, skip_self: bool = False) -> DataFrame:
    """(key, x, near) with the k nearest points as structs (distance, other, y), nearest first, ties by smaller key.

    Both frames hold key and vector x of `width` doubles. `distance` is the squared Euclidean distance, summed in the order of
    the dimensions. Rows whose vector is null or holds null or NaN, and points without a key, take no part; repeated rows count
    each. Fewer than k points give shorter lists, none empty ones. With `skip_self` a query doesn't meet its own key.
    """
    usable = F.col("x").isNotNull() & (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    # -0.0 and 0.0 are one place.
    clean = lambda df: df.where(usable).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    need = k + int(skip_self)
    tree = Tree(clean(points.where(F.col(key).isNotNull()).select(key, "x")), key, width, need)
    asks = durable(clean(queries.select(key, "x")))
    places = durable(asks.select("x").distinct().withColumn("bound", F.lit(float("inf"))))

    def best(found: DataFrame) -> DataFrame:
        each = found.select("x", "distance", "y", F.explode("keys").alias("other"))
        return each.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("distance", "other"))).where(F.col("r") <= need)

    first = durable(best(tree.visit(places, need, home=True)))
    bounds = first.where(F.col("r") == need).select("x", F.col("distance").alias("kth"))
    wider = places.join(bounds, "x", "left").select("x", F.coalesce("kth", "bound").alias("bound"))
    second = best(tree.visit(wider, need, home=False))
    both = first.drop("r").unionByName(second.drop("r"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("distance", "other"))).where(F.col("r") <= need)
    # At most k + 1 structs in a list.
    lists = ranked.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("distance", "other", "y"))).alias("all"))
    joined = asks.join(lists, "x", "left")
    others = F.filter("all", lambda n: n["other"] != F.col(key)) if skip_self else F.col("all")
    nothing = F.array().cast(f"array<struct<distance:double,other:{tree.kind},y:array<double>>>")
    return joined.select(key, "x", F.coalesce(F.slice(others, 1, k), nothing).alias("near"))


def tomek_links(df: DataFrame, label: str, columns: Sequence[str], key: str) -> DataFrame:
    """(key, other): pairs of rows of different classes that are each other's nearest row, each pair once.

    `key` must be unique. Rows with a null label or a null or NaN in `columns` take no part.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    rows = df.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("label"), x)
    near = durable(nearest(rows, rows, key, len(columns), 1, skip_self=True).where(F.size("near") == 1).select(key, F.col("near")[0]["other"].alias("other")))
    back = near.select(F.col(key).alias("other"), F.col("other").alias(key))
    mutual = near.join(back, [key, "other"]).where(F.col(key) < F.col("other"))
    labels = rows.select(key, "label")
    named = mutual.join(labels, key).join(labels.select(F.col(key).alias("other"), F.col("label").alias("other_label")), "other")
    return named.where("label <> other_label").select(key, "other")
