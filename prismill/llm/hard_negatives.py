"""Hard negatives of anchor vectors by threshold joins over an inverted index with suffix-norm bounds.

Vectors are dealt to cells around fitted centres and cut into blocks of bounded size; anchors visit only the blocks of cells
that can reach their threshold. In a block the dimensions lie as posting lists, the heaviest first. A row's last dimensions
have no postings where the norms left cannot reach the lowest threshold. Partial scores are accumulated dimension group by
dimension group, pairs are pruned by the norms that remain, and survivors are finished from the row itself. Thresholds start
high and are lowered for the anchors whose windows are not full, so most anchors never see the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.llm.text import require
from prismill.session import durable

# Rows that centres are fitted on, rows a centre stands for, most centres (pruning only, every row is searched).
FIT_ROWS, PER_CELL, MOST_CELLS = 20_000, 2_000, 256
# Rows of a block, anchors that meet it at once in a task and in one matrix, dimensions of a posting group.
BLOCK, ANCHORS, AT_ONCE, GROUP = 4_096, 16_384, 256, 8
# Thresholds in percent: of the anchor's own score for positives, of the positive's score for negatives. None: the window's end.
POSITIVE_STEPS, NEGATIVE_STEPS = (90, 50, 30, 15, None), (85, 70, None)
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def fit_centres(points: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Means of `cells` groups of the sample; they only decide which rows lie together."""
    centres = points[np.linspace(0, len(points) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        owner = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        for c in np.unique(owner):
            centres[c] = points[owner == c].mean(0)
    return centres


def matrix(column: pa.ChunkedArray | pa.Array, form: str) -> np.ndarray:
    """Rows of packed integers."""
    return np.frombuffer(b"".join(column.to_pylist()), form).reshape(len(column), -1)


def tails(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of each row from each cut on, with 0 behind the last."""
    squares = np.add.reduceat(rows.astype(np.float64) ** 2, cuts, axis=1)
    left = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return np.hstack([left * (1 + 1e-9), np.zeros((len(rows), 1))])


def reaching(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose inner product is at least the anchor's threshold."""
    width = rows.shape[1]
    cuts = list(range(0, width, GROUP))
    ends = [*cuts[1:], width]
    of_rows, of_anchors = tails(rows, cuts), tails(anchors, cuts)
    slack = 1e-9 * of_rows[:, 0].max() * of_anchors[:, 0].max() + 1e-6
    # How many groups of a row are indexed: what lies behind cannot reach the lowest threshold by itself.
    lowest = float(least.min())
    indexed = (of_rows[:, :-1] * of_anchors[:, :-1].max(0) + slack >= lowest).sum(1)
    order = np.argsort(-indexed, kind="stable")
    rows, of_rows, indexed = rows[order], of_rows[order], indexed[order]
    score = np.zeros((len(anchors), len(rows)), rows.dtype)
    open_pairs = np.ones(score.shape, bool)
    need = least.astype(np.float64)[:, None] - slack
    live = np.arange(len(rows))
    for g, (lo, hi) in enumerate(zip(cuts, ends)):
        live = live[indexed[live] > g]
        if not len(live):
            break
        score[:, live] += anchors[:, lo:hi] @ rows[live, lo:hi].T
        open_pairs[:, live] &= score[:, live] + of_anchors[:, g + 1, None] * of_rows[live, g + 1] >= need
        live = live[open_pairs[:, live].any(0)]
    at = np.arange(len(rows))
    open_pairs &= score + of_anchors[:, indexed] * of_rows[at, indexed] >= need
    i, j = np.nonzero(open_pairs)
    found = score[i, j]
    for e in np.unique(indexed[j]):
        if e < len(cuts):
            part = np.flatnonzero(indexed[j] == e)
            for k in range(0, len(part), 1 << 16):
                p = part[k : k + (1 << 16)]
                found[p] += (anchors[i[p], cuts[e] :] * rows[j[p], cuts[e] :]).sum(1)
    found = found.astype(np.int64)
    keep = found >= least[i]
    return i[keep], order[j[keep]], found[keep]


def first_in_windows(table: pa.Table, form: str, exact: type, k: int, same: bool) -> pa.Table:
    """The first k rows of a block for each window (key, lo, hi) of each anchor: (id, key, row, score)."""
    is_anchor = pa.compute.is_valid(table["windows"])
    anchors, rows = table.filter(is_anchor), table.filter(pa.compute.invert(is_anchor))
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        label = np.unique(np.array(rows["label"].to_pylist() + anchors["label"].to_pylist()), return_inverse=True)[1]
        row_label, anchor_label = label[: rows.num_rows], label[rows.num_rows :]
        row_id, anchor_id = rows["id"].to_numpy(), anchors["id"].to_numpy()
        x, q = matrix(rows["x"], form).astype(exact), matrix(anchors["x"], form).astype(exact)
        windows = anchors["windows"].to_pylist()
        most = max(map(len, windows))
        # Windows side by side; an anchor with fewer ones has empty ones behind.
        key, lo, hi = (np.array([[w[name] for w in ws] + [empty] * (most - len(ws)) for ws in windows], np.int64) for name, empty in (("key", 0), ("lo", HIGHEST), ("hi", LOWEST)))
        least = lo.min(1)
        ranked = np.argsort(-least, kind="stable")
        for k0 in range(0, len(ranked), AT_ONCE):
            part = ranked[k0 : k0 + AT_ONCE]
            i, j, score = reaching(x, q[part], least[part])
            i = part[i]
            keep = (row_label[j] == anchor_label[i]) == same
            keep &= row_id[j] != anchor_id[i]
            i, j, score = i[keep], j[keep], score[keep]
            order = np.lexsort((row_id[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            for w in range(most):
                inside = np.flatnonzero((score >= lo[i, w]) & (score <= hi[i, w]))
                owner = i[inside]
                start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
                rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
                got = inside[rank < k]
                out.append((anchor_id[i[got]], key[i[got], w], row_id[j[got]], score[got]))
    names = ("id", "key", "row", "score")
    return pa.table({n: np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c, n in enumerate(names)})


class Index:
    """Packed integer vectors in cells and blocks."""

    def __init__(self, rows: DataFrame, form: str, exact: type, centres: np.ndarray, order: np.ndarray):
        self.form, self.exact, self.centres = form, exact, centres

        def deal(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                ints = np.zeros((batch.num_rows, len(order)), np.int64)
                for n, values in enumerate(batch.column("x")):
                    values = values.values.to_numpy(zero_copy_only=False)
                    ints[n, : len(values)] = values
                ints = ints[:, order]
                near = (centres**2).sum(1) - 2 * ints @ centres.T
                cell = np.argmin(near, axis=1)
                far = np.sqrt(((ints - centres[cell]) ** 2).sum(1)) * (1 + 1e-9)
                packed = [r.tobytes() for r in ints.astype(form)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(cell, pa.int32()), pa.array(far)], ["id", "label", "x", "cell", "far"])

        dealt = durable(rows.mapInArrow(deal, "id long, label string, x binary, cell int, far double"))
        # One line per cell: at most MOST_CELLS.
        cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
        self.blocks = [math.ceil(cells[c].n / BLOCK) if c in cells else 0 for c in range(len(centres))]
        self.radius = np.array([cells[c].far if c in cells else 0.0 for c in range(len(centres))])
        self.rows = dealt.select("id", "label", "x", "cell", F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, self.blocks)), F.col("cell") + 1)).cast("int").alias("block"))

    def first(self, windows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(id, key, row, score): the first k rows of each window (id, key, lo, hi), all others pruned or compared."""
        form, exact, centres, radius, blocks = self.form, self.exact, self.centres, self.radius, np.array(self.blocks)
        asked = anchors.join(windows.groupBy("id").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("windows"), F.min("lo").alias("least")), "id")
        chunks = math.ceil(max(1, windows.select("id").distinct().count()) / ANCHORS)

        def route(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                q = matrix(batch.column("x"), form).astype(np.float64)
                norm = np.sqrt((q**2).sum(1))[:, None]
                most = q @ centres.T + norm * radius * (1 + 1e-9) + 1e-6 * (1 + norm)
                i, c = np.nonzero((most >= batch.column("least").to_numpy()[:, None]) & (blocks > 0))
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(i)) for n in ("id", "label", "x", "windows")], pa.array(c, pa.int32()), pa.array(blocks[c], pa.int32())], ["id", "label", "x", "windows", "cell", "blocks"])

        kinds = "id long, label string, x binary, windows array<struct<key:long,lo:long,hi:long>>"
        routed = asked.select("id", "label", "x", "windows", "least").mapInArrow(route, f"{kinds}, cell int, blocks int")
        routed = durable(routed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")))
        visiting = routed.select("cell", "chunk").distinct().groupBy("cell").agg(F.collect_list("chunk").alias("chunks"))
        rows = self.rows.join(visiting, "cell").select("id", "label", "x", F.lit(None).cast("array<struct<key:long,lo:long,hi:long>>").alias("windows"), "cell", "block", F.explode("chunks").alias("chunk"))
        visits = routed.select("id", "label", "x", "windows", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk")
        found = rows.unionByName(visits).groupBy("cell", "block", "chunk").applyInArrow(lambda t: first_in_windows(t, form, exact, k, same), "id long, key long, row long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "row")))
        return ranked.where(F.col("rank") <= k)


def filled(index: Index, windows: DataFrame, anchors: DataFrame, steps: tuple, k: int, same: bool) -> DataFrame:
    """The first k rows of every window (id, key, floor, hi, scale): thresholds are lowered until it holds k rows or ends."""
    left, done = windows, []
    for share in steps:
        lo = F.col("floor") if share is None else F.greatest("floor", F.floor(F.col("scale") * (share / 100)))
        left = left.withColumn("lo", lo)
        hits = durable(index.first(left.select("id", "key", "lo", "hi"), anchors, k, same))
        if share is None:
            return _union([*done, hits])
        short = left.where("lo > floor").join(hits.where(F.col("rank") == k).select("id", "key"), ["id", "key"], "left_anti")
        left = durable(short.drop("lo"))
        done.append(hits.join(left.select("id", "key"), ["id", "key"], "left_anti"))
        if not left.head(1):
            break
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mine_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among `vectors`.

    * A component x counts as floor(scale * x); a score is the integer inner product with the anchor. Higher scores come
      first, ties by smaller id. Positives are the first `positives` other rows of the anchor's label; a positive's
      negatives are the first `negatives` rows of other labels whose score is `low` to `high` percent of the positive's.
    * Rows with a null id, label or vector, or with a null or non-finite component take no part. Shorter vectors count as
      zero behind their end. Of rows that repeat an id the one with the smallest (label, vector) counts.
    * An anchor without positives, and a positive without negatives, has no row. No rows: no rows. Other columns of
      `vectors` don't matter; `is_anchor` is a condition on its columns. Scores must fit in 63 bits (ValueError).
    """
    require(vectors, id_col, label_col, vec_col)
    value = lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))
    unusable = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~F.exists("vec", unusable))
    rows = rows.select("id", "label", F.transform("vec", value).alias("x"), "anchor")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    width, largest = max(1, shape["width"] or 0), int(shape["largest"] or 0)
    if width * largest * largest >= 2**63 or largest >= 2**62:
        raise ValueError(f"scores of {width} components up to {largest} do not fit in 63 bits")
    form = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
    exact = np.float64 if width * largest * largest < 2**53 else np.int64

    step = max(1, math.ceil(shape["n"] / FIT_ROWS))
    sample = [r.x for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("x").limit(2 * FIT_ROWS).collect()]
    points = np.zeros((max(1, len(sample)), width))
    for n, x in enumerate(sample):
        points[n, : len(x)] = x
    order = np.argsort(-(points**2).sum(0), kind="stable")
    cells = max(1, min(MOST_CELLS, len(points), math.ceil(shape["n"] / PER_CELL)))
    centres = fit_centres(points[:, order], cells)

    unique = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("s"), F.max("anchor").alias("anchor"))
    index = Index(unique.select("id", "s.label", "s.x"), form, exact, centres, order)
    wanted = rows.where("anchor").select("id").distinct()
    anchors = durable(index.rows.join(wanted, "id").select("id", "label", "x"))
    own = unique.where("anchor").select("id", F.lit(0).cast("bigint").alias("key"), F.lit(LOWEST).alias("floor"), F.lit(HIGHEST).alias("hi"), F.aggregate("s.x", F.lit(0).cast("bigint"), lambda a, v: a + v * v).alias("scale"))
    first = durable(filled(index, durable(own), anchors, POSITIVE_STEPS, positives, True).select("id", F.col("row").alias("key"), F.col("score").alias("scale")))
    # 100 * score within low and high percent; a negative positive's window is empty.
    bound = lambda percent, up: F.expr(f"cast(((scale div 100) * {percent}) + {'ceil' if up else 'floor'}((scale % 100) * {percent} / 100.0BD) as bigint)")
    windows = first.where("scale >= 0").select("id", "key", bound(low, True).alias("floor"), bound(high, False).alias("hi"), "scale").where("floor <= hi")
    found = filled(index, windows, anchors, NEGATIVE_STEPS, negatives, False)
    return found.join(first, ["id", "key"]).select(
        F.col("id").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("row").alias("negative_id"), F.col("scale").alias("positive_score"), F.col("score").alias("negative_score"),
    )
