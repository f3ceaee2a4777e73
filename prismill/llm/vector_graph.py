"""Near-duplicate vectors by a robust-pruned flat graph.

Tight groups are first collapsed into balls, so a group of copies of any size becomes one node. Ball centres are dealt to
overlapping cluster shards of bounded size; each shard builds pruned neighbour lists, the lists of a node are united, and a
greedy search from the shard's medoid, widened over everything in range, finds the candidate pairs of every node. Pairs are
then verified in double precision: whole balls by the triangle inequality of angles, the rest vector by vector in blocks.
Recall is audited against brute force, and the shards overlap more if it is short.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismill.llm.components import components
from prismill.llm.text import require
from prismill.session import durable

# Rows that the cluster centres are fitted on, rows per cluster aimed at, most clusters, rows of a group in one task.
FIT_ROWS, PER_CELL, MOST_CELLS, GROUP = 20_000, 400, 1024, 2_000
# Candidates and kept neighbours of a node, slack of the pruning, width of the search.
CANDIDATES, DEGREE, ALPHA, BEAM = 64, 32, 1.2, 24
AUDITED, RECALL = 256, 0.95
HAIR = 1e-7  # angles this close to a bound are decided vector by vector


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def stacked(column) -> np.ndarray:
    """Matrix of packed double vectors."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x) with packed unit vectors in double precision, of (id, vec). Rows that can link with nothing are left out."""
    sizes = vectors.where("vec IS NOT NULL").groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = sizes["width"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep, out = [], []
            for k, cell in enumerate(batch.column("vec")):
                if not cell.is_valid or len(cell) != width or cell.values.null_count:
                    continue
                v = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
                most = np.abs(v).max(initial=0.0)
                if not most or not np.isfinite(most):
                    continue
                v = v / most
                keep.append(k)
                out.append((v / np.linalg.norm(v)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["id", "x"])

    return vectors.where(F.col("id").isNotNull()).mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, x binary")


def fit_cells(units: DataFrame, rows: int, rounds: int = 6) -> np.ndarray:
    """Unit cluster centres by spherical k-means on at most FIT_ROWS vectors, those with the smallest hashes of their ids."""
    sample = units.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("x").toPandas()["x"]
    if not len(sample):
        return np.zeros((1, 1))
    x = stacked(sample)
    k = int(min(MOST_CELLS, max(1, math.ceil(rows / PER_CELL)), len(x)))
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        for c in range(k):
            total = x[near == c].sum(0)
            if np.linalg.norm(total) > 1e-9:
                centres[c] = total / np.linalg.norm(total)
    return centres


def dealt(balls: DataFrame, centres: np.ndarray, overlap: int, split: dict[int, int]) -> DataFrame:
    """`balls` once for each shard it belongs to: its `overlap` nearest clusters. In a crowded cluster the signs along random
    directions part it further, and a ball also goes across the sign it is least sure of. Columns shard, own (the first one)."""
    width = centres.shape[1]
    planes = np.random.default_rng(11).standard_normal((24, width))

    def run(batches: Iterator[pd.DataFrame]):
        for part in batches:
            if not len(part):
                continue
            x = stacked(part["x"])
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
            where, shard, own = [], [], []
            for i in range(len(x)):
                for rank, cell in enumerate(near[i].tolist()):
                    bits = split.get(cell, 0)
                    side = planes[:bits] @ x[i]
                    code = int(sum(1 << b for b in range(bits) if side[b] > 0))
                    codes = [code] if not bits else [code, code ^ (1 << int(np.argmin(np.abs(side))))]
                    for j, c in enumerate(codes):
                        where.append(i)
                        shard.append((cell << 24) | c)
                        own.append(rank == 0 and j == 0)
            out = part.iloc[where].copy()
            out["shard"], out["own"] = shard, own
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in balls.schema.fields)
    return balls.mapInPandas(run, f"{schema}, shard long, own boolean")


def ball_up(x: np.ndarray, radius: np.ndarray, count: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Greedy balls (member positions, centre, radius) of at most `reach`, around means."""
    apart = angles(x @ x.T) + radius[None, :]
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if not free[i]:
            continue
        member = np.flatnonzero(free & (apart[i] <= reach))
        centre, size = x[i], float(radius[i])
        if len(member) > 1:
            mean = (x[member] * count[member][:, None]).sum(0)
            mean /= np.linalg.norm(mean)
            far = angles(x @ mean) + radius
            wider = np.flatnonzero(free & (far <= reach))
            if i in wider and len(wider) >= len(member):
                member, centre, size = wider, mean, float(far[wider].max())
            else:
                size = float(apart[i][member].max())
        else:
            member = np.array([i])
        free[member] = False
        out.append((member, centre, size))
    return out


def collapse(units: DataFrame, centres: np.ndarray, reach: float, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(balls: ball, x, r, n; members: id, ball). A ball's id is its smallest member; any two of its members are within 2 * reach.

    Groups of GROUP rows at most are collapsed at a time; a crowded cluster is dealt to many such groups by a hash, and the
    balls of these meet in the next round.
    """
    kind = units.schema["id"].dataType.simpleString()
    balls = units.select(F.col("id").alias("ball"), "x", F.lit(0.0).alias("r"), F.lit(1).cast("bigint").alias("n"))
    members = None

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ball", kind="stable").reset_index(drop=True)
        x, names = stacked(part["x"]), part["ball"].to_numpy()
        rows = []
        for member, centre, size in ball_up(x, part["r"].to_numpy(), part["n"].to_numpy().astype(np.float64), reach):
            first, total = names[member[0]], int(part["n"].to_numpy()[member].sum())
            for k, m in enumerate(member):
                rows.append((names[m], first, centre.tobytes() if k == 0 else None, size, total))
        return pd.DataFrame(rows, columns=["old", "ball", "x", "r", "n"])

    for _ in range(rounds):
        placed = durable(dealt(balls, centres, 1, {}))
        counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
        grouped = placed.join(counts, "shard").withColumn("salt", F.pmod(F.xxhash64("ball"), F.ceil(F.col("rows") / GROUP)))
        merged = durable(grouped.select("shard", "salt", "ball", "x", "r", "n").groupBy("shard", "salt").applyInPandas(merge, f"old {kind}, ball {kind}, x binary, r double, n long"))
        step = merged.select("old", "ball")
        members = step.withColumnRenamed("old", "id") if members is None else durable(members.withColumnRenamed("ball", "old").join(step, "old").select("id", "ball"))
        balls = merged.where("x IS NOT NULL").select("ball", "x", "r", "n")
        if not counts.where(F.col("rows") > GROUP).head(1):
            break
    return balls, members


def prune(x: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Robust-pruned neighbour positions of each row: the nearest first, and none that a kept one is ALPHA times nearer to."""
    near = x @ x.T
    np.fill_diagonal(near, -2.0)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near))
    most, out = min(CANDIDATES, len(x) - 1), []
    for i in range(len(x)):
        if most < 1:
            out.append(np.empty(0, np.int64))
            continue
        pool = np.argpartition(-near[i], most - 1)[:most]
        pool = pool[np.argsort(apart[i][pool], kind="stable")]
        kept = []
        while len(pool) and len(kept) < degree:
            best, pool = pool[0], pool[1:]
            kept.append(best)
            pool = pool[ALPHA * apart[best][pool] > apart[i][pool]]
        out.append(np.array(kept, np.int64))
    return out


def search(x: np.ndarray, r: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, entry: int, reach: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, positions in range): greedy from the entry and the query's own node, then on through everything in range."""
    stamp = np.full(len(x), -1, np.int64)
    cosine = np.zeros(len(x))
    for q in queries:
        limit = reach + r[q] + r
        seen, heap, best, waiting = [], [], [], []

        def visit(new):
            stamp[new] = q  # noqa: B023
            cosine[new] = x[new] @ x[q]  # noqa: B023
            seen.extend(new.tolist())  # noqa: B023
            inside = angles(cosine[new]) <= limit[new]  # noqa: B023
            for p, c, near in zip(new.tolist(), cosine[new].tolist(), inside.tolist()):
                heapq.heappush(heap, (-c, p))  # noqa: B023
                if near:
                    waiting.append(p)  # noqa: B023

        visit(np.unique(np.array([entry, q])))
        done = set()
        while heap:
            c, p = heapq.heappop(heap)
            if len(best) >= BEAM and -c < best[0]:
                break
            if p in done:
                continue
            done.add(p)
            heapq.heappush(best, -c)
            if len(best) > BEAM:
                heapq.heappop(best)
            new = lists[p][stamp[lists[p]] != q]
            if len(new):
                visit(new)
        while waiting:
            p = waiting.pop()
            if p in done:
                continue
            done.add(p)
            new = lists[p][stamp[lists[p]] != q]
            if len(new):
                visit(new)
        found = np.array([p for p in seen if p != q], np.int64)
        yield q, found[angles(cosine[found]) <= limit[found]] if len(found) else found


def candidate_pairs(balls: DataFrame, centres: np.ndarray, overlap: int, reach: float) -> DataFrame:
    """(u, v) with u < v: pairs of balls whose members may be within `reach`."""
    kind = balls.schema["ball"].dataType.simpleString()
    first = dealt(balls.select("ball", "x", "r"), centres, overlap, {})
    crowded = first.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP).collect()  # one row per cluster at most
    split = {r["shard"] >> 24: math.ceil(math.log2(r["rows"] / GROUP)) for r in crowded}
    placed = durable(dealt(balls.select("ball", "x", "r"), centres, overlap, split))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        names = part["ball"].to_numpy()
        return pd.DataFrame({"ball": names, "near": [names[k].tolist() for k in prune(stacked(part["x"]))]})

    lists = placed.select("shard", "ball", "x").groupBy("shard").applyInPandas(build, f"ball {kind}, near array<{kind}>")
    graph = durable(lists.groupBy("ball").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")))
    inside = placed.join(graph, "ball")
    # Neighbours that the union brought from other shards come along, with their own lists.
    ends = inside.select("shard", F.explode("near").alias("ball")).distinct().join(placed.select("shard", "ball"), ["shard", "ball"], "left_anti")
    outer = ends.join(balls.select("ball", "x", "r"), "ball").join(graph, "ball").select("shard", "ball", "x", "r", F.lit(False).alias("own"), "near")
    everything = inside.select("shard", "ball", "x", "r", "own", "near").unionByName(outer)

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ball", kind="stable").reset_index(drop=True)
        x, names, own = stacked(part["x"]), part["ball"].to_numpy(), np.flatnonzero(part["own"].to_numpy())
        place = {name: k for k, name in enumerate(names.tolist())}
        lists = [np.array([place[b] for b in near if b in place], np.int64) for near in part["near"]]
        entry = int(np.argmax(x @ x.mean(0)))
        rows = [(names[q], names[p]) if names[q] < names[p] else (names[p], names[q]) for q, found in search(x, part["r"].to_numpy(), lists, own, entry, reach) for p in found]
        return pd.DataFrame(rows, columns=["u", "v"])

    return durable(everything.groupBy("shard").applyInPandas(find, f"u {kind}, v {kind}").distinct())


def verify(pairs: DataFrame, balls: DataFrame, members: DataFrame, units: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(counts: id, n; links: u, v). counts holds each vector's links, links join what is linked, not every pair of it."""
    reach = math.acos(least)
    kind = balls.schema["ball"].dataType.simpleString()
    a, b = (balls.select(F.col("ball").alias(e), F.col("x").alias(f"x{e}"), F.col("r").alias(f"r{e}"), F.col("n").alias(f"n{e}")) for e in "uv")

    def judge(batches: Iterator[pd.DataFrame]):
        for part in batches:
            if not len(part):
                continue
            cosine = np.einsum("ij,ij->i", stacked(part["xu"]), stacked(part["xv"]))
            apart, spread = angles(cosine), (part["ru"] + part["rv"]).to_numpy()
            alone = (part["nu"] == 1).to_numpy() & (part["nv"] == 1).to_numpy()
            how = np.where(apart + spread <= reach - HAIR, "all", np.where(apart - spread > reach + HAIR, "none", "some"))
            how[alone] = np.where(cosine[alone] >= least, "all", "none")
            yield pd.DataFrame({"u": part["u"], "v": part["v"], "nu": part["nu"], "nv": part["nv"], "how": how})

    judged = durable(pairs.join(a, "u").join(b, "v").mapInPandas(judge, f"u {kind}, v {kind}, nu long, nv long, how string"))
    whole = judged.where("how = 'all'")
    per_ball = whole.select(F.col("u").alias("ball"), F.col("nv").alias("n")).unionAll(whole.select(F.col("v").alias("ball"), F.col("nu").alias("n")))
    per_ball = per_ball.groupBy("ball").agg(F.sum("n").alias("more"))
    inner = members.join(balls.select("ball", "n"), "ball").join(per_ball, "ball", "left").select("id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n"))

    # The rest is compared vector by vector, in blocks of GROUP rows a side.
    partly = judged.where("how = 'some'")
    vectors = members.join(units, "id")
    blocks = lambda n: F.ceil(F.col(n) / GROUP)
    one = partly.join(vectors.withColumnRenamed("ball", "u"), "u").withColumn("i", F.pmod(F.xxhash64("id"), blocks("nu"))).select("u", "v", "id", "x", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks("nv") - 1)).alias("j"), F.lit(0).alias("side"))
    other = partly.join(vectors.withColumnRenamed("ball", "v"), "v").withColumn("j", F.pmod(F.xxhash64("id"), blocks("nv"))).select("u", "v", "id", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks("nu") - 1)).alias("i"), "j", F.lit(1).alias("side"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        one, other = part[part["side"] == 0], part[part["side"] == 1]
        if not len(one) or not len(other):
            return pd.DataFrame(columns=["id", "n", "to"])
        linked = stacked(one["x"]) @ stacked(other["x"]).T >= least
        rows = []
        for ids, names, table in ((one["id"].to_numpy(), other["id"].to_numpy(), linked), (other["id"].to_numpy(), one["id"].to_numpy(), linked.T)):
            # Each vector names one partner: that joins all that are linked here.
            rows += [(ids[k], int(table[k].sum()), names[int(np.argmax(table[k]))]) for k in np.flatnonzero(table.any(1))]
        return pd.DataFrame(rows, columns=["id", "n", "to"])

    some = durable(one.unionByName(other).groupBy("u", "v", "i", "j").applyInPandas(compare, f"id {kind}, n long, to {kind}"))
    counts = inner.unionAll(some.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    links = members.select(F.col("id").alias("u"), F.col("ball").alias("v")).unionAll(whole.select("u", "v")).unionAll(some.select(F.col("id").alias("u"), F.col("to").alias("v")))
    return counts, links


def audit(units: DataFrame, counts: DataFrame, least: float) -> float:
    """Share of the true links of at most AUDITED vectors, those with the smallest hashes, that were found; by brute force against all."""
    asked = units.orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(AUDITED).toPandas()
    if not len(asked):
        return 1.0
    x, names = stacked(asked["x"]), asked["id"].tolist()
    kind = units.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]):
        for part in batches:
            if len(part):
                yield pd.DataFrame({"id": names, "n": (x @ stacked(part["x"]).T >= least).sum(1)})

    true = units.mapInPandas(run, f"id {kind}, n long").groupBy("id").agg((F.sum("n") - 1).alias("true"))
    row = true.join(counts, "id", "left").agg(F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("f")).first()
    return row["f"] / row["t"] if row["t"] else 1.0


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: its links with cosine >= `least`, and its component's smallest id.

    * Null and zero vectors, vectors with null or non-finite components, and those of another than the usual width link with
      nothing: n_links 0, their own component, kept. A row without an id likewise, with null in the last two.
    * Equal vectors link like others. Rows that repeat an id stand for its first vector: all get the same result.
    * Other columns of `vectors` don't matter. No rows: no rows.

    Shards overlap in 2, then 4, then 8 clusters until the audited recall reaches RECALL; below 0.9 it raises.
    """
    require(vectors, id_col, vec_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    units = durable(unit_vectors(rows).groupBy("id").agg(F.min("x").alias("x")))
    n = units.count()
    centres = fit_cells(units, n)
    balls, members = collapse(units, centres, 0.49 * math.acos(least))
    recall = 0.0
    for overlap in (2, 4, 8):
        pairs = candidate_pairs(balls, centres, overlap, math.acos(least))
        counts, links = verify(pairs, balls, members, units, least)
        counts = durable(counts)
        recall = audit(units, counts, least)
        if recall >= RECALL or overlap >= len(centres):
            break
    if recall < 0.9:
        raise RuntimeError(f"the audited recall is {recall:.3f}")
    found = counts.join(components(links), counts["id"] == F.col("node"), "left").select(F.col("id").alias("node"), "n", "component")
    out = rows.select("id").join(found, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
