"""Near-duplicate documents by Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Shingles are put in one global order, rare ones first. Two sets of similarity t that share k = ceil(t n) or more elements
share at least l elements of their first n - k + l. A document picks its own l: a longer prefix costs more postings but
asks for more shared elements before a pair is verified; two documents must share the smaller of their two l.

How it runs: texts with equal words are one class. Shingle hashes are dealt by hash and counted once; only those that two
classes share return to their class, mostly a few hundredths. Postings of prefixes meet at pivots, so that a group of
copies is compared with a few of its members first; then only pairs of different components are compared, in blocks of
bounded size. No pair is left out, and no group is expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismill.llm.components import components
from prismill.llm.text import require
from prismill.session import durable

# Shingles that a map task holds before it hands them on, and that one counting group should hold.
FLUSH, BUCKET = 1_000_000, 2_000_000
# Documents from which very frequent shingles are told, and the share of them that makes a shingle one of these.
# This only decides where such a shingle is counted and that it comes last in the order; a miss costs time, not links.
HOT_SAMPLE, HOT_SHARE = 4096, 0.005
HOT = np.int32(2**31 - 1)
LONGEST = 6  # largest l
BLOCK = 256  # documents of one side of a block comparison


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    span = min(n, width)
    total = np.full(n - span + 1, 0x9E3779B97F4A7C15 * (span if n < width else width) & (2**64 - 1), np.uint64)
    for k in range(span):
        total = (total ^ hashes[k : n - span + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return np.unique(total)


def split_words(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes]]:
    """The lower-cased words of each text. bytes.lower() and bytes.split() know ASCII only, as wanted."""
    for text in batch.column(name).cast(pa.large_binary()):
        yield (text.as_py() or b"").lower().split()


def class_of(words: list[bytes]) -> tuple[int, int]:
    """96-bit digest of the word sequence: 64 bits and 32 bits."""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:12], "little")


def classes_of(docs: DataFrame) -> DataFrame:
    """(id, a, b) of (id, text)."""

    def run(batches):
        for batch in batches:
            keys = [class_of(words) for words in split_words(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["id", "a", "b"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, a long, b long")


def frequent(docs: DataFrame, width: int, rows: int) -> tuple[np.ndarray, float]:
    """Very frequent shingles by a bounded sample (at most HOT_SAMPLE documents as expected value), and shingles per document.

    At most (mean set size / HOT_SHARE) hashes reach the driver, whatever the table's size.
    """
    step = max(1, math.ceil(rows / HOT_SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)

    def run(batches):
        for batch in batches:
            found = [shingles(words, width) for words in split_words(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["t"])

    least = max(20, math.ceil(HOT_SHARE * min(rows, HOT_SAMPLE)))
    counted = sample.select("text").mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    hot = counted.where(F.col("n") >= least).select("t").toPandas()["t"].to_numpy(np.int64)
    mean = counted.agg(F.sum("n")).first()[0] or 0
    return np.sort(hot.view(np.uint64)), mean / max(1, min(rows, HOT_SAMPLE))


def hash_shift(buckets: int) -> int:
    """Bits that a shingle's hash leaves out: it has 48 and those that its bucket tells, 64 at most."""
    return 16 - min(16, buckets.bit_length() - 1)


def six_bytes(values: np.ndarray) -> bytes:
    """Values below 2^48, six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def dealt(docs: DataFrame, width: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows of packed arrays: the shingles of many classes that fall into one bucket. `hot` ones go by class, uncounted.

    A shingle is the quotient of its hash by the number of buckets. `size` is the set's in one entry of each class, 0 elsewhere.
    """
    shift = np.uint64(hash_shift(buckets))

    def pack(held: list[tuple[int, int, np.ndarray]]):
        sizes = np.array([len(s) for _, _, s in held], np.int64)
        a, b = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        tokens, doc = np.concatenate([h[2] for h in held]), np.repeat(np.arange(len(held)), sizes)
        is_hot = np.isin(tokens, hot, assume_unique=False) if len(hot) else np.zeros(len(tokens), bool)
        tokens = tokens >> shift
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(is_hot, (a[doc] % buckets) + buckets, bucket)
        order = np.argsort(bucket, kind="stable")
        tokens, doc, bucket = tokens[order], doc[order], bucket[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(first)
        owner, where, count = doc[at], bucket[at], np.diff(np.append(at, len(doc))).astype(np.uint32)
        size = np.zeros(len(owner), np.uint32)
        home = np.unique(owner, return_index=True)[1]
        size[home] = sizes[owner[home]]
        count = count.astype(f"<u{1 if count.max() < 256 else 2 if count.max() < 65536 else 4}")
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        ends = np.append(cuts[1:], len(where))
        starts = np.append(at, len(doc))
        for lo, hi in zip(cuts, ends):
            part, uncounted = tokens[starts[lo] : starts[hi]], bool(where[lo] >= buckets)
            yield (
                int(where[lo] % buckets), uncounted, a[owner[lo:hi]].tobytes(), b[owner[lo:hi]].astype("<u4").tobytes(),
                size[lo:hi].tobytes(), count[lo:hi].tobytes(), part.tobytes() if uncounted else six_bytes(part // np.uint64(buckets)),
            )

    def run(batches):
        seen, held, total = set(), [], 0

        def flush():
            rows = list(pack(held))
            held.clear()
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "hot", "a", "b", "size", "count", "tokens"])

        for batch in batches:
            for words in split_words(batch, "text"):
                key = class_of(words)
                if not words or key in seen:
                    continue
                seen.add(key)
                held.append((*key, shingles(words, width)))
                total += len(held[-1][2])
                if total >= FLUSH:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, hot boolean, a binary, b binary, size binary, count binary, tokens binary")


def count_bucket(table: pa.Table, buckets: int) -> pa.Table:
    """Rows of packed arrays (grp, a, b, n, count, tokens, dfs): of the classes of one bucket the shingles that two classes or
    more share, dealt to as many groups by class. n is -1 except where the entry reports the set's size."""
    rows: list[tuple] = []
    for hot in (False, True):
        part = table.filter(pa.compute.equal(table["hot"], hot))
        if not part.num_rows:
            continue
        get = lambda name, kind: np.frombuffer(b"".join(part[name].to_pylist()), kind)  # noqa: B023, E731
        a, b, size = get("a", np.int64), get("b", np.uint32), get("size", np.uint32)
        # Counts have the width that their row needs.
        count = np.concatenate([np.frombuffer(c, f"<u{4 * len(c) // len(n)}").astype(np.int64) for c, n in zip(part["count"].to_pylist(), part["size"].to_pylist())])
        if hot:
            tokens = get("tokens", np.uint64)
        else:
            tokens = from_six_bytes(b"".join(part["tokens"].to_pylist())) * np.uint64(buckets) + np.uint64(part["bucket"][0].as_py())
        order = np.lexsort((b, a))
        again = np.zeros(len(a), bool)
        again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        entry = np.repeat(np.arange(len(a)), count)
        keep = ~again[entry]
        entry, tokens = entry[keep], tokens[keep]
        if hot:
            dfs = np.full(len(tokens), HOT, np.int32)
        else:
            order = np.argsort(tokens, kind="stable")
            ranked = tokens[order]
            starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
            runs = np.diff(np.append(starts, len(ranked)))
            dfs = np.empty(len(tokens), np.int32)
            dfs[order] = np.repeat(np.minimum(runs, HOT - 1), runs)
            keep = dfs > 1
            entry, tokens, dfs = entry[keep], tokens[keep], dfs[keep]
        home = size > 0
        wanted = np.zeros(len(a), bool)
        wanted[entry] = True
        wanted = (wanted | home) & ~again
        lengths = np.bincount(entry, minlength=len(a))
        n = np.where(home, size.astype(np.int64), -1).astype(np.int32)
        first = np.cumsum(lengths) - lengths
        rank = np.argsort(a[wanted] % buckets, kind="stable")
        picked = np.flatnonzero(wanted)[rank]
        group = a[picked] % buckets
        at = np.repeat(first[picked] - (np.cumsum(lengths[picked]) - lengths[picked]), lengths[picked]) + np.arange(lengths[picked].sum())
        tokens, dfs, upto = tokens[at], dfs[at], np.append(0, np.cumsum(lengths[picked]))
        for lo, hi in runs_of(group):
            rows.append((
                int(group[lo]), a[picked[lo:hi]].tobytes(), b[picked[lo:hi]].tobytes(), n[picked[lo:hi]].tobytes(), lengths[picked[lo:hi]].astype(np.int32).tobytes(),
                tokens[upto[lo] : upto[hi]].tobytes(), dfs[upto[lo] : upto[hi]].tobytes(),
            ))
    names = ("grp", "a", "b", "n", "count", "tokens", "dfs")
    return pa.table([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(len(names))], names=list(names))


def runs_of(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal keys."""
    if not len(sorted_keys):
        return []
    cuts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(sorted_keys)).tolist()))


def choose_prefix(n: int, tokens: np.ndarray, dfs: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(l, prefix) for one set: `tokens` are its shared elements in the global order, the n - len(tokens) others come first.

    A candidate must share l elements, so at most (sum of document frequencies / l) candidates are verified, each at the cost
    of reading a set; probing costs a posting for each prefix element. The cheapest l wins.
    """
    alone, needed = n - len(tokens), -(-percent * n // 100)
    weights = np.cumsum(np.minimum(dfs, 1 << 20).astype(np.float64))
    best = None
    for l in range(1, min(LONGEST, needed) + 1):  # noqa: E741
        length = min(n - needed + l - alone, len(tokens))
        if length <= 0:
            cost = 0.0
        else:
            cost = length + weights[length - 1] * (0.05 + 1.0 / l)
        if best is None or cost < best[0]:
            best = (cost, l, length)
    return best[1], tokens[: max(0, best[2])]


def group_prefixes(table: pa.Table, percent: int) -> pa.Table:
    """(a, b, n, l, prefix, tokens) for the classes of one group; arrays are empty for classes that no other can resemble."""
    get = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    a, b, n, count, tokens, dfs = get("a", np.int64), get("b", np.uint32).astype(np.int64), get("n", np.int32), get("count", np.int32), get("tokens", np.int64), get("dfs", np.int32)
    entry = np.lexsort((b, a))
    owner = np.repeat(np.argsort(entry, kind="stable"), count)  # place of each token's entry in that order
    order = np.lexsort((tokens, dfs, owner))
    tokens, dfs = tokens[order], dfs[order]
    upto = np.append(0, np.cumsum(count[entry]))
    a, b, n = a[entry], b[entry], n[entry]
    same = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    sizes, ls, heads, sets = [], [], [], []
    for lo, hi in zip(same, np.append(same[1:], len(a))):
        t, d, size = tokens[upto[lo] : upto[hi]], dfs[upto[lo] : upto[hi]], int(n[lo:hi].max())
        rank = np.lexsort((t, d))
        l, prefix = choose_prefix(size, t[rank], d[rank], percent)  # noqa: E741
        sizes.append(size)
        ls.append(l)
        heads.append(prefix)
        sets.append(np.sort(t) if len(prefix) else t[:0])

    def listed(parts):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))

    return pa.table({"a": a[same], "b": b[same], "n": pa.array(sizes, pa.int32()), "l": pa.array(ls, pa.int32()), "prefix": listed(heads), "tokens": listed(sets)})


def alike(x: dict, y: dict, percent: int) -> bool:
    """Enough shared prefix elements, and then a Jaccard similarity of `percent` in whole numbers."""
    if 100 * min(x["n"], y["n"]) < percent * max(x["n"], y["n"]):
        return False
    if len(np.intersect1d(x["prefix"], y["prefix"], assume_unique=True)) < min(x["l"], y["l"]):
        return False
    both = len(np.intersect1d(x["tokens"], y["tokens"], assume_unique=True))
    return 100 * both >= percent * (x["n"] + y["n"] - both)


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs of structs x and y that are alike."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                get = lambda s: {"n": s["n"].as_py(), "l": s["l"].as_py()} | {k: s[k].values.to_numpy(zero_copy_only=False) for k in ("prefix", "tokens")}
                keep.append(alike(get(x), get(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, f"u {kind}, v {kind}")


def shared(lists: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct lists."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    out = np.zeros((len(lists), len(lists)), np.float32)
    if not len(owner):
        return out
    _, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    keep = count[code] > 1
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, (lo, lo + width))
        grid = np.zeros((len(lists), width), np.float32)
        grid[owner[i:j], code[i:j] - lo] = 1
        out += grid @ grid.T
    return out


def link_block(table: pa.Table, percent: int) -> pa.Table:
    """(u, v) that join components inside one block comparison: a spanning forest of the links, not all of them."""
    prefix = [x.values.to_numpy(zero_copy_only=False) for c in table["prefix"].chunks for x in c]
    tokens = [x.values.to_numpy(zero_copy_only=False) for c in table["tokens"].chunks for x in c]
    n, l = table["n"].to_numpy().astype(np.int64), table["l"].to_numpy()  # noqa: E741
    part = np.array(table["part"].to_pylist())
    code = np.unique(table["component"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    wanted = (code[:, None] != code[None, :]) & np.triu(np.ones((len(n), len(n)), bool), 1)
    if len(np.unique(part)) > 1:
        wanted &= part[:, None] != part[None, :]
    wanted &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if wanted.any():
        wanted &= shared([np.sort(p) for p in prefix]) >= np.minimum(l[:, None], l[None, :])
    kept = []
    if wanted.any():
        both = shared(tokens).astype(np.int64)
        wanted &= 100 * both >= percent * (n[:, None] + n[None, :] - both)
        root = list(range(int(code.max()) + 1))
        for i, j in zip(*np.nonzero(wanted)):
            a, b = int(code[i]), int(code[j])
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((i, j))
    ends = table["component"]
    return pa.table({"u": ends.take(pa.array([i for i, _ in kept], pa.int64())), "v": ends.take(pa.array([j for _, j in kept], pa.int64()))})


def cross_links(families: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components that share a family (node, pivot), all of them up to connectivity.

    A family's largest component needs no comparison with itself: its blocks meet only the blocks of the others.
    """
    member = families.unionByName(families.select(F.col("pivot").alias("node"), "pivot").distinct())
    member = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = member.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    family = counts.groupBy("pivot").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    # With one other member the pair has been verified against the pivot.
    family = family.where("parts > 1 AND all > 2").select(
        F.col("pivot"), F.col("most.component").alias("main"), F.ceil(F.col("most.n") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("others")
    )
    member = member.join(family, "pivot")
    is_main = F.col("component").eqNullSafe(F.col("main"))
    here = F.pmod(F.xxhash64(F.col("node"), F.lit("block")), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    with_others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1), lambda o: F.struct(F.lit("o").alias("kind"), F.least(o, here).alias("i"), F.greatest(o, here).alias("j")))
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("mains") - 1), lambda m: F.struct(F.lit("m").alias("kind"), m.alias("i"), here.alias("j")))
    main = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1), lambda o: F.struct(F.lit("m").alias("kind"), here.alias("i"), o.alias("j")))
    placed = member.select("node", "component", "pivot", is_main.alias("is_main"), here.alias("here"), F.explode(F.when(is_main, main).otherwise(F.concat(with_others, own))).alias("at"))
    # In a block with itself all pairs count, else only those of its two sides.
    part = F.when(F.col("at.kind") == "m", F.when(F.col("is_main"), -1).otherwise(-2)).otherwise(F.col("here")).cast("long")
    rows = placed.select("node", "component", "pivot", "at.kind", "at.i", "at.j", part.alias("part")).join(sets.select("node", "n", "l", "prefix", "tokens"), "node")
    kind = sets.schema["node"].dataType.simpleString()
    return rows.groupBy("pivot", "kind", "i", "j").applyInArrow(lambda table: link_block(table, percent), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, class_size, component_id) for each row: components of Jaccard similarity >= percent / 100.

    * Words are runs of non-blanks, A-Z in lower case. Fewer than `width` words are one shingle. Texts without words
      (null, empty, blank) have no shingle and no link: their component is their own id.
    * component_id is the smallest id reachable by links, itself included; a row without an id belongs to the component of
      its text but never names one. Rows that repeat an id or a text are alike: one class.
    * class_size: rows with the same words. Other columns of `docs` don't matter. No rows: no rows.
    """
    require(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.count()
    hot, mean = frequent(texts, width, rows)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(rows * mean / BUCKET))
    members = durable(classes_of(texts))
    named = members.groupBy("a", "b").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("class_size"))

    packed = "grp long, a binary, b binary, n binary, count binary, tokens binary, dfs binary"
    counted = dealt(texts, width, buckets, hot).groupBy("bucket").applyInArrow(lambda t: count_bucket(t, buckets), packed)
    known = counted.groupBy("grp").applyInArrow(lambda t: group_prefixes(t, percent), "a long, b long, n int, l int, prefix array<long>, tokens array<long>")
    classes = durable(named.join(known, ["a", "b"], "left"), rows)
    sets = classes.where("node IS NOT NULL AND size(prefix) > 0")

    postings = sets.select("node", F.explode("prefix").alias("t"))
    pivots = postings.groupBy("t").agg(F.min_by("node", F.xxhash64("node", F.col("t").bitwiseAND(3))).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    families = durable(postings.join(pivots.select("t", "pivot"), "t").where("node <> pivot").select("node", "pivot").distinct(), rows)
    met = families.count()
    whole = sets.select("node", F.struct("n", "l", "prefix", "tokens").alias("s"))
    pairs = families.join(whole.withColumnRenamed("s", "x"), "node").join(whole.select(F.col("node").alias("pivot"), F.col("s").alias("y")), "pivot")
    first = durable(verified(pairs.select(F.col("node").alias("u"), F.col("pivot").alias("v"), "x", "y"), percent), met)
    found = components(first, rows=met)
    second = components(cross_links(families, sets, found, percent), rows=met)
    merged = found.join(second.select(F.col("node").alias("component"), F.col("component").alias("higher")), "component", "left")
    merged = merged.select("node", F.coalesce("higher", "component").alias("component")).unionByName(second.join(found.select("node"), "node", "left_anti"))
    labels = classes.select("a", "b", "node", "n", "class_size").join(merged, "node", "left")
    out = members.join(labels.select("a", "b", "n", "class_size", F.coalesce("component", "node").alias("component")), ["a", "b"])
    wordless = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"),
        "class_size",
        F.when(wordless, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )
