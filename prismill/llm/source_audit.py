"""How far the sources of a language diverge in their words: identical texts are collapsed before anything is tokenised.

Equal texts of a language become one row with its multiplicity in each source. A text is tokenised once; its terms add their
counts, weighted by the multiplicities, to their sources. Terms that enough documents hold become posting lists over
sources. The divergence of two sources is a closed form over each source's own counts, as if no term were shared, and
corrections for shared terms only, which are summed from the posting lists in blocks of sources. All arithmetic is whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismill.llm.text import require
from prismill.session import durable

# Of each byte: A-Z in lower case, letters and bytes of other characters as they are, a blank for the rest of ASCII.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
SHARE = 1_000_000_000
# Sources of a text in one row, sources of one side of a matrix of sums, matrices that a task holds.
SOURCES, BLOCK, HELD = 512, 512, 64
# Terms that a task counts before it hands them on, and parts that the sources of one language are dealt to.
HELD_TERMS, SALTS = 1_000_000, 32


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SHARE * (count + 2) / (total + 2 * terms)), in decimals of 38 digits."""
    return F.expr(f"1 + ((cast({SHARE} as decimal(20,0)) * cast({count} + 2 as decimal(18,0))) div cast({total} + 2 * {terms} as decimal(18,0)))").cast("bigint")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SHARE + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, of): each text of a language once, with the structs (source, n) of its multiplicities.

    A text that stands in very many sources is split by source, so that no row grows without bound.
    """
    keyed = docs.select("lang", "source", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    counts = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("lang", "digest").agg(F.ceil(F.count(F.lit(1)) / SOURCES).alias("slices"))
    few = counts.join(wide, ["lang", "digest"]).withColumn("slice", F.pmod(F.xxhash64("source"), F.col("slices")))
    few = few.groupBy("lang", "digest", "slice").agg(F.collect_list(F.struct("source", "n")).alias("of"))
    # Map tasks keep one copy of a text, so a hot one reaches its task once per map task.
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(few, ["lang", "digest"]).select("lang", "text", "of")


def counted(texts: DataFrame) -> DataFrame:
    """(lang, term, all, df, entries) of (lang, text, of): entries are the structs (source, count) of a term.

    A task tokenises each of its texts once, adds up its sources in counters of at most HELD_TERMS terms, and hands on one
    row per term, so that a term crosses the network once per task and not once per source or document.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[tuple, Counter] = defaultdict(Counter)
        holding: dict[tuple, Counter] = defaultdict(Counter)

        def flush():
            code: dict[tuple, int] = {}
            keys, of, n, df = [], [], [], []
            for (lang, source), found in counts.items():
                keys += [code.setdefault((lang, term), len(code)) for term in found]
                of += [source] * len(found)
                n += found.values()
                df += map(holding[lang, source].__getitem__, found)
            counts.clear()
            holding.clear()
            order = np.argsort(np.array(keys, np.int64), kind="stable")
            cuts = pa.array(np.append(0, np.cumsum(np.bincount(keys, minlength=len(code)))), pa.int32())
            listed = (pa.ListArray.from_arrays(cuts, pa.array(values, kind).take(pa.array(order))) for values, kind in ((of, pa.string()), (n, pa.int64()), (df, pa.int64())))
            names = pa.array([k[0] for k in code], pa.string()), pa.array([k[1] for k in code], pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([*names, *listed], ["lang", "term", "sources", "counts", "dfs"])
            yield from (out.slice(k, 10_000) for k in range(0, out.num_rows, 10_000))

        for batch in batches:
            for lang, raw, of in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("of").to_pylist()):
                words = raw.as_py().translate(FOLD).split()
                if len(of) == 1 and of[0]["n"] == 1:
                    counts[lang, of[0]["source"]].update(words)
                    holding[lang, of[0]["source"]].update(set(words))
                    continue
                tf = Counter(words)
                for o in of:
                    into, held, n = counts[lang, o["source"]], holding[lang, o["source"]], o["n"]
                    for term, k in tf.items():
                        into[term] += k * n
                        held[term] += n
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield from flush()
        if counts:
            yield from flush()

    rows = texts.select("lang", F.col("text").cast("binary").alias("text"), "of").mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>, dfs array<long>")
    each = rows.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts", "dfs")).alias("e"))
    each = each.groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("count"), F.sum("e.dfs").alias("df"))
    return each.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "count")).alias("entries"))


def corrections(postings: DataFrame) -> DataFrame:
    """(lang, i, j, shift) with i < j: what shared terms change in the divergence of two sources, summed per pair.

    `postings` are (lang, entries) with entries (s, p, p0): a term's sources by number, the term's share and that of an
    absent term. A task adds up matrices of BLOCK by BLOCK sources and hands them on when it holds too many.
    """

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for (lang, bi, bj), grid in sums.items():
                i, j = np.nonzero(grid)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + bi * BLOCK, pa.int64()), pa.array(j + bj * BLOCK, pa.int64()), pa.array(grid[i, j])], ["lang", "i", "j", "shift"])
            sums.clear()

        for batch in batches:
            for lang, entries in zip(batch.column("lang").to_pylist(), batch.column("entries")):
                s, p, p0 = (entries.values.field(n).to_numpy() for n in ("s", "p", "p0"))
                order = np.argsort(s)
                s, p, p0 = s[order], p[order], p0[order]
                block = s // BLOCK
                edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                parts = [slice(a, b) for a, b in zip(edges, np.append(edges[1:], len(s)))]
                for x, left in enumerate(parts):
                    for right in parts[x:]:
                        key = (lang, int(block[left.start]), int(block[right.start]))
                        if key not in sums:
                            if len(sums) >= HELD:
                                yield from flush()
                            sums[key] = np.zeros((BLOCK, BLOCK), np.int64)
                        a, a0, b, b0 = p[left, None], p0[left, None], p[None, right], p0[None, right]
                        value = f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
                        if left is right:
                            value = np.triu(value, 1)
                        sums[key][np.ix_(s[left] % BLOCK, s[right] % BLOCK)] += value
        yield from flush()

    return postings.mapInArrow(run, "lang string, i long, j long, shift long").groupBy("lang", "i", "j").agg(F.sum("shift").alias("shift"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language diverge, and by which terms.

    * Nulls in the three columns count as ''. Terms are runs of letters and non-ASCII characters, A-Z in lower case. A
      language keeps the V terms that at least `least` of its documents hold.
    * A term that occurs `count` times in a source (or language) has p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being
      all its kept occurrences; f = floor((p - q)^2 / (p + q)).
    * Part `pair`: item is each other source of the language, value f summed over the kept terms, all ranks. Part `term`:
      item is each kept term of the source that is commoner there than in the language, value f, the first `top` ranks.
      Values descend, ties by the item's UTF-8. A source without kept terms has only pairs; V = 0 gives pairs of value 0.
    * Repeated rows count each; other columns don't matter; no rows: no rows. Counts must stay below 10^18.
    """
    require(docs, text_col, lang_col, source_col)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    kept = durable(counted(collapsed(docs)).where(F.col("df") >= least).drop("df"))

    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n_lang"))
    own = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source", "e.count").agg(F.count(F.lit(1)).alias("terms"))
    own = durable(own)  # how many kept terms of a source occur how often
    sizes = own.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"), F.sum("terms").alias("held"))
    groups = docs.select("lang", "source").distinct().join(whole, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n", "held"])
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    groups = durable(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v"))))

    # As if no term were shared: a source's own terms against the other's share of an absent term, from counts of counts.
    named = lambda s: groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("s").alias(s), F.col("p0").alias(f"p0_{s}"), F.col("held").alias(f"held_{s}"), "v")
    mine = own.join(groups.select("lang", "source", "s", "n", "v"), ["lang", "source"]).select("lang", F.col("s").alias("a"), share("count", "n", "v").alias("p"), "terms", F.pmod(F.xxhash64("s", "count"), F.lit(SALTS)).cast("int").alias("salt"))
    others = groups.select("lang", F.col("s").alias("b"), "p0", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    alone = mine.join(others, ["lang", "salt"]).where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * distance("p", "p0")).alias("alone"))

    terms = kept.select("lang", "term", "all", F.explode("entries").alias("e")).select("lang", "term", "all", "e.source", "e.count")
    terms = terms.join(groups.select("lang", "source", "s", "n", "n_lang", "v", "p0"), ["lang", "source"]).select("lang", "source", "term", "s", "p0", share("count", "n", "v").alias("p"), share("all", "n_lang", "v").alias("q"))
    shared = corrections(terms.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "p0")).alias("entries")).where(F.size("entries") > 1).select("lang", "entries"))

    pairs = named("i").join(named("j").drop("v"), "lang").where("i < j")
    one = lambda x, y, name: alone.select("lang", F.col("a").alias(x), F.col("b").alias(y), F.col("alone").alias(name))
    pairs = pairs.join(one("i", "j", "alone_i"), ["lang", "i", "j"], "left").join(one("j", "i", "alone_j"), ["lang", "i", "j"], "left").join(shared, ["lang", "i", "j"], "left")
    absent = (F.col("v") - F.col("held_i") - F.col("held_j")) * distance("p0_i", "p0_j")
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("alone_i", "alone_j", "shift")), F.coalesce(absent, F.lit(0))).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item")))).alias("e")
    pairs = pairs.select("lang", value.alias("value"), ends).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    words = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").cast("bigint").alias("value"))
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(words)
