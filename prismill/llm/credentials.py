"""Secrets in texts: base patterns, and weak parts that only count together.

A lone user name, a short password or a bare random-looking string says little. Such weak parts are reported when a
complementary part stands near: the parts of a document are joined on intervals of positions (a bucketed equi-join),
so that no pairs beyond the reach of a scope are formed. Only spans leave the scan; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismill.llm.text import require
from prismill.session import durable

# The base patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "login", "string", "phrase", "endpoint")
# Weak parts: who (login), what (string, phrase), where (endpoint).
LOGIN = r"""(?i)(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,64}"""
STRING = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]{0,63}[0-9])(?=[a-z0-9+/_-]{0,63}[A-Z])(?=[A-Z0-9+/_-]{0,63}[a-z])[A-Za-z0-9+/_-]{20,64}(?![A-Za-z0-9+/_-])"
PHRASE = r"""(?i)(?:password|passwd|pwd|pass|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!#@-]{4,}"""
ENDPOINT = r"""(?i)(?:(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})"""
# What completes what.
PARTNERS = {"login": ("string", "phrase", "hex", "assign"), "string": ("login", "endpoint", "access"), "phrase": ("login", "endpoint"), "endpoint": ("string", "phrase")}


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches, in code points.

    Splitting gives the gaps between the matches; running totals over gaps and matches give their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    wide = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.zip_with(
        F.slice(F.transform(gaps, lambda g: F.length(g)), 1, F.size(found)),
        F.zip_with(found, wide, lambda m, w: F.struct(F.length(m).alias("n"), F.length(w).alias("w"))),
        lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["w"].alias("w")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,w:int>>").alias("out"))
    walked = F.aggregate(
        parts,
        start,
        lambda s, p: F.struct(
            (s["at"] + p["gap"] + p["n"]).alias("at"),
            F.concat(
                s["out"],
                F.array(F.struct((s["at"] + p["gap"]).alias("start"), (s["at"] + p["gap"] + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["w"].alias("w"))),
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    cut = F.transform(F.filter(walked, lambda x: x["w"] >= least), lambda x: F.struct(x["start"], x["end"], x["kind"]))
    return F.when(text.rlike(pattern), cut).otherwise(none)


def written(parts: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    rank = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(i) for i in range(len(KINDS))]))
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"], F.element_at(rank, p["kind"]).alias("rank"), p["end"], p["kind"])))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def linked_parts(found: DataFrame, reach: int) -> DataFrame:
    """(rid, linked): the weak parts of each row that have a complementary part within `reach` code points.

    Both sides are cut into buckets of `reach` positions. A bucket holds few parts, since parts of one kind don't overlap.
    """
    each = found.select("rid", F.explode(F.concat("base", "weak")).alias("p")).select("rid", "p.start", "p.end", "p.kind")
    want = F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    asks = each.where(F.col("kind").isin(*PARTNERS)).withColumn("bucket", F.floor(F.col("start") / reach))
    # A part answers in all buckets from which it can be reached.
    answers = each.where(F.col("kind").isin(*sorted({p for v in PARTNERS.values() for p in v}))).select(
        "rid", F.explode(F.sequence(F.floor(F.col("start") / reach) - 1, F.floor(F.col("end") / reach) + 1)).alias("bucket"),
        F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("kind").alias("o_kind"),
    )
    near = (F.col("o_start") <= F.col("end") + reach) & (F.col("o_end") >= F.col("start") - reach) & ((F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start")))
    completes = F.array_contains(F.element_at(want, F.col("kind")), F.col("o_kind"))
    return asks.join(answers, ["rid", "bucket"]).where(near & completes).groupBy("rid").agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))


def find_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per input row: id_col, base and linked as arrays of (start, end, kind), by start.

    * base: assignments whose value has 8 characters or more, access identifiers of 16 or more, runs of 32 or more hex digits.
    * linked: weak parts (login, string, phrase, endpoint) outside base spans with a complementary part at most `reach`
      code points away; see PARTNERS.
    * Null text counts as empty: no spans. Rows that repeat an id, or have none, are searched each for itself.
    * Other columns of `docs`, whatever their names, don't matter. No rows: no rows.

    The spans are written once to the checkpoint folder, so that the patterns run once.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans(text, ASSIGN, "assign", 2, 8), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    weak = F.concat(spans(text, LOGIN, "login"), spans(text, STRING, "string"), spans(text, PHRASE, "phrase"), spans(text, ENDPOINT, "endpoint"))
    outside = F.filter(F.col("weak"), lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = durable(rows.select("id", F.monotonically_increasing_id().alias("rid"), base.alias("base"), weak.alias("weak")).select("id", "rid", "base", outside.alias("weak")))
    linked = linked_parts(found.where(F.size("weak") > 0), reach)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return found.join(linked, "rid", "left").select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(F.coalesce("linked", none)).alias("linked"))
