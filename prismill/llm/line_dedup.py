"""Lines that several documents share are kept once, in the document with the smallest id.

Lines are exploded as 128-bit hashes, counted per hash, and the surviving lines are joined again by position.
Only hashes and ids are shuffled for the counting; a hot line is pre-aggregated by every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismill.llm.text import BLANKS, ascii_lower, free_name, require


def line_keys(text: Column) -> Column:
    """The normalised line of each \\n-separated line: stripped of blanks at both ends, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id_col, drop): per document the hashes of the lines it has to give up."""
    keys = F.array_distinct(F.filter(line_keys(F.coalesce(F.col(text_col), F.lit(""))), lambda k: F.length(k) >= min_chars))
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))
    seen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(hashed).alias("h")).select("id", "h.a", "h.b")
    if min_docs <= 2:
        often = seen.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        often = seen.groupBy("a", "b").agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs)
    return seen.join(often.select("a", "b", "first"), ["a", "b"]).where("id > first").groupBy(F.col("id").alias(id_col)).agg(F.collect_set("a").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with the kept text in `text_col`, plus n_lines (before) and n_dropped.

    * A key of at least `min_chars` code points that `min_docs` documents hold loses all its lines but those of the
      smallest id; repeats inside that document stay.
    * Null or empty text: one empty line, kept; the text becomes "".
    * Rows without an id are no documents for the count and keep their lines. Rows that repeat an id are one document.
    * The two counts take a free name (leading underscores) if `docs` has columns of that name. No rows: no rows.
    """
    require(docs, id_col, text_col)
    lost, drop = shared_lines(docs, id_col, text_col, min_chars, min_docs), free_name(docs.columns, "drop")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)

    def stays(line: Column) -> Column:
        key = F.btrim(ascii_lower(line), F.lit(BLANKS))
        return ~((F.length(key) >= min_chars) & F.array_contains(F.col(drop), F.xxhash64(key)))

    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, stays))
    n_lines, n_dropped = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_dropped")
    joined = docs.join(lost.withColumnRenamed("drop", drop), id_col, "left")
    out = {c: F.col(c) for c in docs.columns} | {text_col: F.array_join(kept, "\n")}
    return joined.select(
        *[v.alias(c) for c, v in out.items()],
        F.size(lines).cast("bigint").alias(n_lines),
        (F.size(lines) - F.size(kept)).cast("bigint").alias(n_dropped),
    )
