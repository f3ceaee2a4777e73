"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of each text; a chunk ends where the hash meets a mask. Cuts depend on the bytes just before
them, so an insertion moves few cuts and equal passages fall into equal chunks again. Chunks are counted by 128-bit digest;
only digests, ids and places are shuffled, and a hot chunk is pre-aggregated by every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismill.llm.text import require

# Bits that must be zero at a cut, least and most bytes of a chunk.
CUT_BITS, LEAST, MOST = 5, 16, 256
# Bytes in a row that must be shared before anything is dropped: shorter matches are turns of speech.
RUN = 120
# The gear table: one random number per byte, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def cuts(text: bytes) -> list[int]:
    """End positions of the chunks; the last one is the text's end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    # hash[i] = sum of GEAR[text[i - k]] << k for k < 32: the rolling hash of the last 32 bytes, by doubling.
    rolled = GEAR[np.frombuffer(text, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        rolled[shift:] += rolled[:-shift].copy() << np.uint32(shift)
    found, last = [], 0
    for at in (np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            found.append(last)
        if at - last >= LEAST:
            last = at
            found.append(last)
    while n - last > MOST:
        last += MOST
        found.append(last)
    if last < n:
        found.append(n)
    return found


def chunks(docs: DataFrame) -> DataFrame:
    """(id, a, b, at, start, size): digest, number, first byte and bytes of each chunk of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, digests, at, start, size = [], [], [], [], []
            for k, t in enumerate(batch.column("text").cast(pa.large_binary())):
                text, last = t.as_py() or b"", 0
                ends = cuts(text)
                for end in ends:
                    digests.append(xxhash.xxh3_128_digest(text[last:end]))
                    start.append(last)
                    size.append(end - last)
                    last = end
                row.extend([k] * len(ends))
                at.extend(range(len(ends)))
                if len(row) > 200_000:
                    yield packed(batch, row, digests, at, start, size)
                    row, digests, at, start, size = [], [], [], [], []
            yield packed(batch, row, digests, at, start, size)

    def packed(batch, row, digests, at, start, size):
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        ids = batch.column("id").take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(at, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
            ["id", "a", "b", "at", "start", "size"],
        )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, a long, b long, at int, start int, size int")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """(id_col, n_shared, n_dropped, spans, holders) for each id with a shared passage.

    A passage is a run of neighbouring chunks of `least_run` bytes or more, each of which another document has as well. Its
    chunks are kept in the smallest id that has them and dropped elsewhere: spans lists (start, end) of what is dropped, in
    bytes of the UTF-8 text; holders the ids that keep it. n_shared and n_dropped count chunks.

    * Null and empty texts have no chunks. Rows without an id take no part. Rows that repeat an id are one document: equal
      chunks at equal places count once.
    * Other columns of `docs` don't matter. No rows: no rows.
    """
    require(docs, id_col, text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    each = chunks(rows)
    often = each.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("a", "b", "first")
    shared = each.join(often, ["a", "b"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", "start", "size", "first"))).alias("parts"))
    kind = rows.schema["id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, parts in zip(batch.column("id").to_pylist(), batch.column("parts").to_pylist()):
                n, dropped, spans, holders, k = 0, 0, [], {}, 0
                while k < len(parts):
                    j = k + 1
                    while j < len(parts) and parts[j]["start"] <= parts[j - 1]["start"] + parts[j - 1]["size"]:
                        j += 1
                    part, k = parts[k:j], j
                    if part[-1]["start"] + part[-1]["size"] - part[0]["start"] < least_run:
                        continue
                    n += len(part)
                    for p in part:
                        if p["first"] == name:
                            continue
                        dropped += 1
                        holders[tuple(p["first"].values()) if isinstance(p["first"], dict) else p["first"]] = p["first"]
                        if spans and spans[-1][1] == p["start"]:
                            spans[-1][1] += p["size"]
                        else:
                            spans.append([p["start"], p["start"] + p["size"]])
                if n:
                    for column, value in zip(out, (name, n, dropped, spans, [holders[h] for h in sorted(holders)])):
                        column.append(value)
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(batch.schema.field("id").type)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "n_shared", "n_dropped", "spans", "holders"])

    found = shared.mapInArrow(runs, f"id {kind}, n_shared long, n_dropped long, spans array<array<long>>, holders array<{kind}>")
    return found.withColumnRenamed("id", id_col)


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """(id_col, text_col) of each row without the passages that shared_passages drops. Null texts become "".

    Rows that repeat an id with different texts are documents of their own here, in the order of a hash of their texts; rows
    that repeat id and text are one and keep or lose the same. Rows without an id stay as they are.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), text.alias(text_col), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("__row"))
    gone = shared_passages(rows.where(F.col(id_col).isNotNull()).select("__row", text_col), "__row", text_col, least_run).select("__row", "spans")
    joined = rows.join(gone, "__row", "left").select(id_col, text_col, "spans")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kept = []
            for t, spans in zip(batch.column(text_col).cast(pa.large_binary()), batch.column("spans").to_pylist()):
                text, last, parts = t.as_py(), 0, []
                for lo, hi in spans or ():
                    parts.append(text[last:lo])
                    last = hi
                # A cut inside a character leaves nothing of it.
                kept.append(b"".join([*parts, text[last:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(kept, pa.string())], [id_col, text_col])

    return joined.mapInArrow(cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{text_col}` string")
