"""Streaming twins of the trace, cleaning, cache and drift operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismill.functions.keys import prompt_key
from prismill.operators.cleaning import Imputer, Rule, clip, remove_invalid
from prismill.operators.statistics import counted_values, distance_of_counts
from prismill.streaming.replay import run_batches


def trace_windows(traces: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts, errors, mean and 95th percentile of latency per window and agent; rows later than the delay are dropped."""
    window = F.window("start_time", width, slide) if slide else F.window("start_time", width)
    return (
        traces.withWatermark("start_time", delay)
        .groupBy(window.alias("w"), "agent")
        .agg(
            F.count(F.lit(1)).alias("n_traces"),
            F.count_if(~F.col("success")).alias("n_errors"),
            F.avg("latency_ms").alias("mean_latency"),
            F.percentile_approx("latency_ms", 0.95, 1000).alias("p95_latency"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "agent", "n_traces", "n_errors", "mean_latency", "p95_latency")
    )


def request_sessions(traces: DataFrame, gap: str, delay: str) -> DataFrame:
    """Operations of one requester with pauses below the gap, as sessions."""
    return (
        traces.withWatermark("start_time", delay)
        .groupBy(F.session_window("start_time", gap).alias("w"), "correlation_id")
        .agg(F.count(F.lit(1)).alias("n_operations"), F.sum("latency_ms").alias("total_latency"), F.min("success").alias("all_successful"))
        .select("correlation_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_operations", "total_latency", "all_successful")
    )


def first_arrivals(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies arrive within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def clean_and_score(
    rows: DataFrame,
    imputer: Imputer | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    rules: Sequence[Rule] = (),
    score: Callable[[DataFrame], DataFrame] | PipelineModel | None = None,
) -> DataFrame:
    """Frozen fits applied row by row: fill, clip, drop invalid rows, score. No state is kept."""
    if imputer:
        rows = imputer.transform(rows)
    if bounds:
        rows = clip(rows, bounds)
    if rules:
        rows = remove_invalid(rows, rules)
    if score is None:
        return rows
    return score.transform(rows) if isinstance(score, PipelineModel) else score(rows)


def cache_hits(requests: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """(cache_key, request_id, requested_at, hit) per request of (request_id, model, prompt, requested_at).

    The state of a key is the start of its current entry; it is dropped once the watermark passes the entry's end.
    (A processing-time limit would keep an available-now run busy for ever.) Only times
    and ids of one key's share of a micro-batch are held at once, so that the trigger's size limit bounds the memory.
    """
    life = int(ttl_seconds) * 1_000_000

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, ids = [], []
        for chunk in chunks:
            times.append(chunk["at"].to_numpy("int64"))
            ids.append(chunk["request_id"].to_numpy("int64"))
        at, who = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((who, at))
        at, who = at[order], who[order]
        start = state.get[0] if state.exists else None
        hit = np.ones(len(at), dtype=bool)
        # A request from before the current entry finds nothing and stores nothing: that time is past.
        i = int(np.searchsorted(at, start)) if start is not None else 0
        hit[:i] = False
        while i < len(at):
            if start is None or at[i] >= start + life:
                start, hit[i] = int(at[i]), False
            # Everything before the end of the entry is a hit: jump there.
            i = max(i + 1, int(np.searchsorted(at, start + life)))
        state.update((start,))
        state.setTimeoutTimestamp((start + life) // 1000 + 1)
        yield pd.DataFrame({"cache_key": key[0], "request_id": who, "at": at, "hit": hit})

    timed = requests.withColumn("requested_at", F.col("requested_at").cast("timestamp")).withWatermark("requested_at", delay)
    keyed = timed.select(
        "requested_at",
        prompt_key(F.col("model"), F.col("prompt")).alias("cache_key"),
        F.col("request_id").cast("bigint").alias("request_id"),
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("requested_at").cast("timestamp_ntz")).alias("at"),
    )
    return keyed.groupBy("cache_key").applyInPandasWithState(
        follow, "cache_key string, request_id bigint, at bigint, hit boolean", "start bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def store_baseline(baseline: DataFrame, columns: Sequence[str], category: str, path: str) -> DataFrame:
    """Write and return (column_name, value, name, n): how often each number and each category occurs. One pass over
    the baseline; what later compares with it reads one row per distinct value."""
    numbers = counted_values(baseline, columns, n=F.count(F.lit(1))).select("column_name", "value", F.lit(None).cast("string").alias("name"), "n")
    names = baseline.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = names.select(F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("double").alias("value"), "name", "n")
    numbers.unionByName(names).write.mode("overwrite").parquet(path)
    return baseline.sparkSession.read.parquet(path)


def drift_monitor(
    stream: DataFrame, baseline: DataFrame, columns: Sequence[str], category: str, path: str, max_shift: float = 0.05, p_limit: float = 0.05
) -> DataFrame:
    """(batch, kind, name, value, drifted) per micro-batch: change of each category's share, and the distance of each
    numeric column from the baseline. A repeated batch overwrites its own rows.

    The baseline is read once, when the stream starts, and kept as counts below `path`; micro-batches join these.
    """
    spark = stream.sparkSession
    stored = store_baseline(baseline, columns, category, f"{path}/baseline")

    def shares(counts: DataFrame, name: str) -> DataFrame:
        total = counts.select(F.sum("n")).scalar()
        return counts.select("name", F.try_divide(F.col("n").cast("double"), total).alias(name))

    def check(batch: DataFrame, number: int) -> None:
        batch.persist()
        seen = batch.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        both = shares(seen, "now").join(shares(stored.where("name IS NOT NULL"), "before"), "name", "full")
        shift = F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
        report = both.select(F.lit("share").alias("kind"), "name", shift.alias("value"), (shift > max_shift).alias("drifted"))
        now = counted_values(batch, columns, a=F.count(F.lit(1))).withColumn("b", F.lit(0).cast("bigint"))
        before = stored.where("column_name IS NOT NULL").select("column_name", "value", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))
        distance = distance_of_counts(now.unionByName(before).groupBy("column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
        report = report.unionByName(
            distance.select(F.lit("distance").alias("kind"), F.col("column_name").alias("name"), F.col("distance").alias("value"), (F.col("p_value") < p_limit).alias("drifted"))
        )
        report.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        batch.unpersist()

    run_batches(stream, check, path)
    return spark.read.parquet(f"{path}/data").select(F.col("batch").cast("bigint").alias("batch"), "kind", "name", "value", "drifted")
