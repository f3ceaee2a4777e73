"""Named queries: `events` replayed as a stream.

A window or session leaves the stream when the watermark, the newest time minus the delay, has passed its end;
the SQL keeps the same ones.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from prismill.operators import cleaning, profiling
from prismill.plans.journal import _CACHE, WITH_TRACES
from prismill.plans.quality import WITH_GAPPY, _IQR, rounded
from prismill.plans.registry import Tables, named
from prismill.streaming import monitors, replay


def event_stream(t: Tables) -> DataFrame:
    return replay.file_stream(t.spark, t.folder, "events.parquet", t.events.schema)


def trace_stream(t: Tables) -> DataFrame:
    return event_stream(t).select(
        F.col("ts").cast("timestamp").alias("start_time"),
        F.col("event_type").alias("agent"),
        F.col("user_id").alias("correlation_id"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )


def _plain(df: DataFrame, *times: str) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in times else F.col(c) for c in df.columns])


@named(
    "stream_tumbling",
    f"""{WITH_TRACES}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, start_time) AS s, * FROM traces)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, agent, COUNT(*) AS n_traces, COUNT(*) FILTER (WHERE NOT success) AS n_errors,
ROUND(AVG(latency_ms), 10) AS mean_latency FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT MAX(start_time) FROM traces) - INTERVAL 2 HOUR GROUP BY s, agent""",
)
def stream_tumbling(t: Tables) -> DataFrame:
    found = replay.run_to_table(monitors.trace_windows(trace_stream(t), "1 hour", "2 hours"))
    return rounded(_plain(found.drop("p95_latency"), "window_start", "window_end"), 10)


@named(
    "stream_sliding",
    f"""{WITH_TRACES}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, start_time) - i * INTERVAL 6 HOUR AS s, traces.* FROM traces, range(0, 4) r(i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, agent, COUNT(*) AS n_traces, COUNT(*) FILTER (WHERE NOT success) AS n_errors,
ROUND(AVG(latency_ms), 10) AS mean_latency FROM w WHERE s + INTERVAL 1 DAY <= (SELECT MAX(start_time) FROM traces) - INTERVAL 1 HOUR GROUP BY s, agent""",
)
def stream_sliding(t: Tables) -> DataFrame:
    found = replay.run_to_table(monitors.trace_windows(trace_stream(t), "1 day", "1 hour", "6 hours"))
    return rounded(_plain(found.drop("p95_latency"), "window_start", "window_end"), 10)


@named(
    "stream_sessions",
    f"""{WITH_TRACES}, g AS (SELECT *, CASE WHEN start_time < LAG(start_time) OVER u + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM traces WINDOW u AS (PARTITION BY correlation_id ORDER BY start_time)),
s AS (SELECT *, SUM(opens) OVER (PARTITION BY correlation_id ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS n FROM g),
a AS (SELECT correlation_id, MIN(start_time) AS b, MAX(start_time) + INTERVAL 6 HOUR AS e, COUNT(*) AS n_operations, SUM(latency_ms) AS total, bool_and(success) AS all_successful FROM s GROUP BY correlation_id, n)
SELECT correlation_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS session_end, n_operations, ROUND(total, 6) AS total_latency, all_successful FROM a
WHERE e <= (SELECT MAX(start_time) FROM traces) - INTERVAL 1 HOUR""",
)
def stream_sessions(t: Tables) -> DataFrame:
    found = replay.run_to_table(monitors.request_sessions(trace_stream(t), "6 hours", "1 hour"))
    return rounded(_plain(found, "session_start", "session_end"))


@named("stream_first_arrivals", "SELECT event_id, event_type, value FROM events")
def stream_first_arrivals(t: Tables) -> DataFrame:
    """Every event sent twice, kept once."""
    timed = lambda: event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    once = monitors.first_arrivals(timed().unionByName(timed()), ["event_id"], "ts", "40 days")
    return replay.run_to_table(once.select("event_id", "event_type", "value"))


@named(
    "stream_cleaning",
    WITH_GAPPY
    + f""", m AS (SELECT quantile_cont(value, 0.5) AS m FROM gappy), b AS ({_IQR.replace("{c}", "value").replace("{t}", "events")})
SELECT event_id, ROUND(greatest(lower, least(upper, COALESCE(value, m))), 6) AS value FROM gappy, m, b WHERE user_id >= 10""",
)
def stream_cleaning(t: Tables) -> DataFrame:
    """Fits from the stored events, applied to the stream."""
    gaps = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    imputer = cleaning.fit_imputer(t.events.select(gaps))
    bounds = profiling.fit_bounds(t.events, ["value"])
    stream = event_stream(t).select("event_id", "user_id", gaps)
    cleaned = monitors.clean_and_score(stream, imputer, bounds, [cleaning.Rule("user_id", 10)])
    return rounded(replay.run_to_table(cleaned.select("event_id", "value")))


@named(
    "stream_scoring",
    """WITH f AS (SELECT regr_slope(value, user_id) AS a, regr_intercept(value, user_id) AS b FROM events) SELECT event_id, ROUND(a * user_id + b, 4) AS prediction FROM events, f""",
)
def stream_scoring(t: Tables) -> DataFrame:
    stages = [VectorAssembler(inputCols=["user_id"], outputCol="features"), LinearRegression(labelCol="value", solver="normal")]
    model = Pipeline(stages=stages).fit(t.events.select("user_id", "value"))
    scored = monitors.clean_and_score(event_stream(t).select("event_id", "user_id"), score=model)
    return rounded(replay.run_to_table(scored.select("event_id", "prediction")), 4)


@named(
    "stream_cache",
    _CACHE
    + """, m AS (SELECT cache_key, COUNT(*) AS n_misses FROM c WHERE cached_at IS NOT NULL GROUP BY cache_key), n AS (SELECT cache_key, COUNT(*) AS n FROM r GROUP BY cache_key)
SELECT cache_key, n - n_misses AS n_hits, n_misses FROM n JOIN m USING (cache_key)""",
)
def stream_cache(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit("Question "), (F.col("user_id") % 20).cast("string"))
    requests = event_stream(t).select(F.col("event_id").alias("request_id"), F.col("event_type").alias("model"), prompt.alias("prompt"), F.col("ts").alias("requested_at"))
    hits = replay.run_to_table(monitors.cache_hits(requests, 36000, "1 hour"))
    return hits.groupBy("cache_key").agg(F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"))


@named(
    "stream_drift",
    """WITH b AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), s AS (SELECT event_type, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM events) AS x FROM events GROUP BY 1),
c AS (SELECT event_type, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM b) AS y FROM b GROUP BY 1), u AS (SELECT value, 1 AS now FROM events UNION ALL SELECT value, 0 FROM b),
k AS (SELECT value, SUM(SUM(now)) OVER w * 1.0 / SUM(SUM(now)) OVER () AS f1, SUM(SUM(1 - now)) OVER w * 1.0 / SUM(SUM(1 - now)) OVER () AS f2 FROM u GROUP BY value WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT 'share' AS kind, event_type AS name, CAST(ROUND(abs(x - y), 6) AS DOUBLE) AS value, abs(x - y) > 0.05 AS drifted FROM s JOIN c USING (event_type)
UNION ALL SELECT 'distance', 'value', CAST(ROUND(MAX(abs(f1 - f2)), 6) AS DOUBLE), false FROM k""",
)
def stream_drift(t: Tables) -> DataFrame:
    baseline = t.events.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_type", "value")
    found = monitors.drift_monitor(event_stream(t).select("event_type", "value"), baseline, ["value"], "event_type", replay.scratch(t.spark, "drift"))
    return rounded(found.drop("batch"))
