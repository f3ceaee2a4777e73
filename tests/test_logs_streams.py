"""Cache replay against plain Python, also with one hot key, and streams over several files against their batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from prismill.operators import logs
from prismill.streaming import monitors, replay

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests():
    draw = random.Random(11)
    keys = ["hot"] * 200 + [f"k{i % 20}" for i in range(400)]
    return [(i, "m", k, START + datetime.timedelta(seconds=draw.randint(0, 20000))) for i, k in enumerate(keys)]


def replayed(requests, ttl):
    entries, hits = {}, {}
    for i, _, key, at in sorted(requests, key=lambda r: (r[3], r[0])):
        last = entries.setdefault(key, [])
        hits[i] = bool(last) and at < last[-1] + datetime.timedelta(seconds=ttl)
        if not hits[i]:
            last.append(at)
    return entries, hits


SCHEMA = "request_id bigint, model string, prompt string, requested_at timestamp_ntz"


@pytest.mark.parametrize("ttl", [37, 600, 50000])
@pytest.mark.parametrize("slices", [1, 64])
def test_cache_entries(spark, requests, ttl, slices):
    entries, hits = replayed(requests, ttl)
    rows = spark.createDataFrame(requests, SCHEMA).repartition(4)
    got = sorted(r["cached_at"] for r in logs.cache_entries(rows, ttl, slices).collect())
    assert got == sorted(at for key in entries for at in entries[key])
    stats = logs.cache_statistics(rows, ttl, 0.5).first()
    assert (stats["n_hits"], stats["n_misses"]) == (sum(hits.values()), len(hits) - sum(hits.values()))


def test_cache_entries_of_no_request(spark):
    rows = spark.createDataFrame([(1, "m", "a", None)], SCHEMA)
    assert logs.cache_entries(rows, 60).count() == 0
    assert logs.cache_entries(rows.limit(0), 60).count() == 0


def write_in_files(spark, rows, schema, folder, parts, order):
    """One file per slice of time, so that each micro-batch brings the next slice."""
    rows = sorted(rows, key=order)
    size = len(rows) // parts + 1
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_cache_stream_over_batches(spark, requests, tmp_path):
    write_in_files(spark, requests, SCHEMA, tmp_path / "in", 5, lambda r: r[3])
    stream = replay.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)
    found = replay.run_to_table(monitors.cache_hits(stream, 600, "1 minute"), str(tmp_path / "out"))
    _, hits = replayed(requests, 600)
    assert {r["request_id"]: r["hit"] for r in found.collect()} == hits


def test_windows_over_batches(spark, requests, tmp_path):
    schema = "start_time timestamp, agent string, latency_ms double, success boolean"
    rows = [(r[3], r[2], float(r[0]), r[0] % 3 > 0) for r in requests]
    write_in_files(spark, rows, schema, tmp_path / "in", 4, lambda r: r[0])
    stream = replay.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, 1)
    found = replay.run_to_table(monitors.trace_windows(stream, "10 minutes", "5 minutes"), str(tmp_path / "out"))
    got = {(r["window_start"], r["agent"]): r["n_traces"] for r in found.collect()}
    want = {}
    for at, agent, _, _ in rows:
        start = START + datetime.timedelta(seconds=(at - START).total_seconds() // 600 * 600)
        want[(start, agent)] = want.get((start, agent), 0) + 1
    end = max(r[0] for r in rows) - datetime.timedelta(minutes=5)
    assert got == {k: n for k, n in want.items() if k[0] + datetime.timedelta(minutes=10) <= end}


def test_drift_monitor_flags_a_shift(spark, tmp_path):
    schema = "kind string, v double"
    base = [("a" if i % 2 else "b", float(i % 50)) for i in range(400)]
    shifted = [("a" if i % 10 else "b", float(i % 50) + 20) for i in range(400)]
    spark.createDataFrame(shifted, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replay.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema)
    found = monitors.drift_monitor(stream, spark.createDataFrame(base, schema), ["v"], "kind", str(tmp_path / "out"))
    assert {(r["kind"], r["name"]): r["drifted"] for r in found.collect()} == {("share", "a"): True, ("share", "b"): True, ("distance", "v"): True}


def test_decision_checks(spark):
    rows = spark.createDataFrame([("imputation", "mean"), ("imputation", "magic"), ("model", "Nothing")], "stage string, strategy string")
    assert [(r["valid"], r["applied"]) for r in logs.check_decisions(rows).collect()] == [(True, "mean"), (False, "median"), (False, "auto")]


def test_both_section_names_are_read(spark):
    text = '{"missing_value_decisions": {"age": {"strategy": "mean"}}, "task_type": "classification", "categorical_encoding": {"c": {"method": "zip"}}}'
    got = logs.parsed_decisions(spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "id int, t string"), "id", "t")
    assert sorted((r["section"], r["choice"], r["accepted"]) for r in got.collect()) == [
        ("categorical_encoding", "zip", False),
        ("missing_value_decisions", "mean", True),
        ("task_type", "classification", True),
    ]


def test_prompt_changes_across_slices(spark):
    rows = [("a", i, "x" if i // 4 % 2 else "y") for i in range(40)] + [("b", i, "same") for i in range(5)]
    log = spark.createDataFrame(rows, "agent string, at int, prompt string").repartition(3)
    assert sorted(r["at"] for r in logs.version_changes(log, ["at"]).collect()) == list(range(4, 40, 4))
    assert log.where(F.col("agent") == "b").count() == 5
