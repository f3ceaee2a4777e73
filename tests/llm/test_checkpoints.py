"""Checkpoint files follow the rows, not the number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from prismill.llm import components as graph, mixing, ngram_join
from prismill.session import durable


@pytest.fixture
def many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def noted(monkeypatch, module, files):
    """What `module` checkpoints from now on: the number of files of each."""

    def run(df, *rows):
        out = durable(df, *rows)
        files.append(out._jdf.queryExecution().toRdd().getNumPartitions())
        return out

    monkeypatch.setattr(module, "durable", run)


def test_components_write_few_files(many_partitions, monkeypatch):
    spark, files = many_partitions, []
    noted(monkeypatch, graph, files)
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).where("u % 100 <> 99")
    found = graph.components(chain, rows=300)
    assert {(r.node, r.component) for r in found.collect()} == {(k, k // 100 * 100) for k in range(300)}
    assert len(files) > 5 and max(files) <= spark.sparkContext.defaultParallelism


def test_joins_and_mixes_write_few_files(many_partitions, monkeypatch):
    spark, files = many_partitions, []
    for module in (graph, ngram_join, mixing):
        noted(monkeypatch, module, files)
    rows = [(k, " ".join(f"w{j}" for j in range(40)) + f" end{k // 2 % 3}", f"s{k % 2}") for k in range(12)] + [(20, "one of its own kind here", "s0"), (21, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {k: 0 for k in range(12)} | {20: 20, 21: 21}
    assert mixing.mix(docs).count() == len(rows)
    assert len(files) > 10 and max(files) <= spark.sparkContext.defaultParallelism


def test_rows_bound_files_from_below(many_partitions, monkeypatch):
    """A large frame keeps its partitions, and no row is lost."""
    spark = many_partitions
    monkeypatch.setattr("prismill.session.ROWS_A_FILE", 100)
    dealt = spark.range(2000).groupBy((F.col("id") % 500).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    parts = lambda df: df._jdf.queryExecution().toRdd().getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    for rows, most in ((None, 64), (2000, max(cores, 20)), (10**6, 64), (0, cores)):
        out = durable(dealt, rows)
        assert parts(out) == min(64, most) and out.agg(F.sum("n")).first()[0] == 2000
