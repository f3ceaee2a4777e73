"""Edge cases: missing files, ragged CSV, empty frames, SQL guard."""

import pytest
from pyspark.sql import functions as F

from prismill.operators import exploration, features, logs, metrics, preparation, profiling, shapes, sqlrun, statistics
from prismill.sources import readers, writers


def test_missing_and_unknown_files(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.read_file(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(readers.SourceError):
        readers.read_file(spark, "table.xlsx")
    with pytest.raises(readers.SourceError):
        readers.read_file(spark, "notes.txt")


def test_ragged_csv_goes_to_rejects(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12\n")
    loaded = readers.read_file(spark, str(path), spark.createDataFrame([], "a int, b int, c int").schema)
    assert loaded.rows.count() == 2 and loaded.rows.select("b").count() == 2
    assert sorted(r["a"] for r in loaded.rows.collect()) == [1, 10]
    assert loaded.rejects.count() == 2


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Unit Price (USD)", "unit-price usd", "a/b"])
    assert readers.clean_names(df).columns == ["unit_price_usd", "unit_price_usd_2", "a_b"]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y"), (2, 'q"')], "id int, s string")
    writers.write_predictions(df, str(tmp_path / "out.csv"))
    back = readers.read_file(spark, str(tmp_path / "out.csv")).rows
    assert sorted(r["id"] for r in back.collect()) == [1, 2]


def test_synthetic_sales(spark):
    df = writers.synthetic_sales(spark, 2000)
    facts = df.agg(F.count("*"), F.min("date"), F.max("date"), F.count_distinct("region"), F.count_distinct("product")).first()
    assert facts[0] == 2000 and facts[3] == 4 and facts[4] == 3 and (facts[2] - facts[1]).days <= 179
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, writers.synthetic_sales(spark, 2000).collect()))


def test_sql_guard(spark):
    spark.range(5).createOrReplaceTempView("five")
    for text in ("DROP TABLE five", "INSERT INTO five VALUES (1)", "-- SELECT\nDELETE FROM five", "WITH x AS (SELECT 1) INSERT INTO five SELECT * FROM x"):
        assert sqlrun.execute(spark, text).error_class == "read_only", text
    assert sqlrun.execute(spark, "SELECT * FROM nowhere").error_class == "missing_table"
    assert sqlrun.execute(spark, "SELECT (1 FROM five").error_class == "syntax"
    assert sqlrun.execute(spark, "SELECT id FROM five WHERE id > 9").rows.count() == 0
    assert sqlrun.query(spark, "WITH x AS (SELECT id FROM five) SELECT id FROM x;", limit=2).count() == 2
    assert sqlrun.query(spark, "SELECT id FROM five LIMIT 4", limit=2).count() == 4
    assert sqlrun.validate(spark, "SELECT id AS n FROM five").names == ["n"]


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert all(r["frame_is_empty"] for r in profiling.validate_frame(empty).collect())
    assert profiling.missing_summary(empty).first()["total_cells"] == 0


def test_all_null_column(spark):
    rows = spark.createDataFrame([(i, None) for i in range(5)], "a int, gone double")
    found = {r["column_name"]: r for r in profiling.validate_frame(rows).collect()}
    assert found["gone"]["all_missing"] and not found["a"]["all_missing"]
    assert "gone" not in profiling.fit_bounds(rows, ["a", "gone"])


def test_no_spread_gives_null_not_an_error(spark):
    rows = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "c double, x double")
    assert statistics.correlation_pairs(rows, ["c", "x"]).first()["r"] is None
    assert statistics.least_squares(rows, "c", "x").first()["slope"] is None


def test_task_types(spark):
    rows = spark.createDataFrame([(float(i), i % 2, str(i)) for i in range(50)], "price double, flag int, name string")
    assert [exploration.task_type(rows, c) for c in ("price", "flag", "name")] == ["regression", "classification", "classification"]


def test_metric_table(spark):
    y, guess = [1, 1, 1, 0, 0, 0, 0, 1], [1, 0, 1, 0, 0, 1, 0, 1]
    score = [0.9, 0.4, 0.8, 0.1, 0.2, 0.6, 0.3, 0.7]
    rows = spark.createDataFrame(list(zip(y, guess, score)), "y int, g int, s double")
    found = metrics.classification(metrics.confusion(rows, "y", "g")).first()
    assert [found[m] for m in ("accuracy", "precision", "recall", "f1")] == [0.75] * 4 and found["mcc"] == pytest.approx(0.5)
    assert metrics.auc(rows, "y", "s").first()["auc"] == 0.9375
    assert metrics.log_loss(rows, "y", "s").first()[0] == pytest.approx(0.4003674357)


def test_one_class_does_not_divide_by_zero(spark):
    rows = spark.createDataFrame([(0, 0, 0.1)] * 3, "y int, g int, s double")
    assert metrics.classification(metrics.confusion(rows, "y", "g")).first()["mcc"] == 0.0
    assert metrics.auc(rows, "y", "s").first()["auc"] is None


def test_p_values():
    from prismill.functions.distributions import chi_square_tail, student_two_sided

    # Known quantiles of the two distributions.
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert chi_square_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)


def test_token_cost_and_percentiles(spark):
    assert spark.range(1).select(logs.cost(F.lit(1000), F.lit(500))).first()[0] == pytest.approx(0.0125)
    rows = spark.createDataFrame([(1, float(v), True, 1, 0.0) for v in (100, 30, 50, 80)], "correlation_id int, latency_ms double, success boolean, total_tokens int, cost_usd double")
    found = logs.trace_statistics(rows).first()
    assert (found["p50"], found["p95"], found["p99"]) == (65.0, 97.0, pytest.approx(99.4))


def test_verdict_is_anchored(spark):
    rows = spark.createDataFrame([("VALID: fine",), ("invalid: no",), ("So: Valid: yes",)], "x string")
    assert [r[0] for r in rows.select(logs.is_valid_verdict(F.col("x"))).collect()] == [True, False, True]


def test_sql_literals_stay_whole_and_writes_are_refused_unrun(spark):
    assert sqlrun.query(spark, "SELECT 'a--b' AS x, 'a/*b*/c' AS y -- note").first() == ("a--b", "a/*b*/c")
    spark.range(3).write.mode("overwrite").saveAsTable("guarded")
    try:
        for text in (
            "WITH x AS (SELECT 9L AS id) INSERT INTO guarded SELECT id FROM x", "WITH x AS (SELECT 1) DELETE FROM guarded", "/* SELECT */ DROP TABLE guarded",
            "WITH x AS (SELECT 1 AS id) MERGE INTO guarded g USING x ON g.id = x.id WHEN MATCHED THEN DELETE", "WITH x AS (SELECT 1) UPDATE guarded SET id = 1",
        ):
            assert not sqlrun.execute(spark, text).success, text
        assert sorted(r[0] for r in spark.table("guarded").collect()) == [0, 1, 2]
    finally:
        spark.sql("DROP TABLE guarded")
    assert sqlrun.query(spark, "SELECT * FROM (SELECT id FROM range(9) LIMIT 7)", limit=2).count() == 2
    assert sqlrun.query(spark, "SELECT id FROM range(9) LIMIT ALL", limit=2).count() == 9
    assert sqlrun.query(spark, "WITH x AS (SELECT id FROM range(9)) SELECT id FROM x ORDER BY id LIMIT 5 OFFSET 1", limit=2).count() == 5


def test_growth_needs_the_year_before(spark):
    rows = spark.createDataFrame([("a", "2020-05-01", 10.0), ("a", "2022-05-01", 20.0), ("a", "2023-05-01", 30.0)], "g string, d string, v double").withColumn("d", F.to_date("d"))
    got = {r["year"]: r["growth_pct"] for r in shapes.yearly_growth(rows, "g", "d", "v").collect()}
    assert got == {2020: None, 2022: None, 2023: 50.0}


def test_a_missing_target_is_no_class(spark):
    rows = spark.createDataFrame([(1, "a")] * 6 + [(1, "b")] * 4 + [(1, None)] * 10, "id long, y string")
    assert preparation.balance_strategy(rows, "y").first()["minority_pct"] == 40.0
    assert {r["class"]: r["n"] for r in preparation.class_weights(rows, "y").collect()} == {"a": 6, "b": 4}
    assert preparation.add_class_weights(rows, "y").count() == 20


def test_polynomial_refuses_too_many_columns(spark):
    with pytest.raises(ValueError):
        features.polynomial(spark.createDataFrame([(1.0,)], "a double"), ["a"])
