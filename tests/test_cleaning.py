"""Cleaning semantics on small frames with known results."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from prismill.functions.numbers import sample_kurtosis, sample_skewness
from prismill.operators import cleaning, features, fuzzy, profiling


@pytest.fixture(scope="module")
def frame(spark):
    a = [1.0, 2.0, None, 4.0, 5.0, 100.0, 7.0, 8.0]
    rows = [(i, a[i], "abcabcab"[i], [10, 20, 30][i % 3]) for i in range(8)]
    return spark.createDataFrame(rows, "id int, A double, B string, C bigint")


def test_missing(frame):
    report = {r["column_name"]: r for r in profiling.missing_report(frame.select("A", "B", "C")).collect()}
    assert report["A"]["n_missing"] == 1 and report["A"]["pct_missing"] == 12.5
    total = profiling.missing_summary(frame.select("A", "B", "C")).first()
    assert (total["total_cells"], total["total_missing"], total["rows_with_missing"]) == (24, 1, 1)


def test_imputation_and_outliers(frame):
    imputer = cleaning.fit_imputer(frame, columns=["A"])
    assert imputer.values["A"] == 5.0
    filled = imputer.transform(frame)
    bounds = profiling.fit_bounds(filled, ["A"])
    assert bounds["A"] == (-2.125, 12.875)
    assert cleaning.clip(filled, bounds).agg(F.max("A")).first()[0] == 12.875
    assert cleaning.remove_outliers(filled, bounds).count() == 7
    assert profiling.fit_bounds(filled, ["A"], "zscore", 3.0)["A"][1] == pytest.approx(117.9565, abs=1e-4)
    skew, kurtosis = filled.agg(sample_skewness(F.col("A")), sample_kurtosis(F.col("A"))).first()
    assert (skew, kurtosis) == (pytest.approx(2.8017791543), pytest.approx(7.8873872823))


def test_mean_and_mode_ties(spark, frame):
    assert cleaning.fit_imputer(frame, numeric="mean", columns=["A"]).values["A"] == pytest.approx(127 / 7)
    tied = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert cleaning.fit_modes(tied, ["x"]) == {"x": "a"}


def test_bins(frame):
    filled = cleaning.fit_imputer(frame, columns=["A"]).transform(frame)
    bins = lambda method: [r[0] for r in features.fit_bins(filled, "A", 4, method).transform(filled).orderBy("id").select("A_bin").collect()]
    assert bins("quantile") == [0, 0, 1, 1, 1, 3, 2, 3]
    assert bins("uniform") == [0, 0, 0, 0, 0, 3, 0, 0]


@pytest.mark.parametrize("keep, ids", [("first", [0, 1, 2]), ("last", [5, 6, 7]), ("none", [])])
def test_duplicates(frame, keep, ids):
    kept = cleaning.remove_duplicates(frame, ["B", "C"], keep, ["id"])
    assert sorted(r["id"] for r in kept.collect()) == ids
    assert kept.columns == frame.columns


def test_duplicate_keys_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, k string")
    assert sorted(r["id"] for r in cleaning.remove_duplicates(rows, ["k"], "last", ["id"]).collect()) == [2, 3]


def test_age_rule_looks_at_the_last_word(spark):
    rows = spark.createDataFrame([(30, 400), (130, 400), (-1, 10)], "age int, account_age_days int")
    assert cleaning.remove_invalid(rows, cleaning.rules_by_name(rows)).count() == 1
    assert cleaning.remove_invalid(rows, cleaning.rules_by_name(rows, substring_age=True)).count() == 0


def test_null_breaks_only_a_list_of_allowed_values(spark):
    rows = spark.createDataFrame([("a", 1), (None, None)], "k string, v int")
    rules = [cleaning.Rule("k", allowed=("a",)), cleaning.Rule("v", 0, 5)]
    assert {r["column_name"]: r["n_invalid"] for r in cleaning.invalid_report(rows, rules).collect()} == {"k": 1, "v": 0, "(any)": 1}


def test_text(spark):
    rows = spark.createDataFrame([("  <b>cafÃ©</b>  au  lait\n",), (None,)], "x string")
    assert [r[0] for r in cleaning.clean_text_columns(rows, ["x"]).collect()] == ["café au lait", None]


def test_column_drops(spark):
    rows = spark.createDataFrame([(i, None, 1 if i else 2, None if i else "x") for i in range(50)], "id int, empty string, same int, rare string")
    assert set(cleaning.high_null_columns(rows)) == {"empty", "rare"}
    assert "same" in cleaning.low_variance_columns(rows) and "empty" not in cleaning.low_variance_columns(rows)


def test_clean_keeps_an_audit(spark, frame):
    cleaned, audit = cleaning.clean(frame, subset=["B", "C"], order_by=["id"], outliers="clip", protect=["id", "C"])
    assert cleaned.count() == 3
    assert {r["name"] for r in audit.table(spark).collect()} == {"impute", "duplicates", "outliers"}


def test_unknown_strategy_falls_back(frame):
    assert cleaning.fit_imputer(frame, {"A": "mice"}, columns=["A"]).strategies["A"] == "median"
    assert cleaning.fit_imputer(frame, {"A": "drop"}, columns=["A"]).transform(frame).count() == 7
    with pytest.raises(ValueError):
        cleaning.fit_imputer(frame, {"A": "forward_fill"}, columns=["A"])


def greedy(counts, threshold):
    """The grouping by its definition: one value after the other against all leaders."""
    leaders, mapping = [], {}
    for value, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])):
        form = value.strip().lower()
        near = [x for x in leaders if SequenceMatcher(None, x.strip().lower(), form).ratio() >= threshold]
        if not near:
            leaders.append(value)
        mapping[value] = near[0] if near else value
    return mapping


@pytest.mark.parametrize("batch", [2, 7, 1000])
def test_fuzzy_groups_for_any_batch(spark, batch):
    words = ["New York", "newyork", "new york ", "Phone", "phones", "North", "South", "Tablet", "tablets", "Laptop", "laptp", "East", "eastt", "West"]
    counts = {w: 1 + (i * 7) % 5 for i, w in enumerate(words)}
    rows = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)] + [(None,)], "x string")
    got = {r["value"]: r["canonical"] for r in fuzzy.fit_groups(rows, "x", 0.8, batch).collect()}
    assert got == greedy(counts, 0.8)
    assert got["North"] == "North" and got["South"] == "South"
    replaced = fuzzy.standardize(rows, "x", 0.8, batch)
    assert replaced.count() == rows.count() and replaced.where("x IS NULL").count() == 1


@pytest.mark.parametrize("threshold", [0.5, 0.67, 0.8, 0.93, 1.0])
def test_fuzzy_groups_miss_no_candidate(spark, threshold):
    """Random texts over few letters, of any length from none, with near copies and a word that all share."""
    rng = random.Random(int(threshold * 100))
    words = {""}
    while len(words) < 150:
        word = "".join(rng.choices("abcdé ", [5, 3, 2, 2, 1, 1], k=rng.choice([1, 2, 3, 4, 5, 7, 9, 14]))).strip()
        words |= {word, word[::-1], word + rng.choice("abx"), "common " + word}
    counts = {w: rng.randint(1, 4) for w in sorted(words)}
    rows = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "x string")
    got = {r["value"]: r["canonical"] for r in fuzzy.fit_groups(rows, "x", threshold, 3).collect()}
    assert got == greedy(counts, threshold)


def test_fuzzy_large_family_is_not_paired(spark, monkeypatch):
    """A family of 3 000 near copies is compared with its leader; blocks of many texts are split."""
    monkeypatch.setattr(fuzzy, "PART", 100)
    rows = spark.range(3000).select(F.concat(F.lit("a rather long common category name "), F.col("id").cast("string")).alias("x"))
    groups = fuzzy.fit_groups(rows, "x").groupBy("canonical").count().collect()
    assert [tuple(r) for r in groups] == [("a rather long common category name 0", 3000)]


def test_fuzzy_empty_column(spark):
    rows = spark.createDataFrame([(None,), (None,)], "x string")
    assert fuzzy.fit_groups(rows, "x").count() == 0 and fuzzy.standardize(rows, "x").count() == 2
    with pytest.raises(ValueError):
        fuzzy.fit_groups(rows, "x", 0.0)


def test_md5_bucket_equals_the_whole_number(spark):
    import hashlib

    from prismill.functions.keys import md5_bucket

    words = [f"value {i}" for i in range(100)] + ["", "ü"]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", md5_bucket(F.col("x"), 37).alias("b"))
    assert all(r["b"] == int(hashlib.md5(r["x"].encode()).hexdigest(), 16) % 37 for r in rows.collect())


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, y double")
    new = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    got = features.fit_encoder(train, "k", "target", "y").transform(new)
    assert sorted(r[0] for r in got.collect()) == [2.0, 3.5, 3.5]
    hot = features.fit_encoder(train, "k", "one_hot").transform(new)
    assert hot.columns == ["k_b"] and [r[0] for r in hot.collect()] == [0, 0, 0]


def test_wide_dictionary(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.lpad("id", 7, "0"))).alias("c"), "id")
    labels = features.fit_encoder(rows, "c", "label")
    coded = labels.transform(rows)
    top = n - (n + 2) // 3 + 1
    facts = coded.agg(F.count_distinct("c_label"), F.min("c_label"), F.max("c_label"), F.count_if((F.col("c_label") == 1) == (F.col("id") % 3 == 0))).first()
    assert tuple(facts) == (top, 1, top, n)
    vectors = features.fit_encoder(rows, "c", "one_hot_vector").transform(rows.where("id < 3").unionByName(spark.createDataFrame([(None, -1), ("new", -2)], "c string, id bigint")))
    found = {r["id"]: (r["c_vec"].size, list(r["c_vec"].indices)) for r in vectors.collect()}
    # The first category in order, null and a value that was not seen have no flag.
    assert found == {0: (top - 1, []), 1: (top - 1, [0]), 2: (top - 1, [1]), -1: (top - 1, []), -2: (top - 1, [])}
    with pytest.raises(ValueError, match="one_hot_vector"):
        features.fit_encoder(rows, "c", "one_hot")
