"""Training, scoring and packages on small frames."""

import functools
import math
import random
import re
import threading

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from prismill.operators.boosting import AdaBoostClassifier, AdaBoostRegressor, NoWeakLearnerError
from prismill.operators import modeling, neighbours, preparation
from prismill.operators.stages import NearestNeighbours
from prismill.plans import learn
from prismill.plans.registry import Tables
from prismill.sources import packages


@pytest.fixture(scope="module")
def people(spark):
    draw = random.Random(5)
    rows = []
    for i in range(240):
        x, city = draw.gauss(0, 1), draw.choice(["north", "south", "east"])
        y = "yes" if x + (city == "north") + draw.gauss(0, 0.3) > 0.4 else "no"
        rows.append((i, x if i % 17 else None, city, 3 * x + draw.gauss(0, 0.1), y))
    return spark.createDataFrame(rows, "id int, x double, city string, z double, y string").repartition(3)


@pytest.fixture(scope="module")
def trained(people):
    return modeling.run_training(people.drop("z"), "y", "id", "classification", models=["LogisticRegression", "DecisionTree"], k=3)


def test_classification(trained, people):
    results = {r["model"]: r for r in trained.results.collect()}
    assert set(results) == {"LogisticRegression", "DecisionTree"} and all(r["error"] is None and r["cv_score"] > 0.75 for r in results.values())
    assert trained.best_name in results and trained.classes == ["no", "yes"]
    assert modeling.evaluate(trained, trained.test, "y").first()["accuracy"] > 0.75
    assert trained.train.join(trained.test, "id").count() == 0


def test_scoring_contract_risk_and_reasons(trained, people):
    scored = modeling.score_batch(people, trained.best, trained.feature_columns, trained.classes)
    assert scored.count() == people.count()
    assert scored.where((F.col("risk") == "high") != (F.col("probability") > 0.7)).count() == 0
    assert set(r[0] for r in scored.select("prediction").distinct().collect()) == {"yes", "no"}
    with pytest.raises(modeling.TrainingError):
        modeling.score_batch(people.drop("x"), trained.best, trained.feature_columns, trained.classes)
    important = modeling.input_importances(modeling.importances(trained.best, people, 100), trained.feature_columns)
    assert {c for c, w in important if w > 0} == {"x", "city"}
    assert len(modeling.explain(scored, important).first()["reasons"]) == 2


def test_package_round_trip(spark, trained, people, tmp_path):
    ids = [
        packages.save_package(spark, str(tmp_path), trained.best, trained.best_name, "classification", "y", trained.feature_columns, trained.classes, {"f1": 0.5}, [("a", 0.1, 0.2)], day)
        for day in ("2024-01-01", "2024-01-02")
    ]
    assert [r["model_id"] for r in packages.list_packages(spark, str(tmp_path)).collect()] == ids[::-1]
    model, metadata = packages.load_package(spark, str(tmp_path), ids[0])
    assert metadata.first()["metrics"] == {"f1": 0.5}
    before = modeling.score_batch(people, trained.best, trained.feature_columns, trained.classes).select("id", "prediction")
    after = modeling.score_batch(people, model, trained.feature_columns, trained.classes).select("id", "prediction")
    assert before.exceptAll(after).count() == 0


def test_regression_by_time(people):
    trained = modeling.run_training(people.drop("y").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id"))), "z", "id", "regression", date="day", models=["Ridge"], k=3)
    assert trained.results.first()["cv_score"] > 0.8
    assert trained.train.agg(F.max("day")).first()[0] < trained.test.agg(F.min("day")).first()[0]


def test_refusals(spark, people):
    with pytest.raises(modeling.TrainingError):
        modeling.run_training(people, "absent", "id", "classification")
    with pytest.raises(modeling.TrainingError):
        modeling.run_training(people.withColumn("y", F.lit("no")), "y", "id", "classification")


def test_tiers():
    assert modeling.model_tier(50, "classification") == ("small", ["RandomForest", "LogisticRegression", "KNN"])
    assert modeling.model_tier(5000, "regression", True) == ("medium", ["RandomForest", "XGBoost", "LightGBM", "CatBoost", "Ridge"])
    assert modeling.model_tier(10**9, "classification") == ("large", ["LightGBM", "XGBoost", "SGDClassifier"])
    assert modeling.trainable(["LightGBM", "XGBoost", "SGDClassifier", "KNN"]) == ["GradientBoosting", "LogisticRegression"]


def test_smote_lies_between_minority_rows(spark):
    draw = random.Random(1)
    rows = [(i, int(i < 20), draw.random() if i < 20 else 5 + draw.random(), draw.random()) for i in range(120)]
    made = preparation.smote(spark.createDataFrame(rows, "id int, y int, a double, b double"), "y", 1, ["a", "b"], "id", 4)
    facts = made.agg(F.count("*"), F.min("a"), F.max("a"), F.min("y")).first()
    assert facts[0] == 80 and 0 <= facts[1] and facts[2] <= 1 and facts[3] == 1


def brute_near(points, queries, k, skip):
    """{key: [(distance, other)]} of (key, vector) lists."""
    out = {}
    for key, x in queries:
        # Added from the left: sum() rounds in another way.
        found = sorted((functools.reduce(lambda s, ab: s + (ab[0] - ab[1]) * (ab[0] - ab[1]), zip(x, y), 0.0), other) for other, y in points if not (skip and other == key))
        out[key] = found[:k]
    return out


@pytest.mark.parametrize("n, leaf, block", [(60, 10_000, 4096), (900, 40, 4096), (900, 40, 16)])
def test_neighbours_are_exact(spark, monkeypatch, n, leaf, block):
    """Several leaves and blocks, ties on a grid, a point that a third of all rows share, queries outside of every box."""
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    draw = random.Random(n)
    points = [(i, [3.0, 3.0, -0.0] if i % 3 == 0 else [float(draw.randrange(12)), draw.gauss(0, 4) if i % 2 else 1.0, 0.0]) for i in range(n)]
    queries = points[: n // 2] + [(n + i, [draw.gauss(0, 40), draw.gauss(0, 40), draw.random()]) for i in range(20)]
    make = lambda rows: spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    for k, skip in ((1, True), (4, True), (3, False)):
        got = {r["id"]: [(m["distance"], m["other"]) for m in r["near"]] for r in neighbours.nearest(make(queries), make(points), "id", 3, k, skip).collect()}
        assert got == brute_near(points, queries, k, skip)


def test_neighbours_of_odd_rows(spark):
    kinds = "id string, x array<double>"
    rows = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("b", [2.0]), (None, [1.0]), ("c", None), ("d", [None]), ("e", [float("nan")]), ("f", [1.0, 2.0])], kinds)
    got = sorted(((r["id"] or "", [m["other"] for m in r["near"]]) for r in neighbours.nearest(rows, rows, "id", 1, 5).collect()))
    assert got == [("", ["a", "a", "b"]), ("a", ["a", "a", "b"]), ("a", ["a", "a", "b"]), ("b", ["b", "a", "a"])]
    assert neighbours.nearest(rows.limit(0), rows, "id", 1, 5).count() == 0
    assert [r["near"] for r in neighbours.nearest(rows.limit(1), rows.limit(0), "id", 1, 5).collect()] == [[]]


def test_tomek_links_and_balanced_rows(spark):
    draw = random.Random(9)
    rows = [(i, int(i < 30), draw.gauss(0, 1) + (i < 30), draw.gauss(0, 1)) for i in range(260)] + [(500, None, 0.0, 0.0), (501, 1, None, 0.0)]
    frame = spark.createDataFrame(rows, "id long, y int, a double, b double")
    whole = [(i, [a, b]) for i, y, a, b in rows if y is not None and a is not None]
    near = {i: found[0][1] for i, found in brute_near(whole, whole, 1, True).items()}
    label = {r[0]: r[1] for r in rows}
    want = {(i, j) for i, j in near.items() if i < j and near[j] == i and label[i] != label[j]}
    assert {tuple(r) for r in neighbours.tomek_links(frame, "y", ["a", "b"], "id").collect()} == want and want
    count = lambda df: {(r["y"], r["synthetic"]): r["count"] for r in df.groupBy("y", "synthetic").count().collect()}
    for strategy, made in (("none", 0), ("class_weights", 0), ("smote", 230 - 31)):
        got = count(preparation.balance(frame, "y", ["a", "b"], "id", strategy))
        # The row with a gap has no neighbours, so its synthetic rows are missing.
        assert got[0, False] == 230 and got[1, False] == 31 and made - 8 <= got.get((1, True), 0) <= made
    weights = {r["y"]: r["weight"] for r in preparation.balance(frame, "y", ["a", "b"], "id", "class_weights").collect()}
    assert weights == {0: pytest.approx(261 / 460), 1: pytest.approx(261 / 62)}
    more = preparation.balance(frame, "y", ["a", "b"], "id", "smote").select("id", "y", "a", "b").collect()
    kept = preparation.balance(frame, "y", ["a", "b"], "id").select("id").collect()
    places = [(r["id"], [r["a"], r["b"]]) for r in more if r["a"] is not None]
    near, label = {i: f[0][1] for i, f in brute_near(places, places, 1, True).items()}, {r["id"]: r["y"] for r in more}
    gone = {i for i, j in near.items() if near[j] == i and label[i] != label[j]}
    assert sorted(r["id"] for r in kept) == sorted(set(label) - gone) and gone
    with pytest.raises(ValueError):
        preparation.balance(frame, "y", ["a", "b"], "id", "luck")


def test_knn_majority_and_mean(people):
    known = people.where("x IS NOT NULL")
    predicted = modeling.knn_predict(known.where("id % 4 > 0"), known.where("id % 4 = 0"), ["x", "z"], "id", "y")
    right = predicted.join(known.select("id", "y"), "id").agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]
    assert right > 0.7
    assert modeling.knn_predict(known, known, ["x"], "id", "z", classify=False).count() == known.count()


def test_power_of_a_normal_column_is_near_one(spark):
    draw = random.Random(4)
    rows = spark.createDataFrame([(draw.gauss(0, 1), draw.lognormvariate(0, 1)) for _ in range(3000)], "n double, l double")
    powers = preparation.fit_powers(rows, ["n", "l"])
    assert abs(powers["n"] - 1) < 0.1 and powers["l"] < 0


def test_own_stages_save_and_do_what_they_say(spark, tmp_path):
    """Skewed numbers get powers, wide columns frequencies, three classes shares; a loaded package scores the same."""
    rows = [(i, float(2 ** (i % 9)), f"v{i % 1200}" if i % 4 else "often", "abcdef"[i % 6] * 2, float(i % 3)) for i in range(2400)]
    df = spark.createDataFrame(rows, "id long, x double, wide string, some string, label double")
    plan = modeling.FeaturePlan(["x"], {"wide": "frequency", "some": "target"}, "yeo_johnson")
    fitted = Pipeline(stages=modeling.preprocessing_stages(plan, "classification", 3)).fit(df)
    kinds = [type(s).__name__ for s in fitted.stages]
    assert "PowersModel" in kinds and kinds.count("CodesModel") == 2
    fitted.write().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    new = spark.createDataFrame([(0, 4.0, "often", "aa"), (1, None, "never seen", "zz"), (2, 1.0, None, None)], "id long, x double, wide string, some string")
    a, b = ([r for r in m.transform(new).orderBy("id").select("wide__frequency", "some__shares", "features").collect()] for m in (fitted, loaded))
    assert a == b and [r["wide__frequency"] for r in a] == [0.25, 0.0, 0.0]
    assert list(a[0]["some__shares"]) == [1.0, 0.0, 0.0]
    assert list(a[1]["some__shares"]) == list(a[2]["some__shares"]) == pytest.approx([1 / 3] * 3)
    power = preparation.fit_powers(df, ["x"])["x"]
    assert fitted.stages[1].getOrDefault("powers") == [power] and abs(power) < 1


def test_codes_of_a_fold_have_not_seen_its_rows(spark):
    """A random column of 45 values says nothing of a random target: codes fitted before the folds would seem to."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, f"c{rng.randrange(45)}", rng.choice(["no", "yes"])) for i in range(400)], "id long, c string, y string")
    trained = modeling.run_training(df, "y", "id", "classification", models=["DecisionTree", "MultinomialNB"], k=4)
    found = {r["model"]: r for r in trained.results.collect()}
    assert found["DecisionTree"]["cv_score"] < 0.58
    assert found["MultinomialNB"]["error"] is None


def boosted_by_hand(model, rows, classes, step=1.0):
    """(error, say) of each round, from the model's own trees and plain weights."""
    weights, found = {i: 1.0 for i, _, _ in rows}, []
    for tree in model.trees:
        guess = {i: tree.predict(x) for i, x, _ in rows}
        error = sum(weights[i] for i, _, y in rows if guess[i] != y) / sum(weights.values())
        say = step * (math.log((1 - error) / error) + math.log(classes - 1))
        found.append((error, say))
        weights = {i: weights[i] * (math.exp(say) if guess[i] != y else 1) for i, _, y in rows}
    return found


@pytest.mark.parametrize("classes", [2, 3])
def test_adaboost_rounds_and_round_trip(spark, tmp_path, classes):
    draw = random.Random(classes)
    rows = [(i, Vectors.dense(draw.random(), draw.random())) for i in range(300)]
    rows = [(i, x, float(int((x[0] + x[1]) / 2 * classes) if draw.random() > 0.1 else draw.randrange(classes))) for i, x in rows]
    df = spark.createDataFrame(rows, ["id", "features", "label"]).repartition(3)
    model = AdaBoostClassifier(maxIter=7, classes=classes).fit(df)
    wanted = boosted_by_hand(model, rows, classes)
    assert len(model.trees) > 2
    assert list(zip(model.getOrDefault("errors"), model.getOrDefault("says"))) == [pytest.approx(pair) for pair in wanted]
    scored = {r["id"]: (r["prediction"], r["probability"]) for r in model.transform(df).collect()}
    for i, x, _ in rows:
        votes = [sum(a for t, (_, a) in zip(model.trees, wanted) if t.predict(x) == c) for c in range(classes)]
        assert votes[int(scored[i][0])] == pytest.approx(max(votes)) and sum(scored[i][1]) == pytest.approx(1)
        assert scored[i][1][int(scored[i][0])] == pytest.approx(max(scored[i][1]))
    one = DecisionTreeClassifier(maxDepth=1).fit(df).transform(df).where("prediction = label").count()
    assert sum(scored[i][0] == y for i, _, y in rows) > one
    Pipeline(stages=[model]).fit(df).save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p").transform(df).select("id", "prediction")
    assert again.exceptAll(model.transform(df).select("id", "prediction")).count() == 0


def test_adaboost_edges(spark):
    sure = spark.createDataFrame([(Vectors.dense(float(i)), float(i > 4)) for i in range(10)], ["features", "label"])
    model = AdaBoostClassifier().fit(sure)
    assert len(model.trees) == 1 and model.transform(sure).where("prediction <> label").count() == 0
    chance = spark.createDataFrame([(Vectors.dense(1.0), float(i % 2)) for i in range(10)], ["features", "label"])
    with pytest.raises(NoWeakLearnerError):
        AdaBoostClassifier().fit(chance)


def test_adaboost_regression(spark):
    draw = random.Random(3)
    rows = [(Vectors.dense(x := draw.random(), draw.random()), math.sin(9 * x)) for _ in range(300)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = AdaBoostRegressor(maxIter=12).fit(df)
    weights, says = [1.0] * len(rows), model.getOrDefault("says")
    for tree, say in zip(model.trees, says):
        misses = [abs(tree.predict(x) - y) for x, y in rows]
        loss = sum(w * m for w, m in zip(weights, misses)) / sum(weights) / max(misses)
        assert say == pytest.approx(math.log((1 - loss) / loss))
        weights = [w * (loss / (1 - loss)) ** (1 - m / max(misses)) for w, m in zip(weights, misses)]

    def error(scored):
        return scored.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]

    assert error(model.transform(df)) < error(DecisionTreeRegressor(maxDepth=3).fit(df).transform(df))
    got = model.transform(df.limit(1)).first()
    ordered, total = sorted((t.predict(got["features"]), a) for t, a in zip(model.trees, says)), 0.0
    for value, say in ordered:
        total += say
        if total >= sum(says) / 2:
            break
    assert got["prediction"] == pytest.approx(value)


def test_mutual_information_of_numbers(spark):
    draw = random.Random(9)
    rows = [(x := draw.random(), draw.random(), (x - 0.5) ** 2 + draw.gauss(0, 0.01)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, noise double, y double")
    found = dict(preparation.mutual_information(df, ["x", "noise"], "y", 10, 10).collect())
    assert found["x"] > 0.8 and found["noise"] < 0.01


def test_training_on_joined_tables_reads_the_split_once(spark):
    """Folds over a split over a join: the optimizer gave up on the three in one plan, and every reader ran the split again."""
    orders = spark.range(300).select(F.col("id").alias("o"), (F.col("id") * 1.5 + 7).alias("total"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("status"))
    lines = spark.range(900).select((F.col("id") % 300).alias("l"), (F.col("id") * 1.0).alias("price"))
    rows = orders.join(lines.groupBy("l").agg(F.sum("price").alias("lines"), F.count(F.lit(1)).alias("n")), F.col("o") == F.col("l")).drop("l")
    trained = modeling.run_training(rows, "total", "o", "regression", models=["LinearRegression"], k=2)
    assert [r["error"] for r in trained.results.collect()] == [None]
    assert trained.train.count() + trained.test.count() == 300
    assert "Window" not in trained.train._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("options", "strategy"), [({"date": "day"}, "time"), ({"target": "y"}, "stratified"), ({"target": "x"}, "random")])
def test_folds_go_on_with_the_order_of_the_split(spark, options, strategy):
    """The same folds as sorting the training rows anew, without a second global order."""
    draw = random.Random(3)
    rows = [(i, draw.randint(0, 30), draw.choice("abc"), draw.random()) for i in range(401)]
    df = spark.createDataFrame(rows, "id int, day int, y string, x double").repartition(4)
    options = {"target": "x", **options}
    parts, _ = preparation.split(df, key="id", position="place", **options)
    train = parts.where("part = 'train'").drop("part").localCheckpoint()
    by = dict(k=3, target=options["target"], date=options.get("date"))
    kept = preparation.folds(train, strategy, "id", position="place", **by)
    anew = preparation.folds(train.drop("place"), strategy, "id", **by)
    assert kept.columns == anew.columns and sorted(kept.collect()) == sorted(anew.collect())
    assert parts.where("part = 'test' AND place IS NOT NULL").count() == 0
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_of_a_fit_grow_with_many_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    found = [modeling.sized(spark.range(10), rows).rdd.getNumPartitions() for rows in (100, 50_000, 7_200_000)]
    assert found == [1, 3, max(4 * cores, 72) + 1]


def test_shape_features_of_documents(spark, tmp_path):
    """Shares of digits, lines and marks, also of null, empty and all-digit texts; runs of other characters go at once."""
    texts = ["a1 b2\n\nc3!", "", None, "12345", "\n\n", "\u00e9t\u00e9 \u2014 \u0663\u0664, ok?"]
    rows = [(i, text, "en", "s", None if text is None else len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id int, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = learn.labelled_documents(Tables(spark, str(tmp_path)))
    for r in frame.collect():
        text = texts[r["doc_id"]]
        if not text:
            assert r["digit_share"] is None and r["mark_share"] is None
            continue
        words = len(re.split("[ \\t\\n\\x0b\\f\\r]+", text))
        assert r["digit_share"] == sum(c in "0123456789" for c in text) / len(text)
        assert r["line_share"] == text.count("\n") / words
        assert r["mark_share"] == sum(not (c.isalnum() or c.isspace()) for c in text) / len(text)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("]+, ,") == 3


def test_all_classifiers_are_trained(spark, tmp_path):
    """Every model of the registry and KNN have scores, though most sizes in the last rows lie outside of those before."""
    draw = random.Random(7)
    rows = []
    for i in range(150):
        good = draw.random() < 0.6
        text = " ".join(draw.choice(["word", "a1", "b, c", "long\n"]) for _ in range(draw.randrange(1, 60 if good else 12)))
        rows.append((i, text, draw.choice(["en", "fr"]), f"s{draw.randrange(12)}", len(text), int(good)))
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int, quality int")
    frame.drop("quality").write.parquet(f"{tmp_path}/documents.parquet")
    frame.select("doc_id", "quality", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["model"]: r for r in learn.train_all_classifiers(Tables(spark, str(tmp_path))).collect()}
    names = {"RandomForest", "DecisionTree", "GradientBoosting", "AdaBoost", "LogisticRegression", "SVM_Linear", "GaussianNB", "MultinomialNB", "KNN"}
    assert set(found) == names == set(modeling.classifiers())
    assert [(n, r["error"]) for n, r in found.items() if r["error"] or r["cv_score"] is None or r["test_score"] is None] == []


def test_models_at_once_share_no_local_properties(spark):
    """A query number set by one fit was taken away by another one, which then failed: "Cannot parse null string"."""
    meet = threading.Barrier(2, timeout=60)

    class Marked(DecisionTreeClassifier):
        def fit(self, rows):
            context, mine = spark.sparkContext, self.uid
            meet.wait()
            context.setLocalProperty("prismill.mark", mine)
            meet.wait()
            assert context.getLocalProperty("prismill.mark") == mine
            return DecisionTreeClassifier().fit(rows)

    df = spark.createDataFrame([(float(i % 5), float(i % 2), i // 2 % 2) for i in range(40)], "x double, label double, fold int")
    prepare = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")])
    _, fitted, rows = modeling.train_models(df, df, prepare, {"a": Marked, "b": Marked}, "classification", "fold", parallelism=2)
    assert set(fitted) == {"a", "b"} and [r[3] for r in rows] == [None, None]


def test_multinomial_scores_rows_below_the_training_range(spark):
    train = spark.createDataFrame([(Vectors.dense(float(i), float(i % 3)), float(i > 5)) for i in range(10)], ["features", "label"])
    model = modeling.classifiers()["MultinomialNB"]().fit(train)
    far = spark.createDataFrame([(0, Vectors.dense(-4.0, 0.0)), (1, Vectors.dense(0.0, 0.0))], ["id", "features"])
    low, edge = (r["probability"] for r in model.transform(far).orderBy("id").collect())
    assert low == edge


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_a_chosen_knn_is_trained(spark, task):
    """Below 100 rows the tier names KNN; its scores stand beside those of the others."""
    draw = random.Random(8)
    rows = [(i, draw.gauss(0, 1), draw.choice("ab")) for i in range(90)]
    df = spark.createDataFrame([(i, x, c, ("no", "yes")[x > 0] if task == "classification" else 2 * x) for i, x, c in rows], f"id int, x double, c string, y {'string' if task == 'classification' else 'double'}")
    found = {r["model"]: r for r in modeling.run_training(df, "y", "id", task, k=2).results.collect()}
    assert set(found) == {"RandomForest", "LogisticRegression" if task == "classification" else "Ridge", "KNN"}
    assert found["KNN"]["error"] is None and found["KNN"]["cv_score"] > 0.6 and found["KNN"]["test_score"] > 0.6


@pytest.mark.parametrize("classes", [0, 3])
def test_nearest_neighbours_vote_and_round_trip(spark, tmp_path, classes):
    """Against all distances; a row with NaN gets what all rows say; a place with several labels is no vote for the smallest one."""
    draw = random.Random(classes)
    rows = [(i, [draw.gauss(0, 1), draw.gauss(0, 1)]) for i in range(200)]
    rows = [(i, x, float(int(abs(x[0]) + draw.random()) % 3) if classes else x[0] - x[1]) for i, x in rows]
    train = spark.createDataFrame([(Vectors.dense(x), y) for i, x, y in rows if i % 4], ["features", "label"]).repartition(3)
    asked = spark.createDataFrame([(i, Vectors.dense(x)) for i, x, _ in rows if i % 4 == 0] + [(900, Vectors.dense(float("nan"), 0.0))], ["id", "features"])
    model = NearestNeighbours(classes=classes).fit(train)
    got = {r["id"]: r for r in model.transform(asked).collect()}
    assert len(got) == 51
    known, labels = [(i, x) for i, x, _ in rows if i % 4], {i: y for i, _, y in rows}
    for i, near in brute_near(known, [(i, x) for i, x, _ in rows if i % 4 == 0], 5, False).items():
        votes = [labels[j] for _, j in near]
        if classes:
            shares = [votes.count(c) / 5 for c in range(classes)]
            assert list(got[i]["probability"]) == pytest.approx(shares) and got[i]["prediction"] == shares.index(max(shares))
        else:
            assert got[i]["prediction"] == pytest.approx(sum(votes) / 5)
    all_labels = [labels[i] for i, _ in known]
    if classes:
        assert list(got[900]["probability"]) == pytest.approx([all_labels.count(c) / len(known) for c in range(classes)])
    else:
        assert got[900]["prediction"] == pytest.approx(sum(all_labels) / len(known))
    PipelineModel(stages=[model]).save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p").transform(asked).select("id", "prediction")
    assert again.exceptAll(model.transform(asked).select("id", "prediction")).count() == 0
    crowd = spark.createDataFrame([(Vectors.dense(0.0), float(i >= 10)) for i in range(300)], ["features", "label"])
    assert NearestNeighbours(classes=2).fit(crowd).transform(crowd.limit(1)).first()["prediction"] == 1.0
