"""Named queries: training, comparison, scoring and packages."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from prismill.operators import modeling
from prismill.operators.boosting import AdaBoostClassifier
from prismill.plans.quality import rounded
from prismill.plans.registry import Tables, named
from prismill.session import shared_folder
from prismill.sources import packages


def labelled_documents(t: Tables) -> DataFrame:
    """Simple shape features of labelled documents with both labels."""
    text = F.col("text")
    words = F.size(F.split(text, r"\s+"))
    rows = t.documents.select(
        "doc_id",
        "lang",
        "source",
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        F.log1p(words.cast("double")).alias("log_words"),
        F.try_divide(F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("double"), F.length(text)).alias("digit_share"),
        F.try_divide(F.length(F.regexp_replace(text, r"[^\n]+", "")).cast("double"), words.cast("double")).alias("line_share"),
        F.try_divide(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).cast("double"), F.length(text)).alias("mark_share"),
    )
    return rows.join(t.labels, "doc_id")


def priced_lines(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").cast("double").alias("month"), "o_custkey"
    ).join(t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("lines_total"), F.count(F.lit(1)).alias("n_lines")), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def classifier(t: Tables, models: list[str] | None = None) -> modeling.Training:
    return modeling.run_training(labelled_documents(t), "quality", "doc_id", "classification", models=models, k=3, skip=["toxic"])


@named(
    "model_tiers",
    """SELECT 'labels' AS source, COUNT(*) AS n_rows, CASE WHEN COUNT(*) < 1000 THEN 'small' WHEN COUNT(*) < 100000 THEN 'medium' ELSE 'large' END AS tier,
CASE WHEN COUNT(*) < 100 THEN 'RandomForest,LogisticRegression,KNN' WHEN COUNT(*) < 1000 THEN 'RandomForest,LogisticRegression' WHEN COUNT(*) < 100000 THEN 'RandomForest,XGBoost,LightGBM,LogisticRegression' ELSE 'LightGBM,XGBoost,SGDClassifier' END AS models FROM labels
UNION ALL SELECT 'lineitem', COUNT(*), CASE WHEN COUNT(*) < 1000 THEN 'small' WHEN COUNT(*) < 100000 THEN 'medium' ELSE 'large' END,
CASE WHEN COUNT(*) < 100 THEN 'RandomForest,LogisticRegression,KNN' WHEN COUNT(*) < 1000 THEN 'RandomForest,LogisticRegression' WHEN COUNT(*) < 100000 THEN 'RandomForest,XGBoost,LightGBM,LogisticRegression' ELSE 'LightGBM,XGBoost,SGDClassifier' END FROM lineitem""",
)
def model_tiers(t: Tables) -> DataFrame:
    parts = []
    for source in ("labels", "lineitem"):
        rows = getattr(t, source)
        tier, names = modeling.model_tier(rows.count(), "classification")
        parts.append(rows.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.lit(tier).alias("tier"), F.lit(",".join(names)).alias("models")))
    return parts[0].unionByName(parts[1])


@named("train_classifiers")
def train_classifiers(t: Tables) -> DataFrame:
    return rounded(classifier(t).results, 4)


@named("train_all_classifiers")
def train_all_classifiers(t: Tables) -> DataFrame:
    return rounded(classifier(t, list(modeling.classifiers())).results, 4)


@named("train_regressors")
def train_regressors(t: Tables) -> DataFrame:
    names = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTree"]
    return rounded(modeling.run_training(priced_lines(t), "o_totalprice", "o_orderkey", "regression", models=names, k=3).results, 4)


@named(
    "training_stages",
    """WITH n AS (SELECT COUNT(*) AS n, CAST(floor(COUNT(*) * 0.8) AS BIGINT) AS k FROM orders)
SELECT 'split' AS stage, 'time_based' AS detail, n AS size FROM n UNION ALL SELECT 'train', 'time', k FROM n UNION ALL SELECT 'test', 'time_based', n - k FROM n
UNION ALL SELECT 'features', 'standard', CAST(2 AS BIGINT) UNION ALL SELECT 'models', CASE WHEN n < 1000 THEN 'small' WHEN n < 100000 THEN 'medium' ELSE 'large' END, CAST(1 AS BIGINT) FROM n
UNION ALL SELECT 'best', 'LinearRegression', CAST(1 AS BIGINT)""",
)
def training_stages(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", F.month("o_orderdate").alias("month"), "o_custkey")
    return modeling.run_training(rows, "o_totalprice", "o_orderkey", "regression", date="o_orderdate", models=["LinearRegression"], k=3).stages


@named("evaluate_best")
def evaluate_best(t: Tables) -> DataFrame:
    trained = classifier(t, ["LogisticRegression"])
    return rounded(modeling.evaluate(trained, trained.test, "quality"), 4)


@named("feature_importances")
def feature_importances(t: Tables) -> DataFrame:
    trained = classifier(t, ["RandomForest"])
    return rounded(modeling.importances(trained.best, labelled_documents(t)), 4)


@named("score_batch")
def score_batch(t: Tables) -> DataFrame:
    """Every labelled document scored and explained by a stored and reloaded model."""
    trained = classifier(t, ["LogisticRegression"])
    root = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    model_id = packages.save_package(
        t.spark, root, trained.best, trained.best_name, trained.task, "quality", trained.feature_columns, trained.classes, {}, [], "2024-01-01 00:00:00"
    )
    model, _ = packages.load_package(t.spark, root, model_id)
    rows = labelled_documents(t)
    scored = modeling.score_batch(rows, model, trained.feature_columns, trained.classes)
    important = modeling.input_importances(modeling.importances(model, rows, 1000), trained.feature_columns)
    explained = modeling.explain(scored, important)
    return explained.select("doc_id", "prediction", F.round("probability", 4).alias("probability"), "risk", F.col("reasons")[0]["feature"].alias("reason"))


@named("prediction_summary")
def prediction_summary(t: Tables) -> DataFrame:
    trained = classifier(t, ["LogisticRegression"])
    return modeling.prediction_summary(modeling.score_batch(labelled_documents(t), trained.best, trained.feature_columns, trained.classes))


@named("package_catalogue")
def package_catalogue(t: Tables) -> DataFrame:
    trained = modeling.run_training(priced_lines(t), "o_totalprice", "o_orderkey", "regression", models=["LinearRegression"], k=3)
    root = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    found = {k: float(v) for k, v in modeling.evaluate(trained, trained.test, "o_totalprice").first().asDict().items()}
    comparison = [(r["model"], r["cv_score"], r["test_score"]) for r in trained.results.collect()]
    for day in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        packages.save_package(t.spark, root, trained.best, trained.best_name, "regression", "o_totalprice", trained.feature_columns, [], found, comparison, day)
    listed = packages.list_packages(t.spark, root)
    return listed.select("name", "task", "target", "saved_at", F.size("features").alias("n_features"), F.round(F.col("metrics")["r2"], 4).alias("r2"))


def _boosting_sql(rounds: int) -> str:
    """Rounds of weighted stumps: the split with the least Gini impurity, the error, the say, the new weights."""
    parts = [
        """w0 AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CAST(left(o_orderpriority, 1) AS INTEGER) AS a,
month(o_orderdate) AS b, year(o_orderdate) AS c, 1.0::DOUBLE AS w FROM orders)"""
    ]
    for r in range(rounds):
        parts.append(
            f"""v{r} AS (SELECT f, v, SUM(w) AS s, SUM(w * y) AS p FROM (SELECT unnest([1, 2, 3]) AS f, unnest([a, b, c]) AS v, w, y FROM w{r}) GROUP BY f, v),
t{r} AS (SELECT f, v, SUM(s) OVER o AS ls, SUM(p) OVER o AS lp, SUM(s) OVER (PARTITION BY f) AS s, SUM(p) OVER (PARTITION BY f) AS p, MAX(v) OVER (PARTITION BY f) AS top FROM v{r}
WINDOW o AS (PARTITION BY f ORDER BY v)),
b{r} AS (SELECT * FROM t{r} WHERE v < top ORDER BY lp * (ls - lp) / ls + (p - lp) * (s - ls - p + lp) / (s - ls), f, v LIMIT 1),
g{r} AS (SELECT w{r}.*, CASE WHEN [a, b, c][f] <= b{r}.v THEN CASE WHEN 2 * lp > ls THEN 1 ELSE 0 END ELSE CASE WHEN 2 * (p - lp) > s - ls THEN 1 ELSE 0 END END <> y AS wrong FROM w{r}, b{r}),
e{r} AS (SELECT SUM(w) FILTER (WHERE wrong) / SUM(w) AS e FROM g{r}),
w{r + 1} AS (SELECT o_orderkey, y, a, b, c, w * CASE WHEN wrong THEN (1 - e) / e ELSE 1 END / (2 * (1 - e)) AS w FROM g{r}, e{r})"""
        )
    rows = " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS round, ROUND(e, 6) AS error, ROUND(ln((1 - e) / e), 5) AS say FROM e{r}" for r in range(rounds))
    return f"WITH {', '.join(parts)} {rows}"


@named("adaboost_rounds", _boosting_sql(4))
def adaboost_rounds(t: Tables) -> DataFrame:
    """Error and say of the first rounds over all orders."""
    inputs = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"),
        F.month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("year"),
    )
    rows = VectorAssembler(inputCols=["priority", "month", "year"], outputCol="features").transform(inputs)
    model = AdaBoostClassifier(maxIter=4).fit(rows)
    found = list(enumerate(zip(model.getOrDefault("errors"), model.getOrDefault("says"), strict=True)))
    table = t.spark.createDataFrame([(i, e, a) for i, (e, a) in found], "round int, error double, say double")
    return table.select("round", F.round("error", 6).alias("error"), F.round("say", 5).alias("say"))


@named(
    "knn_predict",
    """WITH f AS (SELECT doc_id, quality, len(string_split_regex(text, '[\\x09-\\x0D ]+'))::DOUBLE AS n, length(text)::DOUBLE AS size, ln(1 + n_chars::DOUBLE) AS a,
length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[\\p{L}\\p{N}\\x09-\\x0D ]', '', 'g')) AS marks FROM labels JOIN documents USING (doc_id)),
x AS (SELECT doc_id, quality, a, ln(1 + n) AS b, digits / nullif(size, 0) AS c, marks / nullif(size, 0) AS d FROM f),
usable AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
near AS (SELECT q.doc_id, q.quality, p.quality AS vote FROM usable q JOIN usable p ON q.doc_id % 5 = 0 AND p.doc_id % 5 <> 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY q.doc_id ORDER BY (q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c) + (q.d - p.d) * (q.d - p.d), p.doc_id) <= 5),
votes AS (SELECT doc_id, quality, vote, COUNT(*) AS n FROM near GROUP BY ALL),
won AS (SELECT doc_id, quality, vote AS prediction FROM votes QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n DESC, vote) = 1)
SELECT quality, prediction, COUNT(*) AS n FROM won GROUP BY ALL""",
)
def knn_predict(t: Tables) -> DataFrame:
    rows = labelled_documents(t)
    test = F.col("doc_id") % 5 == 0
    predicted = modeling.knn_predict(rows.where(~test), rows.where(test), ["log_chars", "log_words", "digit_share", "mark_share"], "doc_id", "quality")
    both = rows.where(test).select("doc_id", "quality").join(predicted, "doc_id")
    return both.groupBy("quality", "prediction").agg(F.count(F.lit(1)).alias("n"))
