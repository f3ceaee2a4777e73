"""Model choice, training, comparison, scoring and explanation on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    FeatureHasher,
    Imputer,
    MinMaxScaler,
    OneHotEncoder,
    RobustScaler,
    StandardScaler,
    StringIndexer,
    TargetEncoder,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from prismill.functions.numbers import numeric_columns, string_columns
from prismill.operators import metrics
from prismill.operators.boosting import AdaBoostClassifier, AdaBoostRegressor
from prismill.operators.features import encoding_method
from prismill.operators.neighbours import nearest
from prismill.operators.preparation import folds, mutual_information, scaler_choice, split
from prismill.operators.profiling import distinct_counts
from prismill.operators.shapes import missing_columns
from prismill.operators.stages import ClassShares, Frequencies, NearestNeighbours, NonNegative, Powers
from prismill.session import durable

LABEL, FEATURES = "label", "features"
POSITION = "__position"
SPLIT_OF_FOLDS = {"time": "time_based", "stratified": "stratified", "random": "random"}


class TrainingError(ValueError):
    """Data a model cannot be trained on: no target, no features, one class only."""


# --- registries -------------------------------------------------------------------------------------------


def classifiers(seed: int = 42, classes: int = 2) -> dict[str, Callable[[], Estimator]]:
    io = {"labelCol": LABEL, "featuresCol": FEATURES}

    def many(binary: Callable[[], Estimator]) -> Callable[[], Estimator]:
        return binary if classes <= 2 else lambda: OneVsRest(classifier=binary(), **io)

    return {
        "RandomForest": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **io),
        "DecisionTree": lambda: DecisionTreeClassifier(maxDepth=8, seed=seed, **io),
        "GradientBoosting": many(lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **io)),
        "AdaBoost": lambda: AdaBoostClassifier(maxIter=20, seed=seed, classes=max(2, classes), **io),
        "LogisticRegression": lambda: LogisticRegression(maxIter=100, regParam=1e-3, tol=1e-4, **io),
        "SVM_Linear": many(lambda: LinearSVC(maxIter=50, regParam=1e-3, tol=1e-4, **io)),
        "GaussianNB": lambda: NaiveBayes(modelType="gaussian", **io),
        # Its features are counts: none may be negative.
        "MultinomialNB": lambda: Pipeline(
            stages=[
                MinMaxScaler(inputCol=FEATURES, outputCol="__ranged"),
                NonNegative(inputCol="__ranged", outputCol="__counts"),
                NaiveBayes(modelType="multinomial", labelCol=LABEL, featuresCol="__counts"),
            ]
        ),
        "KNN": lambda: NearestNeighbours(classes=max(2, classes), **io),
    }


def regressors(seed: int = 42) -> dict[str, Callable[[], Estimator]]:
    io = {"labelCol": LABEL, "featuresCol": FEATURES}
    return {
        "RandomForest": lambda: RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed, **io),
        "DecisionTree": lambda: DecisionTreeRegressor(maxDepth=8, seed=seed, **io),
        "GradientBoosting": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=seed, **io),
        "AdaBoost": lambda: AdaBoostRegressor(maxIter=20, seed=seed, **io),
        "LinearRegression": lambda: LinearRegression(**io),
        "Ridge": lambda: LinearRegression(elasticNetParam=0.0, regParam=0.1, **io),
        "Lasso": lambda: LinearRegression(elasticNetParam=1.0, regParam=0.1, **io),
        "ElasticNet": lambda: LinearRegression(elasticNetParam=0.5, regParam=0.1, **io),
        "KNN": lambda: NearestNeighbours(**io),
    }


# Library names whose part a boosted tree or a linear model of MLlib takes.
STAND_INS = {
    "XGBoost": "GradientBoosting",
    "LightGBM": "GradientBoosting",
    "CatBoost": "GradientBoosting",
    "SGDClassifier": "LogisticRegression",
    "SGDRegressor": "LinearRegression",
}


def model_tier(n_rows: int, task: str, high_cardinality: bool = False, most: int = 5) -> tuple[str, list[str]]:
    """(tier, model names) by the number of rows: below 1000 light models, below 100 000 forests and boosting, above boosting and linear."""
    linear = "LogisticRegression" if task == "classification" else "Ridge"
    if n_rows < 1000:
        return "small", ["RandomForest", linear, *(["KNN"] if n_rows < 100 else [])][:most]
    if n_rows < 100_000:
        return "medium", ["RandomForest", "XGBoost", "LightGBM", *(["CatBoost"] if high_cardinality else []), linear][:most]
    return "large", ["LightGBM", "XGBoost", "SGDClassifier" if task == "classification" else "SGDRegressor"][:most]


def trainable(names: Sequence[str]) -> list[str]:
    """Names of MLlib models with stand-ins resolved, each once; KNN is a join of its own, which `run_training` adds."""
    return list(dict.fromkeys(STAND_INS.get(n, n) for n in names if n != "KNN"))


# --- preprocessing pipeline -------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeaturePlan:
    numeric: list[str]
    categorical: dict[str, str] = field(default_factory=dict)
    scaler: str = "standard"


def plan_features(df: DataFrame, target: str, skip: Sequence[str] = ()) -> FeaturePlan:
    """Numeric columns, string columns with their encoding, and the scaler the numeric ones call for."""
    numeric = numeric_columns(df, [target, *skip])
    text = string_columns(df, [target, *skip])
    sizes = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, text).collect()} if text else {}
    scaler = scaler_choice(df, numeric).first()["scaler"] if numeric else "standard"
    return FeaturePlan(numeric, {c: encoding_method(sizes.get(c, 0), True) for c in text}, scaler)


def preprocessing_stages(plan: FeaturePlan, task: str, classes: int = 0) -> list:
    """Imputation, encoding, assembly and scaling as pipeline stages, so that scoring needs nothing else.

    `task` is "binary" for two classes. A target code is the mean of the target, with more classes the share of each.
    """
    stages: list = []
    blocks: list[str] = []
    if plan.numeric:
        filled = [f"{c}__filled" for c in plan.numeric]
        stages.append(Imputer(strategy="median", inputCols=plan.numeric, outputCols=filled))
        if plan.scaler == "yeo_johnson":
            stages.append(Powers(inputCols=filled))
        stages.append(VectorAssembler(inputCols=filled, outputCol="__numbers", handleInvalid="keep"))
        scalers = {
            "minmax": lambda: MinMaxScaler(inputCol="__numbers", outputCol="__scaled"),
            "robust": lambda: RobustScaler(inputCol="__numbers", outputCol="__scaled", withCentering=True),
        }
        standard = lambda: StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True)
        stages.append(scalers.get(plan.scaler, standard)())
        blocks.append("__scaled")
    few = [c for c, m in plan.categorical.items() if m == "one_hot"]
    some = [c for c, m in plan.categorical.items() if m == "target"]
    means = some if task != "classification" else []
    if few or means:
        stages.append(StringIndexer(inputCols=few + means, outputCols=[f"{c}__index" for c in few + means], handleInvalid="keep"))
    if few:
        stages.append(OneHotEncoder(inputCols=[f"{c}__index" for c in few], outputCols=[f"{c}__hot" for c in few], handleInvalid="keep"))
        blocks += [f"{c}__hot" for c in few]
    if means:
        kind = "binary" if task == "binary" else "continuous"
        stages.append(
            TargetEncoder(inputCols=[f"{c}__index" for c in means], outputCols=[f"{c}__mean" for c in means], labelCol=LABEL, targetType=kind, handleInvalid="keep")
        )
        blocks += [f"{c}__mean" for c in means]
    for c in some if not means else []:
        stages.append(ClassShares(inputCol=c, outputCol=f"{c}__shares", labelCol=LABEL, classes=classes))
        stages.append(VectorSizeHint(inputCol=f"{c}__shares", size=classes, handleInvalid="optimistic"))
        blocks.append(f"{c}__shares")
    for c in (c for c, m in plan.categorical.items() if m == "frequency"):
        stages.append(Frequencies(inputCol=c, outputCol=f"{c}__frequency"))
        blocks.append(f"{c}__frequency")
    hashed = [c for c, m in plan.categorical.items() if m == "hash"]
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="__hashed", numFeatures=256))
        blocks.append("__hashed")
    if not blocks:
        raise TrainingError("no feature columns")
    stages.append(VectorAssembler(inputCols=blocks, outputCol=FEATURES, handleInvalid="keep"))
    return stages


def select_features(df: DataFrame, columns: Sequence[str], target: str, task: str, most: int = 30, seed: int = 42) -> list[str]:
    """All columns up to `most`; above, the best by mutual information, or by forest importance beyond 50."""
    if len(columns) <= most:
        return list(columns)
    if len(columns) <= 50:
        ranked = mutual_information(df, columns, target, target_bins=None if task == "classification" else 10).orderBy(F.col("mutual_information").desc(), "column_name").limit(most)
        return [r["column_name"] for r in ranked.collect()]
    label = StringIndexer(inputCol=target, outputCol=LABEL, handleInvalid="skip") if task == "classification" else None
    rows = label.fit(df).transform(df) if label else df.withColumn(LABEL, F.col(target).cast("double"))
    forest = (classifiers(seed) if task == "classification" else regressors(seed))["RandomForest"]()
    filled = [f"{c}__filled" for c in columns]
    steps = [Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol=FEATURES), forest]
    found = Pipeline(stages=steps).fit(rows).stages[-1].featureImportances.toArray()
    order = sorted(range(len(columns)), key=lambda i: (-found[i], columns[i]))[:most]
    return [columns[i] for i in sorted(order)]


# --- training ---------------------------------------------------------------------------------------------


@dataclass
class Training:
    task: str
    tier: str
    classes: list[str]
    results: DataFrame
    best_name: str
    best: PipelineModel
    feature_columns: list[str]
    stages: DataFrame
    train: DataFrame
    test: DataFrame


def _evaluator(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    return RegressionEvaluator(labelCol=LABEL, metricName="r2")


def fold_parts(rows: DataFrame, fold: str, time_ordered: bool = False) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(training rows, held-out rows) of each fold of a fold column. Time folds train on all earlier folds only."""
    for i in range(1 if time_ordered else 0, rows.agg(F.max(fold)).first()[0] + 1):
        yield rows.where(F.col(fold) < i if time_ordered else F.col(fold) != i), rows.where(F.col(fold) == i)


def train_models(
    train: DataFrame,
    test: DataFrame,
    prepare: Pipeline,
    estimators: dict[str, Callable[[], Estimator]],
    task: str,
    fold: str,
    time_ordered: bool = False,
    parallelism: int = 4,
):
    """(preparation fitted on all training rows, {name: model fitted on them}, [(name, cv_score, test_score, error)]).

    The preparation is fitted anew on the training part of every fold, so that no code, bound or mean of a fold
    has seen the rows it is scored on; the models share it. A model that cannot learn from the data is reported
    and does not stop the others.
    """
    scores: dict[str, list[float]] = {name: [] for name in estimators}
    errors: dict[str, str] = {}
    n_rows = train.count()

    def learned(fitted: PipelineModel, part: DataFrame, held: DataFrame) -> dict[str, tuple[Model, float]]:
        ready = sized(fitted.transform(part).select(LABEL, FEATURES), n_rows).persist()
        unseen = fitted.transform(held).select(LABEL, FEATURES)

        def one(name: str):
            try:
                model = estimators[name]().fit(ready)
                return model, float(_evaluator(task).evaluate(model.transform(unseen)))
            except Exception as error:  # noqa: BLE001
                errors[name] = f"{type(error).__name__}: {error}"
                return None

        names = [name for name in estimators if name not in errors]
        # Wrapped one by one: fits that share one set of the session's local properties take each other's query numbers away and fail.
        tasks = [inheritable_thread_target(train.sparkSession)(partial(one, name)) for name in names]
        with ThreadPoolExecutor(parallelism) as pool:
            found = dict(zip(names, pool.map(lambda task: task(), tasks)))
        ready.unpersist()
        return {name: result for name, result in found.items() if result is not None}

    for part, held in fold_parts(train, fold, time_ordered):
        for name, (_, score) in learned(prepare.fit(part), part, held).items():
            scores[name].append(score)
    prepared = prepare.fit(train)
    final = learned(prepared, train, test)
    rows = [(name, sum(scores[name]) / len(scores[name]), final[name][1], None) if name in final else (name, None, None, errors[name]) for name in estimators]
    return prepared, {name: model for name, (model, _) in final.items()}, rows


def sized(df: DataFrame, rows: int, rows_per_partition: int = 20_000, most_rows: int = 100_000) -> DataFrame:
    """As many partitions as the rows need: iterative fits start a job per step. The shuffle keeps what lies before it parallel.

    Where all cores have several partitions, these grow up to `most_rows`: the tasks of a step would take longer to start than to run.
    """
    busy = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(rows // rows_per_partition, max(busy, rows // most_rows)) + 1)


def run_training(
    df: DataFrame,
    target: str,
    key: str,
    task: str,
    date: str | None = None,
    group: str | None = None,
    models: Sequence[str] | None = None,
    k: int = 5,
    skip: Sequence[str] = (),
    seed: int = 42,
) -> Training:
    """Split, plan features on the training rows, cross-validate, refit, test and pick the best by cross-validation."""
    if target not in df.columns:
        raise TrainingError(f"no target column {target!r}")
    df = df.where(F.col(target).isNotNull())
    classes: list[str] = []
    if task == "classification":
        classes = sorted(r[0] for r in df.select(F.col(target).cast("string")).distinct().limit(1001).collect())
        if not 2 <= len(classes) <= 1000:
            raise TrainingError(f"{len(classes)} classes; needs 2 to 1000")
    parts, strategy = split(df, target, key, date=date, group=group, seed=seed, position=POSITION)
    # Stored once: features, scaler, folds, refits and the caller read the parts many times, and the order of the folds is planned apart from that of the split.
    parts = durable(parts)
    placed, test_rows = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part", POSITION)
    train_rows = placed.drop(POSITION)
    plan = plan_features(train_rows, target, [key, *skip, *([group] if group else [])])
    plan = FeaturePlan(select_features(train_rows, plan.numeric, target, task, seed=seed), plan.categorical, plan.scaler)
    inputs = [*plan.numeric, *plan.categorical]
    if task == "classification":
        index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target).cast("string")) - 1
    else:
        index = F.col(target)
    kind = "binary" if len(classes) == 2 else task
    labelled = lambda rows: rows.withColumn(LABEL, index.cast("double"))
    prepare = Pipeline(stages=preprocessing_stages(plan, kind, len(classes)))
    fold_kind = "time" if date else "group" if group and strategy == "group_based" else "stratified" if task == "classification" else "random"
    # The split's order is that of the folds wherever both go by the same rule.
    same = SPLIT_OF_FOLDS.get(fold_kind) == strategy
    numbered = folds(placed if same else train_rows, fold_kind, key, k, target, date, group, seed, POSITION if same else None)
    train, test = (labelled(rows).select(*inputs, LABEL, *extra).persist() for rows, extra in ((numbered, ["fold"]), (test_rows, [])))
    n_train, n_test = train.count(), test.count()
    tier, chosen = model_tier(n_train + n_test, task, any(m in ("hash", "frequency") for m in plan.categorical.values()))
    known = classifiers(seed, len(classes)) if task == "classification" else regressors(seed)
    asked = models or chosen
    wanted = {name: known[name] for name in [*trainable(asked), *(n for n in asked if n == "KNN")] if name in known}
    prepared, fitted, rows = train_models(train, test, prepare, wanted, task, "fold", fold_kind == "time")
    scored = [r for r in rows if r[1] is not None]
    if not scored:
        raise TrainingError(f"no model could be trained: {rows}")
    best_name = max(scored, key=lambda r: (r[1], r[0]))[0]
    spark = df.sparkSession
    results = spark.createDataFrame(rows, "model string, cv_score double, test_score double, error string")
    stages = spark.createDataFrame(
        [
            ("split", strategy, n_train + n_test),
            ("train", fold_kind, n_train),
            ("test", strategy, n_test),
            ("features", plan.scaler, len(inputs)),
            ("models", tier, len(rows)),
            ("best", best_name, len(scored)),
        ],
        "stage string, detail string, size bigint",
    )
    best = PipelineModel(stages=[*prepared.stages, fitted[best_name]])
    train.unpersist()
    test.unpersist()
    return Training(task, tier, classes, results, best_name, best, inputs, stages, train_rows, test_rows)


def evaluate(training: Training, rows: DataFrame, target: str) -> DataFrame:
    """One row with the metrics of the best model on the rows: classification or regression by task."""
    scored = training.best.transform(rows)
    if training.task == "classification":
        labels = F.array_position(F.array(*[F.lit(c) for c in training.classes]), F.col(target).cast("string")) - 1
        return metrics.classification(metrics.confusion(scored.select(labels.alias("y"), F.col("prediction").cast("bigint").alias("p")), "y", "p"))
    return metrics.regression(scored.select(F.col(target).alias("y"), "prediction"), "y", "prediction")


# --- use --------------------------------------------------------------------------------------------------


def feature_names(frame: DataFrame) -> list[str]:
    """Names of the slots of the `features` vector, from its attribute metadata."""
    attributes = frame.schema[FEATURES].metadata.get("ml_attr", {})
    named = {a["idx"]: a.get("name", f"feature_{a['idx']}") for group in attributes.get("attrs", {}).values() for a in group}
    return [named.get(i, f"feature_{i}") for i in range(attributes.get("num_attrs", len(named)))]


def importances(model: PipelineModel, frame: DataFrame, top: int = 10) -> DataFrame:
    """(feature, importance) of the last stage: impurity importance, or the size of the first row of coefficients."""
    last, names = model.stages[-1], feature_names(model.transform(frame.limit(0)))
    # Scalers drop the names of their slots; the assembler in front of them knows them.
    numbers = [c for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "__numbers" for c in s.getInputCols()]
    scaled = {f"__scaled_{i}": c for i, c in enumerate(numbers)}
    names = [scaled.get(n, n) for n in names]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()[0])
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return frame.sparkSession.createDataFrame([], "feature string, importance double")
    names = names if len(names) == len(values) else [f"feature_{i}" for i in range(len(values))]
    table = frame.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


def risk(probability: Column) -> Column:
    return F.when(probability > 0.7, "high").when(probability > 0.4, "medium").otherwise("low")


def score_batch(df: DataFrame, model: PipelineModel, required: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """All input columns with prediction and, for classifiers, probability (of class 1 if binary, else the largest) and risk.

    Works on a stream as on a table. Missing columns are refused before any job starts.
    """
    lacking = missing_columns(df, required)
    if lacking:
        raise TrainingError(f"missing columns: {lacking}")
    scored = model.transform(df)
    if not classes:
        return scored.select(*df.columns, "prediction")
    predicted = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1).alias("prediction")
    if "probability" not in scored.columns:
        return scored.select(*df.columns, predicted)
    p = vector_to_array("probability")
    probability = F.get(p, F.lit(1)) if len(classes) == 2 else F.array_max(p)
    return scored.select(*df.columns, predicted, probability.alias("probability"), risk(probability).alias("risk"))


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Rows per risk level, or mean and range of numeric predictions."""
    if "risk" in scored.columns:
        return scored.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"), F.min("prediction").alias("min"), F.max("prediction").alias("max"))


def explain(scored: DataFrame, important: Sequence[tuple[str, float]], top: int = 3) -> DataFrame:
    """Adds `reasons`: the globally most important input columns with the row's own values."""
    present = [(c, w) for c, w in important if c in scored.columns][:top]
    reasons = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("importance"), F.col(c).cast("string").alias("value")) for c, w in present])
    return scored.withColumn("reasons", reasons)


def input_importances(table: DataFrame, inputs: Sequence[str]) -> list[tuple[str, float]]:
    """Importance per input column: the slots made from it (`c__filled`, `c__hot_value`, ...) added up."""
    total = dict.fromkeys(inputs, 0.0)
    for row in table.collect():
        owner = max((c for c in inputs if c == row["feature"] or f"{c}__" in row["feature"]), key=len, default=None)
        if owner:
            total[owner] += row["importance"]
    return sorted(total.items(), key=lambda item: (-item[1], item[0]))


def knn_predict(train: DataFrame, queries: DataFrame, columns: Sequence[str], key: str, label: str, k: int = 5, classify: bool = True) -> DataFrame:
    """(key, prediction): majority of the k nearest training rows, ties to the smaller label, or their mean."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    near = nearest(queries.select(key, x), train.select(key, x), key, len(columns), k)
    votes = near.select(key, F.explode("near").alias("n")).select(key, F.col("n.other").alias("other"))
    labels = train.select(F.col(key).alias("other"), F.col(label).alias("label"))
    joined = votes.join(labels, "other")
    if not classify:
        return joined.groupBy(key).agg(F.avg("label").alias("prediction"))
    counted = joined.groupBy(key, "label").agg((-F.count(F.lit(1))).alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct("n", "label"))["label"].alias("prediction"))

