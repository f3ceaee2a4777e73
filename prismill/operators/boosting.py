"""AdaBoost over MLlib's weighted decision trees: SAMME for classes, R2 for numbers.

A round trains one tree on a weight column and one aggregate gives its error; the weights are a column that the
rows carry on, never a list on the driver. Lineage is cut every few rounds. Weights keep a mean
near 1, so that no number of rounds exhausts the range of a double.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasStepSize
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from prismill.session import durable

WEIGHT, GUESS = "__weight", "__guess"
# Rounds between two cuts of the lineage.
CUT_EVERY = 5


class NoWeakLearnerError(ValueError):
    """Not even the first tree is better than chance."""


class _Boosted(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", typeConverter=TypeConverters.toInt)


class _BoostedModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLReadable, MLWritable):
    """The trees, and beside them one row per round: the round's error and its say in the vote."""

    says = Param(Params._dummy(), "says", "weight of each tree in the vote", typeConverter=TypeConverters.toListFloat)
    errors = Param(Params._dummy(), "errors", "weighted error of each tree", typeConverter=TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", typeConverter=TypeConverters.toInt)
    tree = DecisionTreeRegressionModel

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", predictionCol: str = "prediction", probabilityCol: str = "probability", says=(), errors=(), classes: int = 0):
        super().__init__()
        self.trees: list = []
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:
        says = self.getOrDefault(self.says)
        found = sum(a * t.featureImportances.toArray() for a, t in zip(says, self.trees))
        # A tree that is one leaf has none to add.
        return DenseVector(found / (found.sum() or 1.0))

    def _guesses(self, dataset: DataFrame) -> DataFrame:
        """One column per tree, `__guess_0` and on."""
        for i, tree in enumerate(self.trees):
            dataset = tree.setPredictionCol(f"{GUESS}_{i}").transform(dataset)
        return dataset

    def write(self) -> MLWriter:
        return _BoostedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostedReader(cls)


class _BoostedWriter(MLWriter):
    def __init__(self, instance: _BoostedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, tree in enumerate(self.instance.trees):
            tree.save(f"{path}/trees/{i}")


class _BoostedReader(MLReader):
    def __init__(self, kind: type[_BoostedModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _BoostedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.trees = [self.kind.tree.load(f"{path}/trees/{i}") for i in range(len(model.getOrDefault(model.says)))]
        return model


def _boost(rows: DataFrame, trainer: Estimator, rounds: int, judge) -> tuple[list, list[float], list[float]]:
    """(trees, says, errors). `judge(scored)` returns (error, say, new weight column, whether to go on) or None to drop the tree."""
    rows = rows.withColumn(WEIGHT, F.lit(1.0))
    trees, says, errors = [], [], []
    for i in range(rounds):
        tree = trainer.fit(rows)
        judged = judge(tree.transform(rows))
        if judged is None:
            break
        error, say, weight, more = judged
        trees.append(tree)
        says.append(say)
        errors.append(error)
        if not more:
            break
        rows = tree.transform(rows).withColumn(WEIGHT, weight).drop(GUESS)
        rows = durable(rows) if (i + 1) % CUT_EVERY == 0 else rows
    if not trees:
        raise NoWeakLearnerError("the first tree is not better than chance")
    return trees, says, errors


class AdaBoostClassificationModel(_BoostedModel):
    """The class with the largest say; probabilities are the softmax of the centred shares of the vote."""

    tree = DecisionTreeClassificationModel

    def _transform(self, dataset: DataFrame) -> DataFrame:
        says, k = self.getOrDefault(self.says), self.getOrDefault(self.classes)
        total = sum(says)

        def vote(c: int) -> Column:
            # Added in the order of the rounds.
            parts = [F.when(F.col(f"{GUESS}_{i}") == c, a / total).otherwise(-a / total / (k - 1)) for i, a in enumerate(says)]
            out = parts[0]
            for part in parts[1:]:
                out = out + part
            return out

        kept = dataset.columns
        voted = self._guesses(dataset).select(*kept, F.array(*[vote(c) for c in range(k)]).alias("__votes"))
        grown = voted.withColumn("__grown", F.transform("__votes", lambda v: F.exp(v / (k - 1))))
        whole = F.aggregate("__grown", F.lit(0.0), lambda a, v: a + v)
        best = (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")
        shares = array_to_vector(F.transform("__grown", lambda v: v / whole))
        return grown.select(*kept, shares.alias(self.getProbabilityCol()), best.alias(self.getPredictionCol()))


class AdaBoostClassifier(Estimator, _Boosted, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """SAMME. Labels are 0, 1, ..., `classes` - 1. A tree without error ends the rounds and alone has a say of 1 or more;
    a tree not better than chance ends them too and is left out."""

    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", probabilityCol: str = "probability",
        maxIter: int = 20, stepSize: float = 1.0, maxDepth: int = 1, seed: int = 42, classes: int = 2,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=20, stepSize=1.0, maxDepth=1, seed=42, classes=2)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> AdaBoostClassificationModel:
        label, k, step = self.getLabelCol(), self.getOrDefault(self.classes), self.getStepSize()
        trainer = DecisionTreeClassifier(
            labelCol=label, featuresCol=self.getFeaturesCol(), predictionCol=GUESS, weightCol=WEIGHT, maxDepth=self.getOrDefault(self.maxDepth), seed=self.getSeed(),
            rawPredictionCol="", probabilityCol="",
        )

        def judge(scored: DataFrame):
            wrong = F.col(GUESS) != F.col(label)
            found = scored.agg(F.sum(F.when(wrong, F.col(WEIGHT)).otherwise(0.0)).alias("wrong"), F.sum(WEIGHT).alias("all")).first()
            error = found["wrong"] / found["all"]
            if error <= 0:
                return 0.0, 1.0, None, False
            if error >= 1 - 1 / k:
                return None
            say = step * (math.log((1 - error) / error) + math.log(k - 1))
            mean = 1 - error + error * math.exp(say)
            return error, say, F.col(WEIGHT) * F.when(wrong, math.exp(say) / mean).otherwise(1 / mean), True

        trees, says, errors = _boost(dataset.select(label, self.getFeaturesCol()), trainer, self.getMaxIter(), judge)
        model = AdaBoostClassificationModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(), says=says, errors=errors, classes=k)
        model.trees = trees
        return model


class AdaBoostRegressionModel(_BoostedModel):
    """The weighted median of the trees' values: the smallest one with at least half of the say at or below it."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        says = self.getOrDefault(self.says)
        kept = dataset.columns
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"{GUESS}_{i}").alias("v"), F.lit(float(a)).alias("a")) for i, a in enumerate(says)]))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
        half = 0.5 * sum(says)

        def step(acc: Column, p: Column) -> Column:
            total = acc["sum"] + p["a"]
            return F.struct(total.alias("sum"), F.coalesce(acc["v"], F.when(total >= half, p["v"])).alias("v"))

        median = F.aggregate(pairs, start, step, lambda acc: F.coalesce(acc["v"], F.element_at(pairs, -1)["v"]))
        return self._guesses(dataset).select(*kept, median.alias(self.getPredictionCol()))


class AdaBoostRegressor(Estimator, _Boosted, DefaultParamsReadable, DefaultParamsWritable):
    """R2 with linear loss. Trees see the weights instead of a sample drawn by them. A tree whose mean loss is half or
    more ends the rounds and is left out, unless it is the first."""

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction",
        maxIter: int = 20, stepSize: float = 1.0, maxDepth: int = 3, seed: int = 42,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=20, stepSize=1.0, maxDepth=3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> AdaBoostRegressionModel:
        label, step = self.getLabelCol(), self.getStepSize()
        trainer = DecisionTreeRegressor(labelCol=label, featuresCol=self.getFeaturesCol(), predictionCol=GUESS, weightCol=WEIGHT, maxDepth=self.getOrDefault(self.maxDepth), seed=self.getSeed())
        kept: list = []

        def judge(scored: DataFrame):
            miss = F.abs(F.col(GUESS) - F.col(label))
            found = scored.agg(F.max(miss).alias("most"), F.sum(F.col(WEIGHT) * miss).alias("miss"), F.sum(WEIGHT).alias("all"), F.count(F.lit(1)).alias("n")).first()
            if not found["most"]:
                return 0.0, 1.0, None, False
            loss = found["miss"] / found["all"] / found["most"]
            if loss >= 0.5:
                return None if kept else (loss, 1.0, None, False)
            kept.append(loss)
            beta = loss / (1 - loss)
            # Weights only fall, by at most beta a round; a power of two of their old mean lifts them again.
            lift = 2.0 ** -round(math.log2(found["all"] / found["n"]))
            return loss, -step * math.log(beta), F.col(WEIGHT) * F.pow(F.lit(beta), (1 - miss / found["most"]) * step) * lift, True

        trees, says, errors = _boost(dataset.select(label, self.getFeaturesCol()), trainer, self.getMaxIter(), judge)
        model = AdaBoostRegressionModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), says=says, errors=errors, classes=0)
        model.trees = trees
        return model
