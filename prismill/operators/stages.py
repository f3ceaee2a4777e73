"""Fitted pipeline stages that MLlib has none for; they save and load with the pipeline they are part of.

What was learned of a column's values is a table beside the metadata, not a list on the driver, so a column
may have any number of values. Scoring joins the table; a value that was not seen gets the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from prismill.functions.numbers import share
from prismill.operators.neighbours import nearest
from prismill.operators.preparation import fit_powers, yeo_johnson
from prismill.operators.shapes import lookup
from prismill.session import durable


class _HasPowers(HasInputCols):
    powers = Param(Params._dummy(), "powers", "power of each input column", typeConverter=TypeConverters.toListFloat)


class Powers(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the Yeo-Johnson power of each input column."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PowersModel:
        columns = self.getInputCols()
        found = fit_powers(dataset, columns)
        return PowersModel(inputCols=columns, powers=[found[c] for c in columns])


class PowersModel(Model, _HasPowers, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces each input column by its power transform; null stays null."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), powers: Sequence[float] = ()):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        powers = self.getOrDefault(self.powers)
        return dataset.withColumns({c: yeo_johnson(F.col(c).cast("double"), p) for c, p in zip(self.getInputCols(), powers, strict=True)})


class NonNegative(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Takes what is below 0 in a vector for 0: a scaler puts rows there that lie below all it was fitted on."""

    @keyword_only
    def __init__(self, *, inputCol: str = "", outputCol: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = F.transform(vector_to_array(self.getInputCol()), lambda v: F.greatest(v, F.lit(0.0)))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))


class _TableWriter(MLWriter):
    def __init__(self, instance: CodesModel | NearestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind: type[CodesModel | NearestModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> CodesModel | NearestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model.table = self.sparkSession.read.parquet(f"{path}/table")
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class CodesModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A column's values become their codes of a table (value, codes); one code is a number, several are a vector."""

    default = Param(Params._dummy(), "default", "codes of values that were not seen, null among them", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "", outputCol: str = "", default: Sequence[float] = (0.0,)):
        super().__init__()
        self.table: DataFrame | None = None
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        default = self.getOrDefault(self.default)
        name = self.getOutputCol()
        keyed = self.table.withColumnRenamed("value", self.getInputCol())
        found = lookup(dataset, keyed, self.getInputCol(), "codes", F.array(*[F.lit(float(x)) for x in default]), name)
        return found.withColumn(name, F.col(name)[0] if len(default) == 1 else array_to_vector(name))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class Frequencies(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns each value's share of the rows; a value that was not seen has 0."""

    @keyword_only
    def __init__(self, *, inputCol: str = "", outputCol: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CodesModel:
        total = dataset.agg(F.count(F.lit(1)).alias("n")).scalar()
        counts = dataset.groupBy(F.col(self.getInputCol()).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        model = CodesModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), default=[0.0])
        model.table = durable(counts.where("value IS NOT NULL").select("value", F.array(share(F.col("n"), total)).alias("codes")))
        return model


class ClassShares(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns each value's share of every class (labels 0, 1, ...); a value that was not seen has the shares of all rows."""

    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "", outputCol: str = "", labelCol: str = "label", classes: int = 2):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CodesModel:
        k = self.getOrDefault(self.classes)
        label = F.col(self.getLabelCol()).cast("int")
        counts = dataset.where(label.isNotNull()).groupBy(F.col(self.getInputCol()).alias("value"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
        counts = durable(counts)

        def shares(entries: str):
            found = F.map_from_entries(entries)
            total = F.aggregate(F.map_values(found), F.lit(0).cast("bigint"), lambda a, n: a + n)
            return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(share(F.get(F.map_values(F.map_filter(found, lambda key, _: key == i)), F.lit(0)), total), F.lit(0.0)))

        whole = counts.groupBy("label").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("label", "n")).alias("e"))
        overall = whole.select(shares("e").alias("codes")).first()["codes"]
        model = CodesModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), default=overall)
        grouped = counts.where("value IS NOT NULL").groupBy("value").agg(F.collect_list(F.struct("label", "n")).alias("e"))
        model.table = durable(grouped.select("value", shares("e").alias("codes")))
        return model


def _place(features: str) -> Column:
    """The vector as an array; -0.0 and 0.0 are one place."""
    return F.transform(vector_to_array(features), lambda v: v + F.lit(0.0))


class NearestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLReadable, MLWritable):
    """The majority of the k nearest training rows, ties to the smaller class, and the share of each class; without classes their mean.

    `table` holds the training rows (key, x); a key is a hash that orders rows of equal distance, a space and the label. A row
    whose vector holds NaN gets `default`, the shares or the mean of all training rows. Scoring runs jobs, so it takes no stream.
    """

    k = Param(Params._dummy(), "k", "number of neighbours", typeConverter=TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", typeConverter=TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the vectors", typeConverter=TypeConverters.toInt)
    default = Param(Params._dummy(), "default", "shares of the classes, or the mean, of all training rows", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", predictionCol: str = "prediction", probabilityCol: str = "probability",
        k: int = 5, classes: int = 0, width: int = 0, default: Sequence[float] = (0.0,),
    ):
        super().__init__()
        self.table: DataFrame | None = None
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, default, kept = self.getOrDefault(self.classes), self.getOrDefault(self.default), dataset.columns
        rows = dataset.withColumn("__x", _place(self.getFeaturesCol()))
        asked = rows.select(F.lit("").alias("key"), F.col("__x").alias("x")).distinct()
        near = nearest(asked, self.table, "key", self.getOrDefault(self.width), self.getOrDefault(self.k)).where(F.size("near") > 0)
        labelled = near.select(F.col("x").alias("__x"), F.transform("near", lambda n: F.substring_index(n["other"], " ", -1).cast("double")).alias("labels"))
        if classes:
            codes = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: share(F.size(F.filter("labels", lambda y: y == c)), F.size("labels")))
        else:
            codes = F.array(share(F.aggregate("labels", F.lit(0.0), lambda s, y: s + y), F.size("labels")))
        found = lookup(rows, labelled.select("__x", codes.alias("codes")), "__x", "codes", F.array(*[F.lit(float(v)) for v in default]), "__codes")
        if not classes:
            return found.select(*kept, F.col("__codes")[0].alias(self.getPredictionCol()))
        best = (F.array_position("__codes", F.array_max("__codes")) - 1).cast("double")
        return found.select(*kept, array_to_vector("__codes").alias(self.getProbabilityCol()), best.alias(self.getPredictionCol()))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class NearestNeighbours(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps all training rows for the exact search of the k nearest. Labels are 0, 1, ..., `classes` - 1, or numbers if `classes` is 0."""

    k = Param(Params._dummy(), "k", "number of neighbours", typeConverter=TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", probabilityCol: str = "probability", k: int = 5, classes: int = 0
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", k=5, classes=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NearestModel:
        classes = self.getOrDefault(self.classes)
        label = F.col(self.getLabelCol()).cast("double")
        rows = dataset.where(label.isNotNull()).select(_place(self.getFeaturesCol()).alias("x"), label.alias("label"))
        # Equal rows are numbered, so that each has a hash of its own: which of several labels at one distance vote depends on no label.
        counts = rows.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
        copies = counts.select("x", "label", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
        key = F.concat_ws(" ", F.hex(F.xxhash64("x", "label", "copy")), F.col("label").cast("string"))
        table = durable(copies.select(key.alias("key"), "x"))
        if classes:
            sizes = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            default = [sizes.get(c, 0) / (sum(sizes.values()) or 1) for c in range(classes)]
        else:
            default = [rows.agg(F.avg("label")).first()[0] or 0.0]
        first = table.select(F.size("x").alias("width")).first()
        model = NearestModel(
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
            k=self.getOrDefault(self.k), classes=classes, width=first["width"] if first else 0, default=default,
        )
        model.table = table
        return model
