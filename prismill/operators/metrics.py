"""Metric tables from labels, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from prismill.functions.numbers import share
from prismill.operators.ordered import cumulate
from prismill.operators.quantiles import fit_quantiles

# Fixed value: the smallest step between doubles at one, used to keep logarithms and quotients finite.
EPSILON = 2.220446049250313e-16

LOWER_IS_BETTER = ("mse", "rmse", "mae", "mape", "max_error", "median_absolute_error", "log_loss")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n): the one shuffle behind all count metrics."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) from a confusion table; undefined values are 0."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    totals = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    rates = totals.select(
        "*",
        F.coalesce(share(F.col("hits"), F.col("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(share(F.col("hits"), F.col("support")), F.lit(0.0)).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def class_report(cells: DataFrame) -> DataFrame:
    """Per-class rows and the rows `macro avg` and `weighted avg`."""
    rows = per_class(cells)
    named = rows.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    support = F.col("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = rows.agg(*[F.try_divide(F.sum(F.col(c) * support), F.sum(support)).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return named.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(weighted.withColumn("class", F.lit("weighted avg")))


def classification(cells: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, F1 (of the larger label when there are two, else weighted by support) and Matthews correlation."""
    rows = per_class(cells)
    s = F.sum("support").cast("double")
    hits, predicted, support = F.sum("hits"), F.col("predicted").cast("double"), F.col("support").cast("double")
    spread = F.sqrt((s * s - F.sum(predicted * predicted)) * (s * s - F.sum(support * support)))
    two = F.count(F.lit(1)) <= 2

    def overall(c: str):
        binary = F.max(F.struct("class", c))[c]
        return F.when(two, binary).otherwise(F.try_divide(F.sum(F.col(c) * support), s)).alias(c)

    return rows.agg(
        F.try_divide(hits.cast("double"), s).alias("accuracy"),
        overall("precision"),
        overall("recall"),
        overall("f1"),
        F.coalesce(F.try_divide(hits * s - F.sum(predicted * support), spread), F.lit(0.0)).alias("mcc"),
    )


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_pos, n_neg, auc) by rank sums with ties counted half. Each distinct score is one counted row
    before the cumulative sum runs over range-partitioned scores."""
    positive = F.col(label).cast("int") == 1
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    running = cumulate(counts, ["score"], by, sums={"neg_upto": F.col("neg")})
    below = F.col("neg_upto") - F.col("neg") / 2.0
    sums = running.groupBy(*by).agg(F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def auc_one_vs_rest(df: DataFrame, label: str, scores: dict[object, str]) -> DataFrame:
    """One row: AUC of every class against the rest, weighted by class size. `scores` names the score column per class."""
    cells = F.array(*[F.struct(F.lit(str(k)).alias("class"), (F.col(label) == F.lit(k)).cast("int").alias("is_class"), F.col(c).alias("score")) for k, c in scores.items()])
    long = df.select(F.explode(cells).alias("cell")).select("cell.*")
    parts = auc(long, "is_class", "score", ["class"])
    return parts.agg(F.try_divide(F.sum(F.col("auc") * F.col("n_pos")), F.sum("n_pos")).alias("auc"))


def log_loss(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mean negative log likelihood of a 0/1 label under the clipped probability of 1."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - EPSILON)), F.lit(EPSILON))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with the error metrics, in one aggregate plus the exact median of the absolute error."""
    y, e = F.col("y"), F.col("e")
    rows = df.select(F.col(label).cast("double").alias("y"), (F.col(label) - F.col(prediction)).cast("double").alias("e")).withColumn("abs_e", F.abs("e"))
    median = F.lit(fit_quantiles(rows, ["abs_e"], [0.5]).get("abs_e", [None])[0]).cast("double")
    n = F.count(F.lit(1))
    return rows.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg("abs_e").alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * n)).alias("r2"),
        F.avg(F.col("abs_e") / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        F.max("abs_e").alias("max_error"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
    ).withColumn("median_absolute_error", median)


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys..., metric, value)."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def rank_models(metrics: DataFrame) -> DataFrame:
    """(model, metric, value, position) per metric, errors ascending; ties by model name."""
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(signed.asc_nulls_last(), "model")
    return metrics.withColumn("position", F.row_number().over(w))


def comparison_table(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric."""
    return metrics.groupBy("model").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])


# Model names that are the usual choice per task.
USUAL_MODELS = {
    "classification": ("RandomForest", "XGBoost", "LightGBM", "LogisticRegression"),
    "regression": ("RandomForest", "XGBoost", "LightGBM", "Ridge", "Lasso"),
}


def rating(score):
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "acceptable").otherwise("needs_improvement")


def model_quality(results: DataFrame) -> DataFrame:
    """Score of trained models (task, model, cv_score, test_score) out of 100: 20 off for a gap above .15 between
    cross-validation and test, 10 for an unusual model, up to 20 for a low score."""
    gap = F.abs(F.col("cv_score") - F.col("test_score"))
    overfits = F.coalesce((F.col("test_score") != 0) & (gap > 0.15), F.lit(False))
    classify = F.col("task") == "classification"
    usual = F.when(classify, F.col("model").rlike("|".join(USUAL_MODELS["classification"]))).otherwise(F.col("model").rlike("|".join(USUAL_MODELS["regression"])))
    cv = F.col("cv_score")
    low = F.when(classify & (cv < 0.60), 20).when(classify & (cv < 0.70), 10).when(~classify & (cv < 0.30), 20).otherwise(0)
    score = 100 - F.when(overfits, 20).otherwise(0) - F.when(usual, 0).otherwise(10) - low
    return results.select("*", gap.alias("overfit_gap"), overfits.alias("overfits"), low.alias("low_score_points"), score.alias("score"), rating(score).alias("rating"))


def stage_score(scores: DataFrame) -> DataFrame:
    """Whole points of cleaning (.25), features (.35), models (.40) and any other stage (.33) summed per run."""
    weight = F.when(F.col("stage") == "cleaning", 0.25).when(F.col("stage") == "features", 0.35).when(F.col("stage") == "models", 0.40).otherwise(0.33)
    total = F.floor(F.round(F.sum(F.col("score") * weight), 6)).cast("int")
    return scores.groupBy("run").agg(total.alias("score"), rating(total).alias("rating"))
