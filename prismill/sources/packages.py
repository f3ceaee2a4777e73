"""Model packages: a fitted pipeline and its metadata in one folder per model."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA = (
    "model_id string, name string, task string, target string, saved_at string, features array<string>, classes array<string>, "
    "metrics map<string, double>, comparison array<struct<model: string, cv_score: double, test_score: double>>"
)


def save_package(
    spark: SparkSession,
    root: str,
    model: PipelineModel,
    name: str,
    task: str,
    target: str,
    features: list[str],
    classes: list[str],
    metrics: dict[str, float],
    comparison: list[tuple[str, float, float]],
    saved_at: str,
    model_id: str | None = None,
) -> str:
    """Write model and metadata; metrics are those of the task. Returns the id."""
    model_id = model_id or uuid.uuid4().hex
    model.write().overwrite().save(f"{root}/{model_id}/model")
    row = (model_id, name, task, target, saved_at, features, classes, metrics, comparison)
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").json(f"{root}/{model_id}/metadata")
    return model_id


def load_package(spark: SparkSession, root: str, model_id: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{root}/{model_id}/model"), spark.read.schema(METADATA).json(f"{root}/{model_id}/metadata")


def list_packages(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every package, newest first."""
    return spark.read.schema(METADATA).json(f"{root}/*/metadata").orderBy(F.col("saved_at").desc(), "model_id")
