"""Writing predictions and generated sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_predictions(df: DataFrame, path: str, kind: str = "csv") -> None:
    """All input columns and the prediction columns, in parallel part files with a header."""
    df.write.mode("overwrite").format(kind).option("header", True).save(path)


def synthetic_sales(spark: SparkSession, rows: int = 300, last_day: str = "2025-05-24", seed: int = 42) -> DataFrame:
    """Generated sales over 180 days: four even regions, products at .5/.3/.2, base price +-20 %,
    and 70 % of the rows in the first 90 days."""
    u = {name: F.rand(seed + i) for i, name in enumerate(("region", "product", "price", "half", "day"))}
    base = F.when(F.col("product") == "Phone", 800.0).when(F.col("product") == "Tablet", 500.0).otherwise(1200.0)
    start = F.date_sub(F.lit(last_day).cast("date"), 179)
    offset = F.when(u["half"] < 0.7, F.floor(u["day"] * 90)).otherwise(90 + F.floor(u["day"] * 90))
    return (
        spark.range(1, rows + 1)
        .withColumn("date", F.date_add(start, offset.cast("int")))
        .withColumn("__r", u["region"])
        .withColumn("region", F.when(F.col("__r") < 0.25, "North").when(F.col("__r") < 0.5, "South").when(F.col("__r") < 0.75, "East").otherwise("West"))
        .withColumn("__p", u["product"])
        .withColumn("product", F.when(F.col("__p") < 0.5, "Phone").when(F.col("__p") < 0.8, "Tablet").otherwise("Laptop"))
        .withColumn("amount", F.round(base * (0.8 + 0.4 * u["price"]), 2))
        .select("id", "date", "region", "product", "amount")
    )
