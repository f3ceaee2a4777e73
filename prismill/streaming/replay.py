"""File streams and runs that stop when all available input is processed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from prismill.session import shared_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, with a known schema and a bound on each micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Write a stream to Parquet until its input is used up; exactly-once through the sink's own log. Returns the table."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], path: str) -> None:
    """Hand each micro-batch to a function until the input is used up. The function must be idempotent per batch number."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
