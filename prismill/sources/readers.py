"""Reading files, checking them, naming and registering them as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prismill.functions.keys import shuffle_key
from prismill.functions.numbers import denull_nan

CORRUPT = "_corrupt"
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


class SourceError(ValueError):
    """A file that cannot be read: missing, of an unknown kind, or empty of columns."""


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejects: DataFrame


def file_format(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".xlsx", ".xls"):
        raise SourceError(f"{suffix} is not readable by Spark; convert it to CSV or Parquet first")
    if suffix not in FORMATS:
        raise SourceError(f"unsupported file type {suffix!r}; expected one of {sorted(FORMATS)}")
    return FORMATS[suffix]


def infer_contract(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a file, inferred once; store its JSON and read with it from then on."""
    kind = file_format(path)
    try:
        reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
        schema = reader.format(kind).load(path).schema
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error.getCondition()}") from error
    if not schema.fields:
        raise SourceError(f"{path} has no columns")
    return schema


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = False) -> Loaded:
    """Rows that fit the schema, and CSV lines that do not (too short, too long, wrong type)."""
    kind = file_format(path)
    schema = schema or infer_contract(spark, path)
    if kind != "csv":
        frame = denull_nan(spark.read.schema(schema).format(kind).load(path))
        return Loaded(frame, spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())])))
    if strict:
        frame = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
        return Loaded(denull_nan(frame), spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())])))
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    frame = (
        spark.read.schema(wide)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # Whether a line fits must not depend on the columns a query happens to read.
        .option("columnPruning", False)
        .csv(path)
    )
    # Always true; Spark refuses scans of the corrupt column alone, as a plain count would ask for.
    first = F.col(schema.fieldNames()[0])
    frame = frame.where(first.isNull() | (F.length(first.cast("string")) >= 0))
    return Loaded(denull_nan(frame.where(F.col(CORRUPT).isNull()).drop(CORRUPT)), frame.where(F.col(CORRUPT).isNotNull()))


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, type, bytes, rows and number of columns."""
    loaded = read_file(spark, path).rows
    per_file = (
        spark.read.format(file_format(path))
        .option("header", True)
        .load(path)
        .groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return per_file.select(
        "file_path", "file_size", "rows", F.lit(len(loaded.columns)).alias("columns"), F.lit(file_format(path)).alias("file_type")
    )


def clean_name(name: str) -> str:
    """Lower case, blanks and `-` and `/` to `_`, parentheses dropped."""
    return re.sub(r"[()]", "", re.sub(r"[ \-/]", "_", name.strip().lower()))


def clean_names(df: DataFrame) -> DataFrame:
    """All columns renamed by `clean_name`; a name that is taken gets `_2`, `_3`, ..."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        base = clean_name(column)
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def register(df: DataFrame, table: str, stored: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Make a frame queryable by name, replacing what had that name."""
    named = clean_names(df)
    if stored:
        named.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(table)
        return df.sparkSession.table(table)
    named.createOrReplaceTempView(table)
    return named


def describe_table(df: DataFrame, samples: int = 3, order_by: Sequence[str] = ()) -> DataFrame:
    """Position, name, type and the first sample values of each column, with the row count."""
    ordered = df.orderBy(*order_by) if order_by else df
    shown = ordered.limit(samples)
    fields = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"s_{i}").alias("sample_values"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    collected = shown.agg(*[F.collect_list(F.col(c).cast("string")).alias(f"s_{i}") for i, c in enumerate(df.columns)])
    rows = df.select(F.count(F.lit(1))).scalar()
    return collected.select(F.explode(F.array(*fields)).alias("f"), rows.alias("row_count")).select("f.*", "row_count")


def head(df: DataFrame, order_by: Sequence[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def sample(df: DataFrame, keys: Sequence[str], n: int = 5, seed: int = 42) -> DataFrame:
    """At most n rows in a random order that depends on the keys and the seed only."""
    return df.orderBy(shuffle_key(*[F.col(k) for k in keys], seed=seed), *keys).limit(n)
