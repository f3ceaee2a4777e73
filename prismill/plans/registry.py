"""The catalogue of named queries: a Spark callable and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prismill.session import pin_runtime


class Tables:
    """The tables of one data folder as attributes: `t.lineitem`, `t.orders`, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = pin_runtime(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def named(name: str, sql: str | None = None):
    """Register the decorated function `Tables -> DataFrame` under a name."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(build, sql.strip() if sql else None)
        return build

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, folder: entry.build(Tables(spark, folder))

    return {name: bind(entry) for name, entry in CATALOG.items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in CATALOG.items() if entry.sql}
