"""Read-only SQL with a limit, typed errors and a check that does not execute."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_LIMIT = 100
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


class ReadOnlyError(ValueError):
    """The text is not a query."""


@dataclass(frozen=True)
class SqlResult:
    success: bool
    query: str
    rows: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    error_class: str | None = None
    error: str | None = None


def _parsed(spark: SparkSession, text: str):
    """The unresolved plan. Nothing is analysed and nothing runs, unlike spark.sql, which executes commands at once."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if not re.match(r"(select|with)\b", _COMMENT.sub(" ", text).strip(), re.I):
        raise ReadOnlyError("only SELECT and WITH queries are allowed")
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    writes = [spark._jvm.org.apache.spark.util.Utils.classForName(logical + name, True, False) for name in ("Command", "ParsedStatement")]
    open_ = [plan]
    while open_:
        node = open_.pop()
        if any(kind.isInstance(node) for kind in writes):
            raise ReadOnlyError("only SELECT and WITH queries are allowed")
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return plan


def _has_limit(plan, text: str) -> bool:
    """A limit of the outermost query. LIMIT ALL leaves no trace in the plan."""
    while plan.nodeName() in ("UnresolvedWith", "Offset"):
        plan = plan.children().apply(0)
    return plan.nodeName() in ("GlobalLimit", "LocalLimit") or bool(re.search(r"\blimit\s+all\s*;?\s*$", text, re.I))


def query(spark: SparkSession, text: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The lazy result of a read-only query; `limit` applies when the text has none of its own.

    The text is only parsed until its plan is known to be a query; Spark then gets it as it is, comments and literals included.
    """
    plan = _parsed(spark, text)
    df = spark.sql(text)
    return df if limit is None or _has_limit(plan, text) else df.limit(limit)


def validate(spark: SparkSession, text: str) -> StructType:
    """The result schema, from analysis alone: no job runs."""
    return query(spark, text, limit=None).schema


def execute(spark: SparkSession, text: str, limit: int | None = DEFAULT_LIMIT) -> SqlResult:
    """Result or error class (`read_only`, `missing_table`, `syntax`, `other`). An empty result is a success."""
    try:
        df = query(spark, text, limit)
        return SqlResult(True, text, df, df.columns)
    except ReadOnlyError as error:
        return SqlResult(False, text, error_class="read_only", error=str(error))
    except ParseException as error:
        return SqlResult(False, text, error_class="syntax", error=str(error))
    except AnalysisException as error:
        kind = "missing_table" if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" else "other"
        return SqlResult(False, text, error_class=kind, error=str(error))
