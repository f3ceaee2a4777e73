"""Date expressions. Month arithmetic clamps to the month end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The layouts tried in this order when text is read as a date.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd")


def month_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def parse_date(text: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """The first layout that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in layouts])


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a date or a time-zone-free timestamp, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
