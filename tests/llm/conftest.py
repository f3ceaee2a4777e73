"""Small frames for the operators of the subpackage; the session fixture is that of the other tests."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

ODD = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), StructField("lang", StringType()), *[StructField(c, StringType()) for c in ("score", "drop", "n_lines", "id", "size", "copies", "component_id", "h", "key")]])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(20_000))
    rows = [
        (1, "the same short line\nand a second line of it", "a", "en"), (2, "The same short line  \nanother one here", "a", "en"), (3, "the same short line\nand a second line of it", "b", "en"),
        (4, None, None, None), (5, "", "b", "de"), (6, " \t\n\x0b ", None, "en"), (7, long, "a", "en"), (8, long + " tail", "a", "en"),
        (None, "the same short line", "a", None), (None, None, None, None), (9, "päss wörd = x; token: abcdefgh12", "c", "de"), (9, "päss wörd = x; token: abcdefgh12", "c", "de"), (10, "word", "c", "fr"),
    ]
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], ODD)
