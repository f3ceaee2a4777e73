"""The sales view over the order tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismill.plans.registry import Tables


COLUMNS = ("order_id", "line", "part_id", "date", "region", "product", "brand", "amount")


def sales(t: Tables, *columns: str) -> DataFrame:
    """One row per order line: date, region of the customer, product kind and brand, amount; or just the named columns.

    A dimension is joined only for columns it provides: every line has its order, customer and part, so the rows are the same.
    """
    wanted = columns or COLUMNS
    rows = t.lineitem
    if {"date", "region"} & set(wanted):
        rows = rows.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "region" in wanted:
        nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
        customers = t.customer.select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
        rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if {"product", "brand"} & set(wanted):
        rows = rows.join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    provided = {
        "order_id": F.col("l_orderkey"), "line": F.col("l_linenumber"), "part_id": F.col("l_partkey"), "date": F.expr("CAST(o_orderdate AS DATE)"), "region": F.col("r_name"),
        "product": F.col("p_type"), "brand": F.col("p_brand"), "amount": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }
    return rows.select(*[provided[c].alias(c) for c in wanted])


SALES = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, CAST(o_orderdate AS DATE) AS date,
         r_name AS region, p_type AS product, p_brand AS brand, l_extendedprice * (1 - l_discount) AS amount
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

WITH_SALES = "WITH " + SALES
