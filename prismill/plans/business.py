"""Named queries: SQL shapes over the sales view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismill.functions.dates import month_text
from prismill.operators import ordered, shapes, sqlrun
from prismill.plans.registry import Tables, named
from prismill.plans.star import WITH_SALES, sales


def money(column: str, name: str | None = None):
    return F.round(F.col(column), 4).alias(name or column)


@named(
    "top_brands_per_region",
    f"""{WITH_SALES}, totals AS (SELECT region, brand, SUM(amount) AS total FROM sales GROUP BY region, brand),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY total DESC, brand) AS position FROM totals)
SELECT region, brand, ROUND(total, 4) AS total, CAST(position AS INTEGER) AS position FROM numbered WHERE position <= 3""",
)
def top_brands_per_region(t: Tables) -> DataFrame:
    totals = sales(t, "region", "brand", "amount").groupBy("region", "brand").agg(F.sum("amount").alias("total"))
    return shapes.top_per_group(totals, "region", "total", 3, ["brand"]).select("region", "brand", money("total"), "position")


@named(
    "readonly_sql",
    "SELECT o_orderpriority AS priority, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority",
)
def readonly_sql(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return sqlrun.query(
        t.spark,
        "SELECT o_orderpriority AS priority, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1;",
    )


@named(
    "readonly_sql_limited",
    "SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def readonly_sql_limited(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return sqlrun.query(t.spark, "SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders ORDER BY price DESC, order_id;")


@named(
    "region_filter_projection",
    f"""{WITH_SALES} SELECT order_id, CAST(line AS INTEGER) AS line, part_id, CAST(date AS VARCHAR) AS sold_on, product, ROUND(amount, 4) AS amount
FROM sales WHERE region = 'EUROPE'""",
)
def region_filter_projection(t: Tables) -> DataFrame:
    return (
        sales(t)
        .where(F.col("region") == "EUROPE")
        .select("order_id", "line", "part_id", F.col("date").cast("string").alias("sold_on"), "product", money("amount"))
    )


@named(
    "last_six_months",
    f"""{WITH_SALES} SELECT region, strftime(date, '%Y-%m') AS month, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows
FROM sales WHERE date >= (SELECT MAX(date) FROM sales) - INTERVAL 6 MONTH GROUP BY ALL""",
)
def last_six_months(t: Tables) -> DataFrame:
    return shapes.recent_totals(sales(t, "date", "region", "amount"), ["region"], "date", "amount", 6).select("region", "month", money("total"), "n_rows")


@named("last_three_months_of_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 3 MONTH")
def last_three_months_of_orders(t: Tables) -> DataFrame:
    return shapes.last_months(t.orders.withColumn("day", F.col("o_orderdate").cast("date")), "day", 3).select("o_orderkey", "o_totalprice")


def _span(span: str, condition: str):
    @named(
        f"as_of_{span}",
        f"""SELECT o_orderpriority AS priority, COUNT(*) AS n_rows, ROUND(SUM(o_totalprice), 2) AS total
FROM orders WHERE {condition} GROUP BY o_orderpriority""",
    )
    def build(t: Tables) -> DataFrame:
        rows = shapes.as_of_range(t.orders.withColumn("day", F.col("o_orderdate").cast("date")), "day", "2001-03-31", span)
        return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
        )

    return build


_span("last_month", "CAST(o_orderdate AS DATE) >= DATE '2001-03-31' - INTERVAL 1 MONTH")
_span("last_3_months", "CAST(o_orderdate AS DATE) >= DATE '2001-03-31' - INTERVAL 3 MONTH")
_span("last_year", "CAST(o_orderdate AS DATE) >= DATE '2001-03-31' - INTERVAL 12 MONTH")
_span("this_year", "CAST(o_orderdate AS DATE) >= date_trunc('year', DATE '2001-03-31')")
_span("month_to_date", "CAST(o_orderdate AS DATE) BETWEEN date_trunc('month', DATE '2001-03-31') AND DATE '2001-03-31'")


@named("totals_by_month", f"{WITH_SALES} SELECT strftime(date, '%Y-%m') AS month, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows FROM sales GROUP BY 1")
def totals_by_month(t: Tables) -> DataFrame:
    return shapes.totals_by_month(sales(t, "date", "amount"), "date", "amount").select("month", money("total"), "n_rows")


@named(
    "totals_by_year_quarter",
    f"""{WITH_SALES} SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows
FROM sales GROUP BY 1, 2""",
)
def totals_by_year_quarter(t: Tables) -> DataFrame:
    dims = [F.year("date").alias("year"), F.quarter("date").alias("quarter")]
    return shapes.totals_by(sales(t, "date", "amount"), dims, "amount").select("year", "quarter", money("total"), "n_rows")


@named("first_quarter_sales", f"{WITH_SALES} SELECT product, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows FROM sales WHERE quarter(date) = 1 GROUP BY product")
def first_quarter_sales(t: Tables) -> DataFrame:
    return shapes.totals_by(sales(t, "date", "product", "amount").where(F.quarter("date") == 1), ["product"], "amount").select("product", money("total"), "n_rows")


@named(
    "default_listing",
    f"""{WITH_SALES} SELECT CAST(date AS VARCHAR) AS date, region, product, ROUND(amount, 4) AS amount FROM sales
ORDER BY sales.date DESC, order_id, line, part_id, amount LIMIT 10""",
)
def default_listing(t: Tables) -> DataFrame:
    return (
        sales(t)
        .orderBy(F.col("date").desc(), "order_id", "line", "part_id", "amount")
        .limit(10)
        .select(F.col("date").cast("string").alias("date"), "region", "product", money("amount"))
    )


@named(
    "declared_metric",
    f"""{WITH_SALES} SELECT brand, region, ROUND(AVG(amount), 4) AS avg_amount FROM sales
WHERE product = 'ECONOMY' AND amount >= 1000 GROUP BY brand, region""",
)
def declared_metric(t: Tables) -> DataFrame:
    rows = shapes.metric_query(sales(t, "amount", "brand", "region", "product"), "amount", "avg", ["brand", "region"], [("product", "=", "ECONOMY"), ("amount", ">=", 1000.0)])
    return rows.select("brand", "region", money("avg_amount"))


@named(
    "declared_metric_top",
    f"""{WITH_SALES} SELECT brand, COUNT(DISTINCT order_id) AS count_distinct_order_id FROM sales GROUP BY brand
ORDER BY count_distinct_order_id DESC, brand LIMIT 5""",
)
def declared_metric_top(t: Tables) -> DataFrame:
    return shapes.metric_query(sales(t, "order_id", "brand"), "order_id", "count_distinct", ["brand"], limit=5)


@named("global_totals", f"{WITH_SALES} SELECT ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows, ROUND(AVG(amount), 4) AS mean FROM sales")
def global_totals(t: Tables) -> DataFrame:
    return sales(t, "amount").agg(
        F.round(F.sum("amount"), 4).alias("total"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("amount"), 4).alias("mean")
    )


@named(
    "statistics_bundle",
    f"""{WITH_SALES} SELECT ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows, COUNT(DISTINCT region) AS n_regions, COUNT(DISTINCT product) AS n_products,
ROUND(AVG(amount), 4) AS mean, CAST(MIN(date) AS VARCHAR) AS first_day, CAST(MAX(date) AS VARCHAR) AS last_day FROM sales""",
)
def statistics_bundle(t: Tables) -> DataFrame:
    return sales(t, "amount", "region", "product", "date").agg(
        F.round(F.sum("amount"), 4).alias("total"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("region").alias("n_regions"),
        F.count_distinct("product").alias("n_products"),
        F.round(F.avg("amount"), 4).alias("mean"),
        F.min("date").cast("string").alias("first_day"),
        F.max("date").cast("string").alias("last_day"),
    )


@named("totals_by_region", f"{WITH_SALES} SELECT region, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows FROM sales GROUP BY region")
def totals_by_region(t: Tables) -> DataFrame:
    return shapes.totals_by(sales(t, "region", "amount"), ["region"], "amount").orderBy(F.col("total").desc(), "region").select("region", money("total"), "n_rows")


@named("totals_by_region_product", f"{WITH_SALES} SELECT region, product, ROUND(SUM(amount), 4) AS total, COUNT(*) AS n_rows FROM sales GROUP BY region, product")
def totals_by_region_product(t: Tables) -> DataFrame:
    return shapes.totals_by(sales(t, "region", "product", "amount"), ["region", "product"], "amount").select("region", "product", money("total"), "n_rows")


@named(
    "busy_parts_by_region",
    f"""{WITH_SALES} SELECT region, COUNT(*) AS n_rows, ROUND(SUM(amount), 4) AS total FROM sales
WHERE part_id IN (SELECT part_id FROM sales GROUP BY part_id HAVING COUNT(*) > 30) GROUP BY region""",
)
def busy_parts_by_region(t: Tables) -> DataFrame:
    return shapes.totals_of_busy(sales(t, "part_id", "region", "amount"), "part_id", ["region"], "amount", 30).select("region", "n_rows", money("total"))


@named(
    "lines_of_busy_parts",
    """SELECT l_returnflag, COUNT(*) AS n_rows FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 30) GROUP BY l_returnflag""",
)
def lines_of_busy_parts(t: Tables) -> DataFrame:
    kept = t.lineitem.join(shapes.busy_groups(t.lineitem, "l_partkey", 30), "l_partkey", "left_semi")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))


# The years that the orders cover.
PIVOT_YEARS = list(range(1995, 2002))


@named(
    "year_pivot",
    f"""{WITH_SALES} SELECT product,
{", ".join(f"ROUND(SUM(CASE WHEN year(date) = {y} THEN amount ELSE 0 END), 4) AS total_{y}" for y in PIVOT_YEARS)} FROM sales GROUP BY product""",
)
def year_pivot(t: Tables) -> DataFrame:
    return shapes.year_pivot(sales(t, "date", "product", "amount"), ["product"], "date", "amount", PIVOT_YEARS).select("product", *[money(f"total_{y}") for y in PIVOT_YEARS])


@named("distinct_groups", f"{WITH_SALES} SELECT region, brand FROM sales GROUP BY region, brand")
def distinct_groups(t: Tables) -> DataFrame:
    return sales(t, "region", "brand").distinct()


@named(
    "value_counts",
    "SELECT c_mktsegment, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(c_mktsegment) FROM customer), 6) AS share FROM customer GROUP BY c_mktsegment",
)
def value_counts(t: Tables) -> DataFrame:
    return shapes.value_counts(t.customer, "c_mktsegment").withColumn("share", F.round("share", 6))


@named(
    "ranks_per_region",
    f"""{WITH_SALES}, totals AS (SELECT region, brand, COUNT(*) AS total FROM sales GROUP BY region, brand)
SELECT region, brand, total, CAST(RANK() OVER (PARTITION BY region ORDER BY total DESC) AS INTEGER) AS rank,
CAST(DENSE_RANK() OVER (PARTITION BY region ORDER BY total DESC) AS INTEGER) AS dense_rank FROM totals""",
)
def ranks_per_region(t: Tables) -> DataFrame:
    totals = sales(t, "region", "brand", "amount").groupBy("region", "brand").agg(F.count(F.lit(1)).alias("total"))
    return shapes.ranked(totals, "region", "total").drop("at_or_above")


@named(
    "running_total_by_day",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, SUM(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, ROUND(total, 2) AS total, ROUND(SUM(total) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM d""",
)
def running_total_by_day(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return shapes.running_total(daily, ["day"], "total").select(
        F.col("day").cast("string").alias("day"), F.round("total", 2).alias("total"), F.round("running_total", 2).alias("running_total")
    )


@named(
    "running_total_per_customer",
    """SELECT o_custkey, o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total
FROM orders""",
)
def running_total_per_customer(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    total = shapes.running_total(rows, ["o_orderdate", "o_orderkey"], "o_totalprice", ["o_custkey"])
    return total.select("o_custkey", "o_orderkey", F.round("running_total", 2).alias("running_total"))


@named("ntile_by_balance", "SELECT c_custkey, CAST(NTILE(7) OVER (ORDER BY c_acctbal, c_custkey) AS INTEGER) AS bucket FROM customer")
def ntile_by_balance(t: Tables) -> DataFrame:
    return ordered.ntile(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 7).select("c_custkey", "bucket")


@named(
    "yearly_growth",
    f"""{WITH_SALES}, y AS (SELECT product, CAST(year(date) AS INTEGER) AS year, SUM(amount) AS total FROM sales GROUP BY 1, 2)
SELECT product, year, ROUND(total, 4) AS total,
ROUND((total - LAG(total) OVER w) / LAG(total) OVER w * 100, 4) AS growth_pct FROM y WINDOW w AS (PARTITION BY product ORDER BY year)""",
)
def yearly_growth(t: Tables) -> DataFrame:
    return shapes.yearly_growth(sales(t, "date", "product", "amount"), "product", "date", "amount").select("product", "year", money("total"), money("growth_pct"))


@named(
    "event_gaps",
    """SELECT event_id, CAST(epoch_us(ts) - LAG(epoch_us(ts)) OVER (ORDER BY ts) AS BIGINT) AS gap FROM events""",
)
def event_gaps(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("us"))
    return ordered.previous_gap(rows, "us").select("event_id", "gap")


@named(
    "time_halves",
    """WITH n AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS i, COUNT(*) OVER () AS total FROM events)
SELECT CASE WHEN i < total // 2 THEN 'first' ELSE 'second' END AS half, COUNT(*) AS n_rows, ROUND(SUM(value), 4) AS total FROM n GROUP BY 1""",
)
def time_halves(t: Tables) -> DataFrame:
    rows = ordered.cumulate(t.events.select("ts", "event_id", "value"), ["ts", "event_id"], index="position")
    n = t.events.select(F.count(F.lit(1))).scalar()
    half = F.when(F.col("position") <= F.floor(n / 2), "first").otherwise("second")
    return rows.groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


@named("top_five_parts", f"{WITH_SALES} SELECT part_id, ROUND(SUM(amount), 4) AS total FROM sales GROUP BY part_id ORDER BY SUM(amount) DESC, part_id LIMIT 5")
def top_five_parts(t: Tables) -> DataFrame:
    totals = sales(t, "part_id", "amount").groupBy("part_id").agg(F.sum("amount").alias("total"))
    return totals.orderBy(F.col("total").desc(), "part_id").limit(5).select("part_id", money("total"))


@named(
    "latest_orders",
    "SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
)
def latest_orders(t: Tables) -> DataFrame:
    return (
        t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey")
        .limit(10)
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_totalprice")
    )


@named(
    "best_and_worst_brand",
    f"""{WITH_SALES}, totals AS (SELECT brand, SUM(amount) AS total FROM sales GROUP BY brand)
SELECT (SELECT brand FROM totals ORDER BY total DESC, brand LIMIT 1) AS highest, (SELECT brand FROM totals ORDER BY total, brand LIMIT 1) AS lowest""",
)
def best_and_worst_brand(t: Tables) -> DataFrame:
    return shapes.first_or_last_group(sales(t, "brand", "amount"), "brand", "amount")


@named("largest_parts", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def largest_parts(t: Tables) -> DataFrame:
    return t.part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@named(
    "lookup_with_default",
    """WITH s AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
SELECT c_custkey, ROUND(COALESCE(spent, 0), 2) AS spent FROM customer LEFT JOIN s ON c_custkey = o_custkey""",
)
def lookup_with_default(t: Tables) -> DataFrame:
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return shapes.lookup(t.customer.select("c_custkey"), spent, "c_custkey", "spent", F.lit(0.0)).select("c_custkey", F.round("spent", 2).alias("spent"))


@named(
    "identical_rows",
    """SELECT p_brand, p_type, p_size FROM part WHERE p_retailprice < 950
INTERSECT SELECT p_brand, p_type, p_size FROM part WHERE p_retailprice >= 950""",
)
def identical_rows(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_type", "p_size", "p_retailprice")
    cheap = rows.where("p_retailprice < 950").drop("p_retailprice")
    return shapes.identical_rows(cheap, rows.where("p_retailprice >= 950").drop("p_retailprice"))


@named(
    "customers_without_large_orders",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def customers_without_large_orders(t: Tables) -> DataFrame:
    """Customers none of whose orders exceeds 400 000; the limit is the question."""
    large = t.orders.where("o_totalprice > 400000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@named("documents_without_labels", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def documents_without_labels(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "lang")


@named(
    "at_most_three_above",
    f"""{WITH_SALES}, totals AS (SELECT region, brand, COUNT(*) AS total FROM sales GROUP BY region, brand)
SELECT region, brand, total, (SELECT COUNT(*) FROM totals u WHERE u.region = totals.region AND u.total >= totals.total) AS at_or_above
FROM totals WHERE (SELECT COUNT(*) FROM totals u WHERE u.region = totals.region AND u.total >= totals.total) <= 3""",
)
def at_most_three_above(t: Tables) -> DataFrame:
    totals = sales(t, "region", "brand", "amount").groupBy("region", "brand").agg(F.count(F.lit(1)).alias("total"))
    return shapes.at_least_as_large(totals, "region", "total", 3)


@named(
    "union_of_extremes",
    """(SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal < 0)
UNION ALL (SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0)""",
)
def union_of_extremes(t: Tables) -> DataFrame:
    customers = t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers)
