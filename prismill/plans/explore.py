"""Named queries: exploratory statistics and features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from prismill.operators import cleaning, exploration, features, statistics
from prismill.plans.quality import WITH_GAPPY, gappy, rounded
from prismill.plans.registry import Tables, named

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- classes, leakage, cardinality ------------------------------------------------------------------------


@named(
    "class_imbalance",
    """WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, COUNT(*) AS n FROM labels GROUP BY 1),
f AS (SELECT COUNT(*) AS n_classes, (SELECT class FROM c ORDER BY n, class LIMIT 1) AS minority_class, (SELECT class FROM c ORDER BY n DESC, class LIMIT 1) AS majority_class,
MIN(n) * 100.0 / SUM(n) AS p, MAX(n) * 1.0 / MIN(n) AS r FROM c)
SELECT n_classes, minority_class, majority_class, ROUND(p, 6) AS minority_pct, ROUND(r, 6) AS imbalance_ratio, p < 20 AS is_imbalanced,
CASE WHEN p < 5 THEN 'severe' WHEN p < 20 THEN 'moderate' ELSE 'mild' END AS severity,
CASE WHEN p < 5 THEN 'smote,class_weights' WHEN p < 20 THEN 'class_weights,stratified_sampling' ELSE '' END AS advice FROM f""",
)
def class_imbalance(t: Tables) -> DataFrame:
    return rounded(exploration.class_imbalance(t.labels, "toxic"))


@named(
    "class_counts",
    "SELECT o_orderstatus AS class, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM orders), 6) AS pct FROM orders GROUP BY o_orderstatus",
)
def class_counts(t: Tables) -> DataFrame:
    return rounded(exploration.class_counts(t.orders, "o_orderstatus"))


@named(
    "leakage",
    """SELECT 'gross_price' AS column_name, 'high_correlation' AS kind, ROUND(corr(l_extendedprice * (1 + l_tax), l_extendedprice), 6) AS correlation, NULL AS keyword FROM lineitem
UNION ALL SELECT 'l_linestatus', 'future_keyword', NULL, 'status'""",
)
def leakage(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_extendedprice", "l_quantity", "l_linestatus", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross_price"))
    return rounded(exploration.leakage(rows, "l_extendedprice"))


@named(
    "high_cardinality",
    """SELECT 'p_name' AS column_name, COUNT(DISTINCT p_name) AS n_distinct, ROUND(COUNT(DISTINCT p_name) * 100.0 / COUNT(*), 6) AS pct_unique,
CASE WHEN COUNT(DISTINCT p_name) > 50 THEN 'target_encoding' ELSE 'one_hot' END AS encoding FROM part HAVING COUNT(DISTINCT p_name) >= 50""",
)
def high_cardinality(t: Tables) -> DataFrame:
    return rounded(exploration.high_cardinality(t.part))


# --- time -------------------------------------------------------------------------------------------------


@named(
    "trend",
    """WITH p AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), f AS (SELECT COUNT(*) AS n, regr_slope(value, i) AS s, corr(value, i) AS r FROM p)
SELECT n, ROUND(s, 9) AS slope, ROUND(r * r, 9) AS r_squared, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, abs(r) > 0.4 AS detected FROM f""",
)
def trend(t: Tables) -> DataFrame:
    return rounded(exploration.trend(t.events, "ts", "value", "event_id").drop("p_value"), 9)


@named(
    "seasonality",
    """WITH m AS (SELECT month(o_orderdate) AS month, AVG(o_totalprice) AS mean FROM orders GROUP BY 1), f AS (SELECT COUNT(*) AS n_months, stddev_samp(mean) / AVG(mean) AS v FROM m)
SELECT n_months, ROUND(v, 9) AS variation, n_months >= 3 AND v > 0.2 AS detected FROM f""",
)
def seasonality(t: Tables) -> DataFrame:
    return rounded(exploration.seasonality(t.orders, "o_orderdate", "o_totalprice"), 9)


_KS = """ k AS (SELECT value, SUM(COUNT(*) FILTER (WHERE side)) OVER w * 1.0 / SUM(COUNT(*) FILTER (WHERE side)) OVER () AS f1,
SUM(COUNT(*) FILTER (WHERE NOT side)) OVER w * 1.0 / SUM(COUNT(*) FILTER (WHERE NOT side)) OVER () AS f2 FROM halves GROUP BY value
WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)),
n AS (SELECT COUNT(*) FILTER (WHERE side) AS n_first, COUNT(*) FILTER (WHERE NOT side) AS n_second FROM halves),
d AS (SELECT n_first, n_second, (SELECT MAX(abs(f1 - f2)) FROM k) AS distance FROM n),
p AS (SELECT *, (SELECT SUM(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * distance * distance * (n_first * 1.0 * n_second) / (n_first + n_second))) FROM range(1, 101) r(i)) AS series FROM d)"""


@named(
    "drift",
    f"""WITH n0 AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS i, COUNT(*) OVER () AS total FROM events),
halves AS (SELECT value, i <= total // 2 AS side FROM n0), {_KS}
SELECT 'value' AS column_name, n_first, n_second, ROUND(distance, 9) AS distance, ROUND(least(greatest(series, 0), 1), 6) AS p_value,
ROUND((SELECT (AVG(value) FILTER (WHERE NOT side) - AVG(value) FILTER (WHERE side)) / AVG(value) FILTER (WHERE side) * 100 FROM halves), 6) AS mean_change_pct,
n_first > 30 AND n_second > 30 AND series < 0.05 AS detected FROM p""",
)
def drift(t: Tables) -> DataFrame:
    found = exploration.drift(t.events, "ts", "value", "event_id")
    return found.select(
        "column_name",
        "n_first",
        "n_second",
        F.round("distance", 9).alias("distance"),
        F.round("p_value", 6).alias("p_value"),
        F.round("mean_change_pct", 6).alias("mean_change_pct"),
        "detected",
    )


@named(
    "two_sample_distance",
    f"""WITH halves AS (SELECT l_extendedprice AS value, l_returnflag = 'R' AS side FROM lineitem), {_KS}
SELECT 'l_extendedprice' AS column_name, n_first, n_second, ROUND(distance, 9) AS distance FROM d""",
)
def two_sample_distance(t: Tables) -> DataFrame:
    found = statistics.two_sample_distance(t.lineitem, ["l_extendedprice"], F.col("l_returnflag") == "R")
    return rounded(found.drop("p_value"), 9)


@named(
    "continuity",
    """WITH g AS (SELECT s - LAG(s) OVER (ORDER BY s) AS gap FROM (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)),
f AS (SELECT COUNT(gap) AS n_gaps, quantile_cont(gap, 0.5) AS m, MAX(gap) AS x FROM g)
SELECT n_gaps, CAST(m AS DOUBLE) AS median_gap, x AS max_gap, x > 5 * m AS has_gaps FROM f""",
)
def continuity(t: Tables) -> DataFrame:
    return exploration.continuity(t.events, "ts")


# --- pairs ------------------------------------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@named(
    "correlation_pairs",
    " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in _PAIRS),
)
def correlation_pairs(t: Tables) -> DataFrame:
    return rounded(statistics.correlation_pairs(t.lineitem, LINE), 9)


@named(
    "strong_pairs",
    """SELECT 'l_extendedprice' AS column_a, 'charged' AS column_b, ROUND(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 9) AS r FROM lineitem""",
)
def strong_pairs(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_extendedprice", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charged"))
    return rounded(exploration.strong_pairs(rows), 9)


@named(
    "rank_correlation",
    """WITH r AS (SELECT RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
RANK() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, ROUND(corr(a, b), 6) AS rho FROM r""",
)
def rank_correlation(t: Tables) -> DataFrame:
    return rounded(statistics.rank_correlation(t.lineitem, "l_quantity", "l_extendedprice"))


@named(
    "independence",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, COUNT(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, SUM(n) AS rt FROM c GROUP BY a),
k AS (SELECT b, SUM(n) AS ct FROM c GROUP BY b), g AS (SELECT rt * ct * 1.0 / (SELECT SUM(n) FROM c) AS e, COALESCE(n, 0) AS o FROM r CROSS JOIN k LEFT JOIN c USING (a, b))
SELECT ROUND(SUM((o - e) * (o - e) / e), 6) AS statistic, (SELECT COUNT(*) FROM r) * (SELECT COUNT(*) FROM k) - (SELECT COUNT(*) FROM r) - (SELECT COUNT(*) FROM k) + 1 AS degrees FROM g""",
)
def independence(t: Tables) -> DataFrame:
    return rounded(statistics.independence(t.orders, "o_orderstatus", "o_orderpriority").drop("p_value"))


@named(
    "least_squares",
    """SELECT l_returnflag, COUNT(*) AS n, ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope, ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
ROUND(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY l_returnflag""",
)
def least_squares(t: Tables) -> DataFrame:
    fit = statistics.least_squares(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select(
        "l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r_squared", 6).alias("r_squared")
    )


def _interaction_sql(columns: list[str]) -> str:
    """All ordered pairs are measured; the pair whose first column is the stronger one counts."""
    singles = " UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr({c}, y)) AS s, COUNT(*) FILTER (WHERE {c} = 0) AS zeros FROM x" for c in columns)
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, 'multiply' AS operation, abs(corr({a} * {b}, y)) AS r FROM x
UNION ALL SELECT '{a}', '{b}', 'divide', CASE WHEN COUNT(*) FILTER (WHERE {b} = 0) = 0 THEN abs(corr({a} / NULLIF({b}, 0), y)) END FROM x"""
        for a in columns
        for b in columns
        if a != b
    )
    return f"""WITH x AS (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem), s AS ({singles}), p AS ({rows}),
m AS (SELECT feature_1, feature_2, operation, greatest(u.s, v.s) AS best, r FROM p JOIN s u ON feature_1 = u.c JOIN s v ON feature_2 = v.c
WHERE r IS NOT NULL AND (u.s > v.s OR (u.s = v.s AND u.c < v.c)))
SELECT feature_1, feature_2, operation, ROUND(best, 6) AS best_single, ROUND(r, 6) AS correlation, r > best * 1.1 AS promising,
CASE WHEN r > best * 1.1 THEN ROUND((r - best) / best * 100, 6) END AS improvement_pct FROM m ORDER BY r DESC, feature_1, feature_2, operation LIMIT 10"""


@named("interactions", _interaction_sql(LINE))
def interactions(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(exploration.interactions(rows, "y", LINE))


@named(
    "interaction_strength",
    """SELECT ROUND(abs(corr(l_extendedprice * (1 - l_discount), l_extendedprice * (1 - l_discount))), 6) AS correlation,
ROUND(greatest(abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))), abs(corr(1 - l_discount, l_extendedprice * (1 - l_discount)))), 6) AS best_single FROM lineitem""",
)
def interaction_strength(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_extendedprice", (1 - F.col("l_discount")).alias("kept"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charged")
    )
    found = exploration.interactions(rows, "charged")
    return rounded(found.where("operation = 'multiply'").select("correlation", "best_single"))


# --- distributions and target -----------------------------------------------------------------------------

_SHAPE = """SELECT '{c}' AS column_name, skewness({c}) AS s, kurtosis({c}) AS k, COUNT(*) FILTER (WHERE {c} = 0) * 1.0 / COUNT({c}) AS z FROM {t}"""


def _shape_sql(parts: list[tuple[str, str]]) -> str:
    cells = " UNION ALL ".join(_SHAPE.replace("{c}", c).replace("{t}", table) for c, table in parts)
    return f"""WITH f AS ({cells}), d AS (SELECT *, CASE WHEN z > 0.3 THEN 'zero_inflated' WHEN abs(s) > 1 THEN 'highly_skewed' WHEN abs(s) > 0.5 THEN 'moderately_skewed'
WHEN abs(k) > 3 THEN 'heavy_tailed' WHEN abs(s) < 0.5 THEN 'normal' ELSE 'other' END AS distribution FROM f)
SELECT column_name, ROUND(s, 6) AS skew, ROUND(k, 6) AS kurtosis, ROUND(z, 6) AS zero_share, distribution, CASE WHEN distribution = 'highly_skewed' AND s > 0 THEN 'log'
WHEN distribution = 'highly_skewed' THEN 'sqrt' WHEN distribution = 'zero_inflated' THEN 'log1p' ELSE 'none' END AS transformation FROM d"""


@named("distributions", _shape_sql([(c, "lineitem") for c in LINE]))
def distributions(t: Tables) -> DataFrame:
    return rounded(exploration.distributions(t.lineitem, LINE))


@named("distributions_of_events", _shape_sql([("value", "events"), ("user_id", "events")]))
def distributions_of_events(t: Tables) -> DataFrame:
    return rounded(exploration.distributions(t.events, ["value", "user_id"]))


@named(
    "jarque_bera",
    """WITH m AS (SELECT AVG(l_quantity) AS a FROM lineitem), c AS (SELECT COUNT(*) AS n, AVG(power(l_quantity - a, 2)) AS m2, AVG(power(l_quantity - a, 3)) AS m3, AVG(power(l_quantity - a, 4)) AS m4 FROM lineitem, m)
SELECT 'l_quantity' AS column_name, ROUND(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 3) AS statistic FROM c""",
)
def jarque_bera(t: Tables) -> DataFrame:
    return exploration.jarque_bera(t.lineitem, ["l_quantity"]).select("column_name", F.round("statistic", 3).alias("statistic"))


@named(
    "category_balance",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS n_distinct, ROUND(MAX(n) * 1.0 / SUM(n), 6) AS top_share, MAX(n) * 1.0 / SUM(n) < 0.7 AS is_balanced
FROM (SELECT {c}, COUNT(*) AS n FROM documents GROUP BY {c})"""
        for c in ("lang", "source")
    ),
)
def category_balance(t: Tables) -> DataFrame:
    return rounded(exploration.category_balance(t.documents, ["lang", "source"]))


@named(
    "target_profile_classes",
    """WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, COUNT(*) AS n FROM labels GROUP BY 1), p AS (SELECT *, n * 100.0 / SUM(n) OVER () AS pct FROM c)
SELECT class, n, ROUND(pct, 6) AS pct, (SELECT MIN(pct) FROM p) > 20 AS is_balanced,
CASE WHEN (SELECT MIN(pct) FROM p) < 5 THEN 'resample' WHEN (SELECT MIN(pct) FROM p) < 20 THEN 'class_weights' ELSE 'none' END AS advice FROM p""",
)
def target_profile_classes(t: Tables) -> DataFrame:
    return rounded(exploration.target_profile(t.labels, "quality"))


@named(
    "target_profile_numbers",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT 'o_totalprice' AS column_name, COUNT(*) AS n_values, ROUND(AVG(o_totalprice), 6) AS mean, ROUND(stddev_samp(o_totalprice), 6) AS std, ROUND(skewness(o_totalprice), 6) AS skew,
MIN(o_totalprice) AS min, MAX(o_totalprice) AS max, ROUND(quantile_cont(o_totalprice, 0.5), 6) AS median,
COUNT(*) FILTER (WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n_outliers,
ROUND(COUNT(*) FILTER (WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) * 100.0 / COUNT(*), 6) AS pct_outliers,
CASE WHEN COUNT(*) FILTER (WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) * 100.0 / COUNT(*) > 5 THEN 'robust_scaling' ELSE 'none' END AS advice
FROM orders, q""",
)
def target_profile_numbers(t: Tables) -> DataFrame:
    return rounded(exploration.target_profile(t.orders, "o_totalprice"))


@named(
    "task_types",
    """SELECT 'o_orderstatus' AS target, 'classification' AS task, COUNT(DISTINCT o_orderstatus) AS n_distinct FROM orders
UNION ALL SELECT 'o_totalprice', CASE WHEN COUNT(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END, COUNT(DISTINCT o_totalprice) FROM orders""",
)
def task_types(t: Tables) -> DataFrame:
    parts = [
        t.orders.agg(F.lit(c).alias("target"), F.lit(exploration.task_type(t.orders, c)).alias("task"), F.count_distinct(c).alias("n_distinct"))
        for c in ("o_orderstatus", "o_totalprice")
    ]
    return parts[0].unionByName(parts[1])


# --- encodings --------------------------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


_BUCKETS = "greatest(1, least(100, (SELECT COUNT(DISTINCT p_name) FROM part) // 10))"
_HALF = "CAST(CAST('0x' || substr(md5(p_name), {i}, 15) AS BIGINT) AS HUGEINT)"
# The 128-bit number in pieces of 60, 60 and 8 bits, each reduced before the next is appended.
HASHED = (
    f"CAST((((({_HALF.format(i=1)} % {_BUCKETS}) * 1152921504606846976 + {_HALF.format(i=16)}) % {_BUCKETS}) * 256"
    f" + CAST('0x' || substr(md5(p_name), 31, 2) AS BIGINT)) % {_BUCKETS} AS BIGINT)"
)


@named(
    "one_hot",
    "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{p}' AS INTEGER) AS \"o_orderpriority_{p}\"" for p in PRIORITIES[1:]) + " FROM orders",
)
def one_hot(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return features.fit_encoder(rows, "o_orderpriority", "one_hot").transform(rows)


@named(
    "target_encoding",
    """WITH s AS (SELECT p_brand, AVG(p_retailprice) AS m FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand)
SELECT p_partkey, ROUND(COALESCE(m, (SELECT AVG(m) FROM s)), 6) AS p_brand_target_enc FROM part LEFT JOIN s USING (p_brand)""",
)
def target_encoding(t: Tables) -> DataFrame:
    """Fitted on two thirds of the parts, applied to all of them."""
    rows = t.part.select("p_partkey", "p_brand", "p_retailprice")
    encoder = features.fit_encoder(rows.where("p_partkey % 3 <> 0"), "p_brand", "target", "p_retailprice")
    return rounded(encoder.transform(rows).drop("p_retailprice"))


@named(
    "frequency_encoding",
    """SELECT c_custkey, ROUND(COUNT(*) OVER (PARTITION BY c_mktsegment) * 1.0 / (SELECT COUNT(*) FROM customer), 6) AS c_mktsegment_freq FROM customer""",
)
def frequency_encoding(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return rounded(features.fit_encoder(rows, "c_mktsegment", "frequency").transform(rows))


@named(
    "hash_encoding",
    f"SELECT p_partkey, {HASHED} AS p_name_hash FROM part",
)
def hash_encoding(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name")
    return features.fit_encoder(rows, "p_name", "hash").transform(rows)


@named("label_encoding", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) AS INTEGER) AS o_orderpriority_label FROM orders")
def label_encoding(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return features.fit_encoder(rows, "o_orderpriority", "label").transform(rows)


@named("label_encoding_wide", "SELECT c_custkey, CAST(DENSE_RANK() OVER (ORDER BY c_name) AS INTEGER) AS c_name_label FROM customer")
def label_encoding_wide(t: Tables) -> DataFrame:
    """A column with as many values as rows: the dictionary is a table."""
    rows = t.customer.select("c_custkey", "c_name")
    return features.fit_encoder(rows, "c_name", "label").transform(rows)


@named(
    "encoding_policy",
    """WITH b AS (SELECT p_brand, AVG(p_retailprice) AS m FROM part GROUP BY p_brand)
SELECT p_partkey, """
    + ", ".join(f"CAST(p_type = '{v}' AS INTEGER) AS \"p_type_{v}\"" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + f""", ROUND(m, 6) AS p_brand_target_enc,
{HASHED} AS p_name_hash FROM part JOIN b USING (p_brand)""",
)
def encoding_policy(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", "p_brand", "p_name", "p_retailprice")
    return rounded(features.encode(rows, features.fit_encoders(rows, "p_retailprice")).drop("p_retailprice"))


# --- numbers, dates, groups -------------------------------------------------------------------------------


@named(
    "polynomial",
    """SELECT p_partkey, ROUND(p_size * p_size, 4) * 1.0 AS poly_p_size_p_size, ROUND(p_size * p_retailprice, 4) AS poly_p_size_p_retailprice,
ROUND(p_retailprice * p_retailprice, 4) AS poly_p_retailprice_p_retailprice FROM part""".replace("ROUND(p_size * p_size, 4) * 1.0", "CAST(p_size * p_size AS DOUBLE)"),
)
def polynomial(t: Tables) -> DataFrame:
    rows = features.polynomial(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rounded(rows.drop("p_size", "p_retailprice"), 4)


@named(
    "quantile_bins",
    """WITH e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
SELECT event_id, CAST(CASE WHEN value <= a THEN 0 WHEN value <= b THEN 1 WHEN value <= c THEN 2 ELSE 3 END AS INTEGER) AS value_bin FROM events, e""",
)
def quantile_bins(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    return features.fit_bins(rows, "value", 4).transform(rows).drop("value")


@named(
    "uniform_bins",
    """WITH e AS (SELECT MIN(c_acctbal) AS lo, (MAX(c_acctbal) - MIN(c_acctbal)) / 5 AS w FROM customer)
SELECT c_custkey, CAST(least(4, greatest(0, ceil((c_acctbal - lo) / w) - 1)) AS INTEGER) AS c_acctbal_bin FROM customer, e""",
)
def uniform_bins(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal")
    return features.fit_bins(rows, "c_acctbal", 5, "uniform").transform(rows).drop("c_acctbal")


@named(
    "ratio_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_extendedprice / (l_extendedprice * (1 + l_tax)), 6) AS l_extendedprice_per_gross FROM lineitem""",
)
def ratio_features(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        (price * (1 + F.col("l_tax"))).alias("gross"),
        "l_discount",
        (price * (1 - F.col("l_discount"))).alias("charged"),
    )
    wide = features.ratio_features(rows, "charged", columns=["l_extendedprice", "gross", "l_discount"])
    return rounded(wide.drop("l_extendedprice", "gross", "l_discount", "charged"))


def _date_sql() -> str:
    turn = 2 * math.pi
    parts = {
        "year": "year(d)",
        "month": "month(d)",
        "day": "day(d)",
        "dayofweek": "isodow(d) - 1",
        "hour": "hour(d)",
        "quarter": "quarter(d)",
        "week": "week(d)",
        "is_month_start": "day(d) = 1",
        "is_month_end": "CAST(d AS DATE) = last_day(d)",
        "is_quarter_end": "CAST(d AS DATE) = last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH)",
        "is_weekend": "isodow(d) >= 6",
        "days_since": "date_diff('day', CAST((SELECT MIN(o_orderdate) FROM orders) AS DATE), CAST(d AS DATE))",
    }
    numbers = ", ".join(f"CAST({v} AS INTEGER) AS d_{k}" for k, v in parts.items())
    waves = ", ".join(
        f"ROUND({f}({v} * {turn / n!r}), 6) + 0.0 AS d_{name}_{f}" for name, v, n in (("month", "month(d)", 12), ("dayofweek", "(isodow(d) - 1)", 7)) for f in ("sin", "cos")
    )
    return f"SELECT o_orderkey, {numbers}, {waves} FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)"


@named("date_features", _date_sql())
def date_features(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("d"))
    wide = rounded(features.date_features(rows, "d").drop("d"))
    return wide.select(*[(F.col(c) + 0.0).alias(c) if c.endswith(("_sin", "_cos")) else F.col(c) for c in wide.columns])


@named(
    "group_statistics",
    """SELECT o_orderkey, COUNT(*) OVER w AS o_custkey_count, ROUND(AVG(o_totalprice) OVER w, 8) AS o_custkey_o_totalprice_mean,
ROUND(SUM(o_totalprice) OVER w, 8) AS o_custkey_o_totalprice_sum FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def group_statistics(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(features.group_statistics(rows, "o_custkey", ["o_totalprice"]).drop("o_custkey", "o_totalprice"), 8)


@named(
    "missing_flags",
    WITH_GAPPY
    + """ SELECT event_id, ROUND(COALESCE(value, (SELECT AVG(value) FROM gappy)), 6) AS value, CAST(value IS NULL AS INTEGER) AS value_was_missing FROM gappy""",
)
def missing_flags(t: Tables) -> DataFrame:
    rows = features.missing_flags(gappy(t).select("event_id", "value"))
    return rounded(cleaning.fit_imputer(rows, numeric="mean", columns=["value"]).transform(rows))


@named(
    "number_transforms",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ROUND(ln(c_acctbal), 6) END AS log, CASE WHEN c_acctbal > -1 THEN ROUND(ln(1 + c_acctbal), 6) END AS log1p,
CASE WHEN c_acctbal >= 0 THEN ROUND(sqrt(c_acctbal), 6) END AS sqrt FROM customer""",
)
def number_transforms(t: Tables) -> DataFrame:
    c = F.col("c_acctbal")
    return rounded(t.customer.select("c_custkey", *[features.transformed(c, how).alias(how) for how in ("log", "log1p", "sqrt")]))


# --- text -------------------------------------------------------------------------------------------------

# A few frequent English words, left out in the term queries.
COMMON = ("the", "of", "and", "to", "in", "is", "for", "on", "that", "with", "as", "by")

_TERMS = f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{features.WORD}')) AS term FROM documents),
kept AS (SELECT * FROM w WHERE term NOT IN ({", ".join(f"'{x}'" for x in COMMON)})),
v AS (SELECT term FROM kept GROUP BY term ORDER BY COUNT(*) DESC, term LIMIT 200),
c AS (SELECT doc_id, term, COUNT(*) AS n FROM kept SEMI JOIN v USING (term) GROUP BY doc_id, term)"""


@named("term_counts", _TERMS + " SELECT doc_id, term, n FROM c")
def term_counts(t: Tables) -> DataFrame:
    return features.term_counts(t.documents, "doc_id", "text", 200, COMMON)


@named(
    "term_weights",
    _TERMS
    + """, d AS (SELECT term, COUNT(*) AS df FROM c GROUP BY term), r AS (SELECT doc_id, term, n * (ln((1 + (SELECT COUNT(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM c JOIN d USING (term))
SELECT doc_id, term, ROUND(raw / sqrt(SUM(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
)
def term_weights(t: Tables) -> DataFrame:
    return rounded(features.term_weights(t.documents, "doc_id", "text", 200, COMMON))


@named(
    "text_features",
    f"SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST(len(regexp_extract_all(lower(text), '{features.WORD}')) AS INTEGER) AS text_words FROM documents",
)
def text_features(t: Tables) -> DataFrame:
    return features.text_features(t.documents.select("doc_id", "text"), "text").drop("text")


@named(
    "text_method",
    """SELECT 'documents' AS source, CASE WHEN AVG(len(regexp_split_to_array(trim(text, chr(32)), '\\s+'))) > 20 THEN 'tfidf' ELSE 'count' END AS method, COUNT(*) AS n FROM documents
UNION ALL SELECT 'part', CASE WHEN AVG(len(regexp_split_to_array(p_name, '\\s+'))) > 20 THEN 'tfidf' ELSE 'count' END, COUNT(*) FROM part""",
)
def text_method(t: Tables) -> DataFrame:
    frames = {"documents": (t.documents, "text"), "part": (t.part, "p_name")}
    parts = [
        df.agg(F.lit(name).alias("source"), F.lit(features.text_method(df, c)).alias("method"), F.count(F.lit(1)).alias("n")) for name, (df, c) in frames.items()
    ]
    return parts[0].unionByName(parts[1])
