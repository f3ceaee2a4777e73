"""Named queries: splits, folds, scaling, balance, metrics and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismill.operators import charts, metrics, preparation, shapes
from prismill.plans.explore import LINE
from prismill.plans.quality import rounded
from prismill.plans.registry import Tables, named
from prismill.plans.star import WITH_SALES, sales

# --- splits and folds -------------------------------------------------------------------------------------


@named(
    "time_split",
    """WITH n AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS i, COUNT(*) OVER () AS total FROM orders)
SELECT o_orderkey, CASE WHEN i > floor(total * 0.8) THEN 'test' ELSE 'train' END AS part FROM n""",
)
def time_split(t: Tables) -> DataFrame:
    return preparation.time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").drop("o_orderdate")


@named(
    "group_split",
    """WITH g AS (SELECT o_custkey, ROW_NUMBER() OVER (ORDER BY md5(o_custkey || '|42'), o_custkey) AS i, COUNT(*) OVER () AS total FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN i <= floor(total * 0.2) THEN 'test' ELSE 'train' END AS part FROM orders JOIN g USING (o_custkey)""",
)
def group_split(t: Tables) -> DataFrame:
    return preparation.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").drop("o_custkey")


@named(
    "stratified_split",
    """WITH n AS (SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|42'), c_custkey) AS i, COUNT(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer)
SELECT c_custkey, CASE WHEN i <= floor(total * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM n""",
)
def stratified_split(t: Tables) -> DataFrame:
    return preparation.stratified_split(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").drop("c_mktsegment")


@named(
    "random_split",
    """WITH n AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey) AS i, COUNT(*) OVER () AS total FROM customer)
SELECT c_custkey, CASE WHEN i <= ceil(total * 0.2) THEN 'test' ELSE 'train' END AS part FROM n""",
)
def random_split(t: Tables) -> DataFrame:
    return preparation.random_split(t.customer.select("c_custkey"), "c_custkey")


@named(
    "split_strategies",
    """WITH o AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS g, COUNT(DISTINCT o_totalprice) AS y FROM orders)
SELECT 'date' AS given, 'time_based' AS strategy, n FROM o UNION ALL SELECT 'group', CASE WHEN g < n * 0.8 THEN 'group_based' ELSE 'other' END, n FROM o
UNION ALL SELECT 'class', 'stratified', n FROM o UNION ALL SELECT 'number', CASE WHEN y <= 20 THEN 'stratified' ELSE 'random' END, n FROM o""",
)
def split_strategies(t: Tables) -> DataFrame:
    rows = t.orders
    options = {
        "date": {"target": "o_totalprice", "date": "o_orderdate"},
        "group": {"target": "o_totalprice", "group": "o_custkey"},
        "class": {"target": "o_orderstatus"},
        "number": {"target": "o_totalprice"},
    }
    parts = []
    for given, option in options.items():
        frame, strategy = preparation.split(rows, key="o_orderkey", **option)
        parts.append(frame.agg(F.lit(given).alias("given"), F.lit(strategy).alias("strategy"), F.count(F.lit(1)).alias("n")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@named("time_folds", "SELECT o_orderkey, CAST(NTILE(6) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def time_folds(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return preparation.folds(rows, "time", "o_orderkey", 5, date="o_orderdate").select("o_orderkey", "fold")


@named(
    "stratified_folds",
    "SELECT c_custkey, CAST((ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|42'), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer",
)
def stratified_folds(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return preparation.folds(rows, "stratified", "c_custkey", 5, target="c_mktsegment").select("c_custkey", "fold")


@named("random_folds", "SELECT c_custkey, CAST((ROW_NUMBER() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def random_folds(t: Tables) -> DataFrame:
    return preparation.folds(t.customer.select("c_custkey"), preparation.fold_strategy(t.customer, "c_acctbal"), "c_custkey", 5)


@named("group_folds", "SELECT CAST(1 AS BIGINT) AS max_folds_per_group, COUNT(DISTINCT o_custkey) AS n_groups, COUNT(*) AS n_rows FROM orders")
def group_folds(t: Tables) -> DataFrame:
    """Every group lies in one fold."""
    rows = preparation.folds(t.orders.select("o_orderkey", "o_custkey"), "group", "o_orderkey", 5, group="o_custkey")
    spread = rows.groupBy("o_custkey").agg(F.count_distinct("fold").alias("f"), F.count(F.lit(1)).alias("n"))
    return spread.agg(F.max("f").alias("max_folds_per_group"), F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


# --- scaling ----------------------------------------------------------------------------------------------


@named(
    "scaler_choice",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (
SELECT COUNT(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) * 1.0 / COUNT(*) > 0.05 AS has_outliers, abs(skewness(value)) > 1 AS is_skewed, MIN(value) < 0 AS has_negatives FROM events, q)
SELECT *, CASE WHEN has_outliers AND is_skewed THEN 'robust' WHEN is_skewed AND NOT has_negatives THEN 'yeo_johnson' WHEN has_outliers THEN 'robust' WHEN NOT is_skewed THEN 'standard' ELSE 'minmax' END AS scaler FROM f""",
)
def scaler_choice(t: Tables) -> DataFrame:
    return preparation.scaler_choice(t.events, ["value"])


def _scaled(name: str, formula: str, kind: str):
    @named(f"scale_{name}", f"SELECT c_custkey, ROUND({formula}, 6) + 0.0 AS c_acctbal FROM customer")
    def build(t: Tables) -> DataFrame:
        rows = t.customer.select("c_custkey", "c_acctbal")
        scaled = preparation.fit_scaler(rows, ["c_acctbal"], kind).transform(rows)
        return scaled.select("c_custkey", (F.round("c_acctbal", 6) + 0.0).alias("c_acctbal"))

    return build


_scaled("standard", "(c_acctbal - (SELECT AVG(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)", "standard")
_scaled("minmax", "(c_acctbal - (SELECT MIN(c_acctbal) FROM customer)) / (SELECT MAX(c_acctbal) - MIN(c_acctbal) FROM customer)", "minmax")
_scaled(
    "robust",
    "(c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer)",
    "robust",
)


def _power_sql() -> str:
    """The three grids of powers, each around the best of the one before."""
    curve = "CASE WHEN p = 0 THEN ln(value + 1) ELSE (power(value + 1, p) - 1) / p END"
    likelihood = f"-COUNT(*) / 2.0 * ln(var_pop({curve})) + (p - 1) * SUM(sign(value) * ln(1 + abs(value)))"
    best = "(SELECT p FROM l{i} ORDER BY l DESC LIMIT 1)"
    parts = ["g1 AS (SELECT i / 4.0::DOUBLE AS p FROM range(-16, 17) r(i))"]
    for i, step in ((1, 0.25), (2, 0.025), (3, 0.0025)):
        parts.append(f"l{i} AS (SELECT p, {likelihood} AS l FROM events, g{i} GROUP BY p)")
        if i < 3:
            parts.append(f"g{i + 1} AS (SELECT {best.format(i=i)} + i * {step}::DOUBLE / 10 AS p FROM range(-10, 11) r(i))")
    return f"""WITH {", ".join(parts)}, y AS (SELECT event_id, {curve} AS y FROM events, (SELECT {best.format(i=3)} AS p))
SELECT event_id, ROUND((y - (SELECT AVG(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 6) + 0.0 AS value FROM y"""


@named("scale_yeo_johnson", _power_sql())
def scale_yeo_johnson(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    scaled = preparation.fit_scaler(rows, ["value"], "yeo_johnson").transform(rows)
    return scaled.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@named(
    "yeo_johnson",
    """SELECT c_custkey, ROUND(CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(power(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS transformed FROM customer""",
)
def yeo_johnson(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(preparation.yeo_johnson(F.col("c_acctbal"), 0.5), 6).alias("transformed"))


# --- balance ----------------------------------------------------------------------------------------------


@named(
    "class_weights",
    "SELECT toxic AS class, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM labels) * 1.0 / ((SELECT COUNT(DISTINCT toxic) FROM labels) * COUNT(*)), 6) AS weight FROM labels GROUP BY toxic",
)
def class_weights(t: Tables) -> DataFrame:
    return rounded(preparation.class_weights(t.labels, "toxic"))


@named(
    "weighted_rows",
    """WITH c AS (SELECT quality, COUNT(*) AS n FROM labels GROUP BY quality)
SELECT doc_id, quality, ROUND((SELECT COUNT(*) FROM labels) * 1.0 / ((SELECT COUNT(*) FROM c) * n), 6) AS weight FROM labels JOIN c USING (quality)""",
)
def weighted_rows(t: Tables) -> DataFrame:
    return rounded(preparation.add_class_weights(t.labels.select("doc_id", "quality"), "quality"))


@named(
    "balance_strategy",
    """WITH c AS (SELECT COUNT(*) AS n FROM labels GROUP BY toxic), p AS (SELECT MIN(n) * 100.0 / SUM(n) AS p FROM c)
SELECT ROUND(p, 6) AS minority_pct, CASE WHEN p >= 40 THEN 'none' WHEN p >= 30 THEN 'class_weights' WHEN p >= 15 THEN 'smote' ELSE 'smote_tomek' END AS strategy FROM p""",
)
def balance_strategy(t: Tables) -> DataFrame:
    return rounded(preparation.balance_strategy(t.labels, "toxic"))


_BY_CLASS = """WITH n AS (SELECT doc_id, toxic, ROW_NUMBER() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '|42'), doc_id) AS i, COUNT(*) OVER (PARTITION BY toxic) AS size FROM labels)"""


@named(
    "oversample",
    _BY_CLASS
    + """, m AS (SELECT *, (SELECT MAX(size) FROM n) AS largest FROM n),
r AS (SELECT doc_id, toxic, unnest(range(0, largest // size + CAST(i <= largest % size AS BIGINT))) AS copy FROM m) SELECT doc_id, toxic, CAST(copy AS INTEGER) AS copy FROM r""",
)
def oversample(t: Tables) -> DataFrame:
    return preparation.oversample(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@named("undersample", _BY_CLASS + " SELECT doc_id, toxic FROM n WHERE i <= (SELECT MIN(size) FROM n)")
def undersample(t: Tables) -> DataFrame:
    return preparation.undersample(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


_SHAPES = """WITH f AS (SELECT doc_id, toxic, ln(1 + n_chars::DOUBLE) AS log_chars, len(string_split_regex(text, '[\x09-\x0D ]+'))::DOUBLE AS n_words FROM labels JOIN documents USING (doc_id)),
pairs AS (SELECT a.doc_id, b.doc_id AS other, a.toxic, b.toxic AS other_toxic, a.log_chars AS xl, a.n_words AS xw, b.log_chars AS yl, b.n_words AS yw,
(a.log_chars - b.log_chars) * (a.log_chars - b.log_chars) + (a.n_words - b.n_words) * (a.n_words - b.n_words) AS distance FROM f a JOIN f b ON a.doc_id <> b.doc_id)"""


def _shapes(t: Tables) -> DataFrame:
    words = F.size(F.split("text", r"[\x09-\x0D ]+")).cast("double")
    return t.labels.join(t.documents, "doc_id").select("doc_id", "toxic", F.log1p(F.col("n_chars")).alias("log_chars"), words.alias("n_words"))


@named(
    "smote",
    _SHAPES
    + """, near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY distance, other) - 1 AS i, COUNT(*) OVER (PARTITION BY doc_id) AS n FROM pairs WHERE toxic = 1 AND other_toxic = 1),
made AS (SELECT *, unnest(range(3)) AS copy FROM near WHERE i < 5),
drawn AS (SELECT *, ('0x' || substr(md5(doc_id || '|' || copy || '|42'), 1, 8))::BIGINT % least(n, 5) AS pick, ('0x' || substr(md5(doc_id || '|' || copy || '|43'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM made)
SELECT doc_id AS source_key, copy::INTEGER AS copy, 1 AS toxic, ROUND(xl + u * (yl - xl), 6) AS log_chars, ROUND(xw + u * (yw - xw), 6) AS n_words FROM drawn WHERE i = pick""",
)
def smote(t: Tables) -> DataFrame:
    return rounded(preparation.smote(_shapes(t), "toxic", 1, ["log_chars", "n_words"], "doc_id", 3))


@named(
    "tomek_links",
    _SHAPES
    + """, near AS (SELECT * FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY distance, other) = 1)
SELECT a.doc_id, a.other FROM near a JOIN near b ON a.other = b.doc_id AND b.other = a.doc_id WHERE a.doc_id < a.other AND a.toxic <> a.other_toxic""",
)
def tomek(t: Tables) -> DataFrame:
    return preparation.tomek_links(_shapes(t), "toxic", ["log_chars", "n_words"], "doc_id")


@named("balanced_labels")
def balanced_labels(t: Tables) -> DataFrame:
    made = preparation.balance(_shapes(t), "toxic", ["log_chars", "n_words"], "doc_id")
    return made.groupBy("toxic", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@named(
    "mutual_information",
    """WITH b AS (SELECT l_returnflag AS y, 'l_quantity' AS column_name, CASE WHEN l_quantity <= quantile_cont(l_quantity, 0.25) OVER () THEN 0 WHEN l_quantity <= quantile_cont(l_quantity, 0.5) OVER () THEN 1
WHEN l_quantity <= quantile_cont(l_quantity, 0.75) OVER () THEN 2 ELSE 3 END AS bin FROM lineitem
UNION ALL SELECT l_returnflag, 'l_tax', CASE WHEN l_tax <= quantile_cont(l_tax, 0.25) OVER () THEN 0 WHEN l_tax <= quantile_cont(l_tax, 0.5) OVER () THEN 1 WHEN l_tax <= quantile_cont(l_tax, 0.75) OVER () THEN 2 ELSE 3 END FROM lineitem),
c AS (SELECT column_name, bin, y, COUNT(*) * 1.0 AS n FROM b GROUP BY ALL),
s AS (SELECT *, SUM(n) OVER (PARTITION BY column_name) AS t, SUM(n) OVER (PARTITION BY column_name, bin) AS bt, SUM(n) OVER (PARTITION BY column_name, y) AS yt FROM c)
SELECT column_name, ROUND(SUM(n / t * ln(CAST(n AS DOUBLE) * t / (CAST(bt AS DOUBLE) * yt))), 9) AS mutual_information FROM s GROUP BY column_name""",
)
def mutual_information(t: Tables) -> DataFrame:
    return rounded(preparation.mutual_information(t.lineitem, ["l_quantity", "l_tax"], "l_returnflag", 4), 9)


def _quarter(c: str) -> str:
    cuts = " ".join(f"WHEN {c} <= quantile_cont({c}, {q}) OVER () THEN {i}" for i, q in enumerate((0.25, 0.5, 0.75)))
    return f"CASE {cuts} ELSE 3 END"


@named(
    "mutual_information_numbers",
    f"""WITH q AS (SELECT {_quarter("l_extendedprice")} AS y, {_quarter("l_quantity")} AS a, {_quarter("l_discount")} AS b FROM lineitem),
c AS (SELECT 'l_quantity' AS column_name, a AS bin, y, COUNT(*) * 1.0 AS n FROM q GROUP BY ALL UNION ALL SELECT 'l_discount', b, y, COUNT(*) * 1.0 FROM q GROUP BY ALL),
s AS (SELECT *, SUM(n) OVER (PARTITION BY column_name) AS t, SUM(n) OVER (PARTITION BY column_name, bin) AS bt, SUM(n) OVER (PARTITION BY column_name, y) AS yt FROM c)
SELECT column_name, ROUND(greatest(0.0::DOUBLE, SUM(n / t * ln(CAST(n AS DOUBLE) * t / (CAST(bt AS DOUBLE) * yt))) - (COUNT(*) - COUNT(DISTINCT bin) - COUNT(DISTINCT y) + 1) / (2.0 * MAX(t))), 9) AS mutual_information
FROM s GROUP BY column_name""",
)
def mutual_information_numbers(t: Tables) -> DataFrame:
    return rounded(preparation.mutual_information(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice", 4, 4), 9)


@named(
    "validate_split",
    """WITH n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey) > ceil((SELECT COUNT(*) FROM customer) * 0.2) AS side FROM customer),
v AS (SELECT 'c_custkey' AS column_name, c_custkey * 1.0 AS value, side FROM n UNION ALL SELECT 'c_nationkey', c_nationkey * 1.0, side FROM n UNION ALL SELECT 'c_acctbal', c_acctbal, side FROM n),
z AS (SELECT column_name, COUNT(*) FILTER (WHERE side) * 1.0 AS a, COUNT(*) FILTER (WHERE NOT side) * 1.0 AS b FROM v GROUP BY 1),
g AS (SELECT column_name, value, COUNT(*) FILTER (WHERE side) AS x, COUNT(*) FILTER (WHERE NOT side) AS y FROM v GROUP BY 1, 2),
k AS (SELECT column_name, SUM(x) OVER w * 1.0 AS cx, SUM(y) OVER w * 1.0 AS cy FROM g WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS UNBOUNDED PRECEDING)),
d AS (SELECT column_name, a, b, MAX(abs(cx / a - cy / b)) AS d FROM k JOIN z USING (column_name) GROUP BY column_name, a, b),
p AS (SELECT column_name, d, CASE WHEN d * d * a * b / (a + b) < 0.09 THEN 1 ELSE (SELECT SUM(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * d * d * a * b / (a + b))) FROM range(1, 101) r(i)) END AS p FROM d)
SELECT 'same_columns' AS "check", NULL AS column_name, true AS passed, 0.0::DOUBLE AS detail UNION ALL SELECT 'train_not_empty', NULL, COUNT(*) > 0, COUNT(*)::DOUBLE FROM n WHERE side UNION ALL SELECT 'test_not_empty', NULL, COUNT(*) > 0, COUNT(*)::DOUBLE FROM n WHERE NOT side
UNION ALL SELECT 'train_finite', NULL, COUNT(*) = 0, COUNT(*)::DOUBLE FROM n WHERE side AND (c_custkey IS NULL OR c_nationkey IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL)
UNION ALL SELECT 'test_finite', NULL, COUNT(*) = 0, COUNT(*)::DOUBLE FROM n WHERE NOT side AND (c_custkey IS NULL OR c_nationkey IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL)
UNION ALL SELECT 'no_shared_rows', NULL, COUNT(*) = 0, COUNT(*)::DOUBLE FROM (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM n WHERE side INTERSECT SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM n WHERE NOT side)
UNION ALL SELECT 'same_distribution', column_name, p >= 0.05, ROUND(d, 6)::DOUBLE FROM p""",
)
def validate_split(t: Tables) -> DataFrame:
    rows, _ = preparation.split(t.customer, "c_acctbal", "c_custkey")
    columns = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
    parts = [rows.where(F.col("part") == name).select(*columns) for name in ("train", "test")]
    return rounded(preparation.validate_split(*parts, columns))


@named(
    "shared_rows_of_split",
    """WITH n AS (SELECT p_brand, p_size, p_partkey, ROW_NUMBER() OVER (ORDER BY md5(p_partkey || '|42'), p_partkey) AS i, COUNT(*) OVER () AS total FROM part)
SELECT p_brand, p_size FROM n WHERE i <= ceil(total * 0.2) INTERSECT SELECT p_brand, p_size FROM n WHERE i > ceil(total * 0.2)""",
)
def shared_rows_of_split(t: Tables) -> DataFrame:
    rows = preparation.random_split(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    sides = [rows.where(F.col("part") == name).select("p_brand", "p_size") for name in ("test", "train")]
    return shapes.identical_rows(*sides)


# --- metrics ----------------------------------------------------------------------------------------------


def predictions(t: Tables) -> DataFrame:
    score = F.col("l_quantity") / 50
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.when(score > 0.5, 1).otherwise(0).alias("guess"),
        score.alias("score"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "F", "A").when(score > 0.6, "R").otherwise("N").alias("flag_guess"),
    )


WITH_P = """WITH p AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity / 50 > 0.5 AS INTEGER) AS guess, l_quantity / 50 AS score, l_returnflag AS flag,
CASE WHEN l_linestatus = 'F' THEN 'A' WHEN l_quantity / 50 > 0.6 THEN 'R' ELSE 'N' END AS flag_guess FROM lineitem)"""


@named("confusion", WITH_P + " SELECT y AS label, guess AS prediction, COUNT(*) AS n FROM p GROUP BY 1, 2")
def confusion(t: Tables) -> DataFrame:
    return metrics.confusion(predictions(t), "y", "guess")


@named(
    "binary_metrics",
    WITH_P
    + """, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND guess = 1) * 1.0 AS tp, COUNT(*) FILTER (WHERE y = 0 AND guess = 1) * 1.0 AS fp,
COUNT(*) FILTER (WHERE y = 1 AND guess = 0) * 1.0 AS fn, COUNT(*) FILTER (WHERE y = 0 AND guess = 0) * 1.0 AS tn FROM p)
SELECT ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1,
ROUND((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""",
)
def binary_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.classification(metrics.confusion(predictions(t), "y", "guess")))


_REPORT = (
    WITH_P
    + """, k AS (SELECT DISTINCT flag AS class FROM p UNION SELECT DISTINCT flag_guess FROM p),
r AS (SELECT class, COUNT(*) FILTER (WHERE flag = class) AS support, COUNT(*) FILTER (WHERE flag_guess = class) AS predicted, COUNT(*) FILTER (WHERE flag = class AND flag_guess = class) AS hits FROM k, p GROUP BY class),
m AS (SELECT class, support, predicted, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits * 1.0 / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits * 1.0 / support END AS recall FROM r),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""
)


@named(
    "class_report",
    _REPORT
    + """ SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6), ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f""",
)
def class_report(t: Tables) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion(predictions(t), "flag", "flag_guess")))


@named(
    "multiclass_metrics",
    _REPORT
    + """ SELECT ROUND(SUM(hits) * 1.0 / SUM(support), 6) AS accuracy, ROUND(SUM(precision * support) / SUM(support), 6) AS precision, ROUND(SUM(recall * support) / SUM(support), 6) AS recall,
ROUND(SUM(f1 * support) / SUM(support), 6) AS f1, ROUND((CAST(SUM(hits) AS DOUBLE) * SUM(support) - SUM(CAST(predicted AS DOUBLE) * support)) /
sqrt((power(SUM(support), 2) - SUM(power(predicted, 2))) * (power(SUM(support), 2) - SUM(power(support, 2)))), 6) AS mcc FROM f""",
)
def multiclass_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.classification(metrics.confusion(predictions(t), "flag", "flag_guess")))


_AUC = """(SUM(CASE WHEN y = 1 THEN r ELSE 0 END) - COUNT(*) FILTER (WHERE y = 1) * (COUNT(*) FILTER (WHERE y = 1) + 1) / 2.0)
/ (COUNT(*) FILTER (WHERE y = 1) * 1.0 * COUNT(*) FILTER (WHERE y = 0))"""


@named(
    "roc_auc",
    WITH_P
    + f""", r AS (SELECT y, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p)
SELECT COUNT(*) FILTER (WHERE y = 1) AS n_pos, COUNT(*) FILTER (WHERE y = 0) AS n_neg, ROUND({_AUC}, 6) AS auc FROM r""",
)
def roc_auc(t: Tables) -> DataFrame:
    return rounded(metrics.auc(predictions(t), "y", "score"))


@named(
    "roc_auc_one_vs_rest",
    WITH_P
    + f""", l AS (SELECT 'A' AS class, CAST(flag = 'A' AS INTEGER) AS y, 1 - score AS s FROM p UNION ALL SELECT 'N', CAST(flag = 'N' AS INTEGER), score * score FROM p UNION ALL SELECT 'R', CAST(flag = 'R' AS INTEGER), score FROM p),
r AS (SELECT class, y, RANK() OVER (PARTITION BY class ORDER BY s) + (COUNT(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS r FROM l),
a AS (SELECT class, COUNT(*) FILTER (WHERE y = 1) AS n, {_AUC} AS auc FROM r GROUP BY class) SELECT ROUND(SUM(auc * n) / SUM(n), 6) AS auc FROM a""",
)
def roc_auc_one_vs_rest(t: Tables) -> DataFrame:
    rows = predictions(t).withColumn("a", 1 - F.col("score")).withColumn("n", F.col("score") * F.col("score"))
    return rounded(metrics.auc_one_vs_rest(rows, "flag", {"A": "a", "N": "n", "R": "score"}))


@named(
    "log_loss",
    WITH_P
    + """, c AS (SELECT y, greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) AS q FROM p)
SELECT ROUND(AVG(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss FROM c""",
)
def log_loss(t: Tables) -> DataFrame:
    return rounded(metrics.log_loss(predictions(t), "y", "score"))


@named(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS guess, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)
SELECT ROUND(AVG(e * e) / 1e6, 4) AS mse, ROUND(sqrt(AVG(e * e)), 4) AS rmse, ROUND(AVG(abs(e)), 4) AS mae, ROUND(1 - SUM(e * e) / (var_pop(y) * COUNT(*)), 6) AS r2,
ROUND(AVG(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, MAX(abs(e)) AS max_error, ROUND(1 - var_pop(e) / var_pop(y), 6) AS explained_variance,
ROUND(AVG(e), 4) AS residual_mean, ROUND(stddev_pop(e), 4) AS residual_std, ROUND(quantile_cont(abs(e), 0.5), 4) AS median_absolute_error FROM p""",
)
def regression_metrics(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 2000).alias("guess"))
    found = metrics.regression(rows, "l_extendedprice", "guess").withColumn("mse", F.col("mse") / 1e6)
    exact = {"max_error": None, "r2": 6, "mape": 6, "explained_variance": 6}
    return found.select(*[F.col(c) if exact.get(c, 4) is None else F.round(c, exact.get(c, 4)).alias(c) for c in found.columns])


def _model_metrics(t: Tables) -> DataFrame:
    """Three fixed guesses of the order price, compared by their errors."""
    y = F.col("o_totalprice")
    guesses = {"flat": F.lit(250000.0), "by_key": F.col("o_custkey") * 100.0, "by_status": F.when(F.col("o_orderstatus") == "F", 240000.0).otherwise(260000.0)}
    parts = []
    for model, guess in guesses.items():
        e = y - guess
        parts.append(t.orders.agg(F.lit(model).alias("model"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_error"), F.avg((F.abs(e) < 50000).cast("double")).alias("hit_rate")))
    wide = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return metrics.long_metrics(wide, ["model"], ["mae", "max_error", "hit_rate"])


_MODELS = """WITH e AS (SELECT 'flat' AS model, o_totalprice - 250000 AS e FROM orders UNION ALL SELECT 'by_key', o_totalprice - o_custkey * 100.0 FROM orders
UNION ALL SELECT 'by_status', o_totalprice - CASE WHEN o_orderstatus = 'F' THEN 240000 ELSE 260000 END FROM orders),
w AS (SELECT model, AVG(abs(e)) AS mae, MAX(abs(e)) AS max_error, AVG(CASE WHEN abs(e) < 50000 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM e GROUP BY model),
l AS (SELECT model, 'mae' AS metric, mae AS value FROM w UNION ALL SELECT model, 'max_error', max_error FROM w UNION ALL SELECT model, 'hit_rate', hit_rate FROM w)"""


@named(
    "rank_models",
    _MODELS
    + """ SELECT model, metric, ROUND(value, 4) AS value, CAST(ROW_NUMBER() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'hit_rate' THEN -value ELSE value END, model) AS INTEGER) AS position FROM l""",
)
def rank_models(t: Tables) -> DataFrame:
    return rounded(metrics.rank_models(_model_metrics(t)), 4)


@named("comparison_table", _MODELS + " SELECT model, ROUND(mae, 4) AS mae, ROUND(max_error, 4) AS max_error, ROUND(hit_rate, 4) AS hit_rate FROM w")
def comparison_table(t: Tables) -> DataFrame:
    return rounded(metrics.comparison_table(_model_metrics(t), ["mae", "max_error", "hit_rate"]), 4)


@named(
    "model_quality",
    """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, CASE user_id % 4 WHEN 0 THEN 'RandomForest' WHEN 1 THEN 'Ridge' WHEN 2 THEN 'KNN' ELSE 'SVR' END AS model, user_id,
AVG(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) - 0.15 AS cv_score, AVG(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END) AS test_score FROM events GROUP BY user_id),
d AS (SELECT *, abs(cv_score - test_score) AS g, CASE WHEN task = 'classification' AND cv_score < 0.6 THEN 20 WHEN task = 'classification' AND cv_score < 0.7 THEN 10 WHEN task <> 'classification' AND cv_score < 0.3 THEN 20 ELSE 0 END AS low FROM r),
s AS (SELECT *, 100 - CASE WHEN test_score <> 0 AND g > 0.15 THEN 20 ELSE 0 END - CASE WHEN user_id % 4 IN (2, 3) THEN 10 ELSE 0 END - low AS score FROM d)
SELECT user_id, task, model, ROUND(g, 6) AS overfit_gap, test_score <> 0 AND g > 0.15 AS overfits, CAST(low AS INTEGER) AS low_score_points, CAST(score AS INTEGER) AS score,
CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'acceptable' ELSE 'needs_improvement' END AS rating FROM s""",
)
def model_quality(t: Tables) -> DataFrame:
    kind = F.col("user_id") % 4
    results = t.events.groupBy("user_id").agg(
        (F.avg((F.col("event_type") != "error").cast("double")) - 0.15).alias("cv_score"),
        F.avg(F.col("event_type").isin("click", "view").cast("double")).alias("test_score"),
    )
    results = results.select(
        "*",
        F.when(F.col("user_id") % 2 == 0, "classification").otherwise("regression").alias("task"),
        F.when(kind == 0, "RandomForest").when(kind == 1, "Ridge").when(kind == 2, "KNN").otherwise("SVR").alias("model"),
    )
    return rounded(metrics.model_quality(results).drop("cv_score", "test_score"))


@named(
    "stage_score",
    """WITH s AS (SELECT user_id AS run, CASE event_type WHEN 'click' THEN 'cleaning' WHEN 'view' THEN 'features' ELSE 'models' END AS stage, COUNT(*) % 100 AS score FROM events GROUP BY 1, 2),
r AS (SELECT run, CAST(floor(ROUND(SUM(score * CASE stage WHEN 'cleaning' THEN 0.25 WHEN 'features' THEN 0.35 ELSE 0.4 END), 6)) AS INTEGER) AS score FROM s GROUP BY run)
SELECT run, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'acceptable' ELSE 'needs_improvement' END AS rating FROM r""",
)
def stage_score(t: Tables) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "cleaning").when(F.col("event_type") == "view", "features").otherwise("models")
    scores = t.events.groupBy(F.col("user_id").alias("run"), stage.alias("stage"))
    return metrics.stage_score(scores.agg((F.count(F.lit(1)) % 100).alias("score")))


# --- charts -----------------------------------------------------------------------------------------------


@named(
    "chart_choice",
    """WITH m AS (SELECT COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n FROM orders), p AS (SELECT COUNT(DISTINCT o_orderpriority) AS n FROM orders), c AS (SELECT COUNT(DISTINCT o_custkey) AS n FROM orders)
SELECT 'months' AS frame, CASE WHEN n > 7 THEN 'line' ELSE 'bar' END AS chart, n AS n_rows FROM m UNION ALL
SELECT 'priorities', CASE WHEN n > 10 THEN 'barh' WHEN n > 5 THEN 'bar' ELSE 'pie' END, n FROM p UNION ALL SELECT 'customers', CASE WHEN n > 10 THEN 'barh' ELSE 'other' END, n FROM c""",
)
def chart_choice(t: Tables) -> DataFrame:
    totals = {
        "months": F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        "priorities": F.col("o_orderpriority"),
        "customers": F.col("o_custkey"),
    }
    parts = [charts.chart_choice(t.orders.groupBy(key).agg(F.sum("o_totalprice").alias("total"))).select(F.lit(name).alias("frame"), "chart", "n_rows") for name, key in totals.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _monthly(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    sums = [F.sum(F.when(status == s, F.col("o_totalprice")).otherwise(0.0)).alias(n) for s, n in (("F", "finished"), ("O", "open"), ("P", "pending"))]
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(*sums)


_MONTHLY = """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS finished,
SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS open, SUM(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS pending FROM orders GROUP BY 1)"""


@named(
    "line_points",
    _MONTHLY + " SELECT month, 'finished' AS series, ROUND(finished, 2) AS value FROM m UNION ALL SELECT month, 'open', ROUND(open, 2) FROM m UNION ALL SELECT month, 'pending', ROUND(pending, 2) FROM m",
)
def line_points(t: Tables) -> DataFrame:
    return rounded(charts.line_points(_monthly(t), "month"), 2)


@named(
    "stacked_areas",
    _MONTHLY
    + """ SELECT month, 'finished' AS series, 0.0::DOUBLE AS lower, ROUND(finished, 2) AS upper FROM m UNION ALL SELECT month, 'open', ROUND(finished, 2), ROUND(finished + open, 2) FROM m
UNION ALL SELECT month, 'pending', ROUND(finished + open, 2), ROUND(finished + open + pending, 2) FROM m""",
)
def stacked_areas(t: Tables) -> DataFrame:
    return rounded(charts.stacked_areas(_monthly(t), "month", ["finished", "open", "pending"]), 2)


@named(
    "bar_values",
    f"""{WITH_SALES}, b AS (SELECT part_id, SUM(amount) AS total, CAST(COUNT(*) AS DOUBLE) AS lines FROM sales GROUP BY part_id ORDER BY SUM(amount) DESC, part_id LIMIT 50)
SELECT part_id, 'total' AS series, ROUND(total, 4) AS value FROM b UNION ALL SELECT part_id, 'lines', lines FROM b""",
)
def bar_values(t: Tables) -> DataFrame:
    bars = sales(t, "part_id", "amount").groupBy("part_id").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("lines"))
    return rounded(charts.bar_values(bars, "part_id", ["total", "lines"]), 4)


@named(
    "pie_slices",
    f"""{WITH_SALES}, b AS (SELECT brand, SUM(amount) AS v FROM sales GROUP BY brand), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY v DESC, brand) AS i FROM b)
SELECT CASE WHEN i < 10 THEN brand ELSE 'Other' END AS slice, ROUND(SUM(v), 2) AS value, ROUND(SUM(v) * 100 / (SELECT SUM(v) FROM b), 6) AS pct FROM r GROUP BY 1""",
)
def pie_slices(t: Tables) -> DataFrame:
    slices = charts.pie_slices(sales(t, "brand", "amount").groupBy("brand").agg(F.sum("amount").alias("v")), "brand", "v")
    return slices.select("slice", F.round("value", 2).alias("value"), F.round("pct", 6).alias("pct"))


@named(
    "scatter_points",
    """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice, ROUND(a * o_custkey + b, 4) AS fitted FROM (SELECT * FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500), f""",
)
def scatter_points(t: Tables) -> DataFrame:
    return charts.scatter_points(t.orders, "o_custkey", "o_totalprice", "o_orderkey", 500).withColumn("fitted", F.round("fitted", 4))


@named("heatmap_cells", " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS \"column\", ROUND(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE for b in LINE))
def heatmap_cells(t: Tables) -> DataFrame:
    return rounded(charts.heatmap_cells(t.lineitem, LINE))


@named(
    "box_values",
    """WITH k AS (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY SUM(l_extendedprice) DESC, p_brand LIMIT 50),
r AS (SELECT p_brand, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey SEMI JOIN k USING (p_brand)),
q AS (SELECT p_brand, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY p_brand)
SELECT p_brand, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3, MIN(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
MAX(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker, COUNT(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outside
FROM r JOIN q USING (p_brand) GROUP BY p_brand, q1, median, q3""",
)
def box_values(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_extendedprice").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(charts.box_values(rows.select("p_brand", "l_extendedprice"), "p_brand", "l_extendedprice"), 4)


@named(
    "histogram",
    """WITH s AS (SELECT COUNT(value) AS n, MIN(value) AS lo, MAX(value) AS hi, 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / power(COUNT(value), 1.0 / 3) AS w FROM events),
b AS (SELECT *, greatest(1, least(50, ceil((hi - lo) / w))) AS k FROM s)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, COUNT(*) AS n, ROUND(MIN(lo + least(floor((value - lo) / ((hi - lo) / k)), k - 1) * (hi - lo) / k), 6) AS lower,
ROUND(MIN(lo + (least(floor((value - lo) / ((hi - lo) / k)), k - 1) + 1) * (hi - lo) / k), 6) AS upper FROM events, b GROUP BY 1""",
)
def histogram(t: Tables) -> DataFrame:
    return rounded(charts.histogram(t.events, "value"))


@named(
    "histogram_density",
    """WITH s AS (SELECT COUNT(l_quantity) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, 2 * (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / power(COUNT(l_quantity), 1.0 / 3) AS w FROM lineitem),
b AS (SELECT *, greatest(1, least(50, ceil((hi - lo) / w))) AS k FROM s)
SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, ROUND(COUNT(*) / (MAX(n) * ((MAX(hi) - MAX(lo)) / MAX(k))), 9) AS density FROM lineitem, b GROUP BY 1""",
)
def histogram_density(t: Tables) -> DataFrame:
    return rounded(charts.histogram(t.lineitem, "l_quantity", density=True).select("bin", "density"), 9)
