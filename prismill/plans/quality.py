"""Named queries: profiles, validation and cleaning.

The test tables have no nulls, so both sides blank the same cells: `gappy` is `events` with every seventh
value and every eleventh type missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from prismill.operators import cleaning, fuzzy, profiling, quantiles, shapes
from prismill.plans.registry import Tables, named
from prismill.session import shared_folder
from prismill.sources import readers, writers


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def gappy(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
    )


WITH_GAPPY = """WITH gappy AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events)"""


def _each(columns: list[str], template: str, glue: str = "\nUNION ALL ") -> str:
    return glue.join(template.replace("{c}", c) for c in columns)


EVENT_COLUMNS = ["event_id", "ts", "user_id", "value", "event_type"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- profiles ---------------------------------------------------------------------------------------------


@named(
    "missing_report",
    WITH_GAPPY
    + _each(
        EVENT_COLUMNS,
        " SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*), 6) AS pct_missing FROM gappy",
    ),
)
def missing_report(t: Tables) -> DataFrame:
    return rounded(profiling.missing_report(gappy(t)))


@named(
    "missing_summary",
    WITH_GAPPY
    + """, n AS (SELECT COUNT(*) AS r, COUNT(*) FILTER (WHERE value IS NULL) + COUNT(*) FILTER (WHERE event_type IS NULL) AS m,
COUNT(*) FILTER (WHERE value IS NULL OR event_type IS NULL) AS rows_with_missing FROM gappy)
SELECT r * 5 AS total_cells, m AS total_missing, ROUND(m * 100.0 / (r * 5), 6) AS pct_missing, ROUND((r * 5 - m) * 100.0 / (r * 5), 6) AS completeness_pct, rows_with_missing FROM n""",
)
def missing_summary(t: Tables) -> DataFrame:
    return rounded(profiling.missing_summary(gappy(t)))


_CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@named(
    "validate_frame",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) - COUNT({c}) AS n_missing, COUNT(DISTINCT {c}) AS n_distinct,
COUNT(*) = 0 AS frame_is_empty, COUNT(*) > 0 AND COUNT({c}) = 0 AS all_missing, COUNT({c}) * 2 < COUNT(*) AS mostly_missing, COUNT(DISTINCT {c}) = 1 AS single_valued FROM customer"""
        for c, kind in _CUSTOMER_TYPES.items()
    ),
)
def validate_frame(t: Tables) -> DataFrame:
    return profiling.validate_frame(t.customer)


_SEMANTIC = """WITH f AS (
SELECT 'p_partkey' AS column_name, 'number' AS kind, COUNT(DISTINCT p_partkey) AS d, COUNT(*) - COUNT(p_partkey) AS n_missing, COUNT(*) AS n FROM part
UNION ALL SELECT 'p_name', 'text', COUNT(DISTINCT p_name), COUNT(*) - COUNT(p_name), COUNT(*) FROM part
UNION ALL SELECT 'p_brand', 'text', COUNT(DISTINCT p_brand), COUNT(*) - COUNT(p_brand), COUNT(*) FROM part
UNION ALL SELECT 'p_type', 'text', COUNT(DISTINCT p_type), COUNT(*) - COUNT(p_type), COUNT(*) FROM part
UNION ALL SELECT 'p_size', 'number', COUNT(DISTINCT p_size), COUNT(*) - COUNT(p_size), COUNT(*) FROM part
UNION ALL SELECT 'p_retailprice', 'number', COUNT(DISTINCT p_retailprice), COUNT(*) - COUNT(p_retailprice), COUNT(*) FROM part
UNION ALL SELECT 'size_class', 'number', COUNT(DISTINCT p_size % 4), 0, COUNT(*) FROM part
UNION ALL SELECT 'made_on', 'date_text', COUNT(DISTINCT p_size), 0, COUNT(*) FROM part),
s AS (SELECT column_name, CASE WHEN kind = 'number' AND d <= 10 AND d * 1.0 / n < 0.05 THEN 'categorical_numeric' WHEN kind = 'number' THEN 'numerical'
WHEN kind = 'date_text' THEN 'datetime_string' WHEN d * 1.0 / n < 0.05 THEN 'categorical' ELSE 'text' END AS semantic_type, d AS n_distinct, n_missing FROM f)"""


def _typed_part(t: Tables) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    return t.part.withColumn("size_class", F.col("p_size") % 4).withColumn("made_on", day)


@named("semantic_types", _SEMANTIC + " SELECT column_name, semantic_type, n_distinct, n_missing FROM s")
def semantic_types(t: Tables) -> DataFrame:
    return profiling.semantic_types(_typed_part(t))


@named(
    "schema_summary",
    _SEMANTIC
    + """ SELECT semantic_type, COUNT(*) AS n_columns, string_agg(column_name, ',' ORDER BY column_name) AS columns, CAST(SUM(n_missing) AS BIGINT) AS n_missing
FROM s GROUP BY semantic_type""",
)
def schema_summary(t: Tables) -> DataFrame:
    return profiling.schema_summary(_typed_part(t))


@named(
    "duplicate_report",
    """WITH g AS (SELECT COUNT(*) AS n FROM part GROUP BY p_brand, p_type, p_size)
SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_unique, CAST(SUM(n) - COUNT(*) AS BIGINT) AS n_duplicates, ROUND((SUM(n) - COUNT(*)) * 100.0 / SUM(n), 6) AS pct_duplicates FROM g""",
)
def duplicate_report(t: Tables) -> DataFrame:
    return rounded(profiling.duplicate_report(t.part, ["p_brand", "p_type", "p_size"]))


_IQR = """SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower,
quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper FROM {t}"""
_Z = "SELECT '{c}' AS column_name, AVG({c}) - 2 * {s}({c}) AS lower, AVG({c}) + 2 * {s}({c}) AS upper FROM {t}"


def _bounds(columns: list[str], table: str, template: str, deviation: str = "stddev_pop") -> str:
    return "b AS (" + _each(columns, template.replace("{t}", table).replace("{s}", deviation)) + ")"


def _outliers(columns: list[str], table: str, template: str, deviation: str = "stddev_pop") -> str:
    cells = _each(columns, f"SELECT '{{c}}' AS column_name, CAST({{c}} AS DOUBLE) AS v FROM {table}")
    return f"""WITH {_bounds(columns, table, template, deviation)}, cells AS ({cells})
SELECT b.column_name, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper, COUNT(*) FILTER (WHERE v < lower OR v > upper) AS n_outliers,
ROUND(COUNT(*) FILTER (WHERE v < lower OR v > upper) * 100.0 / COUNT(*), 6) AS pct_outliers FROM b JOIN cells USING (column_name) GROUP BY b.column_name, lower, upper"""


@named("outliers_iqr", _outliers(["value", "user_id"], "events", _IQR))
def outliers_iqr(t: Tables) -> DataFrame:
    columns = ["value", "user_id"]
    return rounded(profiling.outlier_report(t.events, profiling.fit_bounds(t.events, columns)))


@named("outliers_zscore", _outliers(["value", "user_id"], "events", _Z))
def outliers_zscore(t: Tables) -> DataFrame:
    bounds = profiling.fit_bounds(t.events, ["value", "user_id"], "zscore", 2.0, sample_deviation=False)
    return rounded(profiling.outlier_report(t.events, bounds))


_PROFILE = """SELECT '{c}' AS column_name, COUNT({c}) AS n_values, ROUND(AVG({c}), 6) AS mean, ROUND(stddev_samp({c}), 6) AS std, ROUND(skewness({c}), 6) AS skew,
CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, ROUND(quantile_cont({c}, 0.5), 6) AS median FROM """


@named("numeric_profile", _each(LINE_NUMBERS, _PROFILE + "lineitem"))
def numeric_profile(t: Tables) -> DataFrame:
    return rounded(profiling.numeric_profile(t.lineitem, LINE_NUMBERS))


@named("numeric_profile_with_gaps", WITH_GAPPY + _each(["value"], _PROFILE + "gappy"))
def numeric_profile_with_gaps(t: Tables) -> DataFrame:
    return rounded(profiling.numeric_profile(gappy(t), ["value"]))


@named(
    "sorted_quantiles",
    """SELECT l_returnflag, 'l_extendedprice' AS column_name, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q25, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
ROUND(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT l_returnflag, 'l_quantity', ROUND(quantile_cont(l_quantity, 0.25), 6), ROUND(quantile_cont(l_quantity, 0.5), 6), ROUND(quantile_cont(l_quantity, 0.99), 6) FROM lineitem GROUP BY l_returnflag""",
)
def sorted_quantiles(t: Tables) -> DataFrame:
    found = quantiles.sorted_quantiles(t.lineitem, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.99], ["l_returnflag"])
    q = F.col("quantiles")
    return found.select("l_returnflag", "column_name", *[F.round(q[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q99"))])


@named(
    "moments",
    _each(
        LINE_NUMBERS,
        "SELECT '{c}' AS column_name, ROUND(skewness({c}), 6) AS skew, ROUND(kurtosis({c}), 6) AS kurtosis, ROUND(corr({c}, l_linenumber), 6) AS with_line FROM lineitem",
    ),
)
def moments(t: Tables) -> DataFrame:
    from prismill.functions.numbers import pearson, sample_kurtosis, sample_skewness

    return rounded(
        profiling.per_column(
            t.lineitem, LINE_NUMBERS, {"skew": sample_skewness, "kurtosis": sample_kurtosis, "with_line": lambda c: pearson(c, F.col("l_linenumber"))}
        )
    )


@named(
    "top_values",
    """WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value, COUNT(*) AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'p_type', p_type, COUNT(*) FROM part GROUP BY p_type UNION ALL SELECT 'p_name', p_name, COUNT(*) FROM part GROUP BY p_name),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS position, COUNT(*) OVER (PARTITION BY column_name) AS n_distinct FROM c)
SELECT * FROM r WHERE position <= 5""",
)
def top_values(t: Tables) -> DataFrame:
    return profiling.top_values(t.part)


@named(
    "modes",
    """WITH c AS (SELECT 'p_size' AS column_name, CAST(p_size AS DOUBLE) AS number, CAST(p_size AS VARCHAR) AS value, COUNT(*) AS n FROM part GROUP BY p_size
UNION ALL SELECT 'p_brand', NULL, p_brand, COUNT(*) FROM part GROUP BY p_brand),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, number, value) AS position FROM c)
SELECT column_name, value FROM r WHERE position = 1""",
)
def modes(t: Tables) -> DataFrame:
    # The fitted values stay columns of the frame: every row of `part` is read and counted by Spark.
    best = cleaning.fit_modes(t.part, ["p_size", "p_brand"])
    shown = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(str(int(v)) if isinstance(v, float) else v).alias("value")) for c, v in best.items()])
    return t.part.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.explode(shown).alias("cell")).select("cell.*")


@named(
    "kpi_cards",
    """SELECT 'total_rows' AS card, 'Total Records' AS label, format('{:,}', COUNT(*)) AS value FROM orders
UNION ALL SELECT 'numeric_summary', 'Total O Totalprice', CASE WHEN SUM(o_totalprice) > 1000000 THEN '$' || printf('%.1f', SUM(o_totalprice) / 1000000) || 'M'
WHEN SUM(o_totalprice) > 1000 THEN '$' || printf('%.1f', SUM(o_totalprice) / 1000) || 'K' ELSE '$' || format('{:,}', CAST(ROUND(SUM(o_totalprice)) AS BIGINT)) END FROM orders
UNION ALL SELECT 'diversity', 'Unique O Orderpriority', format('{:,}', COUNT(DISTINCT o_orderpriority)) FROM orders
UNION ALL SELECT 'date_range', 'Date Range', printf('%.1f', date_diff('day', MIN(o_orderdate), MAX(o_orderdate)) / 365.0) || ' years' FROM orders""",
)
def kpi_cards(t: Tables) -> DataFrame:
    return profiling.kpi_cards(t.orders)


@named(
    "metadata_cards",
    """SELECT 'total_rows' AS card, COUNT(*) AS value FROM orders UNION ALL SELECT 'numeric_columns', CAST(3 AS BIGINT) UNION ALL SELECT 'text_columns', CAST(2 AS BIGINT)
UNION ALL SELECT 'date_columns', CAST(1 AS BIGINT) UNION ALL SELECT 'total_columns', CAST(6 AS BIGINT)""",
)
def metadata_cards(t: Tables) -> DataFrame:
    return profiling.metadata_cards(t.orders)


@named(
    "characteristics",
    """SELECT 'c_custkey' AS column_name, 'numeric' AS type_class, CAST(MIN(c_custkey) AS VARCHAR) AS sample_value FROM customer
UNION ALL SELECT 'c_name', 'categorical', MIN(c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'numeric', CAST(MIN(c_nationkey) AS VARCHAR) FROM customer
UNION ALL SELECT 'c_acctbal', 'numeric', CAST(MIN(c_acctbal) AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', 'categorical', MIN(c_mktsegment) FROM customer""",
)
def characteristics(t: Tables) -> DataFrame:
    return profiling.characteristics(t.customer)


@named("value_column_total", "SELECT 'o_totalprice' AS column_name, ROUND(SUM(o_totalprice), 2) AS total FROM orders")
def value_column_total(t: Tables) -> DataFrame:
    column = profiling.value_column(t.orders)
    return t.orders.agg(F.lit(column).alias("column_name"), F.round(F.sum(column), 2).alias("total"))


@named(
    "describe_table",
    """WITH s AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3), n AS (SELECT COUNT(*) AS row_count FROM nation)
SELECT CAST(1 AS INTEGER) AS position, 'n_nationkey' AS column_name, 'int' AS data_type, (SELECT string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY n_nationkey) FROM s) AS sample_values, row_count FROM n
UNION ALL SELECT 2, 'n_name', 'string', (SELECT string_agg(n_name, '|' ORDER BY n_nationkey) FROM s), row_count FROM n
UNION ALL SELECT 3, 'n_regionkey', 'int', (SELECT string_agg(CAST(n_regionkey AS VARCHAR), '|' ORDER BY n_nationkey) FROM s), row_count FROM n""",
)
def describe_table(t: Tables) -> DataFrame:
    return readers.describe_table(t.nation, 3, ["n_nationkey"]).withColumn("sample_values", F.array_join("sample_values", "|"))


@named(
    "preview",
    """(SELECT 'head' AS part, c_custkey FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL (SELECT 'tail', c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5)
UNION ALL (SELECT 'sample', c_custkey FROM customer ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 5)""",
)
def preview(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey")
    parts = {"head": readers.head(rows, ["c_custkey"]), "tail": readers.tail(rows, ["c_custkey"]), "sample": readers.sample(rows, ["c_custkey"])}
    tagged = [df.select(F.lit(k).alias("part"), "c_custkey") for k, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@named("csv_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_round_trip(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/part-{uuid.uuid4().hex}.csv"
    writers.write_predictions(t.part, path)
    return readers.read_file(t.spark, path, t.part.schema).rows


@named("registered_table", "SELECT s_nationkey AS nation_key, COUNT(*) AS n, ROUND(AVG(s_acctbal), 4) AS mean_balance FROM supplier GROUP BY s_nationkey")
def registered_table(t: Tables) -> DataFrame:
    readers.register(t.supplier.toDF("Supplier Key", "Supplier-Name", "Nation Key", "Balance (USD)"), "uploaded_suppliers")
    return t.spark.sql("SELECT nation_key, COUNT(*) AS n, ROUND(AVG(balance_usd), 4) AS mean_balance FROM uploaded_suppliers GROUP BY nation_key")


@named("load_metadata")
def load_metadata(t: Tables) -> DataFrame:
    return readers.load_metadata(t.spark, f"{t.folder}/orders.parquet")


@named("load_metadata_rows", "SELECT COUNT(*) AS rows, CAST(6 AS INTEGER) AS columns, 'parquet' AS file_type FROM orders")
def load_metadata_rows(t: Tables) -> DataFrame:
    return readers.load_metadata(t.spark, f"{t.folder}/orders.parquet").select("rows", "columns", "file_type")


# --- cleaning ---------------------------------------------------------------------------------------------


def _imputed(name: str, value_sql: str, type_sql: str, **options):
    @named(
        name,
        WITH_GAPPY
        + f""", m AS (SELECT event_type AS mode FROM gappy WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1)
SELECT event_id, ROUND(COALESCE(value, {value_sql}), 6) AS value, COALESCE(event_type, {type_sql}) AS event_type FROM gappy""",
    )
    def build(t: Tables) -> DataFrame:
        rows = gappy(t).select("event_id", "value", "event_type")
        return rounded(cleaning.fit_imputer(rows, columns=["value", "event_type"], **options).transform(rows))

    return build


_MODE = "(SELECT mode FROM m)"
_imputed("impute_auto", "(SELECT quantile_cont(value, 0.5) FROM gappy)", _MODE)
_imputed("impute_mean", "(SELECT AVG(value) FROM gappy)", _MODE, numeric="mean")
_imputed(
    "impute_mode_of_numbers",
    "(SELECT value FROM gappy WHERE value IS NOT NULL GROUP BY value ORDER BY COUNT(*) DESC, value LIMIT 1)",
    _MODE,
    numeric="mode",
)
_imputed("impute_constants", "0", "'MISSING'", numeric="zero", other="constant")


@named(
    "imputation_report",
    WITH_GAPPY
    + """, m AS (SELECT event_type AS mode FROM gappy WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1)
SELECT 'value' AS column_name, 'median' AS strategy, ROUND(quantile_cont(value, 0.5), 6) AS fill_number, NULL AS fill_text, COUNT(*) - COUNT(value) AS n_filled FROM gappy
UNION ALL SELECT 'event_type', 'mode', NULL, (SELECT mode FROM m), COUNT(*) - COUNT(event_type) FROM gappy""",
)
def imputation_report(t: Tables) -> DataFrame:
    rows = gappy(t).select("value", "event_type")
    report = cleaning.fit_imputer(rows).report(rows)
    number = F.round(F.col("fill_value").try_cast("double"), 6)
    return report.select("column_name", "strategy", number.alias("fill_number"), F.when(number.isNull(), F.col("fill_value")).alias("fill_text"), "n_filled")


@named(
    "forward_fill",
    WITH_GAPPY
    + """ SELECT event_id, LAST_VALUE(value IGNORE NULLS) OVER w AS value, LAST_VALUE(event_type IGNORE NULLS) OVER w AS event_type
FROM gappy WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill(t: Tables) -> DataFrame:
    rows = gappy(t)
    plan = {"value": "forward_fill", "event_type": "forward_fill"}
    return cleaning.fit_imputer(rows, plan, order_by=["ts", "event_id"], columns=list(plan)).transform(rows).select("event_id", "value", "event_type")


@named(
    "backward_fill_per_user",
    WITH_GAPPY
    + """ SELECT event_id, FIRST_VALUE(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gappy""",
)
def backward_fill_per_user(t: Tables) -> DataFrame:
    from prismill.operators.ordered import carry

    rows = gappy(t).select("event_id", "user_id", "ts", "value")
    return carry(rows, ["value"], ["ts", "event_id"], ["user_id"], forward=False).select("event_id", "value")


@named("drop_missing_rows", WITH_GAPPY + " SELECT event_id, value, event_type FROM gappy WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_rows(t: Tables) -> DataFrame:
    return cleaning.drop_missing_rows(gappy(t)).select("event_id", "value", "event_type")


def _deduplicated(keep: str, condition: str):
    @named(
        f"duplicates_keep_{keep}",
        f"""WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS i, COUNT(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
SELECT p_partkey, p_brand, p_size, p_retailprice FROM n WHERE {condition}""",
    )
    def build(t: Tables) -> DataFrame:
        rows = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
        return cleaning.remove_duplicates(rows, ["p_brand", "p_size"], keep, ["p_partkey"])

    return build


_deduplicated("first", "i = 1")
_deduplicated("last", "i = n")
_deduplicated("none", "n = 1")


@named("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return cleaning.remove_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


def _clipped(name: str, bounds_sql: str, method: str, factor: float):
    @named(
        name,
        f"WITH b AS ({bounds_sql}) SELECT event_id, ROUND(CASE WHEN value < lower THEN lower WHEN value > upper THEN upper ELSE value END, 6) AS value FROM events, b",
    )
    def build(t: Tables) -> DataFrame:
        rows = t.events.select("event_id", "value")
        return rounded(cleaning.clip(rows, profiling.fit_bounds(rows, ["value"], method, factor)))

    return build


_clipped("clip_iqr", _IQR.replace("{c}", "value").replace("{t}", "events"), "iqr", 1.5)
_clipped("clip_zscore", _Z.replace("{c}", "value").replace("{t}", "events").replace("{s}", "stddev_samp"), "zscore", 2.0)
_clipped("winsorize", "SELECT quantile_cont(value, 0.01) AS lower, quantile_cont(value, 0.99) AS upper FROM events", "percentile", 0.99)


@named(
    "remove_outliers",
    f"WITH b AS ({_IQR.replace('{c}', 'value').replace('{t}', 'events')}) SELECT event_id, value FROM events, b WHERE value BETWEEN lower AND upper",
)
def remove_outliers(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    return cleaning.remove_outliers(rows, profiling.fit_bounds(rows, ["value"]))


@named(
    "remove_outliers_in_turn",
    f"""WITH a AS ({_IQR.replace("{c}", "value").replace("{t}", "events")}), kept AS (SELECT event_id, value, user_id * user_id AS squared FROM events, a WHERE value BETWEEN lower AND upper),
b AS ({_IQR.replace("{c}", "squared").replace("{t}", "kept")}) SELECT event_id, value FROM kept, b WHERE squared BETWEEN lower AND upper""",
)
def remove_outliers_in_turn(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value", (F.col("user_id") * F.col("user_id")).alias("squared"))
    return cleaning.remove_outliers_in_turn(rows, ["value", "squared"]).select("event_id", "value")


def _dated(t: Tables) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(kind == 2, F.date_format(day, "yyyy/MM/dd"))
        .otherwise("n/a")
    )
    iso = F.date_format(day, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", text.alias("entered"), F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(iso).alias("booked"))


_DATED = """WITH dated AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'n/a' END AS entered,
CASE WHEN o_orderkey % 10 = 0 THEN '?' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS booked FROM orders)"""


@named("standard_dates", _DATED + " SELECT o_orderkey, strftime(try_strptime(entered, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d']), '%Y-%m-%d') AS entered FROM dated")
def standard_dates(t: Tables) -> DataFrame:
    return cleaning.standardize_dates(_dated(t), ["entered"]).select("o_orderkey", "entered")


@named(
    "date_report",
    _DATED
    + """ SELECT 'entered' AS column_name, COUNT(entered) AS n_values, COUNT(*) FILTER (WHERE try_strptime(entered, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d']) IS NULL) AS n_invalid FROM dated
UNION ALL SELECT 'booked', COUNT(booked), COUNT(*) FILTER (WHERE try_strptime(booked, '%Y-%m-%d') IS NULL) FROM dated""",
)
def date_report(t: Tables) -> DataFrame:
    return cleaning.date_report(_dated(t), ["entered", "booked"])


@named("auto_dates", _DATED + " SELECT o_orderkey, entered, strftime(try_strptime(booked, '%Y-%m-%d'), '%Y-%m-%d') AS booked, 'date' AS booked_type FROM dated")
def auto_dates(t: Tables) -> DataFrame:
    from prismill.functions.dates import parse_date

    rows = _dated(t)
    found = cleaning.fit_date_columns(rows)
    typed = rows.select(*[parse_date(F.col(c)).alias(c) if c in found else F.col(c) for c in rows.columns])
    kind = typed.schema["booked"].dataType.simpleString()
    return typed.withColumn("booked", F.col("booked").cast("string")).withColumn("booked_type", F.lit(kind))


@named(
    "typed_columns",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id END AS whole, CASE WHEN event_id % 3 <> 0 THEN event_id / 4.0 END AS number,
CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""",
)
def typed_columns(t: Tables) -> DataFrame:
    key = F.col("event_id")
    text = t.events.select(
        "event_id",
        F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit("x"))).otherwise(key.cast("string")).alias("whole"),
        F.when(key % 3 == 0, F.lit("bad")).otherwise((key / 4.0).cast("string")).alias("number"),
        F.when(key % 3 == 0, "true").when(key % 3 == 1, "false").otherwise("maybe").alias("flag"),
    )
    return cleaning.convert_types(text, {"whole": "int", "number": "float", "flag": "bool"})[0]


@named(
    "chart_frame",
    _DATED
    + """ SELECT strftime(try_strptime(booked, '%Y-%m-%d'), '%Y-%m-%d') AS date, CAST(o_orderkey AS DOUBLE) AS amount FROM dated WHERE o_orderkey % 6 <> 0""",
)
def chart_frame(t: Tables) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 6 == 0, "unknown").otherwise(F.col("o_orderkey").cast("string"))
    typed = cleaning.chart_frame(_dated(t).select(F.col("booked").alias("date"), amount.alias("amount")))
    return typed.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_RULES = [cleaning.Rule("c_acctbal", 0), cleaning.Rule("c_nationkey", 0, 20), cleaning.Rule("c_mktsegment", allowed=("AUTOMOBILE", "BUILDING", "MACHINERY"))]
_BROKEN = {
    "c_acctbal": "c_acctbal < 0",
    "c_nationkey": "(c_nationkey < 0 OR c_nationkey > 20)",
    "c_mktsegment": "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')",
}


@named(
    "invalid_report",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {b}) AS n_invalid FROM customer" for c, b in [*_BROKEN.items(), ("(any)", " OR ".join(_BROKEN.values()))]
    ),
)
def invalid_report(t: Tables) -> DataFrame:
    return cleaning.invalid_report(t.customer, _RULES)


@named("remove_invalid", f"SELECT c_custkey, c_acctbal FROM customer WHERE NOT ({' OR '.join(_BROKEN.values())})")
def remove_invalid(t: Tables) -> DataFrame:
    return cleaning.remove_invalid(t.customer, _RULES).select("c_custkey", "c_acctbal")


@named(
    "invalid_by_name",
    """SELECT 'retail_price' AS column_name, COUNT(*) FILTER (WHERE p_retailprice - 1000 < 0) AS n_invalid FROM part
UNION ALL SELECT 'age', COUNT(*) FILTER (WHERE p_size * 4 > 120) FROM part UNION ALL SELECT 'discount_rate', COUNT(*) FILTER (WHERE p_size * 3 > 100) FROM part
UNION ALL SELECT '(any)', COUNT(*) FILTER (WHERE p_retailprice - 1000 < 0 OR p_size * 4 > 120 OR p_size * 3 > 100) FROM part""",
)
def invalid_by_name(t: Tables) -> DataFrame:
    rows = t.part.select(
        (F.col("p_retailprice") - 1000).alias("retail_price"),
        (F.col("p_size") * 4).alias("age"),
        (F.col("p_size") * 400).alias("account_age_days"),
        (F.col("p_size") * 3).alias("discount_rate"),
    )
    return cleaning.invalid_report(rows, cleaning.rules_by_name(rows))


def _clean_text_sql(column: str) -> str:
    w = cleaning.WHITE
    c = f"regexp_replace({column}, '\\A{w}+|{w}+\\z', '', 'g')"
    c = f"regexp_replace({c}, '<[^\\n]*?>', '', 'g')"
    for wrong, right in cleaning.MOJIBAKE.items():
        c = f"replace({c}, '{wrong}', '{right}')"
    return f"regexp_replace({c}, '{w}+', ' ', 'g')"


@named("clean_text", f"SELECT doc_id, {_clean_text_sql('text')} AS text FROM documents")
def clean_text(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", "lang")
    return cleaning.clean_text_columns(rows, cleaning.fit_text_columns(rows)).select("doc_id", "text")


@named("clean_html", f"SELECT page_id, {_clean_text_sql('html')} AS html FROM pages")
def clean_html(t: Tables) -> DataFrame:
    return cleaning.clean_text_columns(t.pages.select("page_id", "html"), ["html"])


@named(
    "high_null_columns_dropped",
    "SELECT event_id, value FROM events",
)
def high_null_columns_dropped(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value", F.when(F.col("event_id") % 10 == 0, F.col("event_type")).alias("rarely"))
    return rows.drop(*cleaning.high_null_columns(rows))


@named(
    "dominance_report",
    "\nUNION ALL ".join(
        f"""(SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS dominant_value, COUNT(*) AS n_dominant, ROUND(COUNT(*) * 1.0 / (SELECT COUNT({c}) FROM orders), 6) AS dominant_share
FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"""
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ),
)
def dominance_report(t: Tables) -> DataFrame:
    return rounded(cleaning.dominance_report(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@named(
    "clean_composite",
    WITH_GAPPY
    + f""", m AS (SELECT event_type AS mode FROM gappy WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1),
filled AS (SELECT event_id, user_id, COALESCE(value, (SELECT quantile_cont(value, 0.5) FROM gappy)) AS value, COALESCE(event_type, {_MODE}) AS event_type FROM gappy),
once AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM filled) WHERE i = 1),
b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM once)
SELECT event_id, user_id, event_type, ROUND(CASE WHEN value < a - 1.5 * (z - a) THEN a - 1.5 * (z - a) WHEN value > z + 1.5 * (z - a) THEN z + 1.5 * (z - a) ELSE value END, 6) AS value FROM once, b""",
)
def clean_composite(t: Tables) -> DataFrame:
    rows = gappy(t).withColumn("unused", F.lit("same")).drop("ts")
    frame, _ = cleaning.clean(
        rows,
        subset=["user_id", "event_type"],
        order_by=["event_id"],
        outliers="clip",
        null_threshold=0.8,
        dominance_threshold=0.95,
        protect=["event_id", "user_id"],
    )
    return rounded(frame)


@named(
    "clean_audit",
    WITH_GAPPY
    + """, m AS (SELECT event_type AS mode FROM gappy WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1)
SELECT 'impute' AS name, 'median' AS action, 'value' AS column_name, COUNT(*) - COUNT(value) AS affected FROM gappy
UNION ALL SELECT 'impute', 'mode', 'event_type', COUNT(*) - COUNT(event_type) FROM gappy UNION ALL SELECT 'impute', 'median', 'event_id', CAST(0 AS BIGINT) UNION ALL SELECT 'impute', 'median', 'user_id', CAST(0 AS BIGINT)
UNION ALL SELECT 'duplicates', 'keep_first', NULL, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, COALESCE(event_type, (SELECT mode FROM m)) FROM gappy)) FROM gappy""",
)
def clean_audit(t: Tables) -> DataFrame:
    rows = gappy(t).drop("ts")
    _, audit = cleaning.clean(rows, subset=["user_id", "event_type"], order_by=["event_id"], count=True)
    return audit.table(t.spark).drop("step")


@named(
    "profiled_file",
    """SELECT 'o_orderkey' AS column_name, 'numerical' AS semantic_type, COUNT(DISTINCT o_orderkey) AS n_distinct, COUNT(*) - COUNT(o_orderkey) AS n_missing FROM orders
UNION ALL SELECT 'o_custkey', 'numerical', COUNT(DISTINCT o_custkey), COUNT(*) - COUNT(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', COUNT(DISTINCT o_orderstatus), COUNT(*) - COUNT(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'numerical', COUNT(DISTINCT o_totalprice), COUNT(*) - COUNT(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 'datetime', COUNT(DISTINCT o_orderdate), COUNT(*) - COUNT(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', COUNT(DISTINCT o_orderpriority), COUNT(*) - COUNT(o_orderpriority) FROM orders""",
)
def profiled_file(t: Tables) -> DataFrame:
    return profiling.profile_file(t.spark, f"{t.folder}/orders.parquet").types


@named("standard_spelling", "SELECT p_name, COUNT(*) AS n FROM part GROUP BY p_name")
def standard_spelling(t: Tables) -> DataFrame:
    """Part names in other case and with stray blanks; near enough to 1 the threshold keeps different names apart."""
    name = F.col("p_name")
    variant = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), name)).when(F.col("p_partkey") % 5 == 0, F.initcap(name)).otherwise(name)
    rows = t.part.select("p_partkey", variant.alias("p_name"))
    together = fuzzy.standardize(rows, "p_name", 0.97).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return together.select(F.lower(F.trim("p_name")).alias("p_name"), "n")


def grouped_spellings_sql(values: str, column: str, threshold: float) -> str:
    """The grouping by its definition: matching blocks by halving around the longest common piece, then one text after the other."""
    return f"""WITH RECURSIVE shown AS ({values}),
counts AS (SELECT {column} AS v, COUNT(*) AS n FROM shown GROUP BY ALL),
best AS (SELECT lower(trim(v)) AS form, v, n, ROW_NUMBER() OVER (PARTITION BY lower(trim(v)) ORDER BY n DESC, v) AS k FROM counts),
ranked AS (SELECT form, v, ROW_NUMBER() OVER (ORDER BY n DESC, v) AS r FROM best WHERE k = 1),
pieces AS (
SELECT a.r AS l, b.r AS x, a.form AS sa, b.form AS sb, 0::BIGINT AS taken, 0 AS side FROM ranked a JOIN ranked b ON a.r < b.r
UNION ALL
SELECT l, x, CASE side WHEN 1 THEN left(sa, -hit.i - 1) WHEN 2 THEN substr(sa, -hit.i + hit.k) END, CASE side WHEN 1 THEN left(sb, -hit.j - 1) WHEN 2 THEN substr(sb, -hit.j + hit.k) END,
CASE WHEN side = 1 THEN hit.k ELSE 0 END, side FROM (
SELECT l, x, sa, sb, list_max(flatten(list_transform(range(1, length(sa) + 1), lambda i: list_transform(range(1, length(sb) + 1), lambda j:
struct_pack(k := len(list_filter(range(1, least(length(sa) - i, length(sb) - j) + 2), lambda k: substr(sa, i, k) = substr(sb, j, k))), i := -i, j := -j))))) AS hit
FROM pieces WHERE sa <> '' AND sb <> ''), (VALUES (1), (2)) AS sides(side) WHERE hit.k > 0),
near AS (SELECT p.x, list(p.l) AS ls FROM (SELECT l, x, SUM(taken) AS m FROM pieces GROUP BY l, x) p JOIN ranked a ON a.r = p.l JOIN ranked b ON b.r = p.x
WHERE 2 * m >= {threshold} * (length(a.form) + length(b.form)) GROUP BY p.x),
steps AS (
SELECT 0::BIGINT AS r, []::BIGINT[] AS leaders
UNION ALL
SELECT s.r + 1, CASE WHEN list_has_any(s.leaders, coalesce(n.ls, [])) THEN s.leaders ELSE list_append(s.leaders, s.r + 1) END
FROM steps s JOIN ranked o ON o.r = s.r + 1 LEFT JOIN near n ON n.x = o.r),
chosen AS (SELECT o.form, coalesce(list_min(list_intersect(s.leaders, n.ls)), o.r) AS lead FROM ranked o LEFT JOIN near n ON n.x = o.r, (SELECT leaders FROM steps ORDER BY r DESC LIMIT 1) s)
SELECT o.v AS {column}, COUNT(*) AS n FROM shown JOIN chosen c ON c.form = lower(trim({column})) JOIN ranked o ON o.r = c.lead GROUP BY ALL"""


MISSPELT_SQL = "SELECT CASE WHEN p_partkey % 7 = 0 THEN {c} || right({c}, 1) WHEN p_partkey % 5 = 0 THEN upper({c}) ELSE {c} END AS {c} FROM part"


def misspelt(t: Tables, column: str) -> DataFrame:
    """A doubled letter in every seventh, upper case in every fifth row."""
    name = F.col(column)
    variant = F.when(F.col("p_partkey") % 7 == 0, F.concat(name, F.substring(name, -1, 1))).when(F.col("p_partkey") % 5 == 0, F.upper(name)).otherwise(name)
    return t.part.select("p_partkey", variant.alias(column))


@named("standard_categories", grouped_spellings_sql(MISSPELT_SQL.format(c="p_name"), "p_name", 0.9))
def standard_categories(t: Tables) -> DataFrame:
    """Part names with misspelt variants brought together."""
    return fuzzy.standardize(misspelt(t, "p_name"), "p_name", 0.9).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@named("standard_names", grouped_spellings_sql(MISSPELT_SQL.format(c="p_name"), "p_name", 0.8))
def standard_names(t: Tables) -> DataFrame:
    """The same at the usual threshold, at which some different names are near each other too."""
    return fuzzy.standardize(misspelt(t, "p_name"), "p_name").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@named("standard_brands", grouped_spellings_sql(MISSPELT_SQL.format(c="p_brand"), "p_brand", 0.8))
def standard_brands(t: Tables) -> DataFrame:
    """Brands differ in one or two signs, so the leaders decide who belongs together."""
    return fuzzy.standardize(misspelt(t, "p_brand"), "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@named("missing_contract_columns", "SELECT 'absent' AS column_name, COUNT(*) AS n_rows FROM customer")
def missing_contract_columns(t: Tables) -> DataFrame:
    lacking = shapes.missing_columns(t.customer, ["c_custkey", "c_acctbal", "absent"])
    return t.customer.agg(F.lit(",".join(lacking)).alias("column_name"), F.count(F.lit(1)).alias("n_rows"))
