"""Named queries: trace, prompt, cache, decision, SQL-log and answer analytics.

The log tables are views of `events` (a trace per event) and `conversations` (question and answer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismill.operators import cleaning, logs
from prismill.plans.quality import rounded
from prismill.plans.registry import Tables, named


def traces(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.col("event_id").alias("trace_id"),
        F.col("user_id").alias("correlation_id"),
        F.col("event_type").alias("agent"),
        F.when(F.col("user_id") % 2 == 0, "query").otherwise("data_science").alias("mode"),
        F.col("ts").alias("start_time"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
        k.alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        (k * 3).alias("total_tokens"),
        logs.cost(k, k * 2).alias("cost_usd"),
    )


TRACES = """traces AS (SELECT event_id AS trace_id, user_id AS correlation_id, event_type AS agent, CASE WHEN user_id % 2 = 0 THEN 'query' ELSE 'data_science' END AS mode, ts AS start_time,
value AS latency_ms, event_type <> 'error' AS success, k AS prompt_tokens, k * 2 AS completion_tokens, k * 3 AS total_tokens, k * 5e-6 + k * 2 * 1.5e-5 AS cost_usd
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""
WITH_TRACES = "WITH " + TRACES

_STATISTICS = """COUNT(*) AS n_traces, COUNT(*) FILTER (WHERE NOT success) AS n_errors, ROUND(COUNT(*) FILTER (WHERE NOT success) * 100.0 / COUNT(*), 6) AS error_rate_pct,
ROUND(AVG(latency_ms), 6) AS mean_latency, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, ROUND(SUM(cost_usd), 6) AS total_cost, ROUND(SUM(cost_usd) / COUNT(DISTINCT correlation_id), 6) AS cost_per_request,
ROUND(quantile_cont(latency_ms, 0.5), 6) AS p50, ROUND(quantile_cont(latency_ms, 0.95), 6) AS p95, ROUND(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM traces"""


@named("trace_statistics", f"{WITH_TRACES} SELECT {_STATISTICS}")
def trace_statistics(t: Tables) -> DataFrame:
    return rounded(logs.trace_statistics(traces(t)))


@named("trace_statistics_by_agent", f"{WITH_TRACES} SELECT agent, {_STATISTICS} GROUP BY agent")
def trace_statistics_by_agent(t: Tables) -> DataFrame:
    return rounded(logs.trace_statistics(traces(t), ["agent"]))


@named(
    "request_rollup",
    f"""{WITH_TRACES} SELECT correlation_id, COUNT(*) AS n_operations, ROUND(SUM(latency_ms), 6) AS total_latency, ROUND(SUM(cost_usd), 8) AS total_cost,
CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, bool_and(success) AS all_successful FROM traces GROUP BY correlation_id""",
)
def request_rollup(t: Tables) -> DataFrame:
    return logs.request_rollup(traces(t)).withColumns({"total_latency": F.round("total_latency", 6), "total_cost": F.round("total_cost", 8)})


@named("recent_traces", f"{WITH_TRACES} SELECT trace_id, agent, latency_ms, success FROM traces ORDER BY start_time DESC, trace_id DESC LIMIT 10")
def recent_traces(t: Tables) -> DataFrame:
    return logs.recent_traces(traces(t)).select("trace_id", "agent", "latency_ms", "success")


@named("traces_of_request", f"{WITH_TRACES} SELECT trace_id, agent, latency_ms, success FROM traces WHERE correlation_id = 7")
def traces_of_request(t: Tables) -> DataFrame:
    return logs.recent_traces(traces(t), correlation_id=7).select("trace_id", "agent", "latency_ms", "success")


@named(
    "mode_statistics",
    f"{WITH_TRACES} SELECT mode, COUNT(*) AS n, COUNT(*) FILTER (WHERE success) AS n_success, ROUND(COUNT(*) FILTER (WHERE success) * 100.0 / COUNT(*), 6) AS success_rate_pct FROM traces GROUP BY mode",
)
def mode_statistics(t: Tables) -> DataFrame:
    return rounded(logs.mode_statistics(traces(t)))


@named(
    "validation_statistics",
    f"""{WITH_TRACES}, r AS (SELECT prompt_tokens % 3 + 1 AS i, success FROM traces)
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE i = 1 AND success) AS first_try, ROUND(COUNT(*) FILTER (WHERE i = 1 AND success) * 100.0 / COUNT(*), 6) AS first_try_pct, ROUND(AVG(i), 6) AS mean_iterations,
MIN(i) AS min_iterations, MAX(i) AS max_iterations, COUNT(*) FILTER (WHERE i = 1) AS took_1, COUNT(*) FILTER (WHERE i = 2) AS took_2, COUNT(*) FILTER (WHERE i = 3) AS took_3 FROM r""",
)
def validation_statistics(t: Tables) -> DataFrame:
    return rounded(logs.validation_statistics(traces(t).withColumn("iterations", F.col("prompt_tokens") % 3 + 1)))


@named(
    "verdicts",
    "SELECT event_type <> 'error' AS valid, COUNT(*) AS n FROM events GROUP BY 1",
)
def verdicts(t: Tables) -> DataFrame:
    verdict = F.concat(F.when(F.col("event_type") == "error", "Invalid").otherwise("Valid"), F.lit(": the query answers "), F.col("user_id").cast("string"))
    return t.events.groupBy(logs.is_valid_verdict(verdict).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@named(
    "benchmark_summary",
    f"""{WITH_TRACES} SELECT agent AS phase, COUNT(*) AS n, ROUND(AVG(latency_ms / 1000), 6) AS mean_seconds, MIN(latency_ms / 1000) AS min_seconds, MAX(latency_ms / 1000) AS max_seconds,
ROUND(COUNT(*) FILTER (WHERE success) * 100.0 / COUNT(*), 6) AS success_pct, ROUND(COUNT(*) FILTER (WHERE prompt_tokens > 50) * 100.0 / COUNT(*), 6) AS accuracy_pct,
ROUND(0.5 / AVG(latency_ms / 1000), 6) AS speed_up, ROUND(SUM(total_tokens) / SUM(latency_ms / 1000), 4) AS rows_per_second FROM traces GROUP BY agent""",
)
def benchmark_summary(t: Tables) -> DataFrame:
    runs = traces(t).select(
        F.col("agent").alias("phase"), (F.col("latency_ms") / 1000).alias("seconds"), "success", (F.col("prompt_tokens") > 50).alias("correct"), F.col("total_tokens").alias("rows")
    )
    found = logs.benchmark_summary(runs, 0.5)
    plain = ("min_seconds", "max_seconds")
    return found.select(*[F.col(c) if c in plain or kind != "double" else F.round(c, 4 if c == "rows_per_second" else 6).alias(c) for c, kind in found.dtypes])


# --- prompts and cache ------------------------------------------------------------------------------------


def prompt_log(t: Tables) -> DataFrame:
    version = F.col("correlation_id") % 4
    prompt = F.concat(F.lit("You are the "), F.col("agent"), F.lit(" agent, version "), version.cast("string"), F.when(version == 3, F.repeat(F.lit(" detail"), 300)).otherwise(""))
    return traces(t).select("agent", "start_time", "trace_id", prompt.alias("prompt"), (F.col("total_tokens") * 7).alias("tokens"), (F.col("cost_usd") * 5).alias("cost_usd"))


PROMPTS = f"""{TRACES}, prompts AS (SELECT agent, start_time, trace_id, 'You are the ' || agent || ' agent, version ' || (correlation_id % 4) || CASE WHEN correlation_id % 4 = 3 THEN repeat(' detail', 300) ELSE '' END AS prompt,
total_tokens * 7 AS tokens, cost_usd * 5 AS cost_usd FROM traces),
usage AS (SELECT agent, sha256(prompt) AS version_hash, MAX(length(prompt)) AS prompt_length, COUNT(*) AS n_requests, SUM(tokens) AS total_tokens, SUM(cost_usd) AS total_cost, AVG(tokens) AS mean_tokens, AVG(cost_usd) AS mean_cost FROM prompts GROUP BY 1, 2)"""


@named(
    "version_usage",
    f"""WITH {PROMPTS} SELECT agent, version_hash, CAST(prompt_length AS INTEGER) AS prompt_length, n_requests, CAST(total_tokens AS BIGINT) AS total_tokens, ROUND(total_cost, 6) AS total_cost,
ROUND(mean_tokens, 9) AS mean_tokens, ROUND(mean_cost, 14) AS mean_cost FROM usage""",
)
def version_usage(t: Tables) -> DataFrame:
    return logs.version_usage(prompt_log(t)).withColumns(
        {"total_cost": F.round("total_cost", 6), "mean_tokens": F.round("mean_tokens", 9), "mean_cost": F.round("mean_cost", 14)}
    )


@named(
    "version_changes",
    f"""WITH {PROMPTS}, p AS (SELECT agent, trace_id, sha256(prompt) AS version_hash, LAG(sha256(prompt)) OVER (PARTITION BY agent ORDER BY start_time, trace_id) AS previous_hash FROM prompts)
SELECT * FROM p WHERE version_hash <> previous_hash""",
)
def version_changes(t: Tables) -> DataFrame:
    return logs.version_changes(prompt_log(t), ["start_time", "trace_id"]).drop("start_time")


@named(
    "inefficiencies",
    f"""WITH {PROMPTS} SELECT agent, version_hash, 'long_prompt' AS kind FROM usage WHERE prompt_length > 2000 UNION ALL SELECT agent, version_hash, 'high_token_usage' FROM usage WHERE mean_tokens > 1000
UNION ALL SELECT agent, version_hash, 'high_cost' FROM usage WHERE mean_cost > 0.01""",
)
def inefficiencies(t: Tables) -> DataFrame:
    return logs.inefficiencies(logs.version_usage(prompt_log(t)))


def cache_requests(t: Tables) -> DataFrame:
    prompt = F.concat(F.lit(" Question "), (F.col("user_id") % 20).cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(""))
    return t.events.select(F.col("event_type").alias("model"), prompt.alias("prompt"), F.col("ts").alias("requested_at"))


_CACHE = """WITH RECURSIVE r AS (SELECT sha256(event_type || ':' || 'question ' || (user_id % 20)) AS cache_key, ts FROM events),
c AS (SELECT cache_key, MIN(ts) AS cached_at FROM r GROUP BY cache_key
UNION ALL SELECT c.cache_key, (SELECT MIN(ts) FROM r WHERE r.cache_key = c.cache_key AND r.ts >= c.cached_at + INTERVAL 36000 SECOND) FROM c WHERE c.cached_at IS NOT NULL)"""


@named("cache_entries", _CACHE + " SELECT cache_key, CAST(cached_at AS VARCHAR) AS cached_at FROM c WHERE cached_at IS NOT NULL")
def cache_entries(t: Tables) -> DataFrame:
    return logs.cache_entries(cache_requests(t), 36000).withColumn("cached_at", F.col("cached_at").cast("string"))


@named(
    "cache_statistics",
    _CACHE
    + """, n AS (SELECT COUNT(*) AS n, MAX(ts) AS last FROM r)
SELECT n AS n_requests, COUNT(*) AS n_misses, n - COUNT(*) AS n_hits, ROUND((n - COUNT(*)) * 100.0 / n, 6) AS hit_rate_pct, CAST(ROUND((n - COUNT(*)) * 0.01, 6) AS DOUBLE) AS cost_saved,
COUNT(*) FILTER (WHERE cached_at + INTERVAL 36000 SECOND <= last) AS n_expired FROM c, n WHERE cached_at IS NOT NULL GROUP BY n, last""",
)
def cache_statistics(t: Tables) -> DataFrame:
    return rounded(logs.cache_statistics(cache_requests(t), 36000, 0.01))


# --- decisions --------------------------------------------------------------------------------------------

_CHOICES = {"click": ("imputation", "median", "magic"), "view": ("outlier", "cap", "explode"), "purchase": ("encoding", "one_hot", "zip"), "signup": ("scaling", "robust", "median"), "error": ("imbalance", "smote", "luck")}


def decisions(t: Tables) -> DataFrame:
    stage, strategy = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, good, bad) in _CHOICES.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
        strategy = F.when(F.col("event_type") == kind, F.when(F.col("event_id") % 3 == 0, bad).otherwise(good)).otherwise(strategy)
    return t.events.select("event_id", stage.alias("stage"), strategy.alias("strategy"))


DECISIONS = (
    "WITH decisions AS (SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _, _) in _CHOICES.items())
    + " END AS stage, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN CASE WHEN event_id % 3 = 0 THEN '{b}' ELSE '{g}' END" for k, (_, g, b) in _CHOICES.items())
    + " END AS strategy FROM events)"
)


@named(
    "check_decisions",
    DECISIONS
    + """ SELECT event_id, stage, strategy, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN strategy WHEN stage = 'imputation' THEN 'median' WHEN stage = 'outlier' THEN 'clip'
WHEN stage = 'encoding' THEN 'one_hot' WHEN stage = 'scaling' THEN 'standard' ELSE 'class_weight' END AS applied FROM decisions""",
)
def check_decisions(t: Tables) -> DataFrame:
    return logs.check_decisions(decisions(t))


@named(
    "decision_success",
    DECISIONS
    + """ SELECT stage, COUNT(*) AS n, COUNT(*) FILTER (WHERE event_id % 3 <> 0) AS n_valid, ROUND(COUNT(*) FILTER (WHERE event_id % 3 <> 0) * 100.0 / COUNT(*), 6) AS success_rate_pct FROM decisions GROUP BY stage""",
)
def decision_success(t: Tables) -> DataFrame:
    return rounded(logs.decision_success(logs.check_decisions(decisions(t))))


@named(
    "cleaning_quality",
    """WITH d AS (SELECT user_id // 5 AS run, CASE WHEN event_type = 'click' AND event_id % 60 = 0 THEN 10 WHEN event_type = 'view' AND event_id % 60 = 0 THEN 10 ELSE 0 END
+ CASE WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 5 ELSE 0 END + CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 15 ELSE 0 END AS points FROM events),
s AS (SELECT run, COUNT(*) FILTER (WHERE points > 0) AS n_issues, CAST(100 - SUM(points) AS BIGINT) AS score FROM d GROUP BY run)
SELECT run, n_issues, greatest(score, 0) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'acceptable' ELSE 'needs_improvement' END AS rating FROM s""",
)
def cleaning_quality(t: Tables) -> DataFrame:
    """Runs of choices: the mean for skewed and the mode for normal columns are wrong, dropping and removing are seldom right."""
    kind, odd = F.col("event_type"), F.col("event_id") % 60 == 0
    choices = t.events.select(
        F.floor(F.col("user_id") / 5).alias("run"),
        F.when(kind == "error", "outlier").otherwise("missing").alias("kind"),
        F.when((kind == "error") & (F.col("event_id") % 50 == 0), "price").otherwise("size").alias("column_name"),
        F.when(kind == "click", F.when(odd, "mean").otherwise("median"))
        .when(kind == "view", F.when(odd, "mode").otherwise("mean"))
        .when((kind == "purchase") & (F.col("event_id") % 40 == 0), "drop")
        .when(kind == "error", "remove")
        .otherwise("median")
        .alias("strategy"),
        F.when(kind == "click", "Skewed distribution").when(kind == "view", "Normal distribution").otherwise("few gaps").alias("reasoning"),
    )
    return logs.cleaning_quality(choices, ["price"])


@named(
    "feature_quality",
    """WITH e AS (SELECT p_partkey // 25 AS run, SUM(CASE WHEN p_size > 20 AND p_partkey % 20 = 0 THEN 15 WHEN p_size < 5 AND p_partkey % 20 <> 0 THEN 1 * 5 ELSE 0 END) AS points FROM part GROUP BY 1),
i AS (SELECT p_partkey // 25 AS run, CASE WHEN COUNT(*) > 10 THEN 10 ELSE 0 END AS extra FROM part WHERE p_type = 'PROMO' GROUP BY 1),
s AS (SELECT COALESCE(e.run, i.run) AS run, CAST(100 - COALESCE(points, 0) - COALESCE(extra, 0) AS BIGINT) AS score FROM e FULL JOIN i ON e.run = i.run)
SELECT run, greatest(score, 0) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'acceptable' ELSE 'needs_improvement' END AS rating FROM s""",
)
def feature_quality(t: Tables) -> DataFrame:
    run = F.expr("p_partkey div 25").alias("run")
    encodings = t.part.select(
        run, F.col("p_name").alias("column_name"), F.when(F.col("p_partkey") % 20 == 0, "one_hot").otherwise("target").alias("strategy"), F.col("p_size").alias("cardinality")
    )
    interactions = t.part.where("p_type = 'PROMO'").select(run, F.lit(1).alias("n"))
    return logs.feature_quality(encodings, interactions)


def decision_texts(t: Tables) -> DataFrame:
    """Answers of five forms: bare JSON, fenced JSON, fenced without a name, broken JSON, and JSON inside prose."""
    key, column = F.col("event_id"), F.col("event_type")
    choice = F.when(key % 4 == 0, "guess").otherwise("median")
    body = F.concat(
        F.lit('{"missing_values": {"'), column, F.lit('": {"strategy": "'), choice, F.lit('", "reasoning": "gaps"}}, "duplicates": {"action": "remove", "reasoning": "copies"}, "cv_strategy": "KFold"}')
    )
    form = key % 5
    text = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("Plan:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(form == 2, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(form == 3, F.concat(F.lit("Plan: "), F.substring(body, 1, 40)))
        .otherwise(F.concat(F.lit("I would choose "), body, F.lit(" here.")))
    )
    return t.events.select("event_id", text.alias("answer"))


@named(
    "parsed_decisions",
    """WITH k AS (SELECT event_id, event_type FROM events WHERE event_id % 5 <> 3)
SELECT event_id, 'cleaning' AS stage, 'missing_values' AS section, event_type AS column_name, CASE WHEN event_id % 4 = 0 THEN 'guess' ELSE 'median' END AS choice, 'gaps' AS reasoning, event_id % 4 <> 0 AS accepted FROM k
UNION ALL SELECT event_id, 'cleaning', 'duplicates', NULL, 'remove', 'copies', true FROM k UNION ALL SELECT event_id, 'training', 'cv_strategy', NULL, 'KFold', NULL, true FROM k""",
)
def parsed_decisions(t: Tables) -> DataFrame:
    return logs.parsed_decisions(decision_texts(t), "event_id", "answer")


def sql_log(t: Tables) -> DataFrame:
    """Queries of six forms over the events, with their questions."""
    user, form = F.col("user_id").cast("string"), F.col("event_id") % 6
    sql = (
        F.when(form == 0, F.concat(F.lit("SELECT region, SUM(amount) AS total FROM sales WHERE id > "), user, F.lit(" GROUP BY region ORDER BY total DESC LIMIT 10;")))
        .when(form == 1, F.concat(F.lit("SELECT * FROM sales WHERE id = "), user))
        .when(form == 2, F.lit("WITH r AS (SELECT product, ROW_NUMBER() OVER (PARTITION BY region ORDER BY amount) AS n FROM sales) SELECT product FROM r WHERE n <= 3 LIMIT 9;"))
        .when(form == 3, F.lit("SELECT region FROM sales WHERE date >= DATE('now', '-1 month') GROUP BY region;"))
        .when(form == 4, F.lit("DELETE FROM other WHERE (x = 1;"))
        .otherwise(F.lit("SELECT COUNT(id) FROM sales WHERE date >= DATE((SELECT MAX(date) FROM sales), '-6 months') LIMIT 1;"))
    )
    question = F.when(form == 2, "Top 3 products per region").when(form == 0, "best regions by total").when(form.isin(3, 5), "sales of the last month").otherwise("list something")
    return t.events.select("event_id", sql.alias("sql"), question.alias("question"), (F.col("event_type") != "error").alias("success"))


_LINT = {0: (25, 25, 27, 10), 1: (23, 20, 17, 25), 2: (25, 25, 25, 30), 3: (25, 25, 17, 20), 4: (10, 10, 22, 25), 5: (25, 25, 25, 28)}


@named(
    "lint_sql",
    "WITH f AS (SELECT event_id, event_type <> 'error' AS success, event_id % 6 AS form FROM events), s AS (SELECT event_id, CASE WHEN success THEN CASE form "
    + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in _LINT.items())
    + " END ELSE 0 END AS syntax, "
    + ", ".join(f"CASE form {' '.join(f'WHEN {k} THEN {v[i]}' for k, v in _LINT.items())} END AS {name}" for i, name in ((1, "schema_points"), (2, "practices"), (3, "optimisation")))
    + """ FROM f), t AS (SELECT *, syntax + schema_points + practices + optimisation AS score FROM s)
SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'acceptable' ELSE 'poor' END AS grade FROM t""",
)
def lint_sql(t: Tables) -> DataFrame:
    return logs.lint_sql(sql_log(t), ["sales", "uploaded_data"]).drop("sql", "question", "success", "issues")


@named("sql_in_text", "SELECT event_id, 'SELECT a FROM t WHERE id = ' || user_id || ';' AS sql FROM events")
def sql_in_text(t: Tables) -> DataFrame:
    bare = F.concat(F.lit("SELECT a\nFROM t   WHERE id = "), F.col("user_id").cast("string"))
    form = F.col("event_id") % 3
    text = F.when(form == 0, F.concat(F.lit("Here:\n```sql\n"), bare, F.lit(";\n```\nbye"))).when(form == 1, F.concat(F.lit("```\n"), bare, F.lit("\n```"))).otherwise(F.concat(bare, F.lit(" ;")))
    return t.events.select("event_id", logs.sql_in_text(text).alias("sql"))


# --- answers ----------------------------------------------------------------------------------------------


def answers(t: Tables) -> DataFrame:
    columns = F.array(F.lit("region"), F.lit("Amount"))
    return logs.exchanges(t.conversations).select("*", columns.alias("columns"), F.col("question").alias("data_text"))


_W = cleaning.WHITE
_EXCHANGES = "x AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_SCORES = f"""{_EXCHANGES},
w AS (SELECT *, list_filter(list_distinct(string_split_regex(lower(question), '{_W}+')), lambda v: v <> '' AND v NOT IN ({", ".join(f"'{v}'" for v in logs.QUESTION_STOP_WORDS)})) AS keys,
list_filter(string_split_regex(lower(answer), '{_W}+'), lambda v: v <> '') AS words, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+') AS tokens,
regexp_extract_all(answer, '\\$?[\\p{{Nd}},]+\\.?\\p{{Nd}}*')[1:3] AS numbers FROM x),
o AS (SELECT *, len(list_intersect(keys, words)) * 1.0 / NULLIF(len(keys), 0) AS overlap FROM w),
p AS (SELECT conv_id, turn, CASE WHEN overlap < 0.3 THEN 15 WHEN overlap < 0.5 THEN 25 ELSE 30 END AS relevance,
20 - CASE WHEN len(words) < 10 THEN 10 WHEN len(words) > 100 THEN 5 ELSE 0 END - CASE WHEN NOT regexp_matches(answer, '\\p{{Nd}}') AND question <> '' THEN 5 ELSE 0 END AS completeness,
greatest(0, 25 - CASE WHEN regexp_matches(answer, '[.!?]') THEN 0 ELSE 10 END - CASE WHEN answer <> '' AND NOT regexp_matches(answer, '^\\p{{Lu}}') THEN 2 ELSE 0 END
{" ".join(f"- CASE WHEN contains(lower(answer), '{v}') THEN 3 ELSE 0 END" for v in logs.VAGUE_TERMS)}) AS clarity,
greatest(0, 25 - 5 * len(list_filter(['product', 'date', 'customer', 'sales', 'revenue', 'total'], lambda c: list_contains(tokens, c)))
- CASE WHEN question <> '' THEN 3 * len(list_filter(numbers, lambda n: NOT contains(question, regexp_replace(n, '[$,]', '', 'g')))) ELSE 0 END) AS grounding FROM o),
s AS (SELECT *, relevance + completeness + clarity + grounding AS score FROM p),
g AS (SELECT conv_id, turn, CAST(relevance AS INTEGER) AS relevance, CAST(completeness AS INTEGER) AS completeness, CAST(clarity AS INTEGER) AS clarity, CAST(grounding AS INTEGER) AS grounding, CAST(score AS INTEGER) AS score,
CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'acceptable' ELSE 'poor' END AS grade FROM s)"""


@named("exchanges", f"WITH {_EXCHANGES} SELECT conv_id, turn, question, answer FROM x")
def exchanges(t: Tables) -> DataFrame:
    return logs.exchanges(t.conversations)


@named("answer_scores", f"WITH {_SCORES} SELECT * FROM g")
def answer_scores(t: Tables) -> DataFrame:
    return logs.score_answers(answers(t)).drop("question", "answer", "columns", "data_text")


@named(
    "quality_registry",
    f"""WITH {_SCORES} SELECT 'answer' AS kind, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, COUNT(*) FILTER (WHERE grade = 'excellent') AS n_excellent, COUNT(*) FILTER (WHERE grade = 'poor') AS n_poor FROM g""",
)
def quality_registry(t: Tables) -> DataFrame:
    return rounded(logs.quality_registry(logs.score_answers(answers(t)).withColumn("kind", F.lit("answer"))))


@named(
    "answer_cost",
    f"""WITH {_EXCHANGES}, k AS (SELECT conv_id, turn, CAST(floor(len(list_filter(string_split_regex(question, '{_W}+'), lambda v: v <> '')) * 0.75 + length(question) / 4.0) AS BIGINT) AS p,
CAST(floor(len(list_filter(string_split_regex(answer, '{_W}+'), lambda v: v <> '')) * 0.75 + length(answer) / 4.0) AS BIGINT) AS c FROM x)
SELECT conv_id, turn, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, ROUND(p * 5e-6 + c * 1.5e-5, 8) AS cost_usd FROM k""",
)
def answer_cost(t: Tables) -> DataFrame:
    return logs.cost_of_answers(logs.exchanges(t.conversations), "question", "answer").drop("question", "answer").withColumn("cost_usd", F.round("cost_usd", 8))


_QUESTIONS = {
    "click": "What is the total sales amount by region last month?",
    "view": "Show the top 5 products by average price this year",
    "purchase": "Which product has the lowest sales in the North?",
    "signup": "Show the monthly trend for the last 3 months",
    "error": "Train a model on churn.csv",
}
# Substrings count, so that "lowest" also mentions the West.
_TAGS = {
    "click": ("aggregation", "sum", None, "region,amount,date", "region", "last_month", "", None, "query"),
    "view": ("aggregation", "avg", None, "product", "product", "this_year", "", 5, "query"),
    "purchase": ("ranking", None, "asc", "product,amount", "product", None, "region=North,region=West", None, "query"),
    "signup": ("time_series", None, None, "date", "", "last_3_months", "", None, "query"),
    "error": ("listing", None, None, "", "", None, "", None, "modelling"),
}


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


@named(
    "question_tags",
    "SELECT event_id, "
    + ", ".join(
        f"CAST(CASE event_type {' '.join(f'WHEN {_literal(k)} THEN {_literal(v[i])}' for k, v in _TAGS.items())} END AS {'INTEGER' if name == 'row_limit' else 'VARCHAR'}) AS {name}"
        for i, name in enumerate(("kind", "aggregation", "direction", "fields", "dims", "span", "filters", "row_limit", "route"))
    )
    + " FROM events",
)
def question_tags(t: Tables) -> DataFrame:
    question = F.lit(None).cast("string")
    for kind, text in _QUESTIONS.items():
        question = F.when(F.col("event_type") == kind, text).otherwise(question)
    tagged = logs.tag_questions(t.events.select("event_id", question.alias("question")), "question", {"region": ["North", "South", "East", "West"]})
    joined = [F.array_join(c, ",").alias(c) if c in ("fields", "dims", "filters") else F.col(c) for c in tagged.columns if c != "question"]
    return tagged.select(*joined)
