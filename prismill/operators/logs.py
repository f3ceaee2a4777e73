"""Analytics over request traces, prompt versions, answers and decisions kept as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prismill.functions.keys import prompt_key
from prismill.functions.numbers import percent
from prismill.operators.cleaning import WHITE
from prismill.operators.metrics import rating as points_rating
from prismill.operators.ordered import SLICE, carry, sliced
from prismill.operators.quantiles import quantiles
from prismill.session import durable

# Dollars per prompt and completion token.
PROMPT_PRICE, COMPLETION_PRICE = 5e-6, 1.5e-5

# What each kind of decision may choose, and what stands in for anything else.
ALLOWED = {
    "imputation": ("mean", "median", "mode", "forward_fill", "backward_fill", "zero", "constant", "drop", "auto"),
    "outlier": ("clip", "cap", "remove", "winsorize", "log_transform", "ignore", "cap_at_iqr", "cap_at_percentile"),
    "encoding": ("one_hot", "label", "target_encoding", "frequency_encoding", "hash_encoding", "ordinal", "binary"),
    "scaling": ("standard", "minmax", "robust", "maxabs", "normalizer", "none"),
    "imbalance": ("smote", "adasyn", "random_oversample", "random_undersample", "class_weight", "none", "auto"),
    "model": (
        "RandomForest", "ExtraTrees", "DecisionTree", "GradientBoosting", "AdaBoost", "LogisticRegression", "SGDClassifier",
        "SVM_Linear", "SVM_RBF", "SVM_Poly", "KNN", "GaussianNB", "MultinomialNB", "XGBoost", "LightGBM", "CatBoost",
        "LinearRegression", "Ridge", "Lasso", "ElasticNet", "SGDRegressor", "SVR_Linear", "SVR_RBF", "SVR_Poly",
    ),
}
FALLBACK = {"imputation": "median", "outlier": "clip", "encoding": "one_hot", "scaling": "standard", "imbalance": "class_weight"}

# Words of the scoring and tagging rules.
QUESTION_STOP_WORDS = ("the", "a", "an", "is", "are", "what", "show", "me", "get")
VAGUE_TERMS = ("etc", "stuff", "things", "basically")
NAMED_COLUMNS = ("product", "region", "amount", "date", "customer", "sales", "revenue", "total")
MODELLING_WORDS = (
    "upload", "csv", "dataset", "train", "model", "predict", "classify", "regression",
    "machine learning", "ml", "feature engineering", "eda", "analyze dataset",
)


def split_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, f"{WHITE}+"), lambda w: w != "")


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "acceptable").otherwise("poor")


# --- traces -----------------------------------------------------------------------------------------------


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.size(split_words(text)) * 0.75 + F.length(text) / 4.0).cast("bigint")


def cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return prompt_tokens * PROMPT_PRICE + completion_tokens * COMPLETION_PRICE


def trace_statistics(traces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, error rate, mean and exact p50, p95, p99 of latency, tokens and cost, overall or per key."""
    n = F.count(F.lit(1))
    facts = traces.groupBy(*by).agg(
        n.alias("n_traces"),
        F.count_if(~F.col("success")).alias("n_errors"),
        percent(F.count_if(~F.col("success")), n).alias("error_rate_pct"),
        F.avg("latency_ms").alias("mean_latency"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("total_cost"),
        F.try_divide(F.sum("cost_usd"), F.count_distinct("correlation_id").cast("double")).alias("cost_per_request"),
    )
    q = F.col("quantiles")
    tails = quantiles(traces, ["latency_ms"], [0.5, 0.95, 0.99], by).select(*by, q[0].alias("p50"), q[1].alias("p95"), q[2].alias("p99"))
    if not by:
        packed = tails.select(F.struct("p50", "p95", "p99").alias("t")).scalar()
        return facts.select("*", packed["p50"].alias("p50"), packed["p95"].alias("p95"), packed["p99"].alias("p99"))
    return facts.join(tails, list(by), "left")


def request_rollup(traces: DataFrame) -> DataFrame:
    return traces.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("n_operations"),
        F.sum("latency_ms").alias("total_latency"),
        F.sum("cost_usd").alias("total_cost"),
        F.sum("total_tokens").alias("total_tokens"),
        F.every("success").alias("all_successful"),
    )


def recent_traces(traces: DataFrame, n: int = 10, correlation_id: object = None) -> DataFrame:
    """The latest n traces, or all traces of one request in time order."""
    if correlation_id is not None:
        return traces.where(F.col("correlation_id") == F.lit(correlation_id)).orderBy("start_time")
    return traces.orderBy(F.col("start_time").desc(), F.col("trace_id").desc()).limit(n)


def mode_statistics(requests: DataFrame) -> DataFrame:
    """Requests and success rate per mode."""
    n = F.count(F.lit(1))
    return requests.groupBy("mode").agg(n.alias("n"), F.count_if("success").alias("n_success"), percent(F.count_if("success"), n).alias("success_rate_pct"))


def validation_statistics(runs: DataFrame) -> DataFrame:
    """First-try rate and number of iterations of validated queries, with their distribution up to three."""
    n, i = F.count(F.lit(1)), F.col("iterations")
    first = F.count_if((i == 1) & F.col("success"))
    return runs.agg(
        n.alias("n"),
        first.alias("first_try"),
        percent(first, n).alias("first_try_pct"),
        F.avg(i).alias("mean_iterations"),
        F.min(i).alias("min_iterations"),
        F.max(i).alias("max_iterations"),
        *[F.count_if(i == k).alias(f"took_{k}") for k in (1, 2, 3)],
    )


def is_valid_verdict(text: Column) -> Column:
    """A verdict counts as valid when VALID: starts a word, so that INVALID: does not."""
    return F.upper(text).rlike(r"(^|[^A-Z])VALID:")


def benchmark_summary(runs: DataFrame, baseline_seconds: float) -> DataFrame:
    """Mean, least and most seconds per phase, success and accuracy rates, speed-up and rows per second."""
    n, s = F.count(F.lit(1)), F.col("seconds")
    return runs.groupBy("phase").agg(
        n.alias("n"),
        F.avg(s).alias("mean_seconds"),
        F.min(s).alias("min_seconds"),
        F.max(s).alias("max_seconds"),
        percent(F.count_if("success"), n).alias("success_pct"),
        percent(F.count_if("correct"), n).alias("accuracy_pct"),
        F.try_divide(F.lit(float(baseline_seconds)), F.avg(s)).alias("speed_up"),
        F.try_divide(F.sum("rows").cast("double"), F.sum(s)).alias("rows_per_second"),
    )


# --- prompt versions --------------------------------------------------------------------------------------


def version_hash(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def version_usage(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost per agent and prompt version. Input: agent, prompt, tokens, cost_usd."""
    n = F.count(F.lit(1))
    return usage.groupBy("agent", version_hash(F.col("prompt")).alias("version_hash")).agg(
        F.max(F.length("prompt")).alias("prompt_length"),
        n.alias("n_requests"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("total_cost"),
        F.avg("tokens").alias("mean_tokens"),
        F.avg("cost_usd").alias("mean_cost"),
    )


def version_changes(log: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows where an agent's prompt differs from the one before. The previous hash is found by position, so that
    an agent with most of the log is spread over many tasks."""
    from prismill.operators.ordered import cumulate

    hashed = log.withColumn("version_hash", version_hash(F.col("prompt"))).select("agent", *order_by, "version_hash")
    placed = durable(cumulate(hashed, order_by, ["agent"], index="__position"))
    before = placed.select(F.col("agent").alias("__agent"), (F.col("__position") + 1).alias("__next"), F.col("version_hash").alias("previous_hash"))
    joined = placed.join(before, placed["agent"].eqNullSafe(before["__agent"]) & (placed["__position"] == before["__next"]))
    return joined.where("version_hash <> previous_hash").select("agent", *order_by, "previous_hash", "version_hash")


def inefficiencies(usage: DataFrame) -> DataFrame:
    """(agent, version_hash, kind): prompts above 2000 characters, 1000 tokens or one cent per request."""
    flags = F.array(
        F.when(F.col("prompt_length") > 2000, "long_prompt"),
        F.when(F.col("mean_tokens") > 1000, "high_token_usage"),
        F.when(F.col("mean_cost") > 0.01, "high_cost"),
    )
    return usage.select("agent", "version_hash", F.explode(F.array_compact(flags)).alias("kind"))


# --- response cache ---------------------------------------------------------------------------------------


# A time behind all others, in microseconds.
NEVER = (1 << 63) - 1


def _ends(at: np.ndarray, life: int) -> np.ndarray:
    """For an entry stored at each of the sorted times: the end of the last entry that follows from it."""
    hop = np.searchsorted(at, at + life)
    hop = np.where(hop < len(at), hop, np.arange(len(at)))
    while not np.array_equal(hop, further := hop[hop]):
        hop = further
    return at[hop] + life


def _stored(at: np.ndarray, life: int) -> np.ndarray:
    """The sorted times at which a cache that is empty before the first one stores an entry."""
    found, i = [], 0
    while i < len(at):
        found.append(at[i])
        i = np.searchsorted(at, at[i] + life)
    return np.array(found, dtype="int64")


def _runs(rows: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """(key, sorted times) of each key of one slice."""
    rows = rows.sort_values(["cache_key", "at"])
    keys, at = rows["cache_key"].to_numpy(), rows["at"].to_numpy()
    starts = [*np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))] if len(keys) else []
    for start, end in zip(starts, [*starts[1:], len(keys)]):
        yield keys[start], at[start:end]


def cache_entries(requests: DataFrame, ttl_seconds: int, slices: int | None = None) -> DataFrame:
    """(cache_key, cached_at) of every entry a cache would have stored: the first request of a key, then the first
    one at or after the end of the entry before. A hit does not renew an entry.

    The requests are cut into slices along (key, time). A slice is a function from the end of the entry it finds to
    the end of the entry it leaves; the ends a slice can leave are few, as chains that meet stay together. Only keys
    that reach over several slices need these functions: their ends are linked across slices, marks travel along the
    links while the links double (log2 of the slices of one key, joins on distinct ends), and each slice then replays
    its own requests once from where it is entered. A key with a third of all rows is spread like any other.
    Input: model, prompt, requested_at; requests without a time are left out.
    """
    life = int(ttl_seconds) * 1_000_000
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("requested_at").cast("timestamp_ntz"))
    times = requests.where(F.col("requested_at").isNotNull()).select(prompt_key(F.col("model"), F.col("prompt")).alias("cache_key"), micros.alias("at")).distinct()
    rows = durable(sliced(times, ["at"], ["cache_key"], slices).withColumnRenamed(SLICE, "slice"))
    # A slice has at most one key that began before it: these tables have at most two rows a slice.
    reach = rows.groupBy("cache_key", "slice").agg(F.max("at").alias("until"))
    spans = durable(reach.groupBy("cache_key").agg(F.array_sort(F.collect_list(F.struct("slice", "until"))).alias("parts")).where(F.size("parts") > 1))
    longest = spans.agg(F.max(F.size("parts"))).first()[0] or 0
    entered = _slice_entries(rows, spans, life, longest) if longest else spans.select("cache_key", F.lit(0).alias("slice"), F.lit(0).cast("bigint").alias("start"))

    def replay(own: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        # A group that only one side has comes as an empty frame without columns.
        start = dict(zip(entered["cache_key"], entered["start"])) if len(entered) else {}
        kept = [(key, _stored(at[at >= start.get(key, at[0])], life)) for key, at in _runs(own)]
        keys = pd.Series([key for key, found in kept for _ in found], dtype=object)
        return pd.DataFrame({"cache_key": keys, "at": np.concatenate([np.empty(0, "int64"), *[found for _, found in kept]])})

    stored = rows.groupBy("slice").cogroup(entered.toDF("cache_key", "slice", "start").groupBy("slice")).applyInPandas(replay, "cache_key string, at bigint")
    seconds = (F.col("at") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return stored.select("cache_key", (epoch + F.make_dt_interval(secs=seconds)).alias("cached_at"))


def _slice_entries(rows: DataFrame, spans: DataFrame, life: int, longest: int) -> DataFrame:
    """(cache_key, slice, start): for each later slice of a key the first request it stores; NEVER where an older entry outlives it."""
    wide = rows.join(spans, "cache_key").select("cache_key", "at", "slice", (F.col("slice") == F.col("parts")[0]["slice"]).alias("opens"))

    def leave(own: pd.DataFrame) -> pd.DataFrame:
        opening = dict(zip(own["cache_key"], own["opens"]))
        # The slice in which a key begins is entered in one way only.
        ends = [(key, _ends(at, life)[:1] if opening[key] else np.unique(_ends(at, life))) for key, at in _runs(own)]
        keys = [key for key, found in ends for _ in found]
        columns = {"cache_key": keys, "free_at": np.concatenate([found for _, found in ends]), "marked": [opening[key] for key in keys]}
        return pd.DataFrame(columns).astype({"cache_key": object}).assign(slice=own["slice"].iloc[0])

    left = wide.groupBy("slice").applyInPandas(leave, "cache_key string, free_at bigint, marked boolean, slice int")
    later = F.filter("parts", lambda p: (p["slice"] > F.col("slice")) & (p["until"] >= F.col("free_at")))
    # The same end may be left by several slices; it is one place, the first of them decides where it is met.
    aimed = left.join(spans, "cache_key").select("cache_key", "free_at", "marked", F.get(later, F.lit(0))["slice"].alias("slice"))
    aimed = aimed.groupBy("cache_key", "free_at").agg(F.max("marked").alias("marked"), F.min("slice").alias("slice"))

    def meet(own: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, at in _runs(own) if len(ends) else ():
            group = ends[ends["cache_key"] == key]
            met = np.searchsorted(at, group["free_at"].to_numpy())
            parts.append(group.assign(start=at[met], later=_ends(at, life)[met]) if len(met) else group.assign(start=0, later=0))
        empty = {c: [] for c in ("cache_key", "free_at", "marked", "slice", "start", "later")}
        return (pd.concat(parts) if parts else pd.DataFrame(empty)).astype({"cache_key": object})

    shape = "cache_key string, free_at bigint, marked boolean, slice int, start bigint, later bigint"
    aims = aimed.where(F.col("slice").isNotNull()).toDF("cache_key", "free_at", "marked", "slice")
    links = durable(wide.groupBy("slice").cogroup(aims.groupBy("slice")).applyInPandas(meet, shape))
    state = links.select("cache_key", "free_at", "later", "marked")
    for _ in range((longest - 1).bit_length()):
        ahead = state.select("cache_key", F.col("free_at").alias("later"), F.col("later").alias("furthest"))
        joined = state.join(ahead, ["cache_key", "later"], "left")
        own = F.struct("free_at", F.col("furthest").alias("later"), "marked")
        pushed = F.struct(F.col("later").alias("free_at"), F.lit(None).cast("bigint").alias("later"), F.lit(True).alias("marked"))
        sent = joined.select("cache_key", F.explode(F.when(F.col("marked") & F.col("later").isNotNull(), F.array(own, pushed)).otherwise(F.array(own))).alias("m"))
        state = durable(sent.select("cache_key", "m.*").groupBy("cache_key", "free_at").agg(F.max("later").alias("later"), F.max("marked").alias("marked")))
    reached = links.join(state.where("marked").select("cache_key", "free_at"), ["cache_key", "free_at"], "left_semi").select("cache_key", "slice", "start")
    others = spans.select("cache_key", F.explode("parts").alias("p"), F.col("parts")[0]["slice"].alias("first"))
    return others.where(F.col("p.slice") > F.col("first")).select("cache_key", F.col("p.slice").alias("slice")).join(reached, ["cache_key", "slice"], "left").fillna({"start": NEVER})


def cache_statistics(requests: DataFrame, ttl_seconds: int, cost_per_call: float = 0.0) -> DataFrame:
    """Requests, hits, misses, hit rate, cost saved and entries expired by the last request."""
    entries = cache_entries(requests, ttl_seconds)
    life = F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    n = requests.select(F.count(F.lit(1))).scalar()
    last = requests.select(F.max("requested_at")).scalar()
    misses = F.count(F.lit(1))
    return entries.agg(
        n.alias("n_requests"),
        misses.alias("n_misses"),
        (n - misses).alias("n_hits"),
        percent(n - misses, n).alias("hit_rate_pct"),
        ((n - misses) * F.lit(float(cost_per_call))).alias("cost_saved"),
        F.count_if(F.col("cached_at") + life <= last).alias("n_expired"),
    )


# --- decisions --------------------------------------------------------------------------------------------


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Adds valid and applied: the strategy when its stage allows it, else the stage's fallback."""
    allowed = F.create_map(*[x for stage, names in ALLOWED.items() for x in (F.lit(stage), F.array(*[F.lit(n) for n in names]))])
    fallback = F.create_map(*[F.lit(x) for pair in FALLBACK.items() for x in pair])
    valid = F.coalesce(F.array_contains(allowed[F.col("stage")], F.col("strategy")), F.lit(False))
    applied = F.when(valid, F.col("strategy")).otherwise(F.coalesce(fallback[F.col("stage")], F.lit("auto")))
    return decisions.select("*", valid.alias("valid"), applied.alias("applied"))


def decision_success(checked: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return checked.groupBy("stage").agg(n.alias("n"), F.count_if("valid").alias("n_valid"), percent(F.count_if("valid"), n).alias("success_rate_pct"))


def cleaning_quality(decisions: DataFrame, important: Sequence[str] = ()) -> DataFrame:
    """Score per run of cleaning choices (run, kind, column_name, strategy, reasoning), out of 100: points off for
    other than the median on skewed columns, other than mean or median on normal ones, dropping a column that is
    no identifier, and removing the outliers of an important column."""
    strategy, why = F.lower("strategy"), F.lower("reasoning")
    missing, outlier = F.col("kind") == "missing", F.col("kind") == "outlier"
    important_column = F.col("column_name").isin(*important) if important else F.lit(False)
    points = (
        F.when(missing & F.contains(why, F.lit("skewed")) & (strategy != "median"), 10).otherwise(0)
        + F.when(missing & F.contains(why, F.lit("normal")) & ~strategy.isin("mean", "median"), 10).otherwise(0)
        + F.when(missing & (strategy == "drop") & ~F.col("column_name").isin("id", "identifier"), 5).otherwise(0)
        + F.when(outlier & (strategy == "remove") & important_column, 15).otherwise(0)
    )
    score = 100 - F.sum(points)
    return decisions.groupBy("run").agg(F.count_if(points > 0).alias("n_issues"), F.greatest(score, F.lit(0)).alias("score"), points_rating(score).alias("rating"))


def feature_quality(encodings: DataFrame, interactions: DataFrame) -> DataFrame:
    """Score per run of encodings (run, column_name, strategy, cardinality) and interactions (run, n), out of 100."""
    strategy, size = F.lower("strategy"), F.col("cardinality")
    points = F.when((size > 20) & (strategy == "one_hot"), 15).otherwise(0) + F.when((size < 5) & (strategy != "one_hot"), 5).otherwise(0)
    per_run = encodings.groupBy("run").agg(F.sum(points).alias("points"))
    many = interactions.groupBy("run").agg(F.when(F.sum("n") > 10, 10).otherwise(0).alias("extra"))
    total = 100 - F.coalesce(F.col("points"), F.lit(0)) - F.coalesce(F.col("extra"), F.lit(0))
    return per_run.join(many, "run", "full").select("run", F.greatest(total, F.lit(0)).alias("score"), points_rating(total).alias("rating"))


# Per stage the sections of a decision text, the field that names the choice, and the accepted choices.
SECTIONS = {
    "missing_values": ("cleaning", "strategy", ("mean", "median", "mode", "knn", "mice", "drop", "forward_fill", "backward_fill")),
    "missing_value_decisions": ("cleaning", "strategy", ("mean", "median", "mode", "knn", "mice", "drop", "forward_fill", "backward_fill")),
    "outliers": ("cleaning", "action", ("keep", "cap", "remove", "clip")),
    "categorical_encoding": ("features", "method", ("one_hot", "label", "target", "frequency", "hash", "binary", "ordinal")),
    "numerical_transformations": ("features", "method", ("log", "log1p", "sqrt", "boxcox", "yeo-johnson", "quantile", "none")),
}
SINGLE_CHOICES = {
    "task_type": ("training", ("classification", "regression", "binary_classification", "multi_class")),
    "cv_strategy": ("training", ("KFold", "StratifiedKFold", "TimeSeriesSplit", "GroupKFold")),
}


def json_in_text(text: Column) -> Column:
    """The JSON object of an answer: the whole text, else a fenced block, else the widest braces; null if none parses."""
    candidates = F.array(
        F.when(F.startswith(F.trim(text), F.lit("{")), F.trim(text)),
        F.regexp_extract(text, r"(?is)```json\s*(.*?)\s*```", 1),
        F.regexp_extract(text, r"(?s)```\s*(.*?)\s*```", 1),
        F.regexp_extract(text, r"(?s)\{.*\}", 0),
    )
    return F.get(F.filter(candidates, lambda c: F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull()), F.lit(0))


def sql_in_text(text: Column) -> Column:
    """The SQL of an answer: a fenced sql block, else a fenced block, else the whole text, ended by one semicolon."""
    fenced = F.regexp_extract(text, r"(?is)```sql\s*(.*?)```", 1)
    plain = F.regexp_extract(text, r"(?s)```\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).when(plain != "", plain).otherwise(text)
    one_line = F.trim(F.regexp_replace(body, f"{WHITE}+", " "))
    return F.concat(F.regexp_replace(one_line, r"[; ]+$", ""), F.lit(";"))


def parsed_decisions(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stage, section, column_name, choice, reasoning, accepted) of every decision in the answers' JSON."""
    choice = "map<string, struct<strategy: string, action: string, method: string, reasoning: string>>"
    fields = ", ".join([f"{s}: {choice}" for s in SECTIONS] + [f"{s}: string" for s in SINGLE_CHOICES] + ["duplicates: struct<action: string, reasoning: string>"])
    parsed = answers.select(key, F.from_json(json_in_text(F.col(text)), f"struct<{fields}>").alias("j")).where("j IS NOT NULL")
    def entries(section: str, stage: str, field: str, accepted: Sequence[str]) -> Column:
        def entry(e: Column) -> Column:
            choice, why = e["value"][field], e["value"]["reasoning"]
            return F.struct(
                F.lit(stage).alias("stage"),
                F.lit(section).alias("section"),
                e["key"].alias("column_name"),
                choice.alias("choice"),
                why.alias("reasoning"),
                choice.isin(*accepted).alias("accepted"),
            )

        return F.coalesce(F.transform(F.map_entries(F.col(f"j.{section}")), entry), F.array())

    parts = [entries(section, *rule) for section, rule in SECTIONS.items()]
    nothing = F.lit(None).cast("string")
    for section, (stage, accepted) in SINGLE_CHOICES.items():
        value = F.col(f"j.{section}")
        single = F.struct(F.lit(stage).alias("stage"), F.lit(section).alias("section"), nothing.alias("column_name"), value.alias("choice"), nothing.alias("reasoning"), value.isin(*accepted).alias("accepted"))
        parts.append(F.when(value.isNotNull(), F.array(single)).otherwise(F.array()))
    d = F.col("j.duplicates")
    action = F.struct(F.lit("cleaning").alias("stage"), F.lit("duplicates").alias("section"), nothing.alias("column_name"), d["action"].alias("choice"), d["reasoning"].alias("reasoning"), d["action"].isin("keep", "remove").alias("accepted"))
    parts.append(F.when(d["action"].isNotNull(), F.array(action)).otherwise(F.array()))
    return parsed.select(key, F.explode(F.concat(*parts)).alias("d")).select(key, "d.*")


# --- SQL log ----------------------------------------------------------------------------------------------


def lint_sql(log: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Adds syntax, schema_points, practices, optimisation (25 points each, bonuses on top), score, grade and issues
    to a query log (sql, question, success)."""
    sql, upper, question = F.trim("sql"), F.upper("sql"), F.lower("question")
    has = lambda part: F.contains(upper, F.lit(part))
    grouped = has("GROUP BY")
    aggregated = contains_any(upper, ("SUM(", "COUNT(", "AVG(", "MAX(", "MIN("))
    where, group = F.instr(upper, "WHERE"), F.instr(upper, "GROUP BY")
    intents = [F.contains(question, F.lit(w)).cast("int") for w in ("top", "best", "worst", "each", "per", "by")]
    wants_ranking = sum(intents[1:], intents[0]) >= 2
    windowed = contains_any(upper, ("ROW_NUMBER()", "RANK()", "DENSE_RANK()", "PARTITION BY"))
    about_time = contains_any(question, ("date", "month", "year"))
    clock = contains_any(upper, ("DATE('NOW'", "DATETIME('NOW'"))
    off = lambda test, points: F.when(test, points).otherwise(0)
    ok = F.col("success")
    starts = F.upper(sql).rlike("^(SELECT|WITH)")
    uneven = F.length(F.regexp_replace("sql", r"[^(]", "")) != F.length(F.regexp_replace("sql", r"[^)]", ""))
    open_end = ~F.endswith(sql, F.lit(";"))
    unknown_table = ~contains_any(upper, [t.upper() for t in tables])
    unknown_column = ~contains_any(upper, ("PRODUCT", "REGION", "AMOUNT", "DATE", "CUSTOMER"))
    bare_group = grouped & ~aggregated
    late_where = (where > 0) & (group > 0) & (where > group)
    ranking = wants_ranking & ~windowed
    adaptive = about_time & ~clock & has("MAX(DATE)")
    syntax = F.when(ok, F.greatest(F.lit(0), 25 - off(~starts, 5) - off(uneven, 10) - off(open_end, 2))).otherwise(0)
    schema_points = 25 - off(unknown_table, 10) - off(unknown_column, 5)
    practices = 25 - off(has("SELECT *"), 5) - off(~has("LIMIT"), 3) - off(bare_group, 5) - off(late_where, 5) + off(has("ORDER BY") & aggregated, 2)
    optimisation = 25 - off(ranking, 15) + off(has("WITH") & has("AS ("), 5) - off(about_time & clock, 5) + off(adaptive, 3)
    issues = F.array_compact(
        F.array(
            F.when(~ok, "failed"),
            F.when(ok & ~starts, "not_a_query"),
            F.when(ok & uneven, "unbalanced_parentheses"),
            F.when(ok & open_end, "no_semicolon"),
            F.when(unknown_table, "no_known_table"),
            F.when(unknown_column, "no_known_column"),
            F.when(has("SELECT *"), "select_star"),
            F.when(~has("LIMIT"), "no_limit"),
            F.when(bare_group, "group_without_aggregate"),
            F.when(late_where, "where_after_group"),
            F.when(ranking, "ranking_without_window"),
            F.when(about_time & clock, "clock_dates"),
        )
    )
    scored = log.select("*", syntax.alias("syntax"), schema_points.alias("schema_points"), practices.alias("practices"), optimisation.alias("optimisation"), issues.alias("issues"))
    total = F.col("syntax") + F.col("schema_points") + F.col("practices") + F.col("optimisation")
    return scored.select("*", total.alias("score"), grade(total).alias("grade"))


def quality_registry(scores: DataFrame) -> DataFrame:
    """Counts, mean, excellent and poor per kind of score."""
    return scores.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("grade") == "excellent").alias("n_excellent"), F.count_if(F.col("grade") == "poor").alias("n_poor")
    )


# --- answers and questions --------------------------------------------------------------------------------


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant turn right after, by a join on the turn number."""
    asked = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds relevance (30), completeness (20), clarity (25), grounding (25), score and grade to answers
    (question, answer, columns array, data_text)."""
    answer, low = F.col("answer"), F.lower("answer")
    off = lambda test, points: F.when(test, points).otherwise(0)
    keywords = F.array_except(F.array_distinct(split_words(F.lower("question"))), F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS]))
    overlap = F.try_divide(F.size(F.array_intersect(keywords, split_words(low))).cast("double"), F.size(keywords))
    relevance = F.when(overlap < 0.3, 15).when(overlap < 0.5, 25).otherwise(30)
    n_words = F.size(split_words(answer))
    has_data = F.length("data_text") > 0
    completeness = 20 - F.when(n_words < 10, 10).when(n_words > 100, 5).otherwise(0) - off(~answer.rlike(r"\p{Nd}") & has_data, 5)
    clarity = 25 - off(~answer.rlike("[.!?]"), 10) - off((F.length(answer) > 0) & ~answer.rlike(r"^\p{Lu}"), 2)
    for term in VAGUE_TERMS:
        clarity = clarity - off(F.contains(low, F.lit(term)), 3)
    named = F.array_intersect(F.array(*[F.lit(c) for c in NAMED_COLUMNS]), F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    unknown = F.when(F.size("columns") > 0, F.size(F.array_except(named, F.transform("columns", F.lower)))).otherwise(0)
    numbers = F.slice(F.regexp_extract_all(answer, F.lit(r"\$?[\p{Nd},]+\.?\p{Nd}*"), F.lit(0)), 1, 3)
    cleaned = F.transform(numbers, lambda n: F.regexp_replace(n, r"[$,]", ""))
    unfounded = F.when(has_data, F.size(F.filter(cleaned, lambda n: ~F.contains(F.col("data_text"), n)))).otherwise(0)
    grounding = F.greatest(F.lit(0), 25 - 5 * unknown - 3 * unfounded)
    scored = answers.select("*", relevance.alias("relevance"), completeness.alias("completeness"), F.greatest(clarity, F.lit(0)).alias("clarity"), grounding.alias("grounding"))
    total = F.col("relevance") + F.col("completeness") + F.col("clarity") + F.col("grounding")
    return scored.select("*", total.alias("score"), grade(total).alias("grade"))


def tag_questions(questions: DataFrame, text: str, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Adds kind, aggregation, direction, dims, span, filters, row_limit and route to questions.

    `values` lists the known values per dimension, of which a mentioned one becomes a filter.
    """
    q = F.lower(text)
    says = lambda *parts: contains_any(q, parts)
    total, mean, count = says("total", "sum"), says("average", "avg", "mean"), says("count", "how many", "number of")
    best, worst = says("highest", "top", "maximum", "best"), says("lowest", "bottom", "minimum", "worst")
    kind = (
        F.when(total | mean | count, "aggregation")
        .when(best | worst, "ranking")
        .when(says("trend", "over time", "monthly", "daily"), "time_series")
        .otherwise("listing")
    )
    aggregation = F.when(total, "sum").when(mean, "avg").when(count, "count")
    direction = F.when(kind == "ranking", F.when(best, "desc").otherwise("asc"))
    dims = F.array_compact(F.array(*[F.when(says(d), d) for d in ("region", "product")]))
    span = F.when(says("last month"), "last_month").when(says("last quarter", "last 3 months"), "last_3_months").when(says("last year"), "last_year").when(says("this year"), "this_year")
    filters = F.array_compact(F.array(*[F.when(says(v.lower()), f"{dim}={v}") for dim, known in (values or {}).items() for v in known]).cast("array<string>"))
    limit = F.when(says("top 5", "first 5"), 5).when(says("top 10", "first 10"), 10)
    route = F.when(says(*MODELLING_WORDS) | q.rlike(r"\.(csv|xlsx|xls)$"), "modelling").otherwise("query")
    fields = F.array_compact(
        F.array(F.when(says("region"), "region"), F.when(says("product"), "product"), F.when(says("sales", "amount"), "amount"), F.when(says("date", "time", "month"), "date"))
    )
    return questions.select(
        "*",
        kind.alias("kind"),
        aggregation.alias("aggregation"),
        direction.alias("direction"),
        fields.alias("fields"),
        dims.alias("dims"),
        span.alias("span"),
        filters.alias("filters"),
        limit.alias("row_limit"),
        route.alias("route"),
    )


def cost_of_answers(frame: DataFrame, prompt: str, completion: str) -> DataFrame:
    """Adds prompt_tokens, completion_tokens, total_tokens and cost_usd estimated from the texts."""
    tokens = frame.select("*", estimated_tokens(F.col(prompt)).alias("prompt_tokens"), estimated_tokens(F.col(completion)).alias("completion_tokens"))
    return tokens.select(
        "*", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost_usd")
    )

