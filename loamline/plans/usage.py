"""Usage, cost and access analytics over audit rows and step timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.contains import containing

#: What an unknown model costs per 1000 tokens in and out.
DEFAULT_RATE = (0.001, 0.003)


def estimate_cost(audit: DataFrame, rates: DataFrame) -> DataFrame:
    """cost of each row by the rate (provider, model_key, rate_in, rate_out) whose key is the longest in the model's name."""
    own = audit.withColumn("_model", F.lower(F.coalesce("model", F.lit(""))))
    models = own.select("provider", "_model").distinct()
    named = containing(rates, models, "model_key", "_model").toDF("model_key", "_model")
    fit = models.join(named, "_model").join(rates, ["provider", "model_key"])
    best = fit.groupBy("provider", "_model").agg(F.max_by(F.struct("rate_in", "rate_out"), F.struct(F.char_length("model_key"), "model_key")).alias("r"))
    priced = own.join(best, ["provider", "_model"], "left")
    cost = F.coalesce("prompt_tokens", F.lit(0)) / 1000.0 * F.coalesce("r.rate_in", F.lit(DEFAULT_RATE[0])) + F.coalesce("completion_tokens", F.lit(0)) / 1000.0 * F.coalesce("r.rate_out", F.lit(DEFAULT_RATE[1]))
    return priced.withColumn("cost", cost).drop("r", "_model")


def usage_from_payload(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Tokens from three shapes of answers; the first with a total above 0 counts."""
    get = lambda path: F.try_variant_get(F.try_parse_json(column), path, "bigint")
    shapes = [("$.usage_metadata.input_tokens", "$.usage_metadata.output_tokens"), ("$.response_metadata.token_usage.prompt_tokens", "$.response_metadata.token_usage.completion_tokens"), ("$.response_metadata.usage.input_tokens", "$.response_metadata.usage.output_tokens")]
    p, c = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for a, b in reversed(shapes):
        x, y = F.coalesce(get(a), F.lit(0)), F.coalesce(get(b), F.lit(0))
        p, c = F.when(x + y > 0, x).otherwise(p), F.when(x + y > 0, y).otherwise(c)
    return raw.withColumns({"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c})


def accumulate_usage(calls: DataFrame) -> DataFrame:
    """Sums of all calls of one question."""
    return calls.groupBy("question_id").agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost", "duration_ms")), F.count("*").alias("n_calls"))


def audit_rows(df: DataFrame) -> DataFrame:
    """Prompts cut at 4000 characters and errors at 2000."""
    return df.withColumns({"prompt": F.substring("prompt", 1, 4000), "error": F.substring("error", 1, 2000)})


def step_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("step_name", F.substring("step_name", 1, 128))


def audit_page(audit: DataFrame, users: DataFrame, user: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest rows with their users' addresses."""
    rows = audit if user is None else audit.where(F.col("user_id") == user)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.to_timestamp(F.lit(since)))
    return rows.join(users, "user_id", "left").orderBy(F.desc("created_at"), F.asc("audit_id")).limit(limit)


def audit_summary(page: DataFrame) -> DataFrame:
    return page.agg(F.count("*").alias("n_prompts"), F.count_if(~F.col("success")).alias("n_failed"), F.sum("cost").alias("cost"), F.sum("total_tokens").alias("tokens"), F.avg("duration_ms").alias("mean_ms"))


def steps_of(steps: DataFrame, audit_id: int) -> DataFrame:
    return steps.where(F.col("audit_id") == audit_id).orderBy("ordinal")


def slow_steps(steps: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls, mean, greatest and nearly greatest duration of each step."""
    rows = steps if since is None else steps.where(F.col("created_at") >= since)
    return rows.groupBy("step_name").agg(F.count("*").alias("n_calls"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms"))


def spend_by_user(audit: DataFrame, users: DataFrame, month: str) -> DataFrame:
    rows = audit.where(F.date_trunc("month", "created_at") == F.to_timestamp(F.lit(month)))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_prompts"), F.sum("cost").alias("spend"), F.sum("total_tokens").alias("tokens")).join(users, "user_id", "left")


def recent_runs(log: DataFrame, user: str, n: int = 5) -> DataFrame:
    return log.where(F.col("user_id") == user).orderBy(F.desc("completed_at"), "source", "scope").limit(n)


def chunks_per_resource(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks.groupBy("source", "resource_id").agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "source", "resource_id").limit(n)


def access_list(grants: DataFrame, users: DataFrame) -> DataFrame:
    return grants.join(users, "user_id").select("user_id", "email", "source", "scope")


def orphan_scopes(chunks: DataFrame, grants: DataFrame) -> DataFrame:
    """Scopes that are indexed and granted to nobody."""
    return chunks.groupBy("source", "scope").agg(F.count("*").alias("n_chunks")).join(grants.select("source", "scope"), ["source", "scope"], "left_anti")


def session_totals(audit: DataFrame) -> DataFrame:
    """Running totals of each user's tokens and cost, and the mean time so far."""
    run = Window.partitionBy("user_id").orderBy("created_at", "audit_id").rowsBetween(Window.unboundedPreceding, 0)
    return audit.withColumns({"run_tokens": F.sum("total_tokens").over(run), "run_cost": F.sum("cost").over(run), "run_mean_ms": F.avg("duration_ms").over(run)})


def catalog_listing(chunks: DataFrame) -> DataFrame:
    return chunks.where("source = 'sql'").select("scope", "object_name", "object_type").distinct().orderBy("scope", "object_name")
