"""Usage reports over call, request and processing logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names under which providers report token counts, in the order in which they count.
PROMPT_KEYS = ("prompt_tokens", "input_tokens", "prompt_token_count")
COMPLETION_KEYS = ("completion_tokens", "output_tokens", "candidates_token_count")
TOTAL_KEYS = ("total_tokens", "total_token_count")


def since(rows: DataFrame, start: Column | None, at: str = "timestamp") -> DataFrame:
    """Rows from ``start`` on; all without one."""
    return rows if start is None else rows.where(F.col(at) >= start)


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal all of ``wanted`` but those that are None or empty."""
    kept = [F.col(c) == v for c, v in wanted.items() if v not in (None, "")]
    return rows.where(reduce(lambda a, b: a & b, kept)) if kept else rows


def named(column: str, empty: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", empty).otherwise(F.col(column))


def normalised(usage: Column, field: str) -> Column:
    """A token count from a JSON report, whatever the provider calls it; 0 where there is none."""
    first = lambda keys: F.coalesce(*[F.nullif(F.get_json_object(usage, f"$.{k}").cast("long"), F.lit(0)) for k in keys], F.lit(0))
    prompt, completion = first(PROMPT_KEYS), first(COMPLETION_KEYS)
    total = F.coalesce(*[F.nullif(F.get_json_object(usage, f"$.{k}").cast("long"), F.lit(0)) for k in TOTAL_KEYS], prompt + completion)
    return {"prompt": prompt, "completion": completion, "total": total}[field]


def records(calls: DataFrame) -> DataFrame:
    """Token records of ``calls(id, model, usage)``: one per call that used any token."""
    rows = calls.select("id", named("model", "unknown").alias("model"), *[normalised(F.col("usage"), f).alias(f"{f}_tokens") for f in ("prompt", "completion", "total")])
    return rows.where("total_tokens > 0")


def token_report(usage: DataFrame) -> DataFrame:
    """Counts and sums over all calls, by model and by call type in one pass: (scope, name, calls, tokens)."""
    rows = usage.withColumn("call_type", named("call_type", "unknown")).withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    got = rows.groupingSets([[], [F.col("model")], [F.col("call_type")]], "model", "call_type").agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "model").otherwise("call_type")
    return got.select(scope.alias("scope"), F.coalesce("model", "call_type", F.lit("")).alias("name"), "calls", "tokens")


def requests_by_route(requests: DataFrame) -> DataFrame:
    """Count and average tokens (whole) and latency (one digit), rounded half to even, by route."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return requests.groupBy("route").agg(F.count("*").alias("requests"), F.bround(F.avg(tokens), 0).cast("long").alias("avg_tokens"), F.bround(F.avg("latency_ms"), 1).alias("avg_latency"))


def processing_by_document(log: DataFrame) -> DataFrame:
    return log.groupBy("doc").agg(F.count("*").alias("operations"), F.sum("tokens").alias("tokens"), F.round(F.sum("latency_ms"), 2).alias("latency"))


def request_counters(calls: DataFrame) -> DataFrame:
    """Counters of each request over ``calls(request_id, kind, tokens, ms)``; requests without a call of a model have none."""
    model, tool = F.col("kind") == "llm", F.col("kind") == "tool"
    per = calls.groupBy("request_id").agg(F.count_if(model).alias("llm_calls"), F.count_if(tool).alias("tool_calls"), F.coalesce(F.sum(F.when(model, F.col("tokens"))), F.lit(0)).alias("tokens"), F.round(F.sum("ms"), 2).alias("latency"))
    return per.where("llm_calls > 0")
