"""Queries over the event log, read as usage, request and processing logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import usage
from docquarry.plans.registry import query, table
from docquarry.streaming import windows

K = "cast(get_json_object(props, '$.k') as bigint)"
KSQL = "CAST(props->>'$.k' AS BIGINT)"
USAGE = f"""usage AS (SELECT event_id AS id, ts AS timestamp, event_type AS model, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'qa' ELSE 'extractor' END AS call_type,
  {KSQL} AS prompt_tokens, event_id % 100 AS completion_tokens, value AS duration_ms, user_id FROM events)"""


def _usage(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "ts as timestamp", "event_type as model", "case event_id % 3 when 0 then '' when 1 then 'qa' else 'extractor' end as call_type", f"{K} as prompt_tokens", "event_id % 100 as completion_tokens", "value as duration_ms", "user_id")


@query(f"""WITH {USAGE}, named AS (SELECT *, prompt_tokens + completion_tokens AS tokens, CASE WHEN call_type = '' THEN 'unknown' ELSE call_type END AS kind FROM usage)
SELECT 'all' AS scope, '' AS name, count(*) AS calls, sum(tokens) AS tokens FROM named UNION ALL SELECT 'model', model, count(*), sum(tokens) FROM named GROUP BY model
UNION ALL SELECT 'call_type', kind, count(*), sum(tokens) FROM named GROUP BY kind""")
def token_report(spark, sf_dir):
    return usage.token_report(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT model, count(*) AS calls, count(DISTINCT user_id) AS users, sum(prompt_tokens) AS tokens FROM usage WHERE timestamp >= TIMESTAMP '2024-01-05' GROUP BY model HAVING count(*) > 10")
def token_stats_since(spark, sf_dir):
    rows = usage.since(_usage(spark, sf_dir), F.expr("timestamp_ntz '2024-01-05'"))
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.sum("prompt_tokens").alias("tokens")).where("calls > 10")


@query(f"WITH {USAGE} SELECT model AS route, count(*) AS requests, CAST(round_even(avg(prompt_tokens + completion_tokens), 0) AS BIGINT) AS avg_tokens, round_even(avg(duration_ms), 1) AS avg_latency FROM usage GROUP BY 1")
def request_by_route(spark, sf_dir):
    return usage.requests_by_route(_usage(spark, sf_dir).withColumnsRenamed({"model": "route", "duration_ms": "latency_ms"}))


@query(f"WITH {USAGE} SELECT 'doc' || user_id % 50 AS doc, count(*) AS operations, sum(prompt_tokens) AS tokens, round(sum(duration_ms), 2) AS latency FROM usage GROUP BY 1")
def processing_by_document(spark, sf_dir):
    return usage.processing_by_document(_usage(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("user_id") % 50).alias("doc"), F.col("prompt_tokens").alias("tokens"), F.col("duration_ms").alias("latency_ms")))


@query("SELECT user_id AS request_id, count(*) FILTER (event_type = 'view') AS llm_calls, count(*) FILTER (event_type = 'click') AS tool_calls, coalesce(sum(" + KSQL + ") FILTER (event_type = 'view'), 0) AS tokens, round(sum(value), 2) AS latency FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0")
def request_counters(spark, sf_dir):
    kind = F.expr("case event_type when 'view' then 'llm' when 'click' then 'tool' else '' end")
    return usage.request_counters(table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), kind.alias("kind"), F.expr(K).alias("tokens"), F.col("value").alias("ms")))


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS model, p AS prompt_tokens, c AS completion_tokens, CASE WHEN event_id % 3 = 1 AND k > 0 THEN 2 * k ELSE p + c END AS total_tokens
FROM (SELECT *, {KSQL} AS k, {KSQL} AS p, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 5 END AS c FROM events) WHERE CASE WHEN event_id % 3 = 1 AND k > 0 THEN 2 * k ELSE p + c END > 0""")
def usage_records(spark, sf_dir):
    """Reports in the three key styles of the providers."""
    k, c = F.expr(K), F.col("event_id") % 5
    report = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(k.alias("prompt_tokens"), c.alias("completion_tokens")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(k.alias("input_tokens"), c.alias("output_tokens"), (2 * k).alias("total_tokens")))).otherwise(F.to_json(F.struct(k.alias("prompt_token_count"))))
    return usage.records(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("model"), report.alias("usage")))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN '(none)' ELSE event_type END AS type, count(*) AS n FROM events GROUP BY 1")
def episode_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("type", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")))
    return rows.groupBy(usage.named("type", "(none)").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id = 7")
def episode_filter(spark, sf_dir):
    """Optional equalities; what is not asked for does not filter."""
    return usage.matching(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), event_type="click", user_id=7, event_id=None)


@query("""SELECT time_bucket(INTERVAL 30 MINUTES, ts) - o * INTERVAL 30 MINUTES AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS v(o) GROUP BY ALL""")
def sliding_events(spark, sf_dir):
    """Windows of an hour every half hour."""
    return windows.sliding(table(spark, sf_dir, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS finish, count(*) AS n FROM g GROUP BY user_id, s""")
def session_events(spark, sf_dir):
    got = windows.sessions(table(spark, sf_dir, "events"), "6 hours")
    return got.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("finish"), "n")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS purchases FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (user_id)")
def clicks_and_purchases(spark, sf_dir):
    count = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    return count("click", "clicks").join(count("purchase", "purchases"), "user_id", "full").select("user_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("purchases", F.lit(0)).alias("purchases"))


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def converted_users(spark, sf_dir):
    users = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id")
    return users("signup").intersect(users("purchase")).subtract(users("error"))


@query(f"SELECT coalesce(event_type, '') AS event_type, coalesce({KSQL} % 3, -1) AS bucket, count(*) AS n, grouping(event_type) AS g FROM events GROUP BY ROLLUP (event_type, {KSQL} % 3)")
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.expr(f"{K} % 3").alias("bucket"))
    return rows.rollup("event_type", "bucket").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g")).select(F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("bucket", F.lit(-1)).alias("bucket"), "n", "g")
