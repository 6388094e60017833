"""History contexts of sessions over ``messages(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(value: Column) -> Column:
    """The ``value`` of each row of a group, by descending rank ``n``."""
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("at"), value.alias("value")))), lambda x: x["value"])


def build_context(messages: DataFrame) -> DataFrame:
    """(conv_id, total, history): up to 6 messages all of them with 300 characters, up to 12 the last 10 with 200, beyond
    that a summary of the older ones and the last 8 with 200; histories over 4,000 characters are cut there.

    The summary names the last five user messages before the last 8. No session collects more than 10 and 13 messages.
    """
    text = F.coalesce("text", F.lit(""))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    total = messages.groupBy("conv_id").agg(F.count("*").alias("total"))
    line = F.struct((F.col("role") == "user").alias("asks"), text.alias("text"))
    last = messages.withColumn("n", rank).where("n <= 10").groupBy("conv_id").agg(_in_order(line).alias("last"))
    # of the last 13 user messages 8 at most are among the last 8 messages
    asked = messages.where("role = 'user'").withColumn("n", rank).where("n <= 13").groupBy("conv_id").agg(_in_order(F.substring(text, 1, 60)).alias("asked"))
    rows = total.join(last, "conv_id").join(asked, "conv_id", "left")
    chars = F.when(F.col("total") <= 6, 300).otherwise(200)
    recent = F.when(F.col("total") <= 12, F.col("last")).otherwise(F.slice("last", -8, 8))
    lines = F.array_join(F.transform(recent, lambda x: F.concat(F.lit("- "), F.when(x["asks"], "学生").otherwise("答疑老师"), F.lit(": "), x["text"].substr(F.lit(1), chars))), "\n")
    older = F.expr("slice(asked, 1, size(asked) - size(filter(slice(last, -8, 8), x -> x.asks)))")
    five = F.reverse(F.slice(F.reverse(older), 1, 5))
    summary = F.when(F.coalesce(F.size(older), F.lit(0)) > 0, F.concat(F.lit("之前讨论过："), F.array_join(five, "；"))).otherwise("（之前的对话）")
    n = F.col("total").cast("string")
    history = (
        F.when(F.col("total") <= 6, F.concat(F.lit("【对话历史】\n"), lines))
        .when(F.col("total") <= 12, F.concat(F.lit("【对话历史（最近 10 轮，共 "), n, F.lit(" 轮）】\n"), lines))
        .otherwise(F.concat(F.lit("【对话历史（共 "), n, F.lit(" 轮，早期已摘要）】\n【历史摘要】"), summary, F.lit("\n"), lines))
    )
    cut = F.when(F.length("history") > 4000, F.concat(F.substring("history", 1, 4000), F.lit("\n...（历史已截断）"))).otherwise(F.col("history"))
    return rows.select("conv_id", "total", history.alias("history")).withColumn("history", cut)
