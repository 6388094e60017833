"""Retrieval metrics over ``qrels(qid, vec_id, grade)`` and ``run(qid, vec_id, rank)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group of relevant items.
SLICES = 64


def per_query(queries: DataFrame, qrels: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """recall, precision, ndcg, mrr and ap of every query; a query without a run or relevant items has 0."""
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "vec_id")))
    gold = ideal.groupBy("qid").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1))).alias("idcg"))
    return _measured(queries, gold, run.join(qrels, ["qid", "vec_id"]), k)


def per_query_of_groups(queries: DataFrame, items: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """As ``per_query`` where all ``items(vec_id, label, grade)`` with the label of one of ``queries(qid, label)`` are relevant, but for itself.

    Pairs of a query and a relevant item are not made: a group's size and its first ``k`` + 1 items tell what is best, a run's
    rows look up both labels. Ids are distinct.
    """
    known = items.where("label is not null")
    sizes = known.groupBy("label").agg(F.count("*").alias("size"))
    value = F.struct((-F.col("grade")).alias("g"), "vec_id")
    # the first of the slices' first: a group of any size passes through tasks in parts
    slices = known.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)))
    for part in (["label", "slice"], ["label"]):
        slices = slices.withColumn("i", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("grade"), "vec_id"))).where(F.col("i") <= k + 1)
    first = slices.groupBy("label").agg(F.sort_array(F.collect_list(value)).alias("first"))
    asked = queries.select("qid", "label").join(sizes.join(first, "label"), "label").join(items.select(F.col("vec_id").alias("qid"), F.col("label").alias("of")), "qid", "left")
    asked = asked.withColumn("n_rel", F.col("size") - F.when(F.col("of") == F.col("label"), 1).otherwise(0)).where("n_rel > 0")
    best = F.slice(F.filter("first", lambda x: x["vec_id"] != F.col("qid")), 1, k)
    gains = F.transform(best, lambda x, i: -x["g"] / F.log2(i + 2))
    gold = asked.select("qid", "n_rel", F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("idcg"))
    found = run.join(queries.select("qid", F.col("label").alias("wanted")), "qid").join(known, "vec_id").where("label = wanted and vec_id <> qid").drop("wanted", "label")
    return _measured(queries, gold, found, k)


def _measured(queries: DataFrame, gold: DataFrame, found: DataFrame, k: int) -> DataFrame:
    hits = found.withColumn("hits", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    top = F.col("rank") <= k
    got = hits.groupBy("qid").agg(F.count_if(top).alias("found"), F.sum(F.when(top, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"), F.min("rank").alias("first"), F.sum(F.col("hits") / F.col("rank")).alias("ap"))
    joined = queries.select("qid").join(gold, "qid", "left").join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("qid", zero(F.col("found") / F.col("n_rel")).alias("recall"), zero(F.col("found") / k).alias("precision"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("ap") / F.col("n_rel")).alias("ap"))


def report(each: DataFrame) -> DataFrame:
    """Means over all queries by ``strategy``."""
    return each.groupBy("strategy").agg(F.count("*").alias("num_queries"), *[F.round(F.avg(m), 4).alias(m) for m in ("recall", "precision", "ndcg", "mrr", "ap")])


def summary(queries: DataFrame, qrels: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """Means over all ``queries``, the number of those without a run, and NDCG over those that have grades."""
    each = per_query(queries, qrels, run, k).join(run.select("qid").distinct().withColumn("has_run", F.lit(True)), "qid", "left").join(qrels.select("qid").distinct().withColumn("has_grades", F.lit(True)), "qid", "left")
    means = [F.round(F.avg(m), 4).alias(m) for m in ("recall", "precision", "mrr", "ap")]
    return each.agg(F.count("*").alias("num_queries"), F.count_if(F.col("has_run").isNull()).alias("empty_results"), F.count("has_grades").alias("graded"), *means, F.round(F.avg(F.when(F.col("has_grades"), F.col("ndcg"))), 4).alias("ndcg"))
