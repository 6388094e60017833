"""Retrieval strategies over ranked lists ``(qid, doc_id, text, source, rank)``, ranks from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import contains
from docquarry.operators.retrieval import bm25, dense, jaccard, top_k
from docquarry.registry import strategy

#: Fixed values of the reference: fusion constant, weights where a query has none, characters that a reranker reads.
RRF_K = 60
DEFAULT_WEIGHTS = {"dense": 0.5, "sparse": 0.3, "graph": 0.2}
RERANK_CHARS = 500
#: Fixed markers of results without content.
EMPTY_MARKERS = ("未找到相关内容", "未初始化")


def fuse_texts(lists: DataFrame, k: int, order: list[str], weight: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of items with the same first 200 characters; the first seen (by list, then rank) gives the columns.

    ``sources`` are in the order in which the item was seen, at most one for each list.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    seen = F.struct(place.alias("place"), F.col("rank"), F.col("doc_id"), F.col("source"))
    part = (F.lit(1.0) if weight is None else weight) / (RRF_K + F.col("rank"))
    grouped = lists.groupBy("qid", T.fusion_key(F.col("text")).alias("key")).agg(F.sum(part).alias("score"), F.min(seen).alias("first"), F.array_sort(F.collect_set(F.struct(place.alias("place"), "source"))).alias("seen"))
    named = grouped.select("qid", F.col("first.doc_id").alias("doc_id"), "score", F.array_join(F.transform("seen", lambda x: x["source"]), ",").alias("sources"))
    return top_k(named, k)


def weighted(lists: DataFrame, weights: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Fusion with weights of each query, ``weights(qid, dense, sparse, graph)``; from a dense weight of 0.6 on the dense list alone counts.

    A query without weights has the defaults; a source without one counts 1.
    """
    rows = lists.join(weights, "qid", "left")
    value = {s: F.coalesce(F.col(s), F.lit(w)) for s, w in DEFAULT_WEIGHTS.items()}
    rows = rows.where((value["dense"] < 0.6) | (F.col("source") == "dense"))
    weight = F.lit(1.0)
    for s, v in value.items():
        weight = F.when(F.col("source") == s, v).otherwise(weight)
    return fuse_texts(rows, k, order, weight)


def merged(lists: DataFrame, order: list[str]) -> DataFrame:
    """All items once, from the first list in ``order`` that has them; ranked by list, then rank."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    one = lists.groupBy("qid", "doc_id").agg(F.min(F.struct(place.alias("place"), "rank", "source", "text")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("x.place", "x.rank", "doc_id"))
    return one.select("qid", "doc_id", "x.text", "x.source", rank.alias("rank"))


def overlap(question: Column, text: Column) -> Column:
    """A plain stand-in for a cross-encoder: the share of the question's tokens that stand in the text."""
    q = T.token_set(question)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.token_set(text))) / F.size(q))


def rerank(candidates: DataFrame, questions: DataFrame, k: int, scorer=overlap) -> DataFrame:
    """The ``k`` candidates with the highest ``scorer(question, text)``, which reads 500 characters; up to ``k`` keep their order.

    ``scorer`` makes a column of two columns: an expression, or a pandas UDF around a model.
    """
    rows = candidates.join(questions.select("qid", F.col("text").alias("question")), "qid")
    scored = rows.withColumn("ce", F.round(scorer(F.col("question"), F.substring("text", 1, RERANK_CHARS)), 6)).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    first = F.when(F.col("n") <= k, F.lit(0.0)).otherwise(-F.col("ce"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(first, "rank", "doc_id"))
    return scored.withColumn("new", rank).where(F.col("new") <= k).select("qid", "doc_id", "source", F.col("ce").alias("score"), F.col("new").alias("rank"))


def escalated(questions: DataFrame, unsatisfied: DataFrame) -> DataFrame:
    """``questions(qid, text)`` that equal, contain, or are contained in a question that got no good answer before.

    Both sides may be of any size: they meet by the rarest three characters of each (``contains``).
    """
    norm = F.lower(T.strip(F.col("text")))
    old = unsatisfied.select(norm.alias("term")).where("term <> ''").distinct().withColumn("term_id", F.xxhash64("term"))
    hits = contains.either_way(questions.select(F.col("qid").alias("id"), norm.alias("text")), old).select(F.col("id").alias("qid")).distinct()
    blank = questions.where(norm == "").select("qid").crossJoin(F.broadcast(old.limit(1).select("term_id"))).select("qid")  # an empty one is contained in all
    return questions.join(hits.unionByName(blank), "qid", "left_semi").select(*questions.columns)


def valid_results(results: DataFrame) -> DataFrame:
    """``results(content, error)`` that are no errors, not blank, and do not say that nothing was found."""
    keep = (F.coalesce("error", F.lit("")) == "") & (T.strip(F.col("content")) != "")
    for marker in EMPTY_MARKERS:
        keep &= ~F.col("content").contains(marker)
    return results.where(keep)


def normalise_runs(runs: DataFrame) -> DataFrame:
    """Ids without their ``_vN`` ending; of several the first stays, and the ranks are counted again."""
    rows = runs.withColumn("doc_id", F.regexp_replace("doc_id", r"_v\d+$", "")).groupBy("qid", "doc_id").agg(F.min("rank").alias("old"))
    return rows.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("old", "doc_id")).alias("rank"))


def pivoted(report: DataFrame, metrics: list[str], strategies: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """One row per metric: its value for each strategy, and the first strategy that has the best."""
    long = report.unpivot("strategy", metrics, "metric", "value").groupBy("metric").pivot("strategy", strategies).agg(F.first("value"))
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0)
    best, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for s in strategies:
        better = F.coalesce(sign * F.col(s) > best, F.col(s).isNotNull())
        best, name = F.when(better, sign * F.col(s)).otherwise(best), F.when(better, s).otherwise(name)
    return long.withColumn("best", name)


def wins(judged: DataFrame) -> DataFrame:
    """Wins of either side and ties of ``judged(winner, score_a, score_b)``, with mean scores."""
    return judged.agg(F.count_if(F.col("winner") == "A").alias("wins_a"), F.count_if(F.col("winner") == "B").alias("wins_b"), F.count_if(~F.col("winner").isin("A", "B")).alias("ties"), F.round(F.avg("score_a"), 4).alias("mean_a"), F.round(F.avg("score_b"), 4).alias("mean_b"))


def cached_answer(asked: DataFrame, entries: DataFrame, t: float = 0.85) -> DataFrame:
    """Of ``asked(qid, vec_id, score)`` candidates the nearest entry at ``t`` or more: (qid, vec_id, score)."""
    near = asked.where(F.col("score") >= t).join(entries, "vec_id", "left_semi")
    return top_k(near, 1, "vec_id").drop("rank")


@strategy("sparse")
def sparse(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return bm25(corpus, queries, k)


@strategy("overlap")
def token_overlap(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return jaccard(corpus, queries, k)


@strategy("dense")
def nearest(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """By position: the score of an item is that of a fusion list."""
    ranked = dense(corpus.select(F.col("doc_id").alias("vec_id"), "embedding"), queries, k).withColumnRenamed("vec_id", "doc_id")
    return ranked.withColumn("score", 1.0 / (RRF_K + F.col("rank")))


@strategy("hybrid")
def hybrid(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Twice as many dense and sparse items as asked for, fused by text."""
    lists = nearest(corpus, queries, 2 * k).withColumn("source", F.lit("dense")).select("qid", "doc_id", "source", "rank")
    lists = lists.unionByName(bm25(corpus, queries, 2 * k).withColumn("source", F.lit("sparse")).select("qid", "doc_id", "source", "rank"))
    return fuse_texts(lists.join(corpus.select("doc_id", "text"), "doc_id"), k, ["dense", "sparse"])


@strategy("supplement")
def supplement(corpus: DataFrame, queries: DataFrame, k: int, scorer=overlap) -> DataFrame:
    """20 dense items, 10 sparse ones that are not among them, reranked."""
    lists = nearest(corpus, queries, 20).withColumn("source", F.lit("dense")).select("qid", "doc_id", "source", "rank")
    lists = lists.unionByName(bm25(corpus, queries, 10).withColumn("source", F.lit("sparse")).select("qid", "doc_id", "source", "rank"))
    return rerank(merged(lists.join(corpus.select("doc_id", "text"), "doc_id"), ["dense", "sparse"]), queries, k, scorer)
