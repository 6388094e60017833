"""Question answering as plans: queries of a question, rounds of sub-questions, result texts. Models' answers are input columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import graph, strategies
from docquarry.operators.retrieval import top_k

#: Keywords of a sub-question, characters of a message and messages of a session that a solver reads.
KEYWORDS, MESSAGE_CHARS, MESSAGES = 8, 300, 10


def queries_of(questions: DataFrame) -> DataFrame:
    """(qid, n, text) of ``questions(qid, question, rewritten, decomposition)``: the decomposition, else the rewritten lines, else the question."""
    lines = T.query_lines(F.coalesce("rewritten", F.lit("")), F.col("question"))
    chosen = F.when(F.size(F.coalesce("decomposition", F.array().cast("array<string>"))) > 0, F.col("decomposition")).otherwise(lines)
    return questions.select("qid", F.posexplode(chosen).alias("n", "text"))


def moderate(questions: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all queries of each question that say something: (qid, n, content).

    ``search`` takes queries ``(qid, text)`` with ids of their own and gives ``(qid, content, error)``.
    """
    asked = queries_of(questions).withColumn("query", F.concat_ws("/", "qid", "n"))
    found = search(asked.select(F.col("query").alias("qid"), "text"))
    return strategies.valid_results(found).withColumnRenamed("qid", "query").join(asked.select("query", "qid", "n"), "query").select("qid", "n", "content")


def keywords(sub: DataFrame) -> DataFrame:
    """``sub(plan, id, question, keywords)`` with at most eight keywords, the question among them."""
    return sub.withColumn("keywords", F.slice(F.array_union("keywords", F.array("question")), 1, KEYWORDS))


def in_rounds(sub: DataFrame) -> DataFrame:
    """Sub-questions with the round in which all that they depend on is answered."""
    rounds = graph.topological_rounds(sub.select("plan", "id", "depends_on"))
    return sub.join(rounds, ["plan", "id"])


def plan_errors(items: Column, most: int = 10) -> Column:
    """What is wrong with the sub-questions of a plan, at most ten lines: ids under 1 or repeated, empty questions, more than eight of them."""
    ids = F.transform(items, lambda x: x["id"])
    one = F.transform(items, lambda x, i: F.when(x["id"] < 1, F.concat(F.lit("  - 字段 [sub_questions → "), i, F.lit(" → id]: < 1"))))
    two = F.transform(items, lambda x, i: F.when(T.strip(x["question"]) == "", F.concat(F.lit("  - 字段 [sub_questions → "), i, F.lit(" → question]: empty"))))
    all_ = F.when(F.size(items) > 8, "  - 字段 [sub_questions]: > 8")
    repeated = F.when(F.size(F.array_distinct(ids)) < F.size(ids), "  - 字段 [sub_questions]: repeated id")
    return F.slice(F.array_compact(F.concat(F.array(all_, repeated), one, two)), 1, most)


def seeds_text(seeds: Column, documents: Column) -> Column:
    """Numbered seed questions and the documents at hand, as a planner reads them."""
    numbered = F.array_join(F.transform(seeds, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat(numbered, F.lit("\n\n"), F.array_join(F.transform(documents, lambda d: F.concat(F.lit("- "), d)), "\n"))


def last_messages(messages: DataFrame, most: int = MESSAGES) -> DataFrame:
    """(conv_id, block): the last ten messages, 300 characters of each, as a solver reads them."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    line = F.concat(F.lit("- "), F.when(F.col("role") == "user", "学生").otherwise("答疑老师"), F.lit(": "), F.substring("text", 1, MESSAGE_CHARS))
    last = messages.withColumn("n", rank).where(F.col("n") <= most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("at"), line.alias("line")))).alias("x"))
    return last.select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("block"))


def result_lines(ranked: DataFrame) -> DataFrame:
    """(qid, text): results in order, each with its number and source."""
    line = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "source", F.lit(") "), F.substring("text", 1, 200)).alias("line"))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def metric_table(report: DataFrame, metrics: list[str]) -> DataFrame:
    """One line of text per strategy: its name in 12 characters and each metric with four digits."""
    form = "%-12s" + " %8.4f" * len(metrics)
    return report.select("strategy", F.format_string(form, "strategy", *metrics).alias("line"))


def with_neighbors(ids: DataFrame, concepts: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """``ids(id)`` with the names of the first five neighbours, by name and id."""
    found = graph.neighbors(concepts, relations, ids).select("id", "other", "other_name").distinct()
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("other_name", "other"))).where(F.col("n") <= most)
    names = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "other_name"))), lambda x: x["other_name"]).alias("neighbors"))
    return ids.join(names, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))


def in_hit_order(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Full rows of the hits ``(qid, key, score)``, with the place of each hit."""
    return top_k(hits, 1 << 30, key).join(rows, key)


def episode_text(rows: DataFrame) -> DataFrame:
    """``rows`` with ``search_text``: what an episode is found by, joined by spaces.

    Goal and every observation count even where blank; lesson (where it is blank, that of ``reflection``, a map), corrected
    behaviour and question pattern only if not empty; then the keywords. Null is as if absent; columns: goal, observations
    (array), lesson, reflection (map), corrected_behavior, question_pattern, keywords (array).
    """
    given = lambda c: F.when(c != "", c)
    lesson = F.coalesce(given(F.col("lesson")), given(F.try_element_at("reflection", F.lit("lesson"))))
    parts = [F.coalesce("goal", F.lit("")), "observations", lesson, given(F.col("corrected_behavior")), given(F.col("question_pattern")), "keywords"]
    return rows.withColumn("search_text", F.concat_ws(" ", *parts))


def resolve_name(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked(q)`` with the stored name that equals it, else the least one that contains it whatever the case; null if there is none.

    ``asked`` is a list of file names, far shorter than what is stored, and goes to every partition.
    """
    inside = names.join(F.broadcast(asked), F.lower("name").contains(F.lower("q"))).groupBy("q").agg(F.min(F.struct((F.col("name") != F.col("q")).alias("other"), "name")).alias("x"))
    return asked.join(inside, "q", "left").select("q", F.col("x.name").alias("name"))


def chosen_or_first(selected: DataFrame, parsed: DataFrame) -> DataFrame:
    """``selected(doc, title)`` with the text of the parsed chapter of that title, else of the first: (doc, title, text)."""
    first = parsed.groupBy("doc").agg(F.min_by("text", "pos").alias("first_text"))
    same = parsed.groupBy("doc", "title").agg(F.min_by("text", "pos").alias("text"))
    return selected.join(same, ["doc", "title"], "left").join(first, "doc", "left").select("doc", "title", F.coalesce("text", "first_text").alias("text"))
