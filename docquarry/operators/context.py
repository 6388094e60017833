"""Context assembly over fragments ``(qid, ord, source, content, priority, age_hours)``: score, select, arrange, compress.

A request holds a bounded number of fragments, so each is one row of arrays after selection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Boosts by source, the section of each source, sections in order.
BOOST = {"user_question": 0.3, "system_policy": 0.2, "conversation": 0.1, "episodic": 0.05}
SECTION = {
    "system_policy": "role_policies",
    "tool": "role_policies",
    "user_question": "task",
    "review_target": "task",
    "conversation": "context",
    "search_result": "evidence",
    "kg_concept": "evidence",
    "episodic": "state",
}
SECTIONS = ("role_policies", "task", "state", "evidence", "context", "output_format")
EMPTY = "（无）"
#: Sections in the order in which they are compressed, and their limits in characters.
COMPRESSED = ("context", "evidence", "state", "task", "role_policies")
LIMITS = {"context": 800, "evidence": 1500, "state": 600, "task": 600, "role_policies": 400, "output_format": 200}
HARD_CHARS = 150


def gather(sources: dict[str, DataFrame]) -> DataFrame:
    """The fragments of all sources, each ``(qid, content, priority, age_hours)``, numbered by ``ord`` within its source."""
    parts = [d.withColumn("source", F.lit(name)).withColumn("place", F.lit(i)) for i, (name, d) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, parts)


def scored(fragments: DataFrame, question: Column, least: float = 0.10) -> DataFrame:
    """With relevance, recency and total; those under ``least`` go."""
    boost = F.lit(0.0)
    for name, b in BOOST.items():
        boost = F.when(F.col("source") == name, b).otherwise(boost)
    chars = F.array_distinct(F.split(question, ""))
    both = F.size(F.array_intersect(chars, F.split(F.substring("content", 1, 500), "")))
    relevance = F.when(question == "", 0.5).otherwise(F.least(F.lit(1.0), both / F.size(chars) + boost))
    rows = fragments.withColumn("relevance", relevance).withColumn("recency", T.recency(F.col("age_hours")))
    return rows.withColumn("total", 0.6 * F.col("relevance") + 0.4 * F.col("recency") + 0.05 * F.col("priority")).where(F.round("total", 9) >= least)


def select(rows: DataFrame, budget: int = 3000) -> DataFrame:
    """(qid, selected): by falling total, each fragment that still fits into the budget of tokens; one that does not is skipped."""
    one = F.struct((-F.round("total", 9)).alias("key"), "ord", "source", "content", T.token_estimate(F.col("content")).alias("tokens"))
    item = "struct<key:double,ord:bigint,source:string,content:string,tokens:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("taken"))
    fits = lambda a, x: a["used"] + x["tokens"] <= budget
    step = lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["tokens"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.array_append(a["taken"], x)).otherwise(a["taken"]).alias("taken"))
    ordered = rows.withColumn("ord", F.col("ord").cast("long")).groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return ordered.select("qid", F.aggregate("all", start, step, lambda a: a["taken"]).alias("selected"))


def arrange(selected: DataFrame) -> DataFrame:
    """(qid, one column for each section, tokens): contents of a section in order, between blank lines; an empty one says so."""
    section = F.lit("context")
    for source, name in SECTION.items():
        section = F.when(F.col("x.source") == source, name).otherwise(section)

    def of(name: str) -> Column:
        def named(x: Column) -> Column:
            where = F.lit("context")
            for source, to in SECTION.items():
                where = F.when(x["source"] == source, to).otherwise(where)
            return where == name

        mine = F.filter("selected", named)
        filled = F.filter(F.transform(mine, lambda x: T.strip(x["content"])), lambda t: t != "")
        return F.when(F.size(mine) == 0, EMPTY).otherwise(F.array_join(filled, "\n\n"))

    rows = selected.select("qid", *[of(s).alias(s) for s in SECTIONS])
    return rows.withColumn("tokens", sum(F.floor(F.length(s) / 2) for s in SECTIONS).cast("long"))


def truncated(text: Column, most: Column | int) -> Column:
    """The first ``most`` characters, up to the last line break if it stands in their second half, and a mark."""
    most = F.lit(most) if isinstance(most, int) else most
    head = T.left(text, most)
    line = F.length(head) - F.instr(F.reverse(head), "\n")  # place of the last line break from 0; the length without one
    cut = F.when((F.instr(head, "\n") > 0) & (line > F.floor(most / 2)), T.left(head, line)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("\n...（截断）")))


#: Fixed words that make a sentence worth keeping.
KEY_WORDS = ("问题", "关键", "重要", "核心", "定义", "定理", "结论", "教训", "反馈", "缺失", "建议", "必须", "不能")


def summarised(text: Column) -> Column:
    """The first sentence of each paragraph and those with a key word, ten at most."""
    sentences = F.transform(F.split(text, "\n\n"), lambda p: F.filter(F.transform(F.split(p, r"[。！？.!?]"), T.strip), lambda s: s != ""))
    keyed = lambda s: reduce(lambda a, b: a | b, [s.contains(k) for k in KEY_WORDS])
    kept = F.flatten(F.transform(sentences, lambda p: F.filter(p, lambda s, i: (i == 0) | keyed(s))))
    joined = F.array_join(F.transform(F.slice(kept, 1, 10), lambda s: F.concat(s, F.lit("。"))), "；")
    return F.concat(F.when(joined == "", F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(joined), F.lit("\n（摘要）"))


def compress(prompts: DataFrame, hard_limit: int = 4000) -> DataFrame:
    """Sections of ``prompts`` cut, then summarised, then cut hard, one after the other until all together have ``2 * hard_limit`` characters.

    The steps are a fold over the section array; ``compressed`` tells whether any was needed.
    """
    limit = 2 * hard_limit
    steps = [(phase, SECTIONS.index(s), LIMITS[s]) for phase in (1, 2, 3) for s in COMPRESSED]
    step_array = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(i).alias("at"), F.lit(n).alias("limit")) for p, i, n in steps])
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))

    def merge(state: Column, step: Column) -> Column:
        def change(s: Column) -> Column:
            summary = F.when(F.length(s) > F.floor(step["limit"] / 2), summarised(s)).otherwise(s)
            return F.when(step["phase"] == 1, truncated(s, step["limit"])).when(step["phase"] == 2, summary).otherwise(truncated(s, HARD_CHARS))

        return F.when(total(state) <= limit, state).otherwise(F.transform(state, lambda s, i: F.when(i == step["at"], change(s)).otherwise(s)))

    rows = prompts.withColumn("all", F.array(*SECTIONS)).withColumn("before", total(F.col("all")))
    done = rows.withColumn("all", F.aggregate(step_array, F.col("all"), merge))
    return done.select("qid", *[F.col("all")[i].alias(s) for i, s in enumerate(SECTIONS)], (F.col("before") > limit).alias("compressed"))


def assemble(fragments: DataFrame, question: Column, budget: int = 3000, hard_limit: int = 4000) -> DataFrame:
    """Score, select, arrange and compress."""
    return compress(arrange(select(scored(fragments, question), budget)), hard_limit)


def prompt() -> Column:
    """The sections under their fixed headings."""
    heads = ("Role & Policies", "Task", "State", "Evidence", "Context", "Output Format")
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"## {h}\n"), F.col(s)) for h, s in zip(heads, SECTIONS, strict=True)])


def observations(results: DataFrame) -> DataFrame:
    """(qid, observations, evidence, citations) of ``results(qid, sub_id, question, pos, tool, content, doc)``, blank contents left out.

    Evidence: at most ten first lines; citations: at most ten documents in order of appearance. A request has a bounded number of results.
    """
    kept = results.where(T.strip(F.col("content")) != "")
    line = F.substring(F.split(T.strip(F.col("content")), "\n")[0], 1, 200)
    one = F.struct("sub_id", "pos", "question", "tool", F.substring("content", 1, 600).alias("content"), line.alias("line"), "doc")
    rows = kept.groupBy("qid", "sub_id").agg(F.array_sort(F.collect_list(one)).alias("x"), F.first("question").alias("question"))
    per = rows.select("qid", "sub_id", "x", F.concat(F.lit("\n### 子问题 "), F.col("sub_id"), F.lit(": "), F.col("question"), F.lit("\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["tool"], F.lit("] "), r["content"])), "\n")).alias("text"))
    whole = per.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("sub_id", "x", "text"))).alias("p"))
    lines = F.flatten(F.transform("p", lambda p: F.transform(p["x"], lambda r: r["line"])))
    docs = F.flatten(F.transform("p", lambda p: F.transform(p["x"], lambda r: r["doc"])))
    evidence = F.slice(F.filter(lines, lambda s: (s != "") & ~s.contains("未找到")), 1, 10)
    return whole.select("qid", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("observations"), evidence.alias("evidence"), F.slice(F.array_distinct(F.filter(docs, lambda d: d != "")), 1, 10).alias("citations"))


def accumulated(old: Column, new: Column, keep: int = 3000, most: int = 6000) -> Column:
    """The last ``keep`` characters of the old observations, then the new ones, ``most`` in all."""
    return F.substring(F.concat(F.right(old, F.lit(keep)), new), 1, most)


def result_summary(contents: Column, each: int = 250, most: int = 500) -> Column:
    return F.substring(F.array_join(F.transform(contents, lambda c: F.substring(c, 1, each)), "\n"), 1, most)


def recalled(history: DataFrame, episodes: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """(qid, history, episodes, documents): what a request remembers; ``episodes(qid, rank, goal)`` up to rank ``k``."""
    first = episodes.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "goal"))), lambda x: x["goal"]).alias("episodes"))
    names = documents.agg(F.array_sort(F.collect_set("doc")).alias("documents"))
    return history.join(first, "qid", "left").crossJoin(F.broadcast(names)).select("qid", "history", F.coalesce("episodes", F.array().cast("array<string>")).alias("episodes"), "documents")
