"""Queries of context assembly, chapters and the scalar rules around plans and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import chapters, context
from docquarry.plans.registry import query, table

ASK = "What does the study of markets show?"
FRAGMENTS = "fr AS (SELECT conv_id AS qid, turn AS ord, CASE role WHEN 'system' THEN 'system_policy' WHEN 'user' THEN 'conversation' ELSE 'search_result' END AS source, text AS content, turn % 3 AS priority, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn * 5.0 - 6 END AS age FROM conversations)"
SCORED = f"""{FRAGMENTS}, sc AS (SELECT *, least(1.0, len(list_intersect(list_distinct(string_split('{ASK}', '')), string_split(left(content, 500), ''))) / len(list_distinct(string_split('{ASK}', ''))) + CASE source WHEN 'system_policy' THEN 0.2 WHEN 'conversation' THEN 0.1 ELSE 0 END) AS relevance,
  CASE WHEN age IS NULL THEN 0.5 WHEN age < 0 THEN 1.0 ELSE greatest(0.1, pow(2, -age / 12)) END AS recency FROM fr),
tt AS (SELECT *, round(0.6 * relevance + 0.4 * recency + 0.05 * priority, 9) AS total FROM sc)"""
CHOSEN = f"""{SCORED}, al AS (SELECT qid, list({{'total': total, 'ord': ord, 'source': source, 'content': content, 'tokens': greatest(1, len(content) // 2)}} ORDER BY total DESC, ord) AS l FROM tt WHERE total >= 0.1 GROUP BY qid),
ch AS (SELECT qid, list_reduce(list_transform(l, lambda e: {{'used': e.tokens, 'taken': [e]}}), lambda a, x: CASE WHEN a.used + x.used <= 300 THEN {{'used': a.used + x.used, 'taken': list_concat(a.taken, x.taken)}} ELSE a END, {{'used': 0::BIGINT, 'taken': list_filter([l[1]], lambda e: false)}}) AS r, l FROM al)"""


def _fragments(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    source = F.when(F.col("role") == "system", "system_policy").when(F.col("role") == "user", "conversation").otherwise("search_result")
    age = F.when(F.col("turn") % 4 == 0, None).otherwise(F.col("turn") * 5.0 - 6)
    return rows.select(F.col("conv_id").alias("qid"), F.col("turn").alias("ord"), source.alias("source"), F.col("text").alias("content"), (F.col("turn") % 3).alias("priority"), age.alias("age_hours"))


def _chosen(spark, sf_dir):
    return context.select(context.scored(_fragments(spark, sf_dir), F.lit(ASK)), 300)


@query(f"WITH {SCORED} SELECT qid, ord, round(relevance, 6) AS relevance, round(recency, 6) AS recency, round(total, 6) AS total FROM tt WHERE total >= 0.1")
def context_scores(spark, sf_dir):
    return context.scored(_fragments(spark, sf_dir), F.lit(ASK)).select("qid", "ord", *[F.round(c, 6).alias(c) for c in ("relevance", "recency", "total")])


@query(f"WITH {CHOSEN} SELECT qid, unnest(r.taken).ord AS ord, generate_subscripts(r.taken, 1) AS place FROM ch")
def context_select(spark, sf_dir):
    """Fragments in order of their score that still fit into 300 tokens."""
    return _chosen(spark, sf_dir).select("qid", F.posexplode("selected").alias("place", "x")).select("qid", "x.ord", (F.col("place") + 1).alias("place"))


PARTS = "coalesce(nullif(list_aggregate(list_transform(list_filter(r.taken, lambda e: e.source = '{s}'), lambda e: trim(e.content)), 'string_agg', chr(10) || chr(10)), ''), '（无）')"


@query(f"""WITH {CHOSEN}, a AS (SELECT qid, {PARTS.format(s='system_policy')} AS role_policies, '（无）' AS task, '（无）' AS state, {PARTS.format(s='search_result')} AS evidence, {PARTS.format(s='conversation')} AS context, '（无）' AS output_format FROM ch)
SELECT *, len(role_policies) // 2 + len(task) // 2 + len(state) // 2 + len(evidence) // 2 + len(context) // 2 + len(output_format) // 2 AS tokens FROM a""")
def context_structure(spark, sf_dir):
    return context.arrange(_chosen(spark, sf_dir))


@query()
def context_assembly(spark, sf_dir):
    """From fragments to the prompt, compressed to 200 characters or as near as the rules go."""
    made = context.assemble(_fragments(spark, sf_dir), F.lit(ASK), 300, 100)
    return made.select("qid", "compressed", context.prompt().alias("prompt"))


@query("""WITH r AS (SELECT conv_id AS qid, turn // 3 AS sub, turn % 3 AS pos, text, CASE WHEN turn % 2 = 0 THEN '' ELSE role END AS doc FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''),
l AS (SELECT qid, list(left(split_part(trim(text, ' ' || chr(10) || chr(9)), chr(10), 1), 200) ORDER BY sub, pos)[1:10] AS ev FROM r GROUP BY qid),
d AS (SELECT qid, string_agg(doc, '|' ORDER BY f) AS cited FROM (SELECT qid, doc, min(sub * 1000 + pos) AS f FROM r WHERE doc <> '' GROUP BY ALL) GROUP BY qid)
SELECT l.qid, array_to_string(ev, '|') AS evidence, coalesce(cited, '') AS citations FROM l LEFT JOIN d USING (qid)""")
def result_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id as qid", "cast(turn div 3 as long) as sub_id", "concat('q', turn div 3) as question", "turn % 3 as pos", "'search' as tool", "text as content", "if(turn % 2 = 0, '', role) as doc")
    return context.observations(rows).select("qid", F.array_join("evidence", "|").alias("evidence"), F.array_join("citations", "|").alias("citations"))


@query("""WITH e AS (SELECT conv_id AS qid, string_agg(text, '|' ORDER BY turn, role, text) AS episodes FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 3) GROUP BY 1)
SELECT qid, qid || ' messages' AS history, episodes, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM documents) AS documents FROM e""")
def memory_recall(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    episodes = c.selectExpr("conv_id as qid", "row_number() over (partition by conv_id order by turn, role, text) as rank", "text as goal")
    got = context.recalled(c.selectExpr("conv_id as qid", "concat(conv_id, ' messages') as history").distinct(), episodes, table(spark, sf_dir, "documents").selectExpr("source as doc"))
    return got.select("qid", "history", F.array_join("episodes", "|").alias("episodes"), F.array_join("documents", ",").alias("documents"))


@query("SELECT doc_id, substr(coalesce(right(left(text, 5000), 3000), '') || left(text, 4000), 1, 6000) AS observed, left(left(text, 250) || chr(10) || left(source, 250) || chr(10) || left(text, 250), 500) AS summary FROM documents")
def observation_fold(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", context.accumulated(F.substring(t, 1, 5000), F.substring(t, 1, 4000)).alias("observed"), context.result_summary(F.array(t, F.col("source"), t)).alias("summary"))


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN len({text}) <= {n} THEN {text} ELSE CASE WHEN contains(left({text}, {n}), chr(10)) AND len(regexp_extract(left({text}, {n}), '(?s)^(.*)\n', 1)) > {n} // 2 THEN regexp_extract(left({text}, {n}), '(?s)^(.*)\n', 1) ELSE left({text}, {n}) END || chr(10) || '...（截断）' END"


@query(f"SELECT doc_id, {_cut('text', 700)} AS cut FROM documents")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.truncated(F.col("text"), 700).alias("cut"))


CN = "CASE WHEN n < 10 THEN substr('一二三四五六七八九', n, 1) ELSE CASE WHEN n < 20 THEN '' ELSE substr('一二三四五六七八九', n // 10, 1) END || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', n % 10, 1) END END"


@query("SELECT p_partkey AS id, p_partkey % 99 + 1 AS number, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE '_Ch' || (p_partkey % 99 + 1) END AS slug FROM part")
def chapter_slugs(spark, sf_dir):
    """Numbers written as Chinese numerals, digits, in English, and not at all."""
    digit = lambda n: F.substring(F.lit("一二三四五六七八九"), n.cast("int"), F.lit(1))
    n = F.col("p_partkey") % 99 + 1
    tens, unit = F.floor(n / 10), n % 10
    words = F.when(n < 10, digit(n)).otherwise(F.concat(F.when(n < 20, "").otherwise(digit(tens)), F.lit("十"), F.when(unit == 0, "").otherwise(digit(unit))))
    kind = F.col("p_partkey") % 4
    title = F.when(kind == 0, F.concat(F.lit("第"), words, F.lit("章 绪论"))).when(kind == 1, F.concat(F.lit("第 "), n, F.lit(" 篇"))).when(kind == 2, F.concat(F.lit("chapter "), n, F.lit(" Start"))).otherwise("Preface")
    number = F.when(kind == 0, T.numeral(words)).otherwise(T.numeral(n.cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), number.alias("number"), T.chapter_slug(title).alias("slug"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '第' || p_partkey || '章：' || p_name WHEN 1 THEN 'Chapter ' || p_partkey || ': ' || p_name ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN '第' || p_partkey || '章 ' || p_name ELSE p_name END AS collapsed FROM part")
def normal_titles(spark, sf_dir):
    """Headings with marks, odd spaces and trailing dots, and what they are without."""
    kind, key, name = F.col("p_partkey") % 3, F.col("p_partkey"), F.col("p_name")
    raw = F.when(kind == 0, F.concat(F.lit("## 第"), key, F.lit("篇  "), name, F.lit(" ..."))).when(kind == 1, F.concat(F.lit("Chapter "), key, F.lit("\t"), name, F.lit("：—"))).otherwise(F.concat(F.lit("\n# "), name, F.lit("。")))
    loose = F.when(kind == 0, F.concat(F.lit("第"), key, F.lit("章：： "), name)).otherwise(F.concat(F.lit(" "), name, F.lit("\n")))
    return table(spark, sf_dir, "part").select(key.alias("id"), T.normal_title(raw).alias("title"), T.collapse_space(loose).alias("collapsed"))


@query("SELECT p_brand AS doc, count(*) >= 2 AND sum((p_size % 10 = 0)::INT) = 0 AND avg((p_partkey % 12 <> 5)::INT) >= 0.8 AS passed FROM part GROUP BY 1")
def chapter_review(spark, sf_dir):
    """Documents (brands) whose chapter titles look right: no figure captions, nine of ten numbered."""
    title = F.when(F.col("p_size") % 10 == 0, "图 3 结构").when(F.col("p_partkey") % 12 == 5, F.concat(F.lit("Xy "), "p_name")).otherwise(F.concat(F.lit("第"), F.col("p_partkey"), F.lit("章 "), "p_name"))
    return chapters.plausible(table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), title.alias("title")))


@query("SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey FROM lineitem WHERE NOT (l_linenumber % 2 = 0 AND l_returnflag = 'R')")
def reviewed_chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_returnflag")
    review = rows.where("pos % 2 = 0").select("doc", "pos", (F.col("l_returnflag") != "R").alias("valid"))
    # positions repeat in an order; each line's own review counts
    keyed = rows.withColumn("doc", F.struct("doc", "l_returnflag"))
    return chapters.valid_only(keyed, review.join(rows, ["doc", "pos"]).where((F.col("l_returnflag") != "R") == F.col("valid")).select(F.struct("doc", "l_returnflag").alias("doc"), "pos", "valid")).select("doc.doc", "pos", "l_partkey")


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AS imported FROM part")
def imported_chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("第"), "p_partkey", F.lit("章： "), "p_name").alias("title"))
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("第"), "p_partkey", F.lit("章:"), "p_name").alias("title"))
    return chapters.imported(rows, known).select("id", "imported")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS file, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN 'web_search' ELSE 'rag_search' END AS tool, CASE p_size % 4 WHEN 0 THEN 'planner.plan' WHEN 1 THEN 'rewriter' WHEN 2 THEN 'planner.solve' ELSE '' END AS stage FROM part")
def label_parse(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("["), "p_brand", F.lit("]  "), "p_name"))
    kind = F.element_at(F.array(*map(F.lit, ("plan", "knowledge", "reasoning", "other"))), F.col("p_size") % 4 + 1)
    tool = T.allowed_tool(F.when(F.col("p_size") % 2 == 0, "web_search").otherwise("unheard_of"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), chapters.label_parts(label).alias("x"), tool.alias("tool"), T.failure_stage(kind).alias("stage")).select("id", "x.*", "tool", "stage")


@query("""WITH l AS (SELECT l_orderkey AS doc, 'part' || l_partkey || '.' || l_linenumber AS title, l_linenumber * 10 AS page FROM lineitem),
r AS (SELECT doc, title, page + 5 - min(page) OVER (PARTITION BY doc) AS start, lead(page) OVER (PARTITION BY doc ORDER BY page, title) + 5 - min(page) OVER (PARTITION BY doc) - 1 AS next FROM l)
SELECT doc, title, start, greatest(start, coalesce(next, 90)) AS "end" FROM r""")
def toc_ranges(spark, sf_dir):
    """Contents of each document (order): one line for each entry, the body beginning on page 5."""
    line = F.concat(F.lit("part"), "l_partkey", F.lit("."), "l_linenumber", F.lit(" | "), F.col("l_linenumber") * 10)
    order = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("part"), "l_partkey", F.lit("."), "l_linenumber").alias("t"), line.alias("line"))
    contents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.concat(F.lit("BODY_START: 5\n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n")).alias("contents"))
    return chapters.page_ranges(chapters.contents_lines(contents), contents.select("doc", F.lit(90).alias("pages")))


@query("""WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS "at", CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS level, 't' || l_partkey % 5 AS title, l_linenumber AS page FROM lineitem WHERE l_linenumber <= 4),
k AS (SELECT * FROM e WHERE level = 1 OR doc NOT IN (SELECT doc FROM e WHERE level = 1))
SELECT doc, title, min(k.at) AS "at" FROM k GROUP BY doc, title""")
def outline_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as at", "if(l_returnflag = 'R', 1, 2) as level", "concat('t', l_partkey % 5) as title", "l_linenumber as page")
    return chapters.outline(rows, 4).select("doc", "title", "at")


@query("SELECT doc_id, 0 AS place, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE -1 END AS position, CASE WHEN doc_id % 2 = 0 THEN '第' || doc_id || '章：A' ELSE 'Lost' END AS title FROM documents UNION ALL SELECT doc_id, 1, len('第' || doc_id || '章 A' || chr(10) || 'the first chapter begins here' || chr(10) || text || chr(10)), '第' || (doc_id + 1) || '章：B' FROM documents WHERE doc_id % 2 = 0")
def chapter_split(spark, sf_dir):
    """Even documents become two chapters; the others have a heading that is not in the text."""
    d = F.col("doc_id")
    first, second = F.concat(F.lit("第"), d, F.lit("章 A")), F.concat(F.lit("第"), d + 1, F.lit("章 B"))
    text = F.concat(first, F.lit("\nthe first chapter begins here\n"), F.col("text"), F.lit("\n"), second, F.lit("\n"), F.lit("what follows is the second chapter"))
    heading = lambda t, m: F.struct(t.alias("title"), m.alias("marker"))
    headings = F.when(d % 2 == 0, F.array(heading(second, second), heading(first, F.lit("")))).otherwise(F.array(heading(F.lit("Lost"), F.lit("nowhere to be found"))))
    return chapters.split(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), headings.alias("headings"))).select("doc_id", "place", "position", "title")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'fallback' ELSE p_name || '|' || p_brand END AS queries, p_name AS called FROM part")
def query_lines(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 3 == 0, "# Notes\n- none\nx").otherwise(F.concat(F.lit("# Queries\n1. "), "p_name", F.lit("\n\n2) "), "p_brand", F.lit("\n- skip\n")))
    call = F.concat(F.lit('I call RAG_search: "'), "p_name", F.lit('"\nand wait'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.query_lines(text, F.lit("fallback")), "|").alias("queries"), F.array_join(T.tool_calls(call, "rag_search"), "|").alias("called"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS items, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name || ':rag_search:7,:web_search:2' END AS plan, '900:' || p_name || ',901:' || p_brand AS mini, CASE WHEN p_partkey % 2 = 0 THEN '缺失知识点：a；b。' ELSE '' END || '回答问题：' || p_name AS feedback FROM part")
def plan_salvage(spark, sf_dir):
    """Plans in noisy JSON with fields missing; some cannot be read."""
    good = F.concat(F.lit('Sure {"sub_questions": [{"id": 7, "question": "'), "p_name", F.lit('", "tool": "hammer"}, {"tool": "web_search", "keywords": ["{}"]}]} that is all }'))
    items = T.plan_items(F.when(F.col("p_partkey") % 4 == 3, "no plan {").otherwise(good))
    plan = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["question"], x["tool"], x["id"])), ",")
    mini = F.array_join(F.transform(T.plan_of_queries(F.array("p_name", "p_brand")), lambda x: F.concat_ws(":", x["id"], x["question"])), ",")
    said = T.feedback(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>"), F.array("p_name"))
    return table(spark, sf_dir, "part").withColumn("items", items).select(F.col("p_partkey").alias("id"), F.size("items").alias("items"), plan.alias("plan"), mini.alias("mini"), said.alias("feedback"))


@query("SELECT s_suppkey AS id, array_to_string(list_transform(generate_series(s_nationkey, s_nationkey + s_suppkey % 4 - 1), lambda i: 'c_' || i), ',') AS ids, printf('q%03d', row_number() OVER (ORDER BY s_suppkey)) AS question_id, s_name || '|' || 'x' AS keywords FROM supplier")
def id_ranges(spark, sf_dir):
    n = F.col("s_nationkey")
    enriched = T.enriched_query(F.lit("x"), F.col("s_name"), F.array("s_name", "s_name"))
    number = F.row_number().over(Window.orderBy("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(T.expand_range(F.lit("c_"), n.cast("long"), n + F.col("s_suppkey") % 4 - 1), ",").alias("ids"), F.format_string("q%03d", number).alias("question_id"), F.array_join(enriched["keywords"], "|").alias("keywords"))


@query("SELECT doc_id, left(source || chr(10) || chr(10) || text, 2000) AS chunk FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def evaluation_chunks(spark, sf_dir):
    """Corpus rows as chunks: title, blank line, text, 2,000 characters as the reference has it."""
    from docquarry.sources.files import corpus_chunks

    return corpus_chunks(table(spark, sf_dir, "documents").selectExpr("doc_id", "source as title", "text")).select("doc_id", F.col("text").alias("chunk"))
