"""Queries of the answering rules over conversations, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import answering, metrics
from docquarry.plans.queries import CONCEPTS, EVAL, _each, _graph
from docquarry.plans.registry import query, table


@query("""WITH b AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN [p_name || '?', p_brand] WHEN p_partkey % 3 = 1 THEN [p_type, p_brand] ELSE [p_name] END AS l FROM part)
SELECT qid, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS n FROM b""")
def question_queries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    rows = p.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("question"), F.when(kind == 1, F.concat(F.lit("1. "), "p_type", F.lit("\n2. "), "p_brand")).alias("rewritten"), F.when(kind == 0, F.array(F.concat("p_name", F.lit("?")), F.col("p_brand"))).alias("decomposition"))
    return answering.queries_of(rows)


@query("""WITH b AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN [p_name || '?', p_brand] ELSE [p_name] END AS l FROM part),
q AS (SELECT qid, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS n FROM b)
SELECT qid, n, 'found ' || text AS content FROM q WHERE NOT contains(text, '?')""")
def moderate_results(spark, sf_dir):
    """A search that fails on whatever has a question mark."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("question"), F.lit("").alias("rewritten"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat("p_name", F.lit("?")), F.col("p_brand"))).alias("decomposition"))
    search = lambda q: q.select("qid", F.concat(F.lit("found "), "text").alias("content"), F.when(F.col("text").contains("?"), "timeout").otherwise("").alias("error"))
    return answering.moderate(rows, search)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations)
SELECT conv_id, string_agg('- ' || CASE WHEN role = 'user' THEN '学生' ELSE '答疑老师' END || ': ' || left(text, 300), chr(10) ORDER BY n DESC) AS block FROM r WHERE n <= 10 GROUP BY 1""")
def solver_history(spark, sf_dir):
    return answering.last_messages(table(spark, sf_dir, "conversations"))


@query(f"WITH {EVAL}, m AS (SELECT strategy, avg(recall) AS recall, avg(mrr) AS mrr FROM each GROUP BY strategy) SELECT strategy, printf('%-12s %8.4f %8.4f', strategy, round(recall, 4), round(mrr, 4)) AS line FROM m")
def metric_table(spark, sf_dir):
    return answering.metric_table(metrics.report(_each(spark, sf_dir)), ["recall", "mrr"])


@query(f"""WITH {CONCEPTS}, e AS (SELECT source_id AS id, target_id AS other FROM rel UNION SELECT target_id, source_id FROM rel),
r AS (SELECT e.id, name, row_number() OVER (PARTITION BY e.id ORDER BY name, other) AS n FROM e JOIN concepts c ON c.id = other WHERE e.id % 20 = 0),
l AS (SELECT id, string_agg(name, ',' ORDER BY n) AS neighbors FROM r WHERE n <= 5 GROUP BY id)
SELECT c.id, coalesce(neighbors, '') AS neighbors FROM concepts c LEFT JOIN l USING (id) WHERE c.id % 20 = 0""")
def concept_neighbors(spark, sf_dir):
    c, r = _graph(spark, sf_dir)
    return answering.with_neighbors(c.where("id % 20 = 0").select("id"), c, r).select("id", F.array_join("neighbors", ",").alias("neighbors"))


@query("""WITH h AS (SELECT l_orderkey AS qid, l_partkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)
SELECT qid, id, p_name AS name, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM h JOIN part ON p_partkey = id""")
def hits_in_order(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("score"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return answering.in_hit_order(hits, rows, "id").select("qid", "id", "name", F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT upper(n_name) AS q FROM nation UNION SELECT 'customer#00000000' || r_regionkey FROM region UNION SELECT 'none such')
SELECT q, (SELECT name FROM (SELECT c_name AS name FROM customer UNION SELECT n_name FROM nation) WHERE contains(lower(name), lower(q)) ORDER BY name <> q, name LIMIT 1) AS name FROM q""")
def file_names(spark, sf_dir):
    """Names as asked for, found by a part of them in any case."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    asked = n.select(F.upper("n_name").alias("q")).union(r.select(F.concat(F.lit("customer#00000000"), "r_regionkey"))).union(spark.range(1).select(F.lit("none such"))).distinct()
    return answering.resolve_name(asked, c.select(F.col("c_name").alias("name")).union(n.select("n_name")).distinct())


#: Documents whose chapters one task sorts.
TASK_DOCS = 20_000


@query("""SELECT c_custkey AS doc, 'n' || c_custkey % 30 AS title, coalesce(t.n_name, 'first') AS text FROM customer LEFT JOIN nation t ON t.n_nationkey = c_custkey % 30 AND t.n_nationkey > 0""")
def selected_chapters(spark, sf_dir):
    """A title that no chapter has (or that of the first) takes the first chapter."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    selected = c.selectExpr("c_custkey as doc", "concat('n', c_custkey % 30) as title")
    docs = c.select(F.col("c_custkey").alias("doc"))
    docs = docs.repartition(max(1, -(-docs.count() // TASK_DOCS)), "doc")  # one file split may hold millions of them
    parsed = docs.crossJoin(F.broadcast(n)).selectExpr("doc", "concat('n', n_nationkey) as title", "n_nationkey as pos", "if(n_nationkey = 0, 'first', n_name) as text")  # 25 chapters each
    return answering.chosen_or_first(selected, parsed)


@query("""WITH r AS (SELECT l_orderkey AS qid, l_linenumber AS rank, l_returnflag AS source, 'line ' || l_partkey AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag) = 1)
SELECT qid, string_agg('[' || rank || '] (' || source || ') ' || text, chr(10) ORDER BY rank) AS text FROM r GROUP BY qid""")
def result_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank")).agg(F.min(F.struct("l_partkey", "l_returnflag")).alias("x"))
    return answering.result_lines(rows.select("qid", "rank", F.col("x.l_returnflag").alias("source"), F.concat(F.lit("line "), F.col("x.l_partkey")).alias("text")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS errors,
  CASE p_partkey % 4 WHEN 0 THEN '  - 字段 [sub_questions]: repeated id' WHEN 1 THEN '  - 字段 [sub_questions → 0 → id]: < 1|  - 字段 [sub_questions → 1 → question]: empty' WHEN 2 THEN '  - 字段 [sub_questions]: > 8' ELSE '' END AS said,
  '1. ' || p_name || chr(10) || '2. ' || p_type || chr(10) || chr(10) || '- ' || p_brand AS prompt FROM part""")
def plan_checks(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    item = lambda i, q: F.struct(F.lit(i).alias("id"), q.alias("question"))
    many = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(i.alias("id"), F.col("p_name").alias("question")))
    items = F.when(kind == 0, F.array(item(1, F.col("p_name")), item(1, F.col("p_type")))).when(kind == 1, F.array(item(0, F.col("p_name")), item(2, F.lit(" ")))).when(kind == 2, many).otherwise(F.array(item(1, F.col("p_name"))))
    said = answering.plan_errors(F.col("items"))
    return table(spark, sf_dir, "part").withColumn("items", items).select(F.col("p_partkey").alias("id"), F.size(said).alias("errors"), F.array_join(said, "|").alias("said"), answering.seeds_text(F.array("p_name", "p_type"), F.array("p_brand")).alias("prompt"))


@query("""SELECT conv_id, turn, role, concat_ws(' ', coalesce(text, ''), role, conv_id, CASE WHEN turn % 3 > 0 THEN 'lesson ' || turn WHEN turn % 2 = 0 THEN 'reflected' END,
  CASE WHEN turn % 4 > 0 THEN 'behave' END, nullif(role, 'user'), 'k1', 'k2') AS search_text FROM conversations""")
def episode_text(spark, sf_dir):
    """Every message as an episode: its text is the goal, role and conversation are what was observed."""
    lesson = "case when turn % 3 = 0 then '' else concat('lesson ', turn) end as lesson"
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text as goal", "array(role, cast(conv_id as string)) as observations", lesson, "if(turn % 2 = 0, map('lesson', 'reflected'), map()) as reflection", "if(turn % 4 = 0, '', 'behave') as corrected_behavior", "if(role = 'user', '', role) as question_pattern", "array('k1', 'k2') as keywords")
    return answering.episode_text(rows).select("conv_id", "turn", "role", "search_text")
