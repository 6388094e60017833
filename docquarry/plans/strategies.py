"""Queries of the retrieval strategies. A chunk is a document with the vector of its id; the questions are the chunks
whose id is divisible by 20, their text being the opening words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import graph, metrics, retrieval, strategies
from docquarry.plans.registry import query, table

ORDER = ["dense", "sparse", "graph"]


def _chunks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(v, "doc_id")


def _questions(chunks):
    return chunks.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.substring("text", 1, 80).alias("text"), F.col("embedding").alias("q"))


def _lists(spark, sf_dir, dense=20, sparse=10, concepts=5):
    """Dense, sparse and concept lists of all questions; each vector is a concept of the chunk at or up to two before it."""
    chunks = _chunks(spark, sf_dir)
    asked = _questions(chunks)
    near = retrieval.dense(chunks.select(F.col("doc_id").alias("vec_id"), "embedding"), asked, dense).withColumnRenamed("vec_id", "doc_id")
    words = retrieval.bm25(chunks, asked, sparse)
    known = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "vec_id - vec_id % 3 as chunk_id", "embedding")
    linked = graph.direct_scores(known, asked, concepts).withColumnRenamed("chunk_id", "doc_id")
    parts = [near.withColumn("source", F.lit("dense")), words.withColumn("source", F.lit("sparse")), linked.withColumn("source", F.lit("graph"))]
    one = reduce(DataFrame.unionByName, [p.select("qid", "doc_id", "source", "rank") for p in parts])
    return one.join(chunks.select("doc_id", "text"), "doc_id").select("qid", "doc_id", "text", "source", "rank"), asked


CTE = r"""c AS (SELECT doc_id, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT doc_id AS qid, left(text, 80) AS text, e FROM c WHERE doc_id % 20 = 0),
sim AS (SELECT qid, vec_id, list_cosine_similarity(q.e, v.embedding::DOUBLE[]) AS s FROM q, embeddings v),
de AS (SELECT qid, vec_id AS doc_id, 'dense' AS source, 1 AS place, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) AS rank FROM sim WHERE vec_id IN (SELECT doc_id FROM c)),
gs AS (SELECT qid, vec_id - vec_id % 3 AS doc_id, max(s) AS s FROM sim WHERE s > 0.1 GROUP BY ALL),
gr AS (SELECT qid, doc_id, 'graph' AS source, 3 AS place, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS rank FROM gs),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9]{{2,}}') AS t FROM c),
st AS (SELECT count(*) AS n, sum(len(t)) / greatest(1, count(*)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9]{{2,}}')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY qid, doc_id),
sp AS (SELECT qid, doc_id, 'sparse' AS source, 2 AS place, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc_id) AS rank FROM bm),
lists AS (SELECT l.*, c.text, md5(left(c.text, 200)) AS key FROM (SELECT * FROM de WHERE rank <= {dense} UNION ALL SELECT * FROM sp WHERE rank <= {sparse} UNION ALL SELECT * FROM gr WHERE rank <= {graph}) l JOIN c USING (doc_id))"""
FULL = CTE.format(dense=20, sparse=10, graph=5)
FUSE = """f AS (SELECT qid, key, sum({weight} / (60 + rank)) AS score, arg_min(doc_id, place * 1e12 + rank * 1e8 + doc_id) AS doc_id FROM {lists} GROUP BY ALL),
o AS (SELECT qid, key, string_agg(source, ',' ORDER BY place) AS sources FROM (SELECT DISTINCT qid, key, source, place FROM {lists}) GROUP BY ALL),
r AS (SELECT qid, doc_id, score, sources, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f JOIN o USING (qid, key))
SELECT qid, doc_id, round(score, 6) AS score, sources, rank FROM r WHERE rank <= 10"""


def _out(ranked):
    return ranked.select("qid", "doc_id", F.round("score", 6).alias("score"), "sources", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CTE.format(dense=20, sparse=20, graph=10)}, {FUSE.format(weight='1.0::DOUBLE', lists='lists')}")
def hybrid_search(spark, sf_dir):
    """Twice as many dense and sparse items as asked for, and concepts, fused by text."""
    return _out(strategies.fuse_texts(_lists(spark, sf_dir, 20, 20, 10)[0], 10, ORDER))


@query(f"""WITH {FULL}, w AS (SELECT qid, CASE qid % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.2 ELSE 0.5 END AS dense, CASE qid % 3 WHEN 1 THEN 0.6 ELSE 0.3 END AS sparse, 0.2 AS graph FROM q),
wl AS (SELECT lists.*, CASE source WHEN 'dense' THEN dense WHEN 'sparse' THEN sparse ELSE graph END::DOUBLE AS weight FROM lists JOIN w USING (qid) WHERE dense < 0.6 OR source = 'dense'),
{FUSE.format(weight='weight', lists='wl')}""")
def adaptive_search(spark, sf_dir):
    """Weights by question; some questions go by the dense list alone, others have no weights and take the defaults."""
    lists, asked = _lists(spark, sf_dir)
    weights = asked.where("qid % 3 <> 2").selectExpr("qid", "if(qid % 3 = 0, 0.7D, 0.2D) as dense", "if(qid % 3 = 1, 0.6D, 0.3D) as sparse", "0.2D as graph")
    return _out(strategies.weighted(lists, weights, 10, ORDER))


MERGE = "m AS (SELECT qid, doc_id, text, source, row_number() OVER (PARTITION BY qid ORDER BY place, rank, doc_id) AS rank FROM (SELECT * FROM {lists} QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY place, rank) = 1))"
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"
RERANK = f"""ce AS (SELECT m.qid, doc_id, source, rank, count(*) OVER (PARTITION BY m.qid) AS n, round(coalesce(len(list_intersect({TOKENS.format(x='q.text')}, {TOKENS.format(x='left(m.text, 500)')})) / nullif(len({TOKENS.format(x='q.text')}), 0), 0), 6) AS s FROM m JOIN q ON q.qid = m.qid),
z AS (SELECT qid, doc_id, source, s AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= {{k}} THEN 0 ELSE -s END, rank, doc_id) AS new FROM ce)"""


def _reranked(ranked):
    return ranked.select("qid", "doc_id", "source", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FULL}, {MERGE.format(lists='(SELECT * FROM lists WHERE place = 1)')}, {RERANK.format(k=5)} SELECT qid, doc_id, source, score, new AS rank FROM z WHERE new <= 5")
def rag_search(spark, sf_dir):
    """The fast tier: 20 dense candidates, reranked."""
    lists, asked = _lists(spark, sf_dir)
    return _reranked(strategies.rerank(strategies.merged(lists.where("source = 'dense'"), ORDER), asked, 5))


@query(f"WITH {FULL}, {MERGE.format(lists='lists')}, {RERANK.format(k=5)} SELECT qid, doc_id, source, score, new AS rank FROM z WHERE new <= 5")
def rag_full(spark, sf_dir):
    """The full tier: 20 dense, 10 sparse and 5 concept candidates, each once, reranked."""
    lists, asked = _lists(spark, sf_dir)
    return _reranked(strategies.rerank(strategies.merged(lists, ORDER), asked, 5))


HARD = "hard AS (SELECT q.qid FROM q WHERE EXISTS (SELECT 1 FROM (SELECT lower(trim(substr(text, 5, 40), ' ' || chr(10) || chr(9))) AS u FROM q WHERE qid % 40 = 0) WHERE u <> '' AND (contains(lower(trim(q.text)), u) OR contains(u, lower(trim(q.text))))))"


@query(f"WITH {FULL}, {HARD}, picked AS (SELECT * FROM lists WHERE place = 1 OR qid IN (SELECT qid FROM hard)), {MERGE.format(lists="picked")}, {RERANK.format(k=5)} SELECT qid, doc_id, source, score, new AS rank FROM z WHERE new <= 5")
def rag_skill(spark, sf_dir):
    """The fast tier, and the full one for questions like those that got no good answer before."""
    lists, asked = _lists(spark, sf_dir)
    hard = strategies.escalated(asked, asked.where("qid % 40 = 0").select(F.substring("text", 5, 40).alias("text"))).select("qid")
    some = lists.where("source = 'dense'").unionByName(lists.where("source <> 'dense'").join(hard, "qid", "left_semi"))
    return _reranked(strategies.rerank(strategies.merged(some, ORDER), asked, 5))


@query(f"WITH {FULL}, {HARD} SELECT qid FROM hard")
def escalated_questions(spark, sf_dir):
    asked = _questions(_chunks(spark, sf_dir))
    return strategies.escalated(asked, asked.where("qid % 40 = 0").select(F.substring("text", 5, 40).alias("text"))).select("qid")


@query(f"WITH {FULL} SELECT qid, doc_id AS chunk_id, round(s, 4) AS score, rank FROM gr JOIN gs USING (qid, doc_id) WHERE rank <= 5")
def concept_scores(spark, sf_dir):
    asked = _questions(_chunks(spark, sf_dir))
    known = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "vec_id - vec_id % 3 as chunk_id", "embedding")
    return graph.direct_scores(known, asked, 5).select("qid", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 1) AS score FROM q, embeddings)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM d QUALIFY rank <= 5""")
def ties_reversed(spark, sf_dir):
    """Scores of one digit, so that there are ties; of those the last row counts first."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return retrieval.dense_last_of_ties(v, asked, 5, 1).select("qid", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id % 2 = 1)
SELECT qid, vec_id, round(s, 4) AS score FROM d WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) = 1""")
def semantic_cache(spark, sf_dir):
    """The nearest cached question (odd ids) at a cosine of 0.3 or more."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    entries = v.where("vec_id % 2 = 1")
    return strategies.cached_answer(retrieval.dense(entries, asked, 1), entries, 0.3).select("qid", "vec_id", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id, e.label = q.label AS known, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) AS r FROM q, embeddings e)
SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM d WHERE r <= 5 AND NOT known""")
def annotation_candidates(spark, sf_dir):
    """Of the five nearest vectors those that are not yet annotated (here: of the question's own label)."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    known = v.select("vec_id", "label")
    near = retrieval.dense(v, asked, 5).join(known, "vec_id").join(known.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    return near.where("label <> own").select("qid", "vec_id", F.expr("row_number() over (partition by qid order by rank)").cast("long").alias("rank"))


@query(r"""WITH r AS (SELECT l_orderkey AS qid, (l_partkey // 2) || CASE WHEN l_partkey % 2 = 1 THEN '_v1' ELSE '' END AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank FROM lineitem),
n AS (SELECT qid, regexp_replace(id, '_v\d+$', '') AS doc_id, min(rank) AS old FROM r GROUP BY ALL)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY old, doc_id) AS rank FROM n""")
def run_normalisation(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as qid", "concat(l_partkey div 2, if(l_partkey % 2 = 1, '_v1', '')) as doc_id", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rank")
    return strategies.normalise_runs(runs).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN '未找到相关内容' ELSE url END AS content, CASE WHEN page_id % 7 = 0 THEN 'timeout' ELSE '' END AS error FROM pages)
SELECT page_id FROM p WHERE error = '' AND trim(content, ' ' || chr(10)) <> '' AND NOT contains(content, '未找到')""")
def valid_results(spark, sf_dir):
    kind = F.col("page_id") % 5
    content = F.when(kind == 0, "").when(kind == 1, " \n").when(kind == 2, strategies.EMPTY_MARKERS[0]).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", content.alias("content"), F.when(F.col("page_id") % 7 == 0, "timeout").otherwise("").alias("error"))
    return strategies.valid_results(rows).select("page_id")


@query("""WITH m AS (SELECT c_nationkey % 3 AS s, avg(c_acctbal) AS recall, avg(c_custkey) AS precision, count(*)::DOUBLE AS seconds FROM customer GROUP BY 1),
l AS (SELECT 'recall' AS metric, s, recall AS v FROM m UNION ALL SELECT 'precision', s, precision FROM m UNION ALL SELECT 'seconds', s, seconds FROM m),
p AS (SELECT metric, max(v) FILTER (s = 0) AS a, max(v) FILTER (s = 1) AS b, max(v) FILTER (s = 2) AS c FROM l GROUP BY 1)
SELECT metric, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, CASE WHEN metric = 'seconds' THEN CASE WHEN a <= b AND a <= c THEN 'a' WHEN b <= c THEN 'b' ELSE 'c' END ELSE CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END END AS best FROM p""")
def strategy_pivot(spark, sf_dir):
    report = table(spark, sf_dir, "customer").groupBy(F.element_at(F.array(*map(F.lit, "abc")), F.col("c_nationkey") % 3 + 1).alias("strategy")).agg(F.avg("c_acctbal").alias("recall"), F.avg("c_custkey").alias("precision"), F.count("*").cast("double").alias("seconds"))
    return strategies.pivoted(report, ["recall", "precision", "seconds"], ["a", "b", "c"], ("seconds",)).select("metric", *[F.round(c, 4).alias(c) for c in "abc"], "best")


@query("SELECT count(*) FILTER (s_suppkey % 3 = 0) AS wins_a, count(*) FILTER (s_suppkey % 3 = 1) AS wins_b, count(*) FILTER (s_suppkey % 3 = 2) AS ties, round(avg(s_acctbal), 4) AS mean_a, round(avg(s_nationkey), 4) AS mean_b FROM supplier")
def judge_wins(spark, sf_dir):
    judged = table(spark, sf_dir, "supplier").selectExpr("case s_suppkey % 3 when 0 then 'A' when 1 then 'B' else 'tie' end as winner", "s_acctbal as score_a", "s_nationkey as score_b")
    return strategies.wins(judged)


@query("""WITH rel AS (SELECT o_custkey AS qid, o_orderkey AS vec_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS grade FROM orders),
run AS (SELECT o_custkey AS qid, o_orderkey AS vec_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderpriority <> '1-URGENT'),
g AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY 1), f AS (SELECT qid, count(*) FILTER (rank <= 10) AS found, min(rank) AS first FROM run JOIN rel USING (qid, vec_id) GROUP BY 1),
e AS (SELECT c_custkey AS qid, n_rel, coalesce(found / n_rel, 0) AS recall, coalesce(1 / first, 0) AS mrr, c_custkey IN (SELECT qid FROM run) AS has_run FROM customer LEFT JOIN g ON g.qid = c_custkey LEFT JOIN f ON f.qid = c_custkey)
SELECT count(*) AS num_queries, count(*) FILTER (NOT has_run) AS empty_results, count(n_rel) AS graded, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM e""")
def report_summary(spark, sf_dir):
    """Means over all questions: those without a run count 0, and are counted; questions without grades have no NDCG."""
    orders = table(spark, sf_dir, "orders")
    qrels = orders.selectExpr("o_custkey as qid", "o_orderkey as vec_id", "if(o_orderstatus = 'F', 2, 1) as grade")
    run = orders.where("o_orderpriority <> '1-URGENT'").selectExpr("o_custkey as qid", "o_orderkey as vec_id", "row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank")
    got = metrics.summary(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")), qrels, run)
    return got.select("num_queries", "empty_results", "graded", "recall", "mrr")
