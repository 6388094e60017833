"""Queries of stored indexes, similarity joins, communities and joins by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import contains, graph, keyword_index, knowledge, modularity, temporal, vector_index
from docquarry.plans.knowledge import RELATED, _propagated
from docquarry.plans.queries import BM25_SQL, DENSE, _bench, _graph
from docquarry.plans.registry import query, table


@query(f"WITH {DENSE} SELECT qid, vec_id, round(score, 4) AS score, rank FROM dk WHERE rank <= 10")
def vector_index_topk(spark, sf_dir):
    """As ``dense_topk``, from a stored index: exact, as cells are left unread only where their bounds allow."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vector_index.search(vector_index.build(vectors), asked).select("qid", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(BM25_SQL.format(where="true"))
def keyword_index_topk(spark, sf_dir):
    """As ``bm25_topk``, from a stored index of all documents but those of one language, and a segment of these."""
    docs = table(spark, sf_dir, "documents")
    index = keyword_index.build(docs.where("coalesce(lang <> 'de', true)"))
    keyword_index.add(index, docs)
    return keyword_index.search(index, _bench(spark, sf_dir)).select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id AS id, label % 3 AS name, label AS chapter, embedding::DOUBLE[] AS vec FROM embeddings)
SELECT substr(md5('cross_syn_' || a.id || '_' || b.id), 1, 12) AS id, a.id AS source_id, b.id AS target_id, round(list_cosine_similarity(a.vec, b.vec), 4) AS score FROM v a JOIN v b ON a.id < b.id AND a.name <> b.name AND a.chapter <> b.chapter
WHERE list_cosine_similarity(a.vec, b.vec) >= 0.4""")
def similar_concepts(spark, sf_dir):
    """All pairs of all concepts of other names and chapters; at 0.4, as these vectors have no pair at 0.85."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "label % 3 as name", "label as chapter", "embedding as vec")
    return knowledge.similar_concepts(rows, 0.4).select("id", "source_id", "target_id", F.round("score", 4).alias("score"))


@query(f"""WITH {RELATED}, {_propagated(3)}, m AS (SELECT count(*) AS w FROM e),
t AS (SELECT c, count(*) AS tot FROM e JOIN l3 ON l3.id = e.a GROUP BY c), i AS (SELECT x.c, count(*) AS inner_ FROM e JOIN l3 x ON x.id = e.a JOIN l3 y ON y.id = e.b WHERE x.c = y.c GROUP BY x.c)
SELECT count(*) AS communities, round(sum(coalesce(inner_, 0) / w - (tot / w) ** 2), 6) AS modularity FROM t LEFT JOIN i USING (c), m""")
def community_modularity(spark, sf_dir):
    """How well communities by label propagation divide the graph."""
    relations = _graph(spark, sf_dir)[1]
    edges = graph.saved_edges(relations)
    labels = graph.spread(edges, 3)
    q = modularity.modularity(edges.withColumn("w", F.lit(1.0)), labels)
    return labels.agg(F.countDistinct("community").alias("communities")).withColumn("modularity", F.round(F.lit(q), 6))


@query()
def modularity_communities(spark, sf_dir):
    """Communities by modularity; each has the id of its least member. No SQL: the search is iterative."""
    return modularity.communities(_graph(spark, sf_dir)[1])


@query("""WITH t AS (SELECT item_id AS term_id, lower(substr(text, 3, 12)) AS term FROM benchmark UNION ALL SELECT 1000000 + p_partkey, substr(p_name, 1, 5) FROM part WHERE p_partkey % 20 = 0),
d AS (SELECT doc_id AS id, lower(text) AS text FROM documents) SELECT id, term_id FROM d JOIN t ON term <> '' AND text <> '' AND (contains(text, term) OR contains(term, text))""")
def many_terms(spark, sf_dir):
    """Which documents contain, or are contained in, which of many terms."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.lower(F.substring("text", 3, 12)).alias("term"))
    terms = terms.unionByName(table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select((F.col("p_partkey") + 1000000).alias("term_id"), F.substring("p_name", 1, 5).alias("term")))
    return contains.either_way(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), terms)


@query("""SELECT p.event_id, coalesce(v.event_id, -1) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true""")
def last_view_before_purchase(spark, sf_dir):
    """As-of join: what each buyer had looked at last; -1 for nothing."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return temporal.as_of(bought, seen, "user_id", "ts", ["view_id"]).select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("""WITH s AS (SELECT event_id AS signup_id, user_id, ts AS from_ts, ts + to_seconds(CAST(3600 + event_id % 7200 AS INT)) AS to_ts FROM events WHERE event_type = 'signup')
SELECT s.signup_id, e.event_id FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= from_ts AND e.ts < to_ts AND e.event_type <> 'signup'""")
def events_within_trial(spark, sf_dir):
    """Interval join: events of a user in the hours after a sign-up."""
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'signup'").selectExpr("event_id as signup_id", "user_id", "ts as from_ts", "ts + make_dt_interval(0, 0, 0, 3600 + event_id % 7200) as to_ts")
    points = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    return temporal.within(points, spans, "user_id", "ts", "from_ts", "to_ts").select("signup_id", "event_id")


@query("SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800 * 1000000")
def clicks_near_errors(spark, sf_dir):
    """Range join: clicks of a user within half an hour of an error, before or after it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", "ts")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    return temporal.near(errors, clicks, "user_id", "ts", "click_ts", 1800).select("error_id", "click_id")
