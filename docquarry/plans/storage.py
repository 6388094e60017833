"""Queries over keyed stores: upserts, appends, deletes, look-ups, caches and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import stores
from docquarry.plans.registry import query, table


def _chunks(spark, sf_dir):
    """Documents as chunks: their source is the document, their language the chapter."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", F.col("source"), F.col("lang"), F.col("doc_id")).alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("chapter"), "text")


def _sessions(spark, sf_dir):
    """Each customer is a session, each order a save of it."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("report"))


@query("""WITH s AS (SELECT o_custkey AS session_id, o_orderkey AS version, o_orderdate AS created_at, o_orderpriority AS report FROM orders),
old AS (SELECT * FROM s WHERE version % 2 = 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version) = 1),
new AS (SELECT * FROM s WHERE version % 2 = 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) = 1)
SELECT session_id, coalesce(new.version, old.version) AS version, coalesce(old.created_at, new.created_at) AS created_at, coalesce(new.report, old.report) AS report FROM old FULL JOIN new USING (session_id)""")
def session_upsert(spark, sf_dir):
    """Saves with odd keys replace those stored by even ones; the time of creation stays."""
    s = _sessions(spark, sf_dir)
    stored = s.where("version % 2 = 0").groupBy("session_id").agg(F.min_by(F.struct("version", "created_at", "report"), "version").alias("x")).select("session_id", "x.*")
    return stores.upsert(stored, s.where("version % 2 = 1"), "session_id", "version", keep=("created_at",))


@query("SELECT row_number() OVER (ORDER BY event_id) + 1000000 AS id, event_id, event_type FROM events")
def message_append(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return stores.append(spark.range(1_000_000, 1_000_001), events, "event_id")


@query("SELECT doc_id, source AS doc FROM documents WHERE source NOT IN (SELECT max(source) FROM documents)")
def document_delete(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return stores.without(c, c.agg(F.max("doc").alias("doc")), "doc").select("doc_id", "doc")


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en')")
def chapter_delete(spark, sf_dir):
    return stores.without_chapter(_chunks(spark, sf_dir), "src1", "en").select("doc_id")


@query("SELECT doc_id, source || '_' || lang || '_' || doc_id AS chunk_id FROM documents WHERE NOT starts_with(source || '_' || lang || '_' || doc_id, 'src2_de_')")
def prefix_delete(spark, sf_dir):
    return stores.without_prefix(_chunks(spark, sf_dir), "chunk_id", "src2_de_").select("doc_id", "chunk_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 7 <> 3")
def session_delete(spark, sf_dir):
    """Sessions and, with them, their messages."""
    messages = table(spark, sf_dir, "conversations")
    return stores.without(messages, messages.where("conv_id % 7 = 3").select("conv_id"), "conv_id").select("conv_id", "turn")


@query("SELECT source AS doc, count(*) AS before, 0 AS after FROM documents GROUP BY 1")
def truncated(spark, sf_dir):
    """Chunks of each document before and after all of them are removed."""
    stored = _chunks(spark, sf_dir)
    left = stores.emptied(stored).groupBy(F.col("doc").alias("gone")).agg(F.count("*").alias("after"))
    before = stored.groupBy("doc").agg(F.count("*").alias("before"))
    return before.join(left, F.col("doc").eqNullSafe(F.col("gone")), "left").select("doc", "before", F.coalesce("after", F.lit(0)).alias("after"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def concept_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    return stores.lookup(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), wanted, "id")


MAPPED = "CASE WHEN lang = 'en' THEN source || '_Ch1_' || doc_id ELSE source || '_' || lang || '_' || doc_id END"


@query(f"SELECT doc_id, {MAPPED} AS chunk_id FROM documents")
def key_migration(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    mapping = chunks.where("chapter = 'en'").select(F.col("chunk_id").alias("old_id"), F.concat("doc", F.lit("_Ch1_"), F.col("doc_id")).alias("new_id"))
    return stores.migrate(chunks, mapping, "chunk_id").select("doc_id", "chunk_id")


@query("SELECT l_orderkey AS key, string_agg(CASE WHEN l_partkey % 2 = 0 THEN 'new' || l_partkey ELSE l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def list_migration(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey")
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_partkey"].cast("string")).alias("parts"))
    mapping = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("old_id"), F.concat(F.lit("new"), "p_partkey").alias("new_id"))
    return stores.migrate_lists(lists, mapping, "parts", "key").select("key", F.array_join("parts", ",").alias("parts"))


@query("SELECT doc_id, source || '_' || lang || '_' || doc_id AS chunk_id, left(text, 300) AS preview, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS place FROM documents")
def chunk_export(spark, sf_dir):
    """Chunks of each document by chapter and id, as they are browsed and exported."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", F.substring("text", 1, 300).alias("preview"), F.expr("row_number() over (partition by doc order by chapter, doc_id)").cast("long").alias("place"))


@query("SELECT n_nationkey AS key, n_name AS doc, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990) AS found FROM nation")
def document_exists(spark, sf_dir):
    has = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("found", F.lit(True))
    return table(spark, sf_dir, "nation").join(has, "n_nationkey", "left").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("doc"), F.coalesce("found", F.lit(False)).alias("found"))


CACHE = "cache AS (SELECT substr(sha256(lower(trim(p_name))), 1, 16) AS query_hash, max(p_retailprice) AS result, max(p_size) AS age FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)"


def _cache(spark, sf_dir):
    from docquarry.functions import text as T

    rows = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").groupBy(T.query_hash(F.col("p_name")).alias("query_hash")).agg(F.max("p_retailprice").alias("result"), F.max("p_size").alias("age"))
    return rows.withColumn("created_at", -F.col("age") * 86400.0).withColumn("ttl_days", F.lit(20))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("text"))


@query(f"WITH {CACHE} SELECT p_partkey AS qid, result FROM part LEFT JOIN cache ON query_hash = substr(sha256(lower(trim(p_name))), 1, 16) AND age < 20")
def search_cache(spark, sf_dir):
    """Hits on entries younger than 20 days, whatever the case and the spaces around the query."""
    return stores.cached(_asked(spark, sf_dir), _cache(spark, sf_dir), F.lit(0.0)).select("qid", "result")


@query(f"WITH {CACHE} SELECT p_partkey AS qid, result FROM part LEFT JOIN cache ON query_hash = substr(sha256(lower(trim(p_name))), 1, 16)")
def plan_cache(spark, sf_dir):
    """Plans do not expire."""
    return stores.cached(_asked(spark, sf_dir), _cache(spark, sf_dir)).select("qid", "result")


@query("SELECT o_orderkey AS session_id, left(o_orderpriority, 200) AS preview, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END AS updated_at FROM orders ORDER BY coalesce(updated_at, o_orderdate - INTERVAL 1 YEAR) DESC, o_orderkey LIMIT 100")
def sessions_by_age(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey as session_id", "o_orderpriority as report", "if(o_orderkey % 2 = 0, null, o_orderdate) as updated_at", "o_orderdate - interval 1 year as created_at")
    return stores.sessions_by_age(s).select("session_id", "preview", "updated_at").limit(100)


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 OR c_nationkey = 0 THEN n_nationkey ELSE c_nationkey END AS page, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS label FROM customer JOIN nation ON n_nationkey = c_custkey % 25")
def chapter_enrichment(spark, sf_dir):
    """What a request leaves empty comes from the cached chapter (here: a nation)."""
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "if(c_custkey % 3 = 0, 0, c_nationkey) as page", "if(c_custkey % 2 = 0, '', c_name) as label")
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 25).cast("int").alias("n_nationkey")).join(table(spark, sf_dir, "nation"), "n_nationkey").select("key", F.col("n_nationkey").alias("page"), F.col("n_name").alias("label"))
    return stores.enriched(asked, old, "key", ["page", "label"])


@query("SELECT conv_id, turn, '' AS lesson, 0 AS stage FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, role, turn FROM conversations WHERE turn % 2 = 1")
def widened_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return stores.widened(c.where("turn % 2 = 0").select("conv_id", "turn"), c.where("turn % 2 = 1").select("conv_id", "turn", F.col("role").alias("lesson"), F.col("turn").alias("stage")), {"lesson": "", "stage": 0})
