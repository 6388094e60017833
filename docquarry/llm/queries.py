"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import conversation_repair, decontaminate, embedding_dedup, ngram_join, packing, pseudo_likelihood, sentence_pieces, sharding, substring_dedup, token_store, toxicity, url_filters, whitening
from docquarry.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of each document, the documents that hold them first, and what share of the bytes they are."""
    found = substring_dedup.passages(table(spark, sf_dir, "documents"))
    repeated = F.aggregate(F.arrays_zip("span_starts", "span_ends"), F.lit(0).cast("long"), lambda a, x: a + x["span_ends"] - x["span_starts"])
    return found.withColumn("repeated_bytes", repeated)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, t=0.9)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page was fetched on day page_id mod 365."""
    return pages.select("page_id", "url", F.pmod("page_id", F.lit(365)).alias("day"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts and their first path parts: added on one day, removed on a later one.

    Rule, list and days follow from the md5 of the key, as no table of the test data holds a list.
    """
    host, path = url_filters.host(F.col("url")), url_filters.path(F.col("url"))
    hosts = pages.select(host.alias("h"), F.regexp_extract(path, "^[^/]*", 0).alias("p")).where("h <> ''")
    keys = hosts.select(F.col("h").alias("key")).unionByName(hosts.where("p <> ''").select(F.concat_ws("/", "h", "p").alias("key"))).distinct()
    part = lambda i: F.conv(F.substring(F.md5(F.col("key")), i, 4), 16, 10).cast("long")
    dated = keys.select("key", F.concat(F.lit("list"), F.pmod(part(1), F.lit(3)).cast("string")).alias("list"), F.pmod(part(5), F.lit(300)).alias("day"), F.pmod(part(9), F.lit(120)).alias("stay"))
    added = dated.select("list", "key", "day", F.lit("add").alias("action"))
    return added.unionByName(dated.select("list", "key", (F.col("day") + F.col("stay") + 1).alias("day"), F.lit("remove").alias("action")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.apply(captures(pages), list_entries(pages))


OP4_SQL = r"""
WITH named AS (
  SELECT page_id, page_id % 365 AS day,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', '') AS h,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://[^/?#]*/([^?#]*)', 1), '^/+|/+$', '', 'g') AS p
  FROM pages),
keys AS (
  SELECT h AS key FROM named WHERE h <> ''
  UNION
  SELECT h || '/' || split_part(p, '/', 1) FROM named WHERE h <> '' AND split_part(p, '/', 1) <> ''),
rules AS (
  SELECT key, 'list' || (('0x' || substr(md5(key), 1, 4))::BIGINT % 3) AS list,
    ('0x' || substr(md5(key), 5, 4))::BIGINT % 300 AS valid_from,
    ('0x' || substr(md5(key), 5, 4))::BIGINT % 300 + ('0x' || substr(md5(key), 9, 4))::BIGINT % 120 + 1 AS valid_to
  FROM keys),
cand AS (
  SELECT DISTINCT page_id, day, unnest(list_concat(
    [array_to_string(list_slice(string_split(h, '.'), i, len(string_split(h, '.'))), '.') FOR i IN generate_series(1, greatest(1, len(string_split(h, '.')) - 1))],
    CASE WHEN p = '' THEN [] ELSE [h || '/' || array_to_string(list_slice(string_split(p, '/'), 1, i), '/') FOR i IN generate_series(1, len(string_split(p, '/')))] END)) AS key
  FROM named WHERE h <> ''),
hits AS (SELECT c.page_id, r.list, r.valid_from FROM cand c JOIN rules r ON c.key = r.key AND c.day >= r.valid_from AND c.day < r.valid_to),
per AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(valid_from) AS first_day FROM hits GROUP BY page_id)
SELECT n.page_id, n.h AS url_host, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, first_day, n_active IS NOT NULL AS blocked
FROM named n LEFT JOIN per USING (page_id)
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and the texts decoded from them, as hashes."""
    model = tokenizer("piece_bpe_32k.model")
    both = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), model), model)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_sharding": op7_sharding,
    "op8_token_store": op8_token_store,
    "op9_decontaminate": op9_decontaminate,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentence_pieces": op13_sentence_pieces,
}

SQL = {"op4_url_filters": OP4_SQL}
