"""Whole runs: files to chunks to concepts, and an evaluation of strategies over a test set.

``python -m docquarry.pipelines FOLDER [STRATEGY ...]`` evaluates strategies on a folder with corpus, queries and qrels.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import chapters, chunks, knowledge, metrics
from docquarry.registry import retrieve
from docquarry.sources import files

EXTRACTED = "struct<concepts:array<struct<name:string,description:string,category:string,source_fragment:int,related_fragments:array<int>>>,relations:array<struct<source:string,target:string,relation_type:string,description:string>>>"


def ingest(documents: DataFrame, indexed: DataFrame | None = None, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP) -> DataFrame:
    """New chunks of ``documents(doc_id, file, text, headings)``: (doc_id, file, chapter, chunk_id, position, text, hash).

    A document with headings is split into its chapters first; each chapter is cut for itself, so ids carry its number.
    Chunks whose content is indexed already, or stands earlier in the batch, go.
    """
    split = chapters.split(documents.where("size(headings) > 0")).where("position >= 0").join(documents.select("doc_id", "file"), "doc_id")
    plain = documents.where("headings is null or size(headings) = 0").select("doc_id", "file", F.lit("").alias("title"), "text")
    parts = split.select("doc_id", "file", "title", "text").unionByName(plain)
    named = parts.select(F.struct("doc_id", "file", "title").alias("doc_id"), "file", F.col("title").alias("chapter"), "text")
    cut = chunks.chunk(named, size, overlap).select("doc_id.doc_id", "doc_id.file", F.col("doc_id.title").alias("chapter"), "chunk_id", "position", "text", T.content_hash(F.col("text")).alias("hash"))
    first = cut.where(T.strip(F.col("text")) != "").groupBy("hash").agg(F.min_by(F.struct("doc_id", "file", "chapter", "chunk_id", "position", "text"), F.struct("doc_id", "chunk_id")).alias("x")).select("x.*", "hash")
    return first if indexed is None else first.join(indexed.select("hash").distinct(), "hash", "left_anti")


def extract(batches: DataFrame, model: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, relations and the chunks without a concept of ``batches(batch, pos, doc, chapter, chunk_id, text)``.

    ``model`` makes the answer column (JSON in whatever text) of the input column; an answer that cannot be read gives nothing.
    """
    asked = knowledge.batch_input(batches).withColumn("answer", F.from_json(T.first_object(model(F.col("text"))), EXTRACTED))
    found = asked.select("batch", "source_file", F.posexplode("answer.concepts").alias("pos", "c")).select("batch", "source_file", "pos", "c.name", "c.description", F.coalesce("c.category", F.lit("concept")).alias("category"), F.coalesce("c.source_fragment", F.lit(-1)).alias("fragment"), F.coalesce("c.related_fragments", F.array().cast("array<int>")).alias("others"))
    merged = knowledge.merge_concepts(knowledge.fragment_chunks(found, batches))
    at = batches.select("batch", F.col("pos").alias("other"), F.col("chunk_id").alias("related"))
    related = merged.select("key", "batch", "fragment", F.explode("others").alias("other")).where("other <> fragment").join(at, ["batch", "other"]).groupBy("key").agg(F.array_sort(F.collect_set("related")).alias("related_chunk_ids"))
    concepts = merged.drop("others").join(related, "key", "left").withColumn("related_chunk_ids", F.coalesce("related_chunk_ids", F.array().cast("array<string>")))
    pending = asked.select(F.explode("answer.relations").alias("r")).select("r.source", "r.target", F.coalesce("r.relation_type", F.lit("related_to")).alias("relation_type"), "r.description")
    return concepts, knowledge.resolve_relations(pending, merged), knowledge.uncovered(batches, concepts)


def evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """One row per strategy: its name and the means of its metrics over all queries."""
    grades = qrels.withColumnRenamed("doc_id", "vec_id")
    rows = [metrics.summary(queries, grades, retrieve(n, corpus, queries, k).withColumnRenamed("doc_id", "vec_id"), k).withColumn("strategy", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, rows)


def main(folder: str, *names: str) -> None:
    spark = SparkSession.builder.appName("evaluation").getOrCreate()
    corpus, queries, qrels = files.evaluation_set(spark, folder)
    corpus = files.corpus_chunks(corpus.withColumnRenamed("_id", "doc_id"))
    qrels = qrels.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("grade"))
    evaluate(corpus, queries.withColumnRenamed("_id", "qid"), qrels, list(names) or ["sparse", "overlap"]).show(truncate=False)


if __name__ == "__main__":
    import docquarry.operators.strategies  # noqa: F401  registers the strategies

    main(*sys.argv[1:])
