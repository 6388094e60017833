"""The corpus pipeline: five stages over ``documents``, each written to the shared folder before the next one reads it.

It is part of the training-data subpackage and is removed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from docquarry.llm.common import save, table
from docquarry.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go; the model learns from labelled rows outside of the held-out fold."""
    return toxicity.train(docs, table(spark, sf_dir, "labels")).keep(docs, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 between sets of five-word shingles the least id stays."""
    return ngram_join.keep_first(docs, n=5, t=0.8).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the text."""
    return substring_dedup.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows in a twentieth of their words or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of what is left, one row per piece."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but the removal by benchmark windows can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
