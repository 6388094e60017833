"""Segmentation, content-hash dedup and unique ids of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

SIZE, OVERLAP = 800, 150


def _fold(parts: Column, step) -> Column:
    """Fold pieces into chunks: ``step(open, piece)`` says whether the piece joins, and what is open then; nothing open is ''."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def merge(state: Column, piece: Column) -> Column:
        joins, now = step(state["open"], piece)
        done = F.when(joins | (state["open"] == ""), state["out"]).otherwise(F.array_append(state["out"], state["open"]))
        return F.struct(done.alias("out"), now.alias("open"))

    return F.aggregate(parts, empty, merge, lambda s: F.when(s["open"] == "", s["out"]).otherwise(F.array_append(s["out"], s["open"])))


def _pieces(text: Column, border: str) -> Column:
    return F.filter(F.transform(F.split(text, border), T.strip), lambda x: x != "")


def paragraphs(text: Column, size: int = SIZE) -> Column:
    """Paragraphs joined by blank lines while they fit into ``size`` characters."""

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        joins = (open_ != "") & (F.length(open_) + F.length(x) + 2 <= size)
        return joins, F.when(joins, F.concat(open_, F.lit("\n\n"), x)).otherwise(x)

    return _fold(_pieces(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n"), step)


def sentences(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences joined by spaces while both have ``size`` characters; a longer chunk hands its last ``overlap`` characters on.

    A sentence over ``size`` stays whole, also where it is the first of a chunk (there the reference loses it).
    """

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        joins = (open_ == "") | (F.length(open_) + F.length(x) <= size)
        carried = F.when(F.length(open_) > overlap, F.concat(F.right(open_, F.lit(overlap)), F.lit(" "), x)).otherwise(x)
        return joins, F.when(open_ == "", x).when(joins, T.strip(F.concat(open_, F.lit(" "), x))).otherwise(carried)

    return _fold(_pieces(text, r"(?U)(?<=[。！？.!?])\s*"), step)


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk of ``docs(doc_id, text, file, chapter)``: doc_id, chunk_id, position, text.

    Packs of paragraphs over 1.2 times ``size`` are split by sentences. Ids are the file, the chapter's slug and the position.
    """
    packs = F.transform(paragraphs(F.col("text"), size), lambda p: F.when(F.length(p) <= 1.2 * size, F.array(p)).otherwise(sentences(p, size, overlap)))
    rows = docs.select("doc_id", F.concat("file", T.chapter_slug(F.col("chapter"))).alias("base"), F.posexplode(F.flatten(packs)).alias("position", "text"))
    return rows.select("doc_id", F.concat_ws("_", "base", "position").alias("chunk_id"), "position", "text")


def dedup(docs: DataFrame) -> DataFrame:
    """Keep the first (least id) document of every content hash; blank texts go. Combines before its one shuffle."""
    rows = docs.where(T.strip(F.col("text")) != "").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def new_only(batch: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents of a batch whose content hash is not indexed yet."""
    return dedup(batch).join(indexed.select(T.content_hash(F.col("text")).alias("hash")).distinct(), "hash", "left_anti")


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """``base``, then ``base``_v1, _v2 ... in ``order``, skipping ids that are in use.

    Only where a base itself looks like another one's later id (``x_v1`` beside ``x``) do both meet in one group, which goes
    row by row; all others are numbered by rank.
    """
    root = F.regexp_replace(base, r"(_v\d+)+$", "")
    mixed = rows.where(root != F.col(base)).select(root.alias("root")).distinct()
    keyed = rows.withColumn("root", root)
    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    plain = keyed.join(mixed, "root", "left_anti").withColumn("unique_id", F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_v"), n.cast("string"))))

    def number(group: pd.DataFrame) -> pd.DataFrame:
        used, last, out = set(), {}, []
        for b in group.sort_values(order)[base]:
            k, name = last.get(b, 0), b
            while name in used:
                k += 1
                name = f"{b}_v{k}"
            last[b] = k
            used.add(name)
            out.append(name)
        return group.sort_values(order).assign(unique_id=out)

    odd = keyed.join(mixed, "root", "left_semi")
    return plain.unionByName(odd.groupBy("root").applyInPandas(number, plain.schema)).drop("root")


def batches(rows: DataFrame, run: str, order: str, size: int) -> DataFrame:
    """Batch numbers within each ``run``, at most ``size`` rows in each."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))
