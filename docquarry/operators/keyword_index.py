"""A stored keyword index: postings by term bucket and tile of documents, with maxima that let a search leave tiles unread.

A segment holds the documents of one addition. Its documents are dealt into tiles; a row holds a term's postings of
one tile, with the greatest count and the least document length among them. For a question these give an upper bound of what any
document of a tile can score, so that after the most promising tiles only those are read whose bound reaches the k-th
best score. Results equal those of a full scan.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.scratch import folder, save
from docquarry.operators.retrieval import K1, B, top_k

#: Buckets of terms (directories that a search chooses from), documents of a tile, tiles of a shard.
BUCKETS, TILE, SHARD = 64, 2_048, 4
#: Documents for each part of a bucket, which one task sorts and writes.
PART = 100_000
SLACK = 2e-6
POSTINGS = "term string, tile int, n_docs int, max_tf int, min_dl int, doc_ids array<long>, tfs array<int>, dls array<int>, segment int, bucket int"


def _bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class KeywordIndex:
    """An index folder: ``postings/segment=/bucket=``, ``documents/segment=`` (doc_id, digest) and one row of totals a segment."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, digest long, segment int").parquet(f"{self.path}/documents")

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.schema("n long, n_terms long, segment int").parquet(f"{self.path}/totals")

    def segments(self) -> int:
        """How many segments there are."""
        return self.totals.count()


def _digested(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))


def _counts(frames):
    """How often each document has each of its terms, counted where the document is."""
    for f in frames:
        for at in range(0, len(f), 256):
            part = f.iloc[at : at + 256]
            counts = [Counter(x) for x in part.terms]
            size = [len(c) for c in counts]
            yield pd.DataFrame({"doc_id": part.doc_id.repeat(size).to_numpy(), "dl": np.repeat([len(x) for x in part.terms], size), "term": [t for c in counts for t in c], "tf": [n for c in counts for n in c.values()]})


def _write(index: KeywordIndex, docs: DataFrame, segment: int) -> None:
    terms = docs.select("doc_id", T.terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    n = docs.count()
    tile = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // TILE) or 1)).cast("int")
    counted = terms.mapInPandas(_counts, "doc_id long, dl int, term string, tf int")
    parts = -(-n // PART)
    keyed = counted.select(_bucket("term").alias("bucket"), F.pmod(F.xxhash64(tile), F.lit(parts)).cast("int").alias("part"), "term", tile.alias("tile"), "doc_id", "tf", "dl")
    entry = F.struct("doc_id", "tf", "dl")
    rows = keyed.repartition("bucket", "part").groupBy("bucket", "part", "term", "tile").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    out = rows.select("term", "tile", F.size("e").alias("n_docs"), "max_tf", "min_dl", F.col("e.doc_id").alias("doc_ids"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"), "bucket")
    out.sortWithinPartitions("bucket", "term", "tile").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment={segment}")
    docs.select("doc_id", "digest").write.parquet(f"{index.path}/documents/segment={segment}")
    totals = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("n_terms"))
    totals.coalesce(1).write.parquet(f"{index.path}/totals/segment={segment}")  # last: a segment without totals is not complete


def build(docs: DataFrame, path: str | None = None) -> KeywordIndex:
    """Index ``docs(doc_id, text)``; of rows with one id the least text counts, null texts are empty, null ids are left out."""
    index = KeywordIndex(docs.sparkSession, path or folder(docs.sparkSession, "keyword-index"))
    one = _digested(docs).groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "digest")).alias("x")).select("doc_id", "x.*")
    _write(index, save(one, "new-docs"), 0)
    return index


def add(index: KeywordIndex, docs: DataFrame) -> int:
    """Add the documents of ``docs`` whose ids are new, as one segment; returns how many there are."""
    new = save(_digested(docs).join(index.documents.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "digest")).alias("x")).select("doc_id", "x.*"), "new-docs")
    n = new.count()
    if n:
        _write(index, new, index.segments())
    return n


def is_valid(index: KeywordIndex, docs: DataFrame) -> bool:
    """Whether the index holds just these documents with just these texts."""
    now = _digested(docs).groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "digest")).alias("x")).select("doc_id", "x.digest")
    differ = now.join(index.documents.select("doc_id", F.col("digest").alias("stored")), "doc_id", "full").where("digest is null or stored is null or digest <> stored")
    return not differ.take(1)


def ensure(docs: DataFrame, path: str) -> KeywordIndex:
    """The index at ``path``, built if there is none, extended by new documents, or built anew in another folder where texts changed or went."""
    spark = docs.sparkSession
    index = KeywordIndex(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return build(docs, path)
    add(index, docs)
    return index if is_valid(index, docs) else build(docs, f"{path}-{spark.sparkContext.startTime}-{index.segments()}")


def search(index: KeywordIndex, queries: DataFrame, k: int = 10, most: int = 20_000) -> DataFrame:
    """BM25 top ``k`` of ``queries(qid, text)``: (qid, doc_id, score, rank); statistics over all segments.

    Only buckets of the questions' terms are read (their numbers, at most ``BUCKETS``, are what the driver learns). Questions are dealt
    into blocks of ``most``; one block meets one shard of tiles in a task, which hands on its ``k`` best documents of each question, so
    neither pairs nor bounds are shuffled. A term that repeats in a question counts each time.
    """
    q = save(queries.where("qid is not null").select("qid", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")).withColumn("bucket", _bucket("term")), "terms")
    buckets = [r.bucket for r in q.select("bucket").distinct().collect()]
    stats = index.totals.agg(F.sum("n").alias("n"), F.sum("n_terms").alias("t")).first()
    n, avgdl = stats.n or 0, (stats.t or 0) / max(1, stats.n or 0)
    held = index.postings.where(F.col("bucket").isin(buckets))
    terms = q.select("bucket", "term").distinct()
    df = held.select("bucket", "term", "n_docs").join(terms, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("n_docs").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    numbered = save(df.select("bucket", "term", idf.alias("idf"), F.monotonically_increasing_id().alias("number")), "weights")
    blocks, shards = max(1, -(-queries.count() // most)), max(1, -(-n // (TILE * SHARD)))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.join(numbered, ["bucket", "term"]).select("qid", "number", (F.col("qtf") * F.col("idf")).alias("weight")).withColumn("block", deal(blocks, "qid")).withColumn("shard", every(shards))
    right = held.join(numbered.drop("idf"), ["bucket", "term"]).select("segment", "tile", "number", "max_tf", "min_dl", "doc_ids", "tfs", "dls").withColumn("shard", deal(shards, "segment", "tile")).withColumn("block", every(blocks))
    kinds = f"qid {dict(q.dtypes)['qid']}, doc_id long, score double"
    left, right = (f.toDF(*f.columns).groupBy("block", "shard") for f in (left, right))  # both have columns of ``numbered``
    return top_k(left.cogroup(right).applyInPandas(_best_of_tiles(k, avgdl), kinds), k)


def _best_of_tiles(k: int, avgdl: float):
    """Of each question the ``k`` documents of a shard with the greatest sums, tile by tile, ties by id."""
    part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / max(avgdl, 1e-9)))
    none = lambda: (np.zeros(0, np.int64), np.zeros(0))

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        tiles = []
        for _, rows in f.groupby(["segment", "tile"]):
            ids, place = np.unique(np.concatenate(rows.doc_ids.to_list()), return_inverse=True)
            parts = part(np.concatenate(rows.tfs.to_list()), np.concatenate(rows.dls.to_list()))
            ends = np.cumsum([len(x) for x in rows.doc_ids])
            spans = dict(zip(rows.number, zip(ends - [len(x) for x in rows.doc_ids], ends, part(rows.max_tf.to_numpy(), rows.min_dl.to_numpy()), strict=True), strict=True))
            tiles.append((ids, place, parts, spans))
        found = []
        for qid, terms in q.groupby("qid", sort=False):
            asked = list(zip(terms.number, terms.weight, strict=True))
            bounds = np.array([sum(w * spans[x][2] for x, w in asked if x in spans) for *_, spans in tiles])
            best, scores = none()
            for at in np.argsort(-bounds, kind="stable"):
                if bounds[at] == 0 or len(best) == k and bounds[at] < scores[-1] - SLACK:
                    break
                ids, place, parts, spans = tiles[at]
                sums = np.zeros(len(ids))
                for x, w in asked:
                    if x in spans:
                        a, b, _ = spans[x]
                        sums[place[a:b]] += w * parts[a:b]
                hit = np.flatnonzero(sums > 0)
                ids, sums = np.concatenate([best, ids[hit]]), np.concatenate([scores, sums[hit]])
                order = np.lexsort((ids, -np.round(sums, 6)))[:k]
                best, scores = ids[order], sums[order]
            found.append(pd.DataFrame({"qid": qid, "doc_id": best, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "doc_id": [], "score": []})

    return run
