"""Top-k retrieval (keyword, overlap, vector) and rank fusion as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.scratch import save

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """Rank by score (rounded to 6 digits, ties by id) within ``qid`` and keep ``k``."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, where=None, most: int = 20_000, held: int = 5_000) -> DataFrame:
    """BM25 of ``queries(qid, text)`` over ``docs(doc_id, text)``; statistics over all docs, ``where`` filters what is ranked.

    A term that repeats in a query counts each time. Queries are dealt into blocks of ``most`` and documents into slices of about
    ``held``; a task adds up the scores of one block in one slice and hands on the ``k`` best of each query, so that no
    pair of a query and a document is shuffled. Only postings of query terms reach the slices.
    """
    q = save(queries.where("qid is not null").select("qid", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")), "asked")
    tokens = docs.select("*", T.terms(F.col("text")).alias("terms"))
    stats = tokens.agg(F.count("*").alias("n"), (F.sum(F.size("terms")) / F.greatest(F.lit(1), F.count("*"))).alias("avgdl"))
    kept = F.lit(True) if where is None else where
    of_docs = tokens.select("doc_id", kept.alias("kept"), F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = of_docs.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("kept").alias("kept"))
    tf = save(tf, "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = tf.where("kept").join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    count = lambda f, c, size: max(1, -(-f.select(c).distinct().count() // size))
    blocks, slices = count(q, "qid", most), count(tf, "doc_id", held)
    deal = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("block", deal(blocks, "qid")).withColumn("slice", every(slices)).groupBy("block", "slice")
    right = hits.select("doc_id", "term", part.alias("part"), deal(slices, "doc_id").alias("slice")).withColumn("block", every(blocks)).groupBy("block", "slice")
    kinds = f"qid {dict(q.dtypes)['qid']}, doc_id {dict(docs.dtypes)['doc_id']}, score double"
    return top_k(left.cogroup(right).applyInPandas(_best_sums(k), kinds), k)


def _best_sums(k: int):
    """Of each query the ``k`` documents with the greatest sums of its terms' parts, ties by id."""

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        found = {"qid": [], "doc_id": [], "score": []}
        if not len(q) or not len(f):
            return pd.DataFrame(found)
        f = f.sort_values(["term", "doc_id"])
        ids, place = np.unique(f.doc_id.to_numpy(), return_inverse=True)
        part = f.part.to_numpy()
        names, head = np.unique(f.term.to_numpy(object), return_index=True)
        ends = dict(zip(names, zip(head, [*head[1:], len(f)], strict=True), strict=True))
        for qid, terms in q[q.term.isin(ends)].groupby("qid", sort=False):
            sums = np.zeros(len(ids))
            for term, n in zip(terms.term, terms.qtf, strict=True):
                a, b = ends[term]
                sums[place[a:b]] += n * part[a:b]
            score = np.round(sums, 6)
            hit = np.flatnonzero(sums > 0)
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
            best = hit[np.argsort(-score[hit], kind="stable")[:k]]
            found["qid"].append(np.full(len(best), qid))
            found["doc_id"].append(ids[best])
            found["score"].append(sums[best])
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in found.items()})

    return run


def jaccard(docs: DataFrame, queries: DataFrame, k: int = 10, most: int = 20_000, held: int = 5_000) -> DataFrame:
    """Jaccard similarity of token sets through an inverted index; only documents that share a token are scored.

    Queries are dealt into blocks of ``most`` and documents into slices of about ``held``, as in ``bm25``: a task counts the common tokens of
    one block with one slice and hands on the ``k`` best of each query, so pairs are not shuffled. Tokens travel as numbers.
    """
    known = lambda f, c: F.coalesce(F.col(c), F.lit("0").cast(f.schema[c].dataType)).alias(c)
    sets = lambda f, c, n: f.select(c, T.token_set(F.col("text")).alias("s")).select(known(f, c), F.col(c).isNull().alias(f"no_{c}"), F.size("s").alias(n), F.explode("s").alias("token"))
    q = save(sets(queries, "qid", "nq"), "asked")
    numbers = save(q.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "tokens")
    blocks, slices = (max(1, -(-f.count() // size)) for f, size in ((queries, most), (docs, held)))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.join(numbers, "token").drop("token").withColumn("block", deal(blocks, "qid", "nq")).withColumn("slice", every(slices))
    right = sets(docs, "doc_id", "nd").join(numbers, "token").drop("token").withColumn("slice", deal(slices, "doc_id", "nd")).withColumn("block", every(blocks))
    left, right = (f.toDF(*f.columns).groupBy("block", "slice") for f in (left, right))  # both have columns of ``numbers``
    kinds = f"qid {dict(q.dtypes)['qid']}, no_qid boolean, doc_id {dict(docs.dtypes)['doc_id']}, no_doc_id boolean, score double"
    found = left.cogroup(right).applyInPandas(_best_overlaps(k), kinds)
    own = lambda c: F.when(~F.col(f"no_{c}"), F.col(c)).alias(c)
    return top_k(found.select(own("qid"), own("doc_id"), "score"), k)


def _best_overlaps(k: int):
    """Of each query the ``k`` documents with the greatest share of common tokens, ties by id, one without an id first."""

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(f):
            f = f.sort_values(["no_doc_id", "doc_id", "nd"], ascending=[False, True, True])
            new = (f[["no_doc_id", "doc_id", "nd"]] != f[["no_doc_id", "doc_id", "nd"]].shift()).any(axis=1).to_numpy()
            place, docs, nd = np.cumsum(new) - 1, f[new], f.nd.to_numpy()[new]
            order = np.argsort(f.number.to_numpy(), kind="stable")
            number, place = f.number.to_numpy()[order], place[order]
            lo, hi = (np.searchsorted(number, q.number.to_numpy(), side) for side in ("left", "right"))
            for (qid, none, nq), at in q.groupby(["qid", "no_qid", "nq"], sort=False).indices.items():
                both = np.bincount(np.concatenate([place[x:y] for x, y in zip(lo[at], hi[at], strict=True)]), minlength=len(nd))
                hit = np.flatnonzero(both)
                score = both[hit] / (nq + nd[hit] - both[hit])
                best = np.argsort(-np.round(score, 6), kind="stable")[:k]
                at = docs.iloc[hit[best]]
                found.append(pd.DataFrame({"qid": qid, "no_qid": none, "doc_id": at.doc_id.to_numpy(), "no_doc_id": at.no_doc_id.to_numpy(), "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["qid", "no_qid", "doc_id", "no_doc_id", "score"])

    return run


def against_all(rows: DataFrame, questions: DataFrame, kernel, schema: str, most: int = 5_000, held: int = 8_000) -> DataFrame:
    """What ``kernel(qids, vectors of the questions, frame of rows)`` gives for all of ``questions(qid, q)`` with all of ``rows``.

    Up to ``most`` questions are broadcast. More are dealt into blocks and the rows into slices of about ``held``; a task gets
    one block with one slice, so that no questions pass the driver and no task holds more. Null questions ask nothing.
    """
    asked = questions.where("qid is not null and q is not null").select("qid", "q")
    blocks = -(-asked.count() // most)
    stack = lambda f: (f.qid.to_numpy(), np.array(f.q.tolist(), np.float64))
    if blocks <= 1:
        shared = rows.sparkSession.sparkContext.broadcast(stack(asked.toPandas()))
        return rows.mapInPandas(lambda frames: (found for f in frames if len(f) and len(shared.value[0]) for found in kernel(*shared.value, f)), schema)
    slices = max(1, -(-rows.count() // held))
    part = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", part(blocks, "qid")).withColumn("slice", every(slices)).groupBy("block", "slice")
    right = rows.withColumn("slice", part(slices, *rows.columns)).withColumn("block", every(blocks)).groupBy("block", "slice")
    names = [c.split()[0] for c in schema.split(",")]

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        found = list(kernel(*stack(q), f)) if len(q) and len(f) else []
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    return left.cogroup(right).applyInPandas(run, schema)


#: Cells of a table of similarities that a task holds at a time.
CELLS = 1_000_000


def _nearest(k: int, digits: int, last: bool):
    """The ``k`` nearest rows of a frame for every question, by rounded cosine, ties by id (the ``last`` or the first of them)."""

    def kernel(qids, q, f):
        f = f.sort_values("vec_id", ascending=not last)
        x = np.stack([np.asarray(v, np.float64) for v in f.embedding])
        norm, ids = np.linalg.norm(x, axis=1), f.vec_id.to_numpy()
        step = max(1, CELLS // len(ids))
        for at in range(0, len(qids), step):
            part = q[at : at + step]
            scale = np.linalg.norm(part, axis=1)[:, None] * norm[None]
            sim = np.divide(part @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0)
            best = np.argsort(-np.round(sim, digits), axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"qid": np.repeat(qids[at : at + step], best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(sim, best, 1).ravel()})

    return kernel


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, most: int = 5_000) -> DataFrame:
    """Exact cosine top-k of ``queries(qid, q)`` over ``vectors(vec_id, embedding)``, in blocks of at most ``most`` queries.

    Each frame of vectors gives no more than ``k`` rows for a query. Null vectors match nothing, a zero vector has cosine 0 with all.
    """
    known = vectors.where("embedding is not null").select("vec_id", "embedding")
    return top_k(against_all(known, queries, _nearest(k, 6, False), "qid long, vec_id long, score double", most), k, "vec_id")


def dense_last_of_ties(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, most: int = 5_000) -> DataFrame:
    """As ``dense`` with scores rounded to ``digits``, of equal ones the greatest id first, as a reversed ascending sort gives them."""
    known = vectors.where("embedding is not null").select("vec_id", "embedding")
    got = against_all(known, queries, _nearest(k, digits, True), "qid long, vec_id long, score double", most)
    return last_of_ties(got.withColumn("score", F.round("score", digits)), k, "vec_id")


def last_of_ties(scored: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """As ``top_k``, but of equal scores the last item comes first, as a reversed ascending sort gives them."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), F.col(item).desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = 10, item: str = "vec_id") -> DataFrame:
    """(Weighted) reciprocal rank fusion of ``ranked(qid, item, source, rank)``: sum of weight / (60 + rank), rank from 1."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    scored = ranked.groupBy("qid", item).agg(F.sum(weight / (60 + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return top_k(scored, k, item)


def supplement(ranked: DataFrame, order: list[str], item: str = "vec_id") -> DataFrame:
    """Union of candidate lists where an item counts for the first source in ``order`` that has it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    w = Window.partitionBy("qid", item).orderBy(place, "rank")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
