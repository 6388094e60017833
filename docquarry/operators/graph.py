"""Property-graph operators over ``concepts(id, name, description, category, doc)`` and ``relations(source_id, target_id, relation_type)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import dealt, save
from docquarry.operators.retrieval import CELLS, against_all, top_k


def search(concepts: DataFrame, query: str, limit: int = 10, compat: bool = False) -> DataFrame:
    """Concepts whose name or description contains the query, or is contained in it, without regard to case.

    With ``compat`` an empty description is contained in every query, as in the reference.
    """
    q = F.lower(F.lit(query))
    name, text = F.lower("name"), F.lower("description")
    inside = q.contains(text) if compat else (text != "") & q.contains(text)
    return concepts.where(name.contains(q) | text.contains(q) | q.contains(name) | inside).orderBy("name", "id").limit(limit)


def neighbors(concepts: DataFrame, relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct neighbours of ``ids(id)`` in both directions."""
    out = relations.join(ids, relations.source_id == ids.id).select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type", F.lit("out").alias("direction"))
    back = relations.join(ids, relations.target_id == ids.id).select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation_type", F.lit("in").alias("direction"))
    return out.unionByName(back).distinct().join(concepts.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")


def two_hop(relations: DataFrame, seeds: DataFrame, first: int = 5, second: int = 3) -> DataFrame:
    """Nodes one hop (at most ``first`` of a node) and two hops (at most ``second``) from ``seeds(id)``, not visited before."""
    both = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(relations.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).where("a <> b").distinct()
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b")))
    one = ranked.where(F.col("n") <= first).join(seeds, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(seeds, "id", "left_anti")
    two = ranked.where(F.col("n") <= second).join(one, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct().join(seeds, "id", "left_anti").join(one, "id", "left_anti")
    return one.select("id", F.lit(1).alias("hop")).unionByName(two.select("id", F.lit(2).alias("hop")))


def two_hop_by_seed(relations: DataFrame, seeds: DataFrame, first: int = 5, second: int = 3) -> DataFrame:
    """(seed, id, hop): what ``two_hop`` finds from each of ``seeds(id)`` by itself."""
    both = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(relations.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).where("a <> b").distinct()
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b")))
    one = ranked.where(F.col("n") <= first).join(seeds.select(F.col("id").alias("a")).distinct(), "a").select(F.col("a").alias("seed"), F.col("b").alias("id"))
    near = ranked.where(F.col("n") <= second).select("a", "b")
    two = one.select("seed", F.col("id").alias("a")).join(near, "a").select("seed", F.col("b").alias("id")).where("id <> seed").distinct().join(one, ["seed", "id"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def direct_scores(concepts: DataFrame, questions: DataFrame, k: int, least: float = 0.1, most: int = 5_000) -> DataFrame:
    """The ``k`` best chunks of each question by their most similar concept: (qid, chunk_id, score, rank).

    ``concepts(id, chunk_id, embedding)`` meet ``questions(qid, q)`` in blocks of ``most``. Similarities up to ``least`` do not
    count, null vectors match nothing. A frame of concepts gives its ``k`` best chunks for a question, not all pairs.
    """
    known = concepts.where("embedding is not null and chunk_id is not null").select("chunk_id", "embedding")
    found = against_all(known, questions, _best_concepts(least, k), "qid long, chunk_id long, score double", most)
    return top_k(found.groupBy("qid", "chunk_id").agg(F.max("score").alias("score")), k, "chunk_id")


def _best_concepts(least: float, k: int):
    # the best chunk of all has its best concept in some frame, and is among the k best there

    def kernel(qids, q, f):
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        f = f.sort_values("chunk_id")
        x = np.stack([np.asarray(v, np.float64) for v in f.embedding])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        chunk, head = np.unique(f.chunk_id.to_numpy(), return_index=True)
        step = max(1, CELLS // len(x))
        for at in range(0, len(qids), step):
            sim = np.maximum.reduceat(q[at : at + step] @ x.T, head, axis=1)
            best = np.argsort(-np.round(sim, 6), axis=1, kind="stable")[:, :k]
            found = pd.DataFrame({"qid": np.repeat(qids[at : at + step], best.shape[1]), "chunk_id": chunk[best].ravel(), "score": np.take_along_axis(sim, best, 1).ravel()})
            yield found[found.score > least]

    return kernel


def cascade_delete(concepts: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts without ``gone(id)``, and relations without those that touch them."""
    left = concepts.join(gone, "id", "left_anti")
    edges = relations.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti")
    return left, edges


def topological_rounds(tasks: DataFrame) -> DataFrame:
    """Rounds of ``tasks(plan, id, depends_on)``; missing ids count as done, a cycle comes all in one last round.

    What is left after a round is written down, so that the plan of a round does not hold those of all before it.
    """
    edges = save(tasks.select("plan", "id", F.explode("depends_on").alias("dep")).join(tasks.select("plan", F.col("id").alias("dep")), ["plan", "dep"], "left_semi"), "edges")
    left, rounds, n = tasks.select("plan", "id"), [], 0
    while left.take(1):
        open_ = edges.join(left.select("plan", F.col("id").alias("dep")), ["plan", "dep"], "left_semi").select("plan", "id").distinct()
        state = left.join(open_.withColumn("waits", F.lit(True)), ["plan", "id"], "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
        stuck = state.groupBy("plan").agg(F.min("waits").alias("stuck"))
        state = save(state.join(stuck, "plan").withColumn("now", ~F.col("waits") | F.col("stuck")), "round")
        rounds.append(state.where("now").select("plan", "id", F.lit(n).alias("round")))
        left, n = state.where("not now").select("plan", "id"), n + 1
    return reduce(DataFrame.unionByName, rounds) if rounds else left.withColumn("round", F.lit(0))


def undirected(relations: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops and repeats."""
    back = relations.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(back).where("a <> b").distinct()


def saved_edges(relations: DataFrame) -> DataFrame:
    """``undirected(relations)`` written down, its repeats found by tasks of bounded size."""
    ends = save(relations.select("source_id", "target_id").where("source_id <> target_id"), "relations")
    back = ends.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return save(dealt(ends.toDF("a", "b").unionByName(back), 2 * ends.count(), "a", "b").distinct(), "edges")


def communities(relations: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation: in each round a node takes the label that most neighbours have, of several the least.

    Deterministic, in place of the reference's randomised modularity search: communities differ, their use does not.
    """
    return spread(saved_edges(relations), rounds)


def spread(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``communities`` of symmetric ``edges(a, b)`` that are written down. The labels of a round are, too; a task's share of them is hashed, so edges are not sorted."""
    n = edges.count()
    labels = edges.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = dealt(dealt(edges, n, "b").join(labels.withColumnRenamed("id", "b").hint("shuffle_hash"), "b").select("a", "community"), n, "a").groupBy("a", "community").agg(F.count("*").alias("n"))
        new = votes.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("x")).select("id", (-F.col("x.c")).alias("community"))
        new = save(new, "labels")
        changed = new.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").take(1)
        labels = new
        if not changed:
            break
    return labels


def tiers(matches: DataFrame, concepts: DataFrame, relations: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """Graph retrieval: (qid, chunk_id, tier, score, rank) from ``matches(qid, id, sim)`` over ``concepts(id, name, chunk_id, related)``.

    Tiers: 1 chunks of the matches; 2 further chunks of the first 15 (half the similarity); 3 concepts with the name of one of the first 5
    (0.3); 4 up to ten of the community of one of the first 8 (0.6 of it); 5 up to five neighbours of these (0.4); 6 up to
    three neighbours of five so reached (0.12). A chunk has the score of its first tier; a concept reached by tiers 4 to 6 counts once.
    Only the first 15 matches of a question are expanded, so a question reaches a bounded number of concepts. Where the ``k`` best
    chunks of tier 1 all score more, what has the name of a match is not looked up, and chunks of later tiers that score less go.
    """
    known = concepts.select("id", "name", "chunk_id", "related")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("sim", 6).desc(), "id"))
    some = matches.where("sim > 0.1")
    at = concepts.where("chunk_id is not null").select("id", "chunk_id")
    one = some.join(at, "id").groupBy("qid", "chunk_id").agg(F.max("sim").alias("score")).select("qid", "chunk_id", F.lit(1).alias("tier"), "score")
    one = save(top_k(one, k, "chunk_id").drop("rank"), "tier")
    floor = save(one.groupBy("qid").agg(F.count("*").alias("n"), F.min(F.round("score", 6)).alias("floor")).where(F.col("n") == k).drop("n"), "floor")
    first = save(some.withColumn("place", place).where("place <= 15").join(known, "id"), "first")
    top = first.where("place <= 8").select("qid", "id", "sim", "place")
    chunk = lambda rows, tier, score, order: rows.select("qid", "chunk_id", F.lit(tier).alias("tier"), score.alias("score"), order.alias("ord"))
    parts = [first.select("qid", "sim", "place", F.explode("related").alias("chunk_id")).select("qid", "chunk_id", F.lit(2).alias("tier"), (F.col("sim") * 0.5).alias("score"), F.col("place").cast("long").alias("ord"))]
    five = first.where("place <= 5")
    open_ = five.join(floor.where("floor > 0.3"), "qid", "left_anti")
    twins = open_.select("qid", "name", "place").join(known.select("name", "id", "chunk_id"), "name").join(five.select("qid", "id"), ["qid", "id"], "left_anti")
    parts.append(chunk(twins, 3, F.lit(0.3), F.col("place").cast("long")))
    # 4: of each community the first ten members, by the first match in it
    ten = groups.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where("n <= 10").select("community", F.col("id").alias("member"), "n")
    entered = top.join(groups, "id").groupBy("qid", "community").agg(F.min(F.struct("place", "sim")).alias("x")).select("qid", "community", "x.place", "x.sim")
    fourth = entered.join(ten, "community").join(top.select("qid", F.col("id").alias("member")), ["qid", "member"], "left_anti")
    seen = top.select("qid", "id").unionByName(fourth.select("qid", F.col("member").alias("id"))).distinct()
    parts.append(chunk(fourth.join(known.select(F.col("id").alias("member"), "chunk_id"), "member"), 4, F.col("sim") * 0.6, F.col("place") * 100 + F.col("n").cast("long")))
    near = undirected(relations).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b")))
    fifth = top.join(near.where("n <= 5").withColumnRenamed("a", "id"), "id").select("qid", F.col("b").alias("id"), "sim", "place", "n").join(seen, ["qid", "id"], "left_anti")
    fifth = fifth.groupBy("qid", "id").agg(F.min(F.struct("place", "n", "sim")).alias("x")).select("qid", "id", "x.place", "x.n", "x.sim")
    parts.append(chunk(fifth.join(known, "id"), 5, F.col("sim") * 0.4, F.col("place") * 100 + F.col("n").cast("long")))
    reached = seen.unionByName(fifth.select("qid", "id"))
    added = reached.join(top.select("qid", "id"), ["qid", "id"], "left_anti")
    seeds = added.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where("place <= 5")
    sixth = seeds.join(near.where("n <= 3").withColumnRenamed("a", "id"), "id").select("qid", F.col("b").alias("id"), "place", "n").join(reached, ["qid", "id"], "left_anti")
    sixth = sixth.groupBy("qid", "id").agg(F.min(F.struct("place", "n")).alias("x")).select("qid", "id", "x.place", "x.n")
    parts.append(chunk(sixth.join(known, "id"), 6, F.lit(0.12), F.col("place") * 100 + F.col("n").cast("long")))
    best = reduce(DataFrame.unionByName, parts).where("chunk_id is not null").groupBy("qid", "chunk_id").agg(F.min(F.struct("tier", "ord", "score")).alias("x"))
    later = best.select("qid", "chunk_id", "x.tier", "x.score").join(floor, "qid", "left").where("floor is null or round(score, 6) >= floor").drop("floor")
    later = save(later, "later")
    held = some.join(at, "id").join(later.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").select("qid", "chunk_id").distinct()
    return top_k(one.unionByName(later.join(held, ["qid", "chunk_id"], "left_anti")), k, "chunk_id")
