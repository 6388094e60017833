"""Communities by modularity: local moves by gain, then contraction, level by level, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.scratch import dealt, save
from docquarry.operators.graph import saved_edges

#: Gains that count; neighbours of a row.
LEAST, NEAR = 1e-9, 4_096


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``labels(id, community)`` on symmetric ``edges(a, b, w)``; a loop is one row of twice its weight. 0 without edges."""
    total = edges.agg(F.sum("w").alias("w")).first().w
    if not total:
        return 0.0
    of = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    n = edges.count()
    both = dealt(dealt(edges, n, "a").join(of("a"), "a"), n, "b").join(of("b"), "b")
    each = both.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    return float(each.agg(F.sum(F.col("inner") / total - (F.col("tot") / total) ** 2).alias("q")).first().q)


def best_moves(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community, target, gain): of each node the neighbouring community with the greatest gain of modularity, ties to the least."""
    total = edges.agg(F.sum("w").alias("w")).first().w or 1.0
    near, nodes = _adjacent(edges)
    return _offers(near, _held(nodes.join(labels, "id")), total).where(F.col("gain") > LEAST).select("id", "community", "target", "gain")


def _adjacent(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours as arrays, (b, near(a, w, degree)), of at most about ``NEAR`` entries a row, and nodes(id, degree, loop)."""
    loop = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))
    nodes = save(edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"), loop.alias("loop"), F.count("*").alias("n")), "nodes")
    of_a = nodes.select(F.col("id").alias("a"), "degree")
    of_b = nodes.select(F.col("id").alias("b"), F.ceil(F.col("n") / NEAR).alias("parts"))
    split = edges.where("a <> b").join(of_a, "a").join(of_b, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    near = split.groupBy("b", "part").agg(F.collect_list(F.struct("a", "w", "degree")).alias("near")).select("b", "near")
    return save(near, "near"), nodes.drop("n")


def _held(nodes: DataFrame) -> DataFrame:
    """``nodes(id, degree, loop, community)`` with the degrees of all members of the community as ``tot``."""
    tot = nodes.groupBy("community").agg(F.sum("degree").alias("tot"))
    return save(nodes.join(tot, "community").select("id", "community", "degree", "loop", "tot"), "held")


def _offers(near: DataFrame, held: DataFrame, total: float) -> DataFrame:
    """(id, community, degree, loop, tot, own, target, gain): weight of each node within its community, and its best move, if any.

    Each node sends its community along its edges, and to itself with weight 0; weights of one community add up where they arrive, so
    the edges are shuffled to their senders and to their receivers, and no more.
    """
    sent = near.join(held.select(F.col("id").alias("b"), F.col("community").alias("target"), "tot"), "b")
    sent = sent.select("target", "tot", F.explode("near").alias("x")).select(F.col("x.a").alias("id"), "target", "tot", F.col("x.w").alias("w"), F.col("x.degree").alias("degree"), F.lit(None).cast("double").alias("loop"))
    mine = held.select("id", F.col("community").alias("target"), "tot", F.lit(0.0).alias("w"), "degree", "loop")
    rows = sent.unionByName(mine).repartition("id")
    inner = rows.groupBy("id", "target").agg(F.sum("w").alias("inner"), F.max("tot").alias("tot"), F.max("degree").alias("degree"), F.max("loop").alias("loop"))
    own = F.col("loop").isNotNull()  # only what a node sends to itself has one
    value = F.round((F.col("inner") - F.col("degree") * F.col("tot") / total) * 2 / total, 12)
    of_own = lambda c: F.max(F.when(own, F.col(c)))
    each = inner.groupBy("id").agg(of_own("target").alias("community"), F.max("degree").alias("degree"), F.max("loop").alias("loop"), of_own("tot").alias("tot"), of_own("inner").alias("own"), F.max(F.when(~own, F.struct(value.alias("value"), (-F.col("target")).alias("t")))).alias("x"))
    stay = (F.col("own") - F.col("degree") * (F.col("tot") - F.col("degree")) / total) * 2 / total
    return each.select("id", "community", "degree", "loop", "tot", "own", (-F.col("x.t")).alias("target"), F.round(F.col("x.value") - stay, 12).alias("gain"))


def _settled(edges: DataFrame, rounds: int, total: float) -> tuple[DataFrame, bool]:
    """Rounds of moves that all nodes make at once, at first each node by itself. Moves made together can spoil each other: where a
    round does not pay, a part of the nodes, chosen by a hash, moves; then ever smaller ones.

    One pass over the edges gives the modularity of a round's labels and the moves of the next round.
    """

    def offers(labelled: DataFrame) -> tuple[DataFrame, float]:
        found = save(_offers(near, _held(labelled), total), "offers")
        q = found.agg(F.sum((F.col("own") + F.col("loop")) / total - F.col("degree") * F.col("tot") / total**2).alias("q")).first().q
        return found, float(q or 0.0)

    near, nodes = _adjacent(edges)
    state, q = offers(nodes.withColumn("community", F.col("id")))
    moved, part = False, 1
    for n in range(rounds):
        goes = (F.col("gain") > LEAST) & (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(part)) == 0)
        new, value = offers(state.select("id", F.when(goes, F.col("target")).otherwise(F.col("community")).alias("community"), "degree", "loop"))
        if value > q + LEAST:
            state, q, moved = new, value, True
            part = max(1, part // 2)
        elif part >= 8 or not state.where(F.col("gain") > LEAST).take(1):
            break
        else:
            part *= 2
    return state.select("id", "community"), moved


def communities(relations: DataFrame, rounds: int = 12, levels: int = 8) -> DataFrame:
    """(id, community = least member) of the nodes of ``relations(source_id, target_id)``: in levels, nodes move to the neighbouring
    community that gains most, then each community becomes one node. No level lowers the modularity; the result is
    deterministic. Loops and repeated relations do not count, null ends are left out; an empty table gives no rows.
    """
    plain = saved_edges(relations.where("source_id is not null and target_id is not null"))
    edges = save(plain.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(1.0).alias("w")), "edges")
    nodes = save(edges.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    level, total = edges, float(edges.count()) or 1.0  # contraction keeps the sum of all weights
    for _ in range(levels):
        labels, moved = _settled(level, rounds, total)
        if not moved:
            break
        nodes = save(nodes.withColumnRenamed("community", "at").join(labels.withColumnRenamed("id", "at"), "at").select("id", "community"), "labels")
        of = lambda end: labels.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))  # noqa: B023, E731
        level = save(level.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "edges")
    least = nodes.groupBy("community").agg(F.min("id").alias("least"))
    return nodes.join(least, "community").select("id", F.col("least").alias("community"))
