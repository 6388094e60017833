"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one node. A first neighbour graph comes from blocks of nodes with equal signs under random
hyperplanes; a label has so many tables of them that a pair at the threshold, with no other neighbour to lead to it,
shares a block in one of them. NN-descent then compares, for every node, its neighbours and reverse neighbours with one
another, and keeps the nearest ``k`` of each node, until hardly any list changes. Whatever is compared and within the
threshold is linked by a spanning forest, so a full list (all ``k`` within the threshold) drops no link between groups;
components are counted in tiles of bounded size, without emitting pairs. An audit compares a bounded set of vectors with
all others of their label; while recall is short, more hyperplane tables are added and the descent goes on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import components, save, shuffle_width

EPS = 1e-12


def nodes(vectors: DataFrame) -> DataFrame:
    """(node, label, dim, copies, vec): one row per distinct usable vector of a label, node being the least id of its copies."""
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(usable).where(fine).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("raw"))
    one = rows.groupBy("label", "raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # by the greatest component first, as squares of very large or small ones leave the range of doubles
    scaled = one.withColumn("top", F.array_max(F.transform("raw", F.abs))).withColumn("even", F.expr("transform(raw, x -> x / top)"))
    normed = scaled.withColumn("norm", F.sqrt(F.aggregate("even", F.lit(0.0), lambda a, x: a + x * x)))
    return normed.select("node", "label", F.size("raw").alias("dim"), "copies", F.expr("transform(even, x -> x / norm)").alias("vec"), "raw")


def _needed(t: float, miss: float, least: int):
    """Tables, by ``bits``, of which a pair at cosine ``t`` shares a block in none with a probability of ``miss`` at most."""
    alike = 1 - math.acos(max(-1.0, min(1.0, t))) / math.pi
    met = F.least(F.pow(F.lit(alike), F.col("bits")), F.lit(1 - 1e-12))
    return F.greatest(F.lit(least), F.ceil(F.lit(math.log(miss)) / F.log1p(-met))).cast("int")


def _signs(seed: int):
    """Add the signs under 32 hyperplanes for each of a node's ``tables`` tables; ``bits`` of them make its block."""

    def run(frames):
        for f in frames:
            out = []
            for dim, g in f.groupby("dim", sort=False):
                x = np.stack(g.vec.to_numpy())
                for t in range(int(g.tables.max())):
                    planes = np.random.Generator(np.random.PCG64([seed, t, int(dim)])).standard_normal((int(dim), 32))
                    has = g.tables.to_numpy() > t
                    signs, bits = ((x[has] @ planes) > 0).astype(np.int64) @ (1 << np.arange(32)), g.bits.to_numpy()[has].astype(np.int64)
                    out.append(pd.DataFrame({"node": g.node[has], "label": g.label[has], "dim": g.dim[has], "t": seed * 100_000 + t, "sign": signs & ((1 << bits) - 1), "rest": signs >> bits}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["node", "label", "dim", "t", "sign", "rest"])

    return run


def _runs(compare, keys: list[str]):
    """Apply ``compare`` to each run of rows with equal ``keys``, over sorted partitions."""

    def run(frames):
        held, key = [], None
        for frame in frames:
            for k, g in frame.groupby(keys, sort=False):
                if key is not None and k != key:
                    yield compare(pd.concat(held))
                    held = []
                key = k
                held.append(g)
        if held:
            yield compare(pd.concat(held))

    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their parents in a spanning forest of the graph of ``near``."""
    parent, seen = np.full(len(near), -1), np.zeros(len(near), bool)
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root], open_ = True, [root]
        while open_:
            at = open_.pop()
            new = np.flatnonzero(near[at] & ~seen)
            parent[new], seen[new] = at, True
            open_.extend(new)
    nodes_ = np.flatnonzero(parent >= 0)
    return nodes_, parent[nodes_]


def _nearest(t: float, floor: float, k: int):
    """The ``k`` nearest of every node within its run, as pairs in both directions, and links that span all pairs within ``t``."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        ids, x = g.node.to_numpy(), np.stack(g.vec.to_numpy())
        u, v, s, near = [], [], [], []
        for at in range(0, len(ids), 512):
            sim = x[at : at + 512] @ x.T
            sim[ids[at : at + 512][:, None] == ids[None]] = -2
            top = np.argpartition(-sim, min(k, len(ids)) - 1, axis=1)[:, :k]
            got = np.take_along_axis(sim, top, 1)
            a, b = np.nonzero(got >= floor)
            u.append(ids[at + a]), v.append(ids[top[a, b]]), s.append(got[a, b]), near.append(sim >= t - EPS)
        u, v, s = map(np.concatenate, (u, v, s))
        a, b = _forest(np.concatenate(near))
        return pd.DataFrame({"u": np.concatenate([u, v, ids[a]]), "v": np.concatenate([v, u, ids[b]]), "s": np.concatenate([s, s, np.full(len(a), 1.0)]), "link": np.repeat([False, True], [2 * len(u), len(a)])})

    return compare


def _top(edges: DataFrame, k: int) -> DataFrame:
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


PAIRS = "u long, v long, s double, link boolean"


def _blocks(base: DataFrame, seed: int, t: float, floor: float, k: int, most: int) -> DataFrame:
    """Pairs and links within blocks of equal signs. Blocks over ``most`` nodes are cut by further signs, which keep near
    pairs together; what is too large even so (near copies of one another) is cut by a hash, the descent joins the parts."""
    width = shuffle_width(base.sparkSession)
    signed = save(base.select("node", "label", "dim", "bits", "tables", "vec").mapInPandas(_signs(seed), "node long, label long, dim int, t int, sign long, rest long"), "signs")
    keys = ["label", "dim", "t", "sign"]
    sizes = signed.groupBy(*keys).agg(F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*") / most))).cast("int").alias("more"))
    finer = signed.join(sizes, keys).withColumn("fine", F.expr("rest & ((1L << least(more, 8)) - 1)")).drop("rest", "more")
    keys = [*keys, "fine"]
    parts = finer.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = finer.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int")).drop("parts")
    full = dealt.join(base.select("node", "vec"), "node")
    keys = [*keys, "part"]
    return full.repartition(width, *keys).sortWithinPartitions(*keys).mapInPandas(_runs(_nearest(t, floor, k), keys), PAIRS)


def _descend(graph: DataFrame, base: DataFrame, t: float, floor: float, k: int) -> DataFrame:
    """One round: neighbours of neighbours of the nodes whose lists have changed."""
    width = shuffle_width(base.sparkSession)
    both = graph.select("u", "v", "s", "fresh").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh"))
    lists = _top(both, 2 * k)
    live = lists.groupBy("u").agg(F.max("fresh").alias("any"), F.count("*").alias("n")).where("any = 1 and n > 1").select("u")
    rows = lists.join(live, "u", "left_semi").select("u", "v").join(base.select(F.col("node").alias("v"), "vec"), "v").select(F.col("u").alias("w"), F.col("v").alias("node"), "vec")
    return rows.repartition(width, "w").sortWithinPartitions("w").mapInPandas(_runs(_nearest(t, floor, k), ["w"]), PAIRS)


def _count_tile(t: float):
    def compare(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g.side == 0], g[g.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "n": [], "m": []})
        x, y = np.stack(a.vec.to_numpy()), np.stack(b.vec.to_numpy())
        near = ((x @ y.T) >= t - EPS) & (a.node.to_numpy()[:, None] != b.node.to_numpy()[None])
        return pd.DataFrame({"node": a.node.to_numpy(), "n": near @ b.copies.to_numpy(), "m": near.sum(axis=1)})

    return compare


def link_counts(members: DataFrame, t: float, tile: int = 1024) -> DataFrame:
    """(node, n, m): the other nodes (m) of its component at cosine ``t`` or more, and their copies (n), for ``members(component, node, copies, vec)``."""
    width = shuffle_width(members.sparkSession)
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    left = spread.select("component", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "node", "copies", "vec")
    right = spread.select("component", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "node", "copies", "vec")
    keys = ["component", "i", "j"]
    tiles = left.unionByName(right).repartition(width, *keys).sortWithinPartitions(*keys)
    return tiles.mapInPandas(_runs(_count_tile(t), keys), "node long, n long, m long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _truth(base: DataFrame, asked: list, t: float) -> DataFrame:
    """(node, true): other nodes of their label at cosine ``t`` or more, for the ``asked`` nodes."""
    shared = base.sparkSession.sparkContext.broadcast([(key, np.array([r.node for r in rows]), np.array([r.vec for r in rows])) for key, rows in _by_label(asked).items()])

    def run(frames):
        for f in frames:
            ids, found = [], []
            mine = {key: rest for key, *rest in shared.value}
            for key, g in f.groupby(["label", "dim"], sort=False):
                if key not in mine:
                    continue
                (nodes_, x), y, other = mine[key], np.stack(g.vec.to_numpy()), g.node.to_numpy()
                for at in range(0, len(nodes_), 256):
                    near = (x[at : at + 256] @ y.T) >= t - EPS
                    near &= nodes_[at : at + 256][:, None] != other[None]
                    n = near.sum(axis=1)
                    ids += nodes_[at : at + 256][n > 0].tolist()
                    found += n[n > 0].tolist()
            yield pd.DataFrame({"node": ids, "true": found}, dtype="int64")

    return base.select("node", "label", "dim", "vec").mapInPandas(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))


def _by_label(rows: list) -> dict:
    out = {}
    for r in rows:
        out.setdefault((r.label, r.dim), []).append(r)
    return out


def linked_sample(base: DataFrame, t: float, most: int = 2048, least: int = 400, batches: int = 8) -> DataFrame:
    """(node, true): nodes that do have a link and how many nodes they link to, each compared with all nodes of its label.

    Nodes are asked in the order of a hash, ``most`` at a time, until ``least`` with a link are found, ``batches`` times at most.
    """
    got, after = None, None
    hashed = base.select(F.xxhash64("node", F.lit(5)).alias("h"), "node", "label", "dim", "vec")
    for _ in range(batches):
        asked = (hashed if after is None else hashed.where(F.col("h") > after)).orderBy("h").limit(most).collect()
        if asked:
            found = save(_truth(base, asked, t), "truth")
            got, after = found if got is None else got.unionByName(found), asked[-1].h
        if len(asked) < most or got.count() >= least:
            break
    return got if got is not None else base.select("node", F.lit(0).cast("long").alias("true")).limit(0)


def audit(sample: DataFrame, counts: DataFrame, least: int = 20) -> float:
    """The least recall over classes of nodes by links (1, 2 to 3, 4 to 7, ...), each the mean of its nodes' recalls.

    Classes of under ``least`` nodes are taken together.
    """
    recall = F.coalesce("m", F.lit(0)) / F.col("true")
    rows = sample.join(counts, "node", "left").groupBy(F.floor(F.log2("true")).alias("size")).agg(F.sum(recall).alias("got"), F.count("*").alias("n")).collect()
    small = [r for r in rows if r.n < least]
    means = [r.got / r.n for r in rows if r.n >= least] + ([sum(r.got for r in small) / sum(r.n for r in small)] if small else [])
    return min(means, default=1.0)


def _with_links(edges: DataFrame | None, pairs: DataFrame) -> DataFrame:
    new = pairs.where("link").select("u", "v")
    return new if edges is None else edges.unionByName(new)


def dedup(vectors: DataFrame, t: float = 0.93, k: int = 12, floor: float = 0.7, tables: int = 6, rounds: int = 4, recall: float = 0.98, tries: int = 4, most: int = 512, miss: float = 0.005) -> DataFrame:
    """Link ``vectors(vec_id, embedding, label)`` of equal label at cosine ``t`` or more.

    Returns one row per input row: vec_id, n_links, component_id, kept. Vectors that are null, zero or hold null or
    non-finite components, and rows without a label or id, link with nothing. Equal vectors are linked with one
    another. Vectors of different length are not compared. Lists do not hold neighbours below ``floor``. A label has
    ``tables`` tables at least, and so many that they miss a lone pair at ``t`` with a probability of ``miss`` at most.
    RuntimeError if the audited recall is under ``recall`` after ``tries`` sets of tables.
    """
    found = save(nodes(vectors), "nodes")
    bits = found.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.count("*") / (most / 2))))).cast("int").alias("bits"))
    bits = bits.withColumn("tables", _needed(t, miss, tables))
    base = save(found.join(F.broadcast(bits) if bits.count() <= 10_000 else bits, ["label", "dim"]).select("node", F.col("label").cast("long").alias("label"), "dim", "bits", "tables", "copies", "vec"), "base")
    sample = linked_sample(base, t)
    graph = edges = None
    for attempt in range(tries):
        got = save(_blocks(base, attempt, t, floor, k, most), "pairs")
        edges = _with_links(edges, got)
        fresh = got.where("not link").select("u", "v", "s", F.lit(1).alias("fresh"))
        graph = save(_top(fresh if graph is None else graph.unionByName(fresh), k), "graph")
        size = graph.count()
        for _ in range(rounds):
            got = save(_descend(graph, base, t, floor, k), "pairs")
            edges = _with_links(edges, got)
            new = got.where("not link").select("u", "v", "s", F.lit(1).alias("fresh"))
            graph = save(_top(graph.withColumn("fresh", F.lit(0)).unionByName(new), k), "graph")
            if graph.where("fresh = 1").count() <= 0.001 * size:
                break
        groups = save(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), "linked"), "groups")
        members = base.join(groups, "node").select("component", "node", "copies", "vec")
        counts = save(link_counts(members, t), "counts")
        reached = audit(sample, counts)
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"embedding dedup: audited recall of links is {reached:.3f} after {tries} sets of tables, {recall} is asked for")
    per_node = found.select("label", "raw", "node", "copies").join(groups, "node", "left").join(counts, "node", "left").select(F.col("label").alias("l"), "raw", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    out = rows.join(per_node, (F.col("vec_id").isNotNull()) & (F.col("label") == F.col("l")) & (F.col("e") == F.col("raw")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
