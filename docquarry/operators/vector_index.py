"""A stored vector index: k-means cells with residual codes, searched exactly or by a few cells, and exact similarity joins.

A vector lies in the cell of its nearest centroid and is kept there as one byte a dimension of what it differs from the centroid by,
with the length of the error that leaves. From these follow bounds of each cosine, so that a search reads codes only, and
whole vectors for the few candidates whose bounds reach the k-th best. Cells whose angle bound stays below that are not
read at all. Questions are a table throughout: nothing but centroids is broadcast, whose number is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import folder
from docquarry.operators.retrieval import top_k

#: Cells at most (bounds the broadcast of centroids), rows that k-means learns from for a cell, vectors of a block, questions of a block.
CELLS, LEARN, BLOCK, ASKED = 4_096, 64, 20_000, 4_000
#: Cosines that a task holds at a time.
TILE = 4_000_000
#: Zero vectors have no direction; their cosine is 0 with all.
ZERO = -1
#: Scores are ranked after rounding to six digits, so bounds give way by that.
SLACK = 2e-6


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class VectorIndex:
    """Where an index is stored: ``entries`` by cell (vec_id, block, code, error, embedding), and its cells."""

    path: str
    entries: DataFrame
    cells: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray
    step: float


def _assigned(shared, step: float | None):
    def run(frames):
        centroids = shared.value
        for f in frames:
            f = f[f.embedding.notna()]
            if not len(f):
                continue
            x = _unit(f.embedding)
            sims = x @ centroids.T
            cell = np.where(x.any(axis=1), sims.argmax(axis=1), ZERO)
            base = np.where((cell == ZERO)[:, None], 0.0, centroids[cell])
            out = pd.DataFrame({"vec_id": f.vec_id.to_numpy(), "cell": cell, "angle": np.where(cell == ZERO, 0.0, np.arccos(np.clip((x * base).sum(axis=1), -1, 1))), "spread": np.abs(x - base).max(axis=1)})
            if step is not None:
                code = np.clip(np.round((x - base) / step), -127, 127).astype(np.int8)
                out["error"] = np.linalg.norm(x - base - code * step, axis=1) + 1e-9
                out["code"] = [c.tobytes() for c in code]
                out["embedding"] = f.embedding.to_numpy()
            yield out

    return run


def learn_cells(vectors: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit length from at most ``LEARN`` vectors a cell, those with the least hashes of their ids."""
    some = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").orderBy(F.xxhash64("vec_id")).limit(LEARN * cells)
    rows = some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if not rows.take(1):
        return np.zeros((0, 0))
    if cells < 2:
        return _unit([rows.first().features.toArray()])
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(rows)
    return _unit(model.clusterCenters())


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> VectorIndex | None:
    """Index ``vectors(vec_id, embedding)`` into ``path``, by default a folder of the shared scratch space; None without any vector.

    ``cells`` is the root of the number of vectors if not given. Null vectors are left out. A cell of any size is
    stored in blocks of about ``BLOCK`` vectors, so no task ever holds a whole one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    n = rows.count()
    k = max(1, min(CELLS, cells or math.isqrt(n), n))
    centroids = learn_cells(rows, k)
    if not n:
        return None
    if not len(centroids):
        centroids = np.zeros((1, len(rows.first().embedding)))
    path = path or folder(spark, "vector-index")
    shared = spark.sparkContext.broadcast(centroids)
    measured = rows.mapInPandas(_assigned(shared, None), "vec_id long, cell int, angle double, spread double")
    stats = measured.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.max("spread").alias("spread")).toPandas()
    step = max(float(stats.spread.max()) / 127, 1e-12)
    radii, blocks = np.zeros(len(centroids)), np.zeros(len(centroids) + 1, np.int64)  # the last one: zero vectors
    for r in stats.itertuples():
        blocks[r.cell] = -(-r.n // BLOCK)
        if r.cell != ZERO:
            radii[r.cell] = r.radius + 1e-9
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + F.when(F.col("cell") == ZERO, len(blocks) + 1).otherwise(1)) if len(blocks) <= 256 else None
    coded = rows.mapInPandas(_assigned(shared, step), "vec_id long, cell int, angle double, spread double, error double, code binary, embedding array<double>").drop("angle", "spread")
    if n_blocks is None:
        sizes = spark.createDataFrame([(int(c), int(blocks[c])) for c in range(-1, len(centroids))], "cell int, n_blocks long")
        coded = coded.join(F.broadcast(sizes), "cell")
    else:
        coded = coded.withColumn("n_blocks", n_blocks.cast("long"))
    blocked = coded.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    blocked.repartition("cell", "block").sortWithinPartitions("cell", "block").write.partitionBy("cell").parquet(f"{path}/entries")
    about = spark.createDataFrame([(i, c.tolist(), float(r), int(b)) for i, (c, r, b) in enumerate(zip(centroids, radii, blocks[:-1], strict=True))], "cell int, centroid array<double>, radius double, blocks long")
    about.coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(step, int(blocks[-1]))], "step double, zero_blocks long").coalesce(1).write.parquet(f"{path}/about")
    return load(spark, path)


def load(spark, path: str) -> VectorIndex:
    """An index that ``build`` has stored."""
    cells = spark.read.parquet(f"{path}/cells")
    rows, about = cells.orderBy("cell").collect(), spark.read.parquet(f"{path}/about").first()
    entries = spark.read.schema("vec_id long, block int, error double, code binary, embedding array<double>, cell int").parquet(f"{path}/entries")
    return VectorIndex(path, entries, cells, np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]), np.array([r.blocks for r in rows] + [about.zero_blocks]), about.step)


def _probes(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(qid, q, cell, bound, turn) of all cells that hold vectors: the best cosine a cell can have, and the cell's turn."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.blocks))

    def run(frames):
        centroids, radii, blocks = shared.value
        cells = np.append(np.arange(len(centroids)), ZERO)[blocks > 0]
        for f in frames:
            if not len(f):
                continue
            q = _unit(f.q)
            angle = np.arccos(np.clip(q @ centroids.T, -1, 1))
            bound = np.where(q.any(axis=1)[:, None], np.cos(np.maximum(0.0, angle - radii)), 0.0)
            bound = np.hstack([bound, np.zeros((len(q), 1))])[:, blocks > 0]
            near = np.hstack([angle, np.full((len(q), 1), np.pi)])[:, blocks > 0]
            turn = near.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            m = len(cells)
            yield pd.DataFrame({"qid": np.repeat(f.qid.to_numpy(), m), "cell": np.tile(cells, len(q)), "bound": bound.ravel(), "turn": turn.ravel()})

    return queries.select("qid", "q").mapInPandas(run, "qid long, cell int, bound double, turn int")


def _scored(index: VectorIndex, queries: DataFrame, probes: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(qid, vec_id, low, high): bounds of the cosines in the probed cells, of all that may be among a block's ``k`` best."""
    parts = max(1, -(-n_queries // ASKED))
    centroids, step = index.centroids, index.step
    spread = queries.sparkSession.sparkContext.broadcast(index.blocks)

    def places(frames):
        for f in frames:
            n = spread.value[f.cell.to_numpy()]
            at = np.repeat(np.arange(len(f)), n)
            block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield f.iloc[at].assign(block=block.astype(np.int32))

    asked = probes.select("qid", "cell").mapInPandas(places, "qid long, cell int, block int").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).join(queries.select("qid", "q"), "qid")
    held = index.entries.select("vec_id", "cell", "block", "error", "code").join(F.broadcast(probes.select("cell").distinct()), "cell")  # at most CELLS + 1 rows
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else held.withColumn("part", F.lit(0))

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"qid": [], "vec_id": [], "low": [], "high": []}).astype({"qid": "int64", "vec_id": "int64"})
        cell = int(held.cell.iloc[0])
        x = np.stack([np.frombuffer(c, np.int8) for c in held.code]) * step + (0.0 if cell == ZERO else centroids[cell])
        error, ids, out = held.error.to_numpy(), held.vec_id.to_numpy(), []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            sim = _unit(part.q) @ x.T
            low, high = sim - error, sim + error
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
            i, j = np.nonzero(high >= least[:, None] - SLACK)
            out.append(pd.DataFrame({"qid": part.qid.to_numpy()[i], "vec_id": ids[j], "low": low[i, j], "high": high[i, j]}))
        return pd.concat(out)

    keys = ["cell", "block", "part"]
    return asked.groupBy(keys).cogroup(held.groupBy(keys)).applyInPandas(score, "qid long, vec_id long, low double, high double")


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(qid, least): the k-th best lower bound of each question that has as many."""
    w = Window.partitionBy("qid").orderBy(F.desc("low"))
    return bounds.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).select("qid", F.col("low").alias("least"))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probe: int = 4, exact: bool = True) -> DataFrame:
    """The ``k`` nearest vectors of each of ``queries(qid, q)`` by cosine: (qid, vec_id, score, rank).

    First the ``probe`` nearest cells are read. With ``exact`` all other cells follow whose bound reaches what
    the first ones have shown, so the result is that of a full scan; without, the first cells are all (``recall`` measures what
    that loses). Candidates within the bounds are ranked by their whole vectors. Questions have distinct ids; a zero
    question has cosine 0 with all.
    """
    from docquarry.functions.scratch import save

    queries = save(queries.where("qid is not null and q is not null").select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")), "asked")
    n = queries.count()
    probes = save(_probes(index, queries), "probes")
    bounds = save(_scored(index, queries, probes.where(F.col("turn") < probe), k, n), "bounds")
    if exact:
        more = probes.where(F.col("turn") >= probe).join(_kth(bounds, k), "qid", "left").where(F.col("bound") >= F.coalesce(F.col("least"), F.lit(-2.0)) - SLACK)
        bounds = bounds.unionByName(save(_scored(index, queries, more, k, n), "bounds"))
    kept = bounds.join(_kth(bounds, k), "qid", "left").where(F.col("high") >= F.coalesce(F.col("least"), F.lit(-2.0)) - SLACK).select("qid", "vec_id")
    pairs = kept.join(index.entries.select("vec_id", "embedding"), "vec_id").join(queries, "qid")

    def cosines(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"qid": f.qid, "vec_id": f.vec_id, "score": (_unit(f.embedding) * _unit(f.q)).sum(axis=1)})

    return top_k(pairs.select("qid", "vec_id", "embedding", "q").mapInPandas(cosines, "qid long, vec_id long, score double"), k, "vec_id")


def recall(index: VectorIndex, queries: DataFrame, k: int = 10, probe: int = 4) -> float:
    """Which part of the exact ``k`` nearest the ``probe`` nearest cells show; 1 where there is nothing to find."""
    right = search(index, queries, k)
    found = search(index, queries, k, probe, exact=False).select("qid", "vec_id", F.lit(1).alias("hit"))
    got = right.join(found, ["qid", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).first().r
    return 1.0 if got is None else float(got)


def probes_for(index: VectorIndex, queries: DataFrame, k: int = 10, least: float = 0.95) -> int:
    """The least number of cells, doubled from one on, whose measured recall on ``queries`` reaches ``least``."""
    probe = 1
    while probe < len(index.centroids) and recall(index, queries, k, probe) < least:
        probe *= 2
    return min(probe, len(index.centroids) + 1)


def similar_links(index: VectorIndex, t: float, differ: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b, score) with a < b and a cosine of ``t`` or more (t > 0), exactly.

    With ``differ`` (vec_id, and columns without nulls) only vectors with a row there count, and only pairs that have other values in
    each of its columns; a task compares these itself.

    Two cells are compared only if the angle between their centroids, less both radii, is within that of ``t``; which cells are
    is found from the centroids. Blocks of such cells meet in a task each and hand on nothing but links, so a cell of any
    size is divided, and no pair of rows is ever a row of a table before it is a link.
    """
    spark = index.entries.sparkSession
    if t <= 0:
        raise ValueError("t must be positive")
    shared = spark.sparkContext.broadcast((index.centroids, index.radii, index.blocks))

    def partners(frames):
        centroids, radii, blocks = shared.value
        for f in frames:
            for cell in f.cell:
                angle = np.arccos(np.clip(centroids[cell:] @ centroids[cell], -1, 1))
                near = cell + np.flatnonzero(angle - radii[cell:] - radii[cell] <= math.acos(min(t, 1.0)) + 1e-7)
                rows = [(cell, i, other, j) for other in near.tolist() for i in range(blocks[cell]) for j in range(i if other == cell else 0, blocks[other])]
                if rows:
                    yield pd.DataFrame(rows, columns=["cell", "block", "other", "other_block"])

    tiles = index.cells.select("cell").repartition(64).mapInPandas(partners, "cell int, block int, other int, other_block int")
    others = [] if differ is None else [c for c in differ.columns if c != "vec_id"]
    held = index.entries.where(F.col("cell") != ZERO).select("vec_id", "embedding", "cell", "block")
    if others:
        held = held.join(differ, "vec_id")
    keys = ["cell", "block", "other", "other_block"]
    left = held.join(tiles, ["cell", "block"]).select("vec_id", "embedding", *others, *keys)
    right = held.toDF("vec_id", *held.columns[1:]).withColumnsRenamed({"cell": "other", "block": "other_block"}).join(tiles, ["other", "other_block"]).select("vec_id", "embedding", *others, *keys)

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64", "score": "float64"})]
        if len(a) and len(b):
            x, y, i, j = _unit(a.embedding), _unit(b.embedding), a.vec_id.to_numpy(), b.vec_id.to_numpy()
            same = (a.cell.iloc[0], a.block.iloc[0]) == (b.other.iloc[0], b.other_block.iloc[0])
            step = max(1, TILE // len(y))
            for at in range(0, len(x), step):
                sim = x[at : at + step] @ y.T
                p, q = np.nonzero(sim >= t)
                u, v = i[at + p], j[q]
                keep = u < v if same else u != v
                for c in others:
                    keep &= a[c].to_numpy()[at + p] != b[c].to_numpy()[q]
                out.append(pd.DataFrame({"a": np.minimum(u, v)[keep], "b": np.maximum(u, v)[keep], "score": sim[p, q][keep]}))
        return pd.concat(out)

    left, right = (f.toDF(*f.columns).groupBy(keys) for f in (left, right))
    return left.cogroup(right).applyInPandas(links, "a long, b long, score double")
