"""K-d tree sharding by distributed weighted medians (DataFrame operations only).

Coordinates come from each text's metadata: logarithm of its bytes, bytes per character, and white
space per character. A node that should hold k leaves is split along its widest dimension at the weighted
median that gives k // 2 leaves their share of the bytes, until every leaf holds the target. Ties are ordered by a
hash of the text and then of the id: equal texts are neighbours and stay together, unless their group is
heavier than the tolerance, then it is divided. Medians are found by histograms that are
refined until the bucket on the border is light; each has at most ``nodes * BINS`` rows whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import save

BINS = 256
#: Bits of a sort key: coordinate, hash of the text, hash of the id.
BITS = (20, 24, 18)
KEY = 1 << sum(BITS)
TEXT = 1 << BITS[2]
DIMS = ("d0", "d1", "d2")
OVERHEAD = 16
#: A group of equal texts up to so many times the tolerance stays whole on one side of a cut.
WHOLE_GROUP = 15


@dataclass
class Node:
    first: int  # its first leaf
    leaves: int
    weight: float = 0.0
    dim: str = ""
    cut: int = 0


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates, all in 0 .. 2^20 - 1, with hashes that order ties."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes, chars = F.octet_length(text).cast("long"), F.char_length(text)
    spaces = chars - F.char_length(F.translate(text, " \n\t\r", ""))
    top = (1 << BITS[0]) - 1
    scaled = lambda x: F.least(F.lit(top), F.greatest(F.lit(0), F.floor(x * top))).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n_bytes + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        scaled(F.log2(n_bytes + 1.0) / 40).alias("d0"),
        scaled(F.when(chars > 0, (n_bytes / chars - 1) / 3).otherwise(0.0)).alias("d1"),
        scaled(F.when(chars > 0, spaces / chars).otherwise(0.0)).alias("d2"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - BITS[1]).alias("t"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 64 - BITS[2]).alias("r"),
    )


def _key(dim: str) -> Column:
    return (F.col(dim) * (1 << BITS[1]) + F.col("t")) * TEXT + F.col("r")


def _params(rows: DataFrame, nodes: dict[int, Node], low: dict, high: dict, step: dict) -> DataFrame:
    """A table of at most as many rows as there are shards, which is the bound of its broadcast."""
    values = ", ".join(f"({i}, {DIMS.index(n.dim)}, {low[i]}L, {high[i]}L, {step[i]}L)" for i, n in nodes.items())
    return F.broadcast(rows.sparkSession.sql(f"select * from values {values} as p(node, dim, lo, hi, st)"))


def _place(tree: list[dict[int, Node]]) -> Column:
    """The node of a row after all splits made so far: one comparison for each inner node, nested as the tree is."""

    def at(i: int, depth: int) -> Column:
        n = tree[depth].get(i) if depth < len(tree) else None
        if n is None:
            return F.lit(i)
        return F.when(_key(n.dim) < n.cut, at(2 * i + 1, depth + 1)).otherwise(at(2 * i + 2, depth + 1))

    return at(0, 0)


def _split(rows: DataFrame, nodes: dict[int, Node], tolerance: float) -> None:
    """Find dim and cut of each node of this level."""
    extent = rows.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(d).alias(f"{d}_lo") for d in DIMS], *[F.max(d).alias(f"{d}_hi") for d in DIMS]).collect()
    low, high, aim, below = {}, {}, {}, {}
    for i, n in nodes.items():
        e = next((x for x in extent if x.node == i), None)
        n.weight = float(e.w) if e else 0.0
        n.dim = max(DIMS, key=lambda d: e[f"{d}_hi"] - e[f"{d}_lo"]) if e else DIMS[0]
        unit = KEY >> BITS[0]
        low[i], high[i] = (e[f"{n.dim}_lo"] * unit, (e[f"{n.dim}_hi"] + 1) * unit) if e else (0, 1)
        aim[i], below[i] = n.weight * (n.leaves // 2) / n.leaves, 0.0
        n.cut = high[i]
    todo = {i for i, n in nodes.items() if n.weight}
    while todo:
        at = {i: nodes[i] for i in todo}
        step = {i: max(1, -(-(high[i] - low[i]) // BINS)) for i in todo}
        if any(s >= TEXT for s in step.values()):  # whole groups of equal texts, as long as that is fine enough
            step = {i: -(-s // TEXT) * TEXT if s >= TEXT else s for i, s in step.items()}
        key = (F.when(F.col("dim") == 0, F.col("d0")).when(F.col("dim") == 1, F.col("d1")).otherwise(F.col("d2")) * (1 << BITS[1]) + F.col("t")) * TEXT + F.col("r")
        inside = rows.join(_params(rows, at, low, high, step), "node").select("node", "lo", "hi", "st", "size", key.alias("key"))
        got = inside.where("key >= lo and key < hi").groupBy("node", F.expr("cast((key - lo) div st as int)").alias("bin")).agg(F.sum("size").alias("w")).collect()
        for i in list(todo):
            bins = sorted((x.bin, float(x.w)) for x in got if x.node == i)
            for b, w in bins:
                if below[i] + w >= aim[i]:
                    start = low[i] + b * step[i]
                    if step[i] == 1 or w <= tolerance or (step[i] == TEXT and w <= WHOLE_GROUP * tolerance):
                        over = below[i] + w - aim[i] > aim[i] - below[i]
                        nodes[i].cut = start if over else start + step[i]
                        todo.discard(i)
                    else:
                        low[i], high[i] = start, start + step[i]
                    break
                below[i] += w
            else:
                todo.discard(i)


def build(rows: DataFrame, shards: int, tolerance: float = 0.002) -> tuple[list[dict[int, Node]], dict[int, int]]:
    """The tree over measured rows, level by level, and the shard of each leaf."""
    tree: list[dict[int, Node]] = []
    level, leaf_of = {0: Node(0, shards)}, {}
    target = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    while level:
        inner = {i: n for i, n in level.items() if n.leaves > 1}
        leaf_of |= {i: n.first for i, n in level.items() if n.leaves == 1}
        if not inner:
            break
        _split(rows.withColumn("node", _place(tree)), inner, tolerance * target)
        tree.append(inner)
        level = {}
        for i, n in inner.items():
            left = n.leaves // 2
            level[2 * i + 1], level[2 * i + 2] = Node(n.first, left), Node(n.first + left, n.leaves - left)
    return tree, leaf_of


def shard(docs: DataFrame, shards: int = 40, slot_rows: int = 20_000) -> DataFrame:
    """Deal all ``docs(doc_id, text)`` to ``shards`` shards of nearly equal bytes (law ``bytes``).

    Returns doc_id, size (UTF-8 bytes and 16; null text: 16), text_crc32, law, shard, slot (gapless from 0 in
    each shard) and grown_shard (null). Null and empty texts, null ids and repeated rows are
    dealt like others; an empty table gives no rows.
    """
    rows = save(measured(docs), "measured")
    tree, leaf_of = build(rows, shards)
    node = F.create_map(*[F.lit(x) for pair in leaf_of.items() for x in pair])[F.col("node")]
    dealt = rows.withColumn("node", _place(tree)).select("doc_id", "size", "text_crc32", node.alias("shard"), "t", "r")
    # slots: small blocks within a shard, so that no task orders a whole shard
    n = rows.count()
    blocks = max(16, -(-n // (shards * slot_rows)))
    dealt = save(dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", F.expr("coalesce(sum(n) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    slot = F.expr("row_number() over (partition by shard, block order by doc_id, text_crc32)")
    out = dealt.withColumn("rank", slot).join(before, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
