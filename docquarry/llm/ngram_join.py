"""Exact n-gram Jaccard join in a metric space.

The metric is the symmetric difference D(A, B) = |A - B| + |B - A| of two shingle sets;
two sets of Jaccard similarity t or more are at most (1 - t) / (1 + t) * (|A| + |B|) apart.

1. *Rings.* The empty set is the first pivot, D(A, {}) = |A|. Sizes fall into rings; by the
   triangle inequality a set can only reach the ring below, and boundary sets are replicated there.
2. *Cells or prefixes.* From similarity 0.85 on, every ring cuts the shingle space into more cells than a
   linked pair can differ in, so such a pair has equal traces in some cells; the region of (ring, cell, trace) holds both.
   Where that is g cells or more, the g - 1 with the fewest shingles, which unrelated texts share most, are left out.
   Sets with so many empty cells that only those may agree also join the regions of their prefix.
   Below, traces would be too short to tell texts apart, and prefixes are used alone: all shingles have one order, known frequent ones last. Of two linked sets the first
   |A| - ceil(t |A|) + 1 shingles have one in common; the region of (ring, shingle) holds both. Any order
   is exact; this one keeps passages that many documents share out of the prefixes. A region of few sets names its
   pairs, a larger one (a crowd) is searched by sketches within a task; sets that sizes and sketches show to be apart
   do not merge regions, so a chance shingle or trace chains nothing. Of copies only one joins regions.
3. *Voronoi regions.* Regions that share sets are merged. Each picks document pivots. What lies in the ball of radius
   r = 1 - t around a pivot is linked with it at once. Every set goes to the region of its nearest pivot and,
   within the window d(x, p) <= d(x, nearest) + 2 r of the Jaccard distance, to others; sets farther than
   3 r from all pivots, with the boundary sets down to 2 r, form the region outside. The regions are divided again
   in the same way until all of their sets are linked or were pivots. A region of up to ``most`` sets is divided within
   one task (``forest``), a larger one by all tasks: there, pivots that are linked with one another
   share a region, and a ball member stays only if the nearest set out of the ball can reach it.
4. *Tiles.* A region that no longer shrinks (sets that are all about as far from one another) is compared directly.

Plain Voronoi regions at the first level would be useless: unrelated texts have distance 1 from
every pivot and would be replicated everywhere. Steps 1 and 2 bring the work down
to sets which agree somewhere; no pair that qualifies is lost in any step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import textkit
from docquarry.llm.common import bit_table, clean, components, drop, give_back, in_bits, ints, maybe_in, released, save, shuffle_width, text_slices

RING = 1.5
#: Similarity from which regions come from cells: their traces hold about five shingles there, at 0.8 only two.
CELLS_FROM = 0.85
#: Rows of a table of region names and counts up to which it is broadcast (some 20 MB); beyond, it is joined by a shuffle.
LIGHT = 200_000
#: Sets of a region up to which its pairs are named, and up to which a larger one is searched; beyond, it keeps its sets together.
FEW, CROWD = 16, 20_000
#: What ``_gather`` hands on: a pair to be tried, a sure edge, a set (b) of a crowd (a).
TRY, SURE, MEMBER = 0, 1, 2


def _rings(t: float, longest: int = 1 << 40) -> np.ndarray:
    """The least size of every ring; a ring spans a factor of 1 / t or more."""
    lows = [1]
    while lows[-1] < longest:
        lows.append(max(lows[-1], math.ceil(lows[-1] * max(RING, 1 / t)) - 1) + 1)
    return np.array(lows)


def sketches(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each set, the parities of its shingles' numbers in cells: a power of two of them, about one a shingle, 256 at least.

    Sketches of two sets differ in no more cells than the sets in shingles. Half the cells result from folding the halves by
    exclusive or, so sketches of different length compare.
    """
    size = np.diff(begin)
    cells = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(1, 0.6 * size))).astype(np.int64))
    base = np.cumsum(cells) - cells
    of = np.repeat(np.arange(len(size)), size)
    place = base[of] + (textkit.mix(sets + textkit.STEP[56]) & (cells[of] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=int(cells.sum())) & 1, bitorder="little").tobytes()
    return [raw[a // 8 : (a + b) // 8] for a, b in zip(base.tolist(), cells.tolist(), strict=True)]


def sketch_distance(a: bytes, b: bytes) -> int:
    """The number of cells in which two sketches differ."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def _profile(n: int, sketched: bool):
    def run(batches):
        for batch in released(batches):
            ids = ints(batch, "doc_id")
            for at, rows, data, offs in text_slices(batch, "text"):
                sets, begin = textkit.shingle_sets(data, offs, n)
                one, two = textkit.set_digests(sets, begin)
                out = {"doc_id": ids.slice(at, rows), "n_shingles": pa.array(np.diff(begin)), "d1": pa.array(one), "d2": pa.array(two)}
                if sketched:
                    out["sketch"] = pa.array(sketches(sets, begin), pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def profiles(docs: DataFrame, n: int, sketched: bool = False) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): size and digest of each document's set of ``n``-word shingles, with its ``sketch`` if asked for."""
    return docs.select("doc_id", "text").mapInArrow(_profile(n, sketched), "doc_id long, n_shingles long, d1 long, d2 long" + ", sketch binary" * sketched)


def _frequent(n: int):
    """Shingles that two documents of a slice or more hold, with their number."""

    def run(batches):
        for batch in released(batches):
            for _, _, data, offs in text_slices(batch, "text", 4 << 20):
                value, count = np.unique(textkit.shingle_sets(data, offs, n)[0], return_counts=True)
                many = count > 1
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(count[many])], ["value", "n"])

    return run


def frequent(docs: DataFrame, n: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` shingles (16 bytes each) with the highest counts, ascending by hash, and their counts.

    They only order the shingles: a list that is cut or incomplete costs time, not links.
    """
    counted = docs.select("text").mapInArrow(_frequent(n), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "value").limit(most).toArrow()
    value = top.column("value").to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], top.column("n").to_numpy()[order]


def _prefix_keys(sets: np.ndarray, begin: np.ndarray, t: float, lows: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Region keys by prefixes of the sets, and the number of the set that each belongs to."""
    size = np.diff(begin)
    of = np.repeat(np.arange(len(size)), size)
    count = np.zeros(len(sets), np.int64)
    if len(hot[0]) and len(sets):
        place = np.minimum(np.searchsorted(hot[0], sets), len(hot[0]) - 1)
        count = np.where(hot[0][place] == sets, hot[1][place], 0)
    order = np.lexsort((sets, count, of))
    prefix = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
    taken = np.arange(len(sets)) - begin[:-1][of] < prefix[of]
    value, of = sets[order][taken], of[taken]
    own = np.searchsorted(lows, size, "right") - 1
    down = (own > 0) & (np.ceil(size * t - 1e-9) < lows[np.maximum(own, 0)])
    also = down[of]
    ring = np.concatenate([own[of], own[of[also]] - 1]).astype(np.uint64)
    return textkit.mix(np.concatenate([value, value[also]]) + textkit.STEP[55] * (ring + np.uint64(1))), np.concatenate([of, of[also]])


def _cell_keys(sets: np.ndarray, begin: np.ndarray, t: float, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Region keys by cells of the shingle space, and the number of the set that each belongs to."""
    size = np.diff(begin)
    diff_most = np.floor((1 - t) / t * (np.append(lows[1:], lows[-1] * 2) - 1) + 1e-9).astype(np.int64)
    own = np.searchsorted(lows, size, "right") - 1
    down = (own > 0) & (np.ceil(size * t - 1e-9) < lows[np.maximum(own, 0)])
    which = np.concatenate([np.flatnonzero(size > 0), np.flatnonzero((size > 0) & down)])
    ring = np.concatenate([own[size > 0], own[(size > 0) & down] - 1])
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    diff = diff_most[ring]
    cells = diff + np.maximum(1, -(-diff // 4))
    n = size[which]
    first = np.cumsum(n) - n
    value = sets[np.repeat(begin[:-1][which] - first, n) + np.arange(int(n.sum()))]
    of = np.repeat(np.arange(len(which)), n)
    base = np.cumsum(cells) - cells
    # sets are ascending, so cells cut by the high bits are runs of them
    cell = base[of] + ((value >> np.uint64(32)) * cells[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    trace = np.add.reduceat(textkit.mix(value + textkit.STEP[53]), head)
    salt = textkit.mix((ring[of[head]] * (1 << 32) + cell[head] - base[of[head]]).astype(np.uint64) + textkit.STEP[54])
    keys, owner = textkit.mix(trace ^ salt), which[of[head]]
    full = np.bincount(of[head], minlength=len(which))
    # linked sets agree in cells - diff or more, of which no more are empty than either has; the last of these in one order is in both
    spare = np.maximum(0, cells - diff - 1 - (cells - full))
    order = np.lexsort((keys, np.diff(np.append(head, len(value))), of[head]))
    kept = order[np.arange(len(head)) - np.repeat(np.cumsum(full) - full, full) >= spare[of[head]]]
    keys, owner = keys[kept], owner[kept]
    prefixes, owners = [], []
    for i in np.flatnonzero(cells - full >= cells - diff):
        k = n[i] - math.ceil(t * n[i] - 1e-9) + 1
        prefixes.append(textkit.mix(value[first[i] : first[i] + k] + textkit.STEP[55:56] * np.uint64(ring[i] + 1)))
        owners.append(np.full(k, which[i]))
    return np.concatenate([keys, *prefixes]), np.concatenate([owner, *owners])


def _scatter(n: int, t: float, buckets: int, shared, firsts):
    """Region keys, packed by bucket of the key: 8 bytes a key and 4 a reference instead of a row each.

    Of copies only the representative has keys; ``firsts`` is a bit table of those, which may let others through.
    """
    lows = _rings(t)

    def run(batches):
        for batch in released(batches):
            ids = ints(batch, "doc_id")
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            known &= in_bits(firsts.value, ids)
            for at, rows, data, offs in text_slices(batch, "text", 4 << 20):
                sets, begin = textkit.shingle_sets(data, offs, n)
                one, two = textkit.set_digests(sets, begin)
                keep, named = np.zeros(rows, bool), np.flatnonzero(known[at : at + rows])
                if len(named):  # one of equal sets is enough: the digests join the others
                    keep[named[np.unique(np.stack([one, two])[:, named], axis=1, return_index=True)[1]]] = True
                keys, owner = _cell_keys(sets, begin, t, lows) if t >= CELLS_FROM else _prefix_keys(sets, begin, t, lows, shared.value)
                live = keep[owner]
                keys, owner = keys[live], owner[live]
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, owner, cut = keys[order], owner[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(buckets + 1))
                own = ids[at : at + rows]
                out = []
                for p in np.flatnonzero(np.diff(cut)):
                    docs, ref = np.unique(owner[cut[p] : cut[p + 1]], return_inverse=True)
                    out.append((int(p), keys[cut[p] : cut[p + 1]].tobytes(), ref.astype(np.int32).tobytes(), own[docs].tobytes()))
                if out:
                    p, k, r, d = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.binary()), pa.array(r, pa.binary()), pa.array(d, pa.binary())], ["p", "keys", "refs", "docs"])

    return run


def _gather(few: int, crowd: int):
    """Rows (a, b, kind) that keep each region together; a bucket's packed keys are sorted at once.

    Those of a region of up to ``few`` documents are all of its pairs, to be tried one by one; of one of up to ``crowd``, its
    members; of a larger one, sure edges from its least document to the others.
    """

    def close(keys: list, ids: list) -> pa.RecordBatch:
        k, d = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        k, d = k[once], d[once]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(begin, len(k)))
        held, least = np.repeat(count, count), np.repeat(d[begin], count)
        star, member, small = (held > crowd) & (least != d), (held > few) & (held <= crowd), held <= few
        a, b, kind = [least[star], k[member].view(np.int64)], [d[star], d[member]], [np.full(int(star.sum()), SURE), np.full(int(member.sum()), MEMBER)]
        for step in range(1, few):
            at = np.flatnonzero(small[:-step] & (k[step:] == k[:-step]))
            a, b, kind = [*a, d[at]], [*b, d[at + step]], [*kind, np.full(len(at), TRY)]
        a, b, kind = map(np.concatenate, (a, b, kind))
        order = np.lexsort((b, a, kind))
        a, b, kind = a[order], b[order], kind[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])])[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(kind[new], pa.int32())], ["a", "b", "kind"])

    def run(batches):
        keys, ids, bucket = [], [], None
        for batch in batches:
            for p, k, r, d in zip(*(batch.column(i) for i in range(4)), strict=True):
                if bucket is not None and p.as_py() != bucket:
                    yield close(keys, ids)
                    keys, ids = [], []
                bucket = p.as_py()
                keys.append(np.frombuffer(k.as_py(), np.uint64))
                ids.append(np.frombuffer(d.as_py(), np.int64)[np.frombuffer(r.as_py(), np.int32)])
        if keys:
            yield close(keys, ids)

    return run


def _apart(t: float):
    """Of pairs with sizes and sketches, those whose sketches differ in no more cells than linked sets may in shingles."""
    share = (1 - t) / (1 + t)

    def run(batches):
        for batch in batches:
            most = share * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            near = [x is None or y is None or sketch_distance(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return run


def _folded(x: np.ndarray) -> np.ndarray:
    """Sketches, as rows of words, of half as many cells."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def crowd_forest(size: np.ndarray, drawn: list[bytes], t: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph of those sets whose sizes and sketches allow a similarity of ``t``."""
    share, m = (1 - t) / (1 + t), len(size)
    order = np.argsort(size, kind="stable")
    size = size[order]
    words = np.array([len(drawn[i]) // 8 for i in order])  # ascending, as sizes are
    lengths, first = np.unique(words, return_index=True)
    last = np.append(first[1:], m)
    tables = [np.frombuffer(b"".join(drawn[i] for i in order[a:b]), np.uint64).reshape(b - a, w) for a, b, w in zip(first, last, lengths, strict=True)]
    low, high = np.searchsorted(size, t * size - 1e-6), np.searchsorted(size, (size + 1e-6) / t, "right")
    half = [None] * len(tables)  # each with half its cells, made when it is asked for
    open_, found, left = np.ones(m, bool), [], m
    for start in range(m):
        if not open_[start]:
            continue
        open_[start], left, queue = False, left - 1, [start]
        while queue and left:
            x = queue.pop()
            mine = int(np.searchsorted(lengths, words[x]))
            row = tables[mine][x - first[mine]][None]
            for c in range(max(0, mine - 1), min(len(lengths), mine + 2)):  # linked sets have sketches of one length or of twice that
                a, b = max(first[c], low[x]), min(last[c], high[x])
                at = a + np.flatnonzero(open_[a:b]) if a < b else np.zeros(0, np.int64)
                if not len(at):
                    continue
                if lengths[c] > words[x]:
                    half[c] = _folded(tables[c]) if half[c] is None else half[c]
                    apart = half[c][at - first[c]] ^ row
                else:
                    apart = tables[c][at - first[c]] ^ (row if lengths[c] == words[x] else _folded(row))
                near = at[np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= share * (size[at] + size[x]) + 1e-6]
                open_[near] = False
                left -= len(near)
                queue += near.tolist()
                found += [(int(order[x]), int(order[y])) for y in near]
    return found


def _crowds(t: float):
    """Edges of ``crowd_forest`` of each crowd, a run of rows (crowd, doc_id, size, sketch); one without a sketch meets all others."""

    def close(parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts)
        ids, size = rows.column("doc_id").to_numpy(), rows.column("size").fill_null(0).to_numpy()
        drawn = rows.column("sketch").to_pylist()
        clear = np.array([x is not None for x in drawn])
        one = np.flatnonzero(clear)
        found = [(one[x], one[y]) for x, y in crowd_forest(size[one], [drawn[i] for i in one], t)] if len(one) else []
        found += [(x, y) for x in np.flatnonzero(~clear) for y in range(len(ids)) if y != x]
        a, b = (ids[[int(p[i]) for p in found]] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        parts, key = [], None
        for batch in released(batches):
            rows = pa.Table.from_batches([batch])
            crowd = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], crowd[1:] != crowd[:-1]])) if len(crowd) else np.zeros(0, np.int64)
            for at, end in zip(cut, np.append(cut[1:], len(crowd)), strict=True):
                if parts and crowd[at] != key:
                    yield close(parts)
                    parts = []
                key = crowd[at]
                parts.append(rows.slice(at, end - at))
        if parts:
            yield close(parts)

    return run


def possible(near: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The edges (a, b) of ``near(a, b, kind)`` that are sure, or whose sets can be linked by ``sets(doc_id, n_shingles, sketch)``, and those of crowds.

    An id that comes with several texts has no one sketch; its pairs all stay.
    """
    open_, members = near.where(F.col("kind") == TRY).select("a", "b").distinct(), near.where(F.col("kind") == MEMBER).select(F.col("a").alias("crowd"), F.col("b").alias("doc_id"))
    ends = open_.select(F.col("a").alias("doc_id")).unionByName(open_.select(F.col("b").alias("doc_id"))).unionByName(members.select("doc_id")).distinct()
    of = F.struct("n_shingles", "sketch")
    known = sets.where("n_shingles > 0").join(ends, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(of).alias("x"), F.max(of).alias("y"))
    one = F.col("x") == F.col("y")
    known = save(known.select("doc_id", F.when(one, F.col("x.n_shingles")).alias("size"), F.when(one, F.col("x.sketch")).alias("sketch")), "sketches")
    sized = lambda end: known.select(F.col("doc_id").alias(end), F.col("size").alias(f"n_{end}"))
    drawn = lambda end: known.select(F.col("doc_id").alias(end), F.col("sketch").alias(f"s_{end}"))
    close = F.coalesce(F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b") - 1e-6, F.lit(True))
    pairs = open_.join(sized("a"), "a").join(sized("b"), "b").where(close | F.col("n_a").isNull() | F.col("n_b").isNull())
    pairs = pairs.join(drawn("a"), "a").join(drawn("b"), "b").select("a", "b", F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)), "s_a", "s_b")
    crowds = members.join(known, "doc_id").select("crowd", "doc_id", "size", "sketch").repartition(shuffle_width(near.sparkSession), "crowd").sortWithinPartitions("crowd")
    edges = near.where(F.col("kind") == SURE).select("a", "b").unionByName(pairs.mapInArrow(_apart(t), "a long, b long")).unionByName(crowds.mapInArrow(_crowds(t), "a long, b long"))
    out = save(edges.distinct(), "possible")
    drop(known)
    return out


def search(members: list[np.ndarray], t: float, only: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which sets of Jaccard similarity ``t`` or more are linked.

    ``only`` = (k, n) links just the first k sets with the others, for tiles.
    """
    m = len(members)
    size = np.array([len(s) for s in members])
    begin = np.concatenate([[0], np.cumsum(size)])
    _, flat = np.unique(np.concatenate(members) if m else np.zeros(0, np.uint64), return_inverse=True)
    order = np.argsort(size, kind="stable")
    of = np.repeat(np.arange(m), size)
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    open_ = np.ones(m, bool)
    side = np.arange(m) < only[0] if only else None
    forest: list[tuple[int, int]] = []
    rest_flat, rest_of = flat, of
    removed = 0
    for start in order:
        if not open_[start]:
            continue
        open_[start] = False
        queue = [int(start)]
        while queue:
            x = queue.pop()
            removed += 1
            if removed * 4 > m:  # drop what has been reached from the arrays to be scanned
                live = open_[rest_of]
                rest_flat, rest_of, removed = rest_flat[live], rest_of[live], 0
            mine = flat[begin[x] : begin[x + 1]]
            mark[mine] = True
            common = np.bincount(rest_of[mark[rest_flat]], minlength=m)
            mark[mine] = False
            near = open_ & (common >= t * (size + size[x] - common) - 1e-9)
            if side is not None:
                near &= side != side[x]
            for y in np.flatnonzero(near):
                forest.append((x, int(y)))
                queue.append(int(y))
            open_ &= ~near
    return forest


def forest(members: list[np.ndarray], t: float, pivots: int = 8) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which sets of Jaccard similarity ``t`` or more are linked, by recursive Voronoi regions.

    Pivots are picked one after the other as the set farthest from all earlier ones, until all lie in some ball.
    """
    r = 1 - t
    size = np.array([len(s) for s in members])
    begin = np.concatenate([[0], np.cumsum(size)])
    _, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *members]), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    group, links, work = np.arange(len(members)), [], 0
    regions = [np.arange(len(members))]

    def direct(at: np.ndarray) -> None:
        for a, b in search([members[i] for i in at], t):
            if group[at[a]] != group[at[b]]:
                links.append((int(at[a]), int(at[b])))
                group[group == group[at[b]]] = group[at[a]]

    while regions:
        at = regions.pop()
        if len(np.unique(group[at])) < 2:
            continue
        work += len(at)
        if work > 8 * len(members):  # windows that hold most of every region: the division does not pay
            direct(np.arange(len(members)))
            break
        values = flat[np.repeat(begin[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(int(size[at].sum()))]
        of = np.repeat(np.arange(len(at)), size[at])
        near, far, next_ = np.full(len(at), 2.0), [], 0
        while len(far) < min(pivots, len(at)) and near[next_] > r + 1e-9:
            p = at[next_]
            mark[flat[begin[p] : begin[p + 1]]] = True
            both = np.bincount(of[mark[values]], minlength=len(at))
            mark[flat[begin[p] : begin[p + 1]]] = False
            union = size[at] + size[p] - both
            for x in at[both >= t * union - 1e-9]:
                if group[x] != group[p]:
                    links.append((int(p), int(x)))
                    group[group == group[x]] = group[p]
            far.append(1 - both / union)
            near = np.minimum(near, far[-1])
            next_ = int(near.argmax())
        if len(far) == len(at):  # every set was a pivot
            continue
        parts = [at[(d <= near + 2 * r + 1e-9) & (near <= 3 * r + 1e-9)] for d in far]
        parts.append(at[near > 2 * r - 1e-9])
        if sum(map(len, parts)) <= 1.5 * len(at):
            regions += parts
        else:
            direct(at)
    return links


def _sets_of(texts: pd.Series, n: int, most: int = 2 << 20) -> list[np.ndarray]:
    """The shingle set of each text; texts of up to ``most`` bytes together are hashed at once, so long ones need no more memory."""
    sets, held, size = [], [], 0

    def close() -> None:
        offs = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        flat, begin = textkit.shingle_sets(np.frombuffer(b"".join(held), np.uint8), offs, n)
        sets.extend(flat[begin[i] : begin[i + 1]].copy() for i in range(len(held)))
        held.clear()

    for raw in (x.encode("utf-8", "surrogatepass") for x in texts):
        if held and size + len(raw) > most:
            close()
            size = 0
        held.append(raw)
        size += len(raw)
    if held:
        close()
    return sets


def _join(n: int, t: float):
    """Join each region (a run of rows with the same key; side 1 meets side 0 only in tiles)."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "side"]).sort_values(["side", "doc_id"])
        ids, tile = rows.doc_id.to_numpy(), rows.tile.to_numpy()[0]
        sets = _sets_of(rows.text, n)
        found = search(sets, t, (int((rows.side == 0).sum()), len(rows))) if tile else forest(sets, t)
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    def run(frames):
        held, key = [], None
        for frame in frames:
            for k, rows in frame.groupby("region", sort=False):
                if key is not None and k != key:
                    yield close(pd.concat(held))
                    held = []
                key = k
                held.append(rows)
            give_back()
        if held:
            yield close(pd.concat(held))

    return run


def _join_regions(rows: DataFrame, n: int, t: float) -> DataFrame:
    """``rows``: (region, tile, side, doc_id, text)."""
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "region").sortWithinPartitions("region")
    return dealt.select("region", "tile", "side", "doc_id", "text").mapInPandas(_join(n, t), "a long, b long")


def _groups(pivots: list[np.ndarray], t: float) -> np.ndarray:
    """The group of every pivot: those connected by links among the pivots have the same."""
    group = np.arange(len(pivots))
    for a, b in search(pivots, t):
        group[group == group[b]] = group[a]
    return group


def _voronoi(n: int, t: float):
    """Links with the pivots of a region, and the regions of the next level that its sets go to.

    Runs of (region, salt) begin with the pivots (kind 0). Rows with ``pivot`` are links, the others have a region.
    """
    r = 1 - t

    def place(region: str, pivots: list[np.ndarray], pivot_ids: list[int], rows: pd.DataFrame) -> pd.DataFrame:
        members = _sets_of(rows.text, n)
        size = np.array([len(x) for x in members])
        flat, begin = np.concatenate(members), np.cumsum(size) - size
        far = np.empty((len(pivots), len(members)))
        for k, p in enumerate(pivots):
            both = np.add.reduceat(np.isin(flat, p).astype(np.int64), begin)
            far[k] = 1 - both / (size + len(p) - both)
        group = _groups(pivots, t)
        names = np.unique(group)
        near = np.stack([far[group == g].min(axis=0) for g in names])
        least = near.min(axis=0)
        ids, texts, seen, held = (rows[c].to_numpy() for c in ("doc_id", "text", "closed", "held"))
        out = []
        for k, x in zip(*np.nonzero(far <= r + 1e-9), strict=True):
            out.append((None, ids[x], None, None, None, pivot_ids[k], None))
        for k in range(len(pivots)):  # linked pivots are linked with one another, too
            first = int(np.flatnonzero(group == group[k])[0])
            if first != k:
                out.append((None, pivot_ids[k], None, None, None, pivot_ids[first], None))
        for g, x in zip(*np.nonzero((near <= least + 2 * r + 1e-9) & (least <= 3 * r + 1e-9)), strict=True):
            inside = near[g, x] <= r + 1e-9
            out.append((f"{region}.{names[g]}", ids[x], texts[x], bool(inside or seen[x]), None if inside else near[g, x], None, held[x]))
            if inside:
                out[-1] = (*out[-1][:4], -near[g, x], *out[-1][5:])
        for x in np.flatnonzero(least > 2 * r - 1e-9):
            out.append((f"{region}.out", ids[x], texts[x], bool(seen[x]), 9.0, None, held[x]))
        return pd.DataFrame(out, columns=["region", "doc_id", "text", "closed", "d", "pivot", "was"]).astype({"doc_id": "Int64", "pivot": "Int64", "was": "Int64"})

    def run(frames):
        key, pivots, ids = None, [], []
        for f in frames:
            for k, g in f.groupby(["region", "salt"], sort=False):
                if k != key:
                    key, pivots, ids = k, [], []
                is_pivot = g.kind == 0
                pivots += _sets_of(g.text[is_pivot], n)
                ids += g.doc_id[is_pivot].tolist()
                if not is_pivot.all():
                    yield place(k[0], pivots, ids, g[~is_pivot])

    return run


def _region_links(found: DataFrame, n: int, t: float, most: int, pivots: int = 8, depth: int = 4) -> DataFrame:
    """Links of all regions ``found`` (region, doc_id, text; a saved table), cutting those of more than ``most`` documents.

    A region is joined in tiles at ``depth``, if it has hardly fewer sets than the one it was cut from, or if its own
    regions would hold one and a half times its sets or more (sets that are all near one another).
    """
    width = shuffle_width(found.sparkSession)
    old, links = found, []
    found = found.select("region", "doc_id", "text", F.lit(False).alias("closed"), F.lit(None).cast("long").alias("was"), F.lit(False).alias("whole"))
    for level in range(depth + 1):
        large = save(found.groupBy("region").agg(F.count("*").alias("held"), F.max("was").alias("was"), F.max("whole").alias("whole")).where(F.col("held") > most), "regions")
        # every large region has up to ``pivots`` regions of its own and a rest, which bounds all tables of regions below
        light = F.broadcast if large.count() * (pivots + 1) <= LIGHT else lambda df: df
        small = found.join(light(large), "region", "left_anti").select("region", F.lit(0).alias("tile"), F.lit(0).alias("side"), "doc_id", "text")
        stuck = F.lit(level == depth) | F.col("whole") | F.coalesce(F.col("held") > 0.9 * F.col("was"), F.lit(False))
        tiles = large.where(stuck).select("region", F.ceil(F.col("held") * 2 / most).cast("int").alias("k"))
        blocks = found.join(light(tiles), "region").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
        blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        blocks = blocks.select(F.concat_ws("/", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), (F.col("block") != F.col("other")).cast("int").alias("tile"), (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "text")
        links.append(save(_join_regions(small.unionByName(blocks), n, t), "links"))
        clean(found.sparkSession)
        cut = large.where(~stuck).select("region", "held", F.ceil(F.col("held") / 500).cast("int").alias("salts"))
        if not cut.take(1):
            drop(old)
            break
        rows = found.drop("was", "whole").join(light(cut), "region")
        # pivots: sets outside of earlier balls first, then by hash; a bounded aggregate that combines before the shuffle
        first = F.struct("closed", F.xxhash64("doc_id", F.lit(level + 99)).alias("h"), "doc_id", "text").alias("s")
        picked = rows.select("region", "salts", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(pivots)).alias("slot"), first).groupBy("region", "salts", "slot").agg(F.min("s").alias("s"))
        dealt = picked.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "s.doc_id", "s.text", F.lit(False).alias("closed"), F.lit(0).cast("long").alias("held"))
        dealt = dealt.unionByName(rows.select("region", F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "text", "closed", "held"))
        dealt = dealt.repartition(width, "region", "salt").sortWithinPartitions("region", "salt", "kind", "doc_id")
        placed = save(dealt.mapInPandas(_voronoi(n, t), "region string, doc_id long, text string, closed boolean, d double, pivot long, was long"), "voronoi")
        clean(found.sparkSession)
        links.append(save(placed.where("pivot is not null and pivot <> doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), "links"))
        # d of ball members is negative; the nearest other set decides which of them can have a link out of the ball
        reach = placed.where("pivot is null and d > 0").groupBy("region").agg(F.min("d").alias("nearest"))
        kept = placed.where("pivot is null").join(light(reach), "region").where((F.col("d") > 0) | (-F.col("d") >= F.col("nearest") - (1 - t) - 1e-9))
        kept = kept.select("region", "doc_id", "text", "closed", "was", F.expr("substring_index(region, '.', -1)").alias("last"))
        kept = kept.withColumn("parent", F.expr("substring(region, 1, length(region) - length(last) - 1)"))
        poor = kept.groupBy("parent").agg(F.count("*").alias("n"), F.max("was").alias("held")).where(F.col("n") >= 1.5 * F.col("held")).select("parent")
        parts = kept.join(light(poor), "parent", "left_anti").select("region", "doc_id", "text", "closed", "was", F.lit(False).alias("whole"))
        again = rows.join(light(poor.withColumnRenamed("parent", "region")), "region", "left_semi").select("region", "doc_id", "text", "closed", F.col("held").alias("was"), F.lit(True).alias("whole"))
        found = save(parts.unionByName(again), "found")
        drop(old, placed)
        old = found
    out = links[0]
    for part in links[1:]:
        out = out.unionByName(part)
    return out


def join(docs: DataFrame, n: int = 5, t: float = 0.8, most: int = 1000, buckets: int | None = None) -> DataFrame:
    """Group ``docs(doc_id, text, ...)`` by links of Jaccard similarity ``t`` or more between sets of ``n``-word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id. Texts without words
    and null texts have an empty set and are alone, with their own id. Rows without an id take no part
    in links unless another row has an equal set; they are alone otherwise (null component).
    Equal sets are one node; rows that repeat are returned as often as they come.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or 4 * shuffle_width(docs.sparkSession)
    sets = save(profiles(docs, n, True), "sets")
    with_words = sets.where("n_shingles > 0")
    rep = save(with_words.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, n)) if t < CELLS_FROM else None
    firsts = docs.sparkSession.sparkContext.broadcast(bit_table(rep, "rep"))
    packed = docs.mapInArrow(_scatter(n, t, buckets, hot, firsts), "p int, keys binary, refs binary, docs binary")
    near = packed.repartition(shuffle_width(docs.sparkSession), "p").sortWithinPartitions("p").mapInArrow(_gather(FEW, CROWD), "a long, b long, kind int")
    tried = save(near, "near")
    near = possible(tried, sets, t)
    drop(tried)
    to_rep = with_words.join(rep, ["d1", "d2"]).select("doc_id", "rep").where("doc_id is not null").distinct()
    ends = near.select("a").unionByName(near.select(F.col("b").alias("a"))).distinct()
    known = save(ends.join(to_rep, ends.a == to_rep.doc_id).select("doc_id", "rep"), "ends")
    edges = near.join(known.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    regions = save(components(edges, "candidates"), "candidates")
    drop(near, known)
    # only texts that are in some region are shuffled
    likely = maybe_in(docs, regions.select(F.col("node").alias("doc_id"))).where("dq_maybe").drop("dq_maybe")
    found = save(likely.join(regions, likely.doc_id == regions.node).select(F.col("component").cast("string").alias("region"), "doc_id", "text"), "found")
    clean(docs.sparkSession)
    links = _region_links(found, n, t, most)
    # an id may come with several texts: only links between representatives count
    groups = components(links.join(rep.select(F.col("rep").alias("a")), "a", "left_semi"), "groups")
    named = rep.join(groups, rep.rep == groups.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """``docs`` without those that are not the least id of their group; rows without words, and rows without an id, all stay.

    Of rows with the same id the least one, by columns from left to right, stays. Rows whose id is surely neither
    dropped nor repeated pass without a shuffle.
    """
    groups = save(join(docs, n, t), "groups")
    known = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("first"))
    touched = save(known.where("n > 1 or first = 0").select("doc_id", (F.col("first") == 1).alias("dq_first")), "touched")
    marked = maybe_in(docs, touched.select("doc_id"))
    sure = marked.where("doc_id is null or not dq_maybe").select(docs.columns)
    near = marked.where("doc_id is not null and dq_maybe").drop("dq_maybe").join(touched, "doc_id", "left").where("dq_first is null or dq_first")
    once = near.where("dq_first is null").select(docs.columns)
    least = near.where("dq_first").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("dq_row")).select("dq_row.*")
    return sure.unionByName(once).unionByName(least)
