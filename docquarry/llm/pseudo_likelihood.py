"""Language-model scoring by masked pseudo-likelihood.

A small window network predicts every word from two words on either side of it: their embeddings are joined, pass a
tanh layer, and give the word's class and the word within its class. All words of the corpus are counted; the most
frequent have an id of their own, all others share the id *rest*, and a rest word costs what the network gives for
*rest* and, on top, its share of all rest words, from a table of counts by 24 bits of the word's hash. So a word that the
corpus does not hold costs more than any that it holds. Every partition trains on all of its documents from the
same start; the weights are averaged by the number of words in a tree through the shared folder. A document's
score is the sum of its words' conditional log-probabilities, or their mean.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import textkit
from docquarry.llm.common import drop, ints, save, shuffle_width, text_slices
from docquarry.llm.tokens import Memo, keys

WINDOW, WIDE, HIDDEN = 2, 8, 16
CELL_BITS = 24
#: Sets of weights that one task averages.
FAN_IN = 16


@dataclass
class Vocabulary:
    """Hashes and counts of the words with an id (from 1 on, by falling counts; 0 is *rest*), and the counts of the others."""

    hashes: np.ndarray
    counts: np.ndarray
    cells: np.ndarray  # by the upper bits of a word's hash: 8 * log2(1 + count)
    n_words: int

    def __post_init__(self):
        self.side = max(2, math.ceil(0.5 + math.sqrt(0.25 + len(self.hashes))))  # side * (side - 1) words and *rest*
        self.rest = max(0, self.n_words - int(self.counts.sum()))
        self.table = None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if self.table is None:  # made once in each worker
            self.table = Memo(max(16, len(self.hashes)))
            self.table.add(self.hashes, self.hashes, np.zeros(0, np.uint32), np.zeros(len(self.hashes), np.int64))
        return self.table.find(hashes, hashes) + 1

    def rest_cost(self, hashes: np.ndarray) -> np.ndarray:
        """Logarithm of the share of each word among all rest words; half a count more for each of the cells."""
        count = np.exp2(self.cells[hashes >> np.uint64(64 - CELL_BITS)] / 8.0) - 1
        return np.log((count + 0.5) / (self.rest + 0.5 * len(self.cells)))


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (between ASCII white space, A-Z as a-z), and where each text's words begin."""
    low = textkit.LOWER[data]
    starts, ends, at = textkit.words(low, offs, textkit.SPACED)
    return (keys(low, starts, ends)[0] if len(starts) else np.zeros(0, np.uint64)), at


def _scatter(buckets: int):
    """The distinct words of each slice with their counts, packed by bucket of the hash: 12 bytes a word instead of a row."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text", 8 << 20):
                word, n = np.unique(_words(data, offs)[0], return_counts=True)
                cut = np.searchsorted(word, np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length()))
                cut = np.append(cut, len(word))
                full = np.flatnonzero(np.diff(cut))
                if len(full):
                    parts = [(word[cut[p] : cut[p + 1]].tobytes(), n[cut[p] : cut[p + 1]].astype(np.uint32).tobytes()) for p in full]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([a for a, _ in parts], pa.binary()), pa.array([b for _, b in parts], pa.binary())], ["p", "words", "counts"])

    return run


def _gather(buckets: int, least: int, most: int):
    """Of each bucket the most frequent words with their counts, the quantised counts of its cells, and all its words' number."""

    def run(batches):
        held, bucket = [], None

        def close():
            word, n = np.concatenate([np.frombuffer(w, np.uint64) for w, _ in held]), np.concatenate([np.frombuffer(c, np.uint32) for _, c in held])
            order = np.argsort(word)
            word, n = word[order], n[order].astype(np.int64)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            word, n = word[head], np.add.reduceat(n, head)
            wide = (1 << CELL_BITS) // buckets
            sums = np.bincount((word >> np.uint64(64 - CELL_BITS)).astype(np.int64) - bucket * wide, n, wide)
            cells = np.minimum(255, np.rint(8 * np.log2(1 + sums))).astype(np.uint8)
            top = np.lexsort((word, -n))[:most]
            top = top[n[top] >= least]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([word[top].view(np.int64)], pa.list_(pa.int64())), pa.array([n[top]], pa.list_(pa.int64())), pa.array([cells.tobytes()], pa.binary()), pa.array([int(n.sum())])], ["p", "words", "counts", "cells", "n"])

        for batch in batches:
            for p, w, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket is not None and p != bucket:
                    yield close()
                    held = []
                bucket = p
                held.append((w.as_py(), c.as_py()))
        if held:
            yield close()

    return run


def count_words(docs: DataFrame, least: int = 4, most: int = 4_032) -> Vocabulary:
    """Count all words of ``docs(text)``. At most ``most`` words, of ``least`` occurrences or more, get an id.

    These and 2^24 bytes of quantised counts reach the driver, whatever the size of the corpus.
    """
    width = shuffle_width(docs.sparkSession)
    buckets = 1 << min(20, (4 * width - 1).bit_length())
    packed = docs.select("text").mapInArrow(_scatter(buckets), "p int, words binary, counts binary").repartition(width, "p").sortWithinPartitions("p")
    found = save(packed.mapInArrow(_gather(buckets, least, most), "p int, words array<long>, counts array<long>, cells binary, n long"), "counts")
    top = found.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.*").orderBy(F.desc("counts"), "words").limit(most).toArrow()
    cells, wide, n = np.zeros(1 << CELL_BITS, np.uint8), (1 << CELL_BITS) // buckets, 0
    for r in found.select("p", "cells", "n").toLocalIterator():
        cells[r.p * wide : (r.p + 1) * wide] = np.frombuffer(r.cells, np.uint8)
        n += r.n
    drop(found)
    hashes = top.column("words").to_numpy().astype(np.int64).view(np.uint64)
    cells[hashes >> np.uint64(64 - CELL_BITS)] = 0
    return Vocabulary(hashes, top.column("counts").to_numpy().astype(np.int64), cells, n)


def places(ids: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id and its place there. *Rest* is alone in class 0, the others are dealt out by frequency."""
    known = ids > 0
    return np.where(known, 1 + (ids - 1) % (side - 1), 0), np.where(known, (ids - 1) // (side - 1), 0)


def start(vocabulary: Vocabulary) -> list[np.ndarray]:
    """Weights before training: embeddings (one more row for the border), hidden layer, classes, words, and biases by counts."""
    side = vocabulary.side
    rng = np.random.Generator(np.random.PCG64(21))
    make = lambda *shape: rng.standard_normal(shape).astype(np.float32) * np.float32(0.1)
    count = np.full((side, side), 0.5)
    count[places(np.arange(len(vocabulary.counts) + 1), side)] += np.append(vocabulary.rest, vocabulary.counts)
    by_class = count.sum(axis=1, keepdims=True)
    return [make(side * side + 1, WIDE), make(2 * WINDOW * WIDE, HIDDEN), make(HIDDEN, side) * 0, make(side, HIDDEN, side) * 0, np.log(by_class[:, 0] / by_class.sum()).astype(np.float32), np.log(count / by_class).astype(np.float32)]


def contexts(ids: np.ndarray, at: np.ndarray, border: int) -> np.ndarray:
    """The ids in the window of each word, ``border`` beyond the text."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    near = np.full((len(ids), 2 * WINDOW), border, np.int64)
    for c, d in enumerate([d for d in range(-WINDOW, WINDOW + 1) if d]):
        a, b = max(0, -d), len(ids) - max(0, d)
        if a < b:
            near[a:b, c] = np.where(of[a:b] == of[a + d : b + d], ids[a + d : b + d], border)
    return near


def _softmax(z: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the targets; ``z`` becomes exponentials, whose sums are the second value."""
    z -= z.max(axis=1, keepdims=True)
    picked = z[rows, target]
    np.exp(z, out=z)
    total = z.sum(axis=1)
    return picked - np.log(total), total


def _gradient(z: np.ndarray, total: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the log-probabilities by the inputs of the softmax, from what ``_softmax`` left."""
    z /= -total[:, None]
    z[rows, target] += 1
    return z


def forward(w: list[np.ndarray], ids: np.ndarray, near: np.ndarray, side: int, rate: float = 0.0) -> np.ndarray:
    """Log-probability of every id; with a ``rate`` one step of gradient ascent on these words follows.

    A step goes by the sum of the gradients over the root of their number: of all words, of a class's, of an embedding's uses.
    """
    emb, hid, cls, inner, cb, wb = w
    kind, word = places(ids, side)
    order = np.argsort(kind, kind="stable")  # the words of a class are neighbours
    kind, word, near = kind[order], word[order], near[order]
    x = emb[near].reshape(len(ids), -1)
    h = np.tanh(x @ hid)
    rows, z = np.arange(len(ids)), h @ cls + cb
    logp, total = _softmax(z, rows, kind)
    if rate:
        g = _gradient(z, total, rows, kind)
        dh, dcls, dcb = g @ cls.T, h.T @ g, g.sum(axis=0)
    cut = np.searchsorted(kind, np.arange(side + 1))
    for c in np.flatnonzero(np.diff(cut)):
        if not c:
            continue  # *rest* is sure within its class
        a, b = cut[c], cut[c + 1]
        mine, z = rows[: b - a], h[a:b] @ inner[c] + wb[c]
        part, total = _softmax(z, mine, word[a:b])
        logp[a:b] += part
        if rate:
            g = _gradient(z, total, mine, word[a:b])
            dh[a:b] += g @ inner[c].T
            step = rate / math.sqrt(b - a)
            inner[c] += step * (h[a:b].T @ g)
            wb[c] += step * g.sum(axis=0)
    if rate:
        step = rate / math.sqrt(len(ids))
        dz = dh * (1 - h * h)
        dx = (dz @ hid.T).reshape(-1, WIDE)
        cls += step * dcls
        cb += step * dcb
        hid += step * (x.T @ dz)
        flat = near.ravel().astype(np.int32)
        place = np.argsort(flat, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(flat[place]) != 0))
        count = np.diff(np.append(head, len(flat)))
        emb[flat[place][head]] += (rate / np.sqrt(count))[:, None].astype(emb.dtype) * np.add.reduceat(dx[place], head)
    out = np.empty(len(ids))
    out[order] = logp
    return out


def _train(shared, rate: float, step: int):
    def run(batches):
        from pyspark import TaskContext

        vocabulary = shared.value
        w, n, side = start(vocabulary), 0, vocabulary.side
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                hashes, at = _words(data, offs)
                ids = vocabulary.ids(hashes)
                near = contexts(ids, at, side * side)
                for a in range(0, len(ids), step):
                    forward(w, ids[a : a + step], near[a : a + step], side, rate)
                n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n]), pa.array([b"".join(x.tobytes() for x in w)], pa.binary())], ["part", "n", "w"])

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    total, n = None, int(rows.n.sum())
    for m, raw in rows.sort_values("part")[["n", "w"]].itertuples(index=False):
        part = np.frombuffer(raw, np.float32) * (m / n)
        total = part if total is None else total + part
    return pd.DataFrame({"part": [int(rows.part.min()) // FAN_IN], "n": [n], "w": [total.astype(np.float32).tobytes()]})


def train(docs: DataFrame, rate: float = 0.04, step: int = 4096) -> tuple[Vocabulary, list[np.ndarray]]:
    """Vocabulary and weights learnt from all words of ``docs(text)``. One set of weights, of bounded size, reaches the driver."""
    vocabulary = count_words(docs)
    w = start(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    made = save(docs.select("text").mapInArrow(_train(shared, rate, step), "part long, n long, w binary"), "weights")
    while (n := made.count()) > 1:
        before, made = made, save(made.groupBy(F.expr(f"part div {FAN_IN}").alias("of")).applyInPandas(_mean, "part long, n long, w binary"), "weights")
        drop(before)
    if n:
        cuts = np.cumsum([x.size for x in w])[:-1]
        w = [x.reshape(y.shape) for x, y in zip(np.split(np.frombuffer(made.first().w, np.float32).copy(), cuts), w, strict=True)]
    drop(made)
    return vocabulary, w


def _score(shared, step: int):
    def run(batches):
        vocabulary, w = shared.value
        side = vocabulary.side
        for batch in batches:
            doc_ids = ints(batch, "doc_id")
            for at, rows, data, offs in text_slices(batch, "text"):
                hashes, begin = _words(data, offs)
                ids = vocabulary.ids(hashes)
                near = contexts(ids, begin, side * side)
                logp = np.concatenate([np.zeros(0), *(forward(w, ids[a : a + step], near[a : a + step], side) for a in range(0, len(ids), step))])
                rest = ids == 0
                logp[rest] += vocabulary.rest_cost(hashes[rest])
                sums = np.append(0.0, np.cumsum(logp))
                total, n = sums[begin[1:]] - sums[begin[:-1]], np.diff(begin)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, rows), pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0)), pa.array(total), pa.array(n)], ["doc_id", "score", "pseudo_log_likelihood", "n_words"])

    return run


def score(docs: DataFrame, model: tuple[Vocabulary, list[np.ndarray]] | None = None, step: int = 32_768) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, score (mean log-probability of a word), pseudo_log_likelihood, n_words.

    Texts without words (null, empty) score 0 with n_words 0. Rows that repeat, or have no id, train and are scored as
    often as they come; whole texts count, however long. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    return docs.mapInArrow(_score(shared, step), "doc_id long, score double, pseudo_log_likelihood double, n_words long")
