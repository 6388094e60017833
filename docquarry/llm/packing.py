"""Sum-of-squares online packing of token sequences.

Each partition keeps the number of open sequences at every fill level. A document goes to
the level whose use leaves the least sum of squared counts (a new sequence is level 0). What stays
open in the end is filled up from the emptiest, by cutting; a last open sequence is
cut into lengths that are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import released, text_slices
from docquarry.llm.tokens import encoder


class Packer:
    """Pieces are (document, start, length); ``done`` holds full sequences as lists of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open sequences at each level
        self.open: dict[int, list[list]] = {}
        self.done: list[list] = []

    def place(self, piece: tuple[int, int, int]) -> None:
        doc, start, length = piece
        while length >= self.size:  # whole sequences of a long document
            self.done.append([(doc, start, self.size)])
            start, length = start + self.size, length - self.size
        if not length:
            return
        level = self.level(length)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        else:
            held = []
        held.append((doc, start, length))
        if level + length == self.size:
            self.done.append(held)
        else:
            self.open.setdefault(level + length, []).append(held)
            self.count[level + length] += 1

    def level(self, length: int) -> int:
        """The level h with the least change of the sum of squares when an open sequence goes from h to h + length.

        A new sequence (level 0) takes nothing away, a full one leaves the sum. Of equal changes the highest level counts.
        """
        c = self.count
        used = np.flatnonzero(c[1 : self.size - length + 1]) + 1
        change = 2 * (c[used + length] - c[used]) + 2
        if len(used) and used[-1] + length == self.size:
            change[-1] = 1 - 2 * c[used[-1]]
        best = change.min(initial=np.iinfo(np.int64).max)
        return int(used[np.flatnonzero(change == best)[-1]]) if best <= 2 * c[length] + 1 else 0

    def shrink(self, most: int) -> None:
        """Fill the fullest open sequences with cut pieces of the emptiest until ``most`` are open."""
        left = [[level, held] for level in sorted(self.open, reverse=True) for held in self.open[level]]
        high, low = 0, len(left) - 1
        while high < low and low - high + 1 > most:
            room = self.size - left[high][0]
            while room and high < low:
                doc, start, length = left[low][1].pop()
                take = min(room, length)
                left[high][1].append((doc, start, take))
                room -= take
                if take < length:
                    left[low][1].append((doc, start + take, length - take))
                left[low][0] -= take
                if not left[low][0]:
                    low -= 1
            left[high][0] = self.size - room
            if not room:
                self.done.append(left[high][1])
                high += 1
        self.open, self.count[:] = {}, 0
        for level, held in left[high : low + 1]:
            self.open.setdefault(level, []).append(held)
            self.count[level] += 1

    def finish(self) -> None:
        """Close all open sequences; only the last one is not full, and is cut into powers of two."""
        self.shrink(1)
        for held in [held for level in self.open.values() for held in level]:
            self._powers(held)
        self.open, self.count[:] = {}, 0

    def _powers(self, pieces: list) -> None:
        total = sum(p[2] for p in pieces)
        for bit in range(self.size.bit_length(), -1, -1):
            want = total & 1 << bit
            held = []
            while want:
                doc, start, length = pieces.pop()
                take = min(want, length)
                held.append((doc, start, take))
                want -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            if held:
                self.done.append(held)


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _trimmed(doc_id: int | None, size: int, begin: int, tokens: np.ndarray, low: int, high: int) -> tuple[int | None, int, int, np.ndarray]:
    """A document's ids from ``low`` to ``high``, in memory of their own."""
    return (doc_id, size, begin, tokens) if high - low == len(tokens) else (doc_id, size, low, tokens[low - begin : high - begin].copy())


def _pack(path: str, end: int, size: int, window: int):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        packer, held, base = Packer(size), {}, 0

        def flush():
            """Sequences that are full leave; of the documents' ids only those in open ones stay, up to ``size`` of each sequence."""
            nonlocal first, held
            rows = []
            for seq in packer.done:
                offset = 0
                for doc, start, length in seq:
                    doc_id, size, begin, tokens = held[doc]
                    rows.append((doc_id, start, length, zlib.crc32(tokens[start - begin : start - begin + length].tobytes()), size, first, offset))
                    offset += length
                first += 1
            packer.done = []
            alive: dict[int, tuple[int, int]] = {}
            for doc, start, length in (p for seqs in packer.open.values() for seq in seqs for p in seq):
                low, high = alive.get(doc, (start, start + length))
                alive[doc] = min(low, start), max(high, start + length)
            held = {doc: _trimmed(*held[doc], *span) for doc, span in alive.items()}
            cols = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], FIELDS)

        for batch in released(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, rows, data, offs in text_slices(batch, "text", 1 << 20):
                flat, begin = encoder(path).encode(data, offs, end)
                for doc_id, a, b in zip(ids.slice(at, rows).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    held[base] = (doc_id, b - a, 0, flat[a:b].copy())
                    packer.place((base, 0, b - a))
                    base += 1
                if sum(map(len, packer.open.values())) > window:  # their ids are held in memory
                    packer.shrink(window // 2)
                yield flush()
        packer.finish()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096, window: int = 4096) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into sequences of at most ``size`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every
    document, null and empty texts too, ends with id ``end`` and so has a piece. Rows with the
    same id, or none, are documents of their own. An empty table gives no rows.
    ``window`` bounds the memory of a task: where more sequences are open, the fullest are filled up with cut pieces
    of the emptiest until half as many are; no id is lost, and the placing goes on by the levels that stay open.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, end, size, window), schema)
