"""Token-id files: a concatenated id array and Elias-Fano encoded document boundaries.

A file is ``b"DQTOKENS"``, a header of six little-endian 64-bit integers (documents, tokens,
bytes per id, low bits per boundary, words of the high-bit array, first token), the high-bit array, the samples
of its select structure, the packed low bits, the document ids with a null mask, and the ids.
Boundary i (the ids before document i) is split into ``low`` low bits, stored packed, and the rest, stored
in unary as bit (high + i) of the high-bit array: n * (2 + log2(tokens / n)) bits in place of 64 n.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import save, shuffle_width, text_slices
from docquarry.llm.tokens import encoder

MAGIC = b"DQTOKENS"
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of integers with constant-time access by ``select``."""

    def __init__(self, n: int, low: int, high: np.ndarray, lows: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.high, self.lows, self.samples = n, low, high, lows, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n + (top >> low) + 1, np.uint8)
        bits[(values >> low) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % 8, np.uint8)]).view(np.uint64)
        lows = np.packbits(((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low, high, lows, cls._sampled(high, n))

    @staticmethod
    def _sampled(high: np.ndarray, n: int) -> np.ndarray:
        """Of every ``SAMPLE``-th one, the word of the high-bit array, and the ones before that word."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        word = np.searchsorted(before, np.arange(0, n, SAMPLE), "right") - 1
        return np.stack([word, before[word]]).astype(np.uint32)

    def select(self, i: int) -> int:
        """Value i: position of one number i in the high bits, less i, above its low bits."""
        word, seen = int(self.samples[0][i // SAMPLE]), int(self.samples[1][i // SAMPLE])
        while seen + (ones := int(self.high[word]).bit_count()) <= i:
            word, seen = word + 1, seen + ones
        x = int(self.high[word])
        for _ in range(i - seen):
            x &= x - 1
        at = word * 64 + (x & -x).bit_length() - 1
        first = i * self.low
        part = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little") >> first % 8
        return (at - i) << self.low | part & (1 << self.low) - 1

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """``select`` of many places at once."""
        word, seen = (x[i // SAMPLE].astype(np.int64) for x in self.samples)
        ones = np.bitwise_count(self.high).astype(np.int64)
        while len(on := np.flatnonzero(seen + ones[word] <= i)):
            seen[on] += ones[word[on]]
            word[on] += 1
        out = np.zeros(len(i), np.int64)
        lows = np.concatenate([self.lows, np.zeros(8, np.uint8)])
        view = np.ndarray((len(lows) - 7,), "<u8", lows, strides=(1,))
        for a in range(0, len(i), 1 << 16):  # 64 bytes for each place in a block
            b = slice(a, a + (1 << 16))
            bits = np.unpackbits(self.high[word[b]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = word[b] * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) > (i[b] - seen[b])[:, None]).argmax(axis=1)
            first = i[b] * self.low
            part = (view[first // 8] >> (first % 8).astype(np.uint64)).astype(np.int64) & ((1 << self.low) - 1)
            out[b] = (at - i[b]) << self.low | part
        return out


def write_file(ids: list[np.ndarray], counts: list[int], doc_ids: list[int | None], width: int, first: int = 0) -> bytes:
    """The bytes of a file with these documents: joined ids, how many each document has, and its id."""
    index = EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"token id {flat.max()} does not fit into {width} bytes")
    flat = flat.astype(f"<u{width}")
    known = np.array([d is not None for d in doc_ids], bool)
    parts = [index.high.tobytes(), index.samples.tobytes(), index.lows.tobytes(), np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), flat.tobytes()]
    return MAGIC + struct.pack("<6q", len(doc_ids), len(flat), width, index.low, len(index.high), first) + b"".join(parts)


class TokenFile:
    """Reads what ``write_file`` made; ``tokens(i)`` finds a document by the select structure."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_tokens, width, low, words, self.first = struct.unpack_from("<6q", data, 8)
        at = 56

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        high = take("<u8", words)
        samples = take("<u4", 2 * -(-(self.n + 1) // SAMPLE)).reshape(2, -1)
        self.index = EliasFano(self.n + 1, low, high, take(np.uint8, ((self.n + 1) * low + 7) // 8), samples)
        known = np.unpackbits(take(np.uint8, (self.n + 7) // 8), count=self.n)
        self.doc_ids = [int(d) if k else None for d, k in zip(take("<i8", self.n), known, strict=True)]
        self.ids = take("<u2" if width == 2 else "<u4", self.n_tokens)

    def start(self, i: int) -> int:
        return self.first + self.index.select(i)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.index.select(i) : self.index.select(i + 1)]


def _encode(path: str, end: int, width: int | None, most: int):
    def run(batches):
        from pyspark import TaskContext

        part, file, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, docs, held = [], [], [], 0
        encode = encoder(path)
        size = width or (2 if max(encode.vocabulary, end + 1) <= 1 << 16 else 4)

        def close():
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([file]), pa.array([first]), pa.array([held]), pa.array([write_file(ids, counts, docs, size, first)], pa.binary())], ["part", "file", "first", "n_tokens", "data"])

        for batch in batches:
            for at, rows, data, offs in text_slices(batch, "text", 4 << 20):
                flat, begin = encode.encode(data, offs, end)
                ids.append(flat)
                counts += np.diff(begin).tolist()
                docs += batch.column(0).slice(at, rows).to_pylist()
                held += len(flat)
                if held >= most:
                    yield close()
                    ids, counts, docs, file, first, held = [], [], [], file + 1, first + held, 0
        if docs:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, end: int = 2, width: int | None = None, most: int = 2_000_000) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending order of doc_id into token files of ``most`` tokens or somewhat more.

    The files are rows (part, file, first, n_tokens, data) of a table in the shared folder, so that Spark's
    committer makes each appear once, whatever executor is lost. Null ids come first; null texts are empty; rows of
    one id are in the order of a hash of their text, and repeated rows are documents of their own. An empty table
    gives no files. ``width``: bytes of an id, by default 2 for vocabularies up to 65,536 ids, else 4.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange(shuffle_width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return save(ranged.mapInArrow(_encode(tokenizer, end, width, most), "part long, file long, first long, n_tokens long, data binary"), "tokens")


def _read(bases: dict[int, int]):
    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                cut = f.index.select_many(np.arange(f.n + 1))
                flat = f.ids.astype("<u4")
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(cut[:-1] + f.first + bases[part]), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    Only one sum for each partition of the writer, whose number is a setting, reaches the driver.
    """
    sums = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, base = {}, 0
    for part in sorted(sums):
        bases[part], base = base, base + sums[part]
    return files.select("part", "data").mapInArrow(_read(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")
