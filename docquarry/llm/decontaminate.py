"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one). For every
pattern length there is a shift table over blocks of up to three words: a block that occurs in no
pattern lets the search skip length - block + 1 words, which numpy tests for all texts of a batch at
once, one block for each such step. Only texts with an occurring block are searched word by
word; where the shift is 0, the bucket of the window's last block gives the patterns to compare directly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import textkit
from docquarry.llm.common import ints, kept, released, text_slices


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z."""
    raw = textkit.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return np.where(textkit.ALNUM[raw], raw, 32).astype(np.uint8).tobytes().split()


class WuManber:
    """Occurrences of patterns of ``length`` words, each with the items that have it."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(3, length)
        self.step = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets = defaultdict(list)
        for p, items in patterns.items():
            for i in range(self.step):
                key, far = p[i : i + self.block], self.step - 1 - i
                self.shift[key] = min(far, self.shift.get(key, far))
            self.buckets[p[-self.block :]].append((p, items))
        # the shift table for numpy: hashes of the blocks that occur
        flat = [w for key in self.shift for w in key]
        raw = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(w) for w in flat]) if flat else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in flat], np.int64) if flat else ends
        h = textkit.word_hashes(raw, starts, ends).reshape(-1, self.block)
        self.hashes = np.unique((h * textkit.STEP[: self.block]).sum(axis=1, dtype=np.uint64))
        bits = max(16, int(len(self.hashes)).bit_length() + 5)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.hashes & self.mask] = True

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each text may hold a pattern: a block at a multiple of the step occurs in some pattern."""
        count = np.maximum(np.diff(at) - self.block + 1, 0)
        n = np.where(np.diff(at) >= self.length, -(-count // self.step), 0)
        of = np.repeat(np.arange(len(n)), n)
        place = at[:-1][of] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * self.step
        sums = np.zeros(len(place), np.uint64)
        for k in range(self.block):
            sums += hashes[place + k] * textkit.STEP[k]
        hit = np.flatnonzero(self.table[sums & self.mask])
        hit = hit[np.isin(sums[hit], self.hashes)]
        out = np.zeros(len(n), bool)
        out[of[hit]] = True
        return out

    def find(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the words of all occurrences, and gather their items."""
        end, most = self.length, self.step
        while end <= len(words):
            key = tuple(words[end - self.block : end])
            shift = self.shift.get(key, most)
            if shift:
                end += shift
                continue
            window = tuple(words[end - self.length : end])
            for pattern, owners in self.buckets[key]:
                if pattern == window:
                    hit[end - self.length : end] = True
                    items |= owners
            end += 1


def tables(items: list[tuple[str, str]], window: int = 13) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = split(text)
        if words:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                by_length[size][tuple(words[i : i + size])].add(item)
    return [WuManber(n, p) for n, p in sorted(by_length.items())]


FIELDS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

def _tables(shared, window: int, only_one: bool) -> list[WuManber]:
    """The tables of a part; those of a benchmark of one part are made once in each worker."""
    if not only_one:
        return tables(shared.value, window)
    return kept(("benchmark", window, shared.value), lambda: tables(shared.value, window))


def _scan(parts: list, window: int, share: int):
    """Scan each batch for one part of the benchmark after the other, and unite the hit words and the items of each text."""

    def run(batches):
        for batch in released(batches):
            ids, text = ints(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))
            n_words, hits, items = np.zeros(len(ids), np.int64), {}, defaultdict(set)
            for shared in parts:
                found = _tables(shared, window, len(parts) == 1)
                for at, rows, data, offs in text_slices(batch, "text"):
                    data = textkit.LOWER[data]
                    starts, ends, begin = textkit.words(data, offs, textkit.ALNUM)
                    hashes = textkit.word_hashes(data, starts, ends)
                    n_words[at : at + rows] = np.diff(begin)
                    maybe = [m.candidates(hashes, begin) for m in found]
                    for i in np.flatnonzero(np.any(maybe, axis=0)).tolist() if maybe else ():
                        words = split(text[at + i].as_py())
                        hit = hits.setdefault(at + i, np.zeros(len(words), bool))
                        for m, may in zip(found, maybe, strict=True):
                            if may[i]:
                                m.find(words, hit, items[at + i])
            n_hit, n_items = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            shas = [NO_ITEMS] * len(ids)
            for i, hit in hits.items():
                n_hit[i], n_items[i] = hit.sum(), len(items[i])
                shas[i] = hashlib.sha256(",".join(sorted(items[i])).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(shas), pa.array((n_hit > 0) & (share * n_hit >= n_words))], FIELDS)

    return run


NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _parts(benchmark: DataFrame, window: int, most: int) -> list:
    """Broadcasts of the benchmark's items, each of about ``most`` text bytes; an item over that is cut where no window is lost."""

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text.encode("utf-8", "surrogatepass")) <= most:
                    ids.append(item)
                    texts.append(text)
                    continue
                words = [w.decode("utf-8", "surrogatepass") for w in split(text)]
                step = max(1, most // 16)
                for i in range(0, max(1, len(words) - window + 1), step):
                    ids.append(item)
                    texts.append(" ".join(words[i : i + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, text string")
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most))
    dealt = items if n == 1 else items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [spark.sparkContext.broadcast([(r.item_id, r.text) for r in (dealt if n == 1 else dealt.where(F.col("part") == p)).collect()]) for p in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, most: int = 1 << 20) -> DataFrame:
    """Words of ``docs(doc_id, text)`` inside any occurrence of a window of ``benchmark(item_id, text)``.

    One row per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and ``share`` * n_hit >= n_words).
    Null and empty texts have no words and no hits; an item without words or id has no window; an empty benchmark hits
    nothing, an empty table gives no rows. Rows that repeat, or have no id, are scanned as often as they come; whole texts count.
    The benchmark is broadcast in parts of about ``most`` text bytes, which bounds the tables that a worker builds at a time
    (some hundred MB); with several parts they are built anew for each batch, so a large benchmark costs time, not hits.
    """
    parts = _parts(benchmark, window, most)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(parts, window, share), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, most: int = 1 << 20) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay, also of rows without text or id."""
    parts = _parts(benchmark, window, most)

    def run(batches):
        inner = _scan(parts, window, share)
        for batch in batches:
            flags = [x for out in inner(iter([batch])) for x in out.column("contaminated").to_pylist()]
            if flags:
                yield batch.filter(pa.array([not x for x in flags]))

    return docs.mapInArrow(run, docs.schema)
