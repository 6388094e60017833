"""Byte-fallback piece models: exact encoding by backtracking over longest matches, and decoding.

A merge model joins the neighbours whose joint piece has the best score, leftmost first, until none can be joined. A sequence
of pieces is that result if and only if each two neighbours stay as they are when merged alone: the merges within a
stretch of text do not depend on what lies outside of it until one crosses its border, and the first that crosses a border
between two pieces would also cross it between these two alone. So the encoding is found from left to right with longest
matches, a check of neighbours, and one step back where nothing fits; a place that was left that way is never
entered again.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import released, text_slices

SPACE = "▁"
LETTER, STOPS = r"[^\W\d_¹²³]", ".,;:!?"
#: No piece joins anything to a space or line end after it, nor a letter to a stop after it (``Codec`` makes sure); so these
#: stretches, which repeat far more often than whole words, are encoded alone.
WORD = re.compile(rf"{SPACE}*+{LETTER}++(?=[{SPACE}\n{STOPS}]|\Z)|{SPACE}++[^{SPACE}\n]*+|\n++|[^{SPACE}\n]++")
#: Words and pairs whose result a Python worker keeps.
WORDS, PAIRS = 3 << 17, 1 << 18


class Words(dict):
    """The ids of a word as bytes, found once; emptied when full, as words of a corpus have no bound."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        got = self.codec.ids(self.codec.pieces(word))
        if len(word) <= 64:
            self[word] = got
        return got


class Raw(dict):
    """The ids of a piece as bytes; of a character that is no piece, those of its UTF-8 bytes."""

    def __init__(self, codec: Codec):
        super().__init__((s, np.array([i], np.int32).tobytes()) for s, i in codec.id.items())
        self.codec = codec

    def __missing__(self, char: str) -> bytes:
        return np.array([self.codec.bytes[b] for b in char.encode()], np.int32).tobytes()


class Codec:
    """Encoder and decoder of a merge model with an identity normaliser, a leading space and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [(p.id_to_piece(i), i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.id = dict(named)
        self.score = {s: p.get_score(i) for s, i in named}
        self.bytes = {int(p.id_to_piece(i)[1:-1], 16): i for i in range(p.vocab_size()) if p.is_byte(i)}
        if len(self.bytes) != 256 or any(p.is_unused(i) for _, i in named) or p.normalize("  aﬁ \x00 b ") != f"{SPACE * 3}aﬁ{SPACE}\x00{SPACE}b{SPACE}":
            raise ValueError("only models with an identity normaliser, a leading space and byte fallback are read")
        joint = re.compile(rf"\n|[^{SPACE}]{SPACE}|{LETTER}[{STOPS}]")
        if any(map(joint.search, self.id)):
            raise ValueError("a piece joins a word to the space, line end or stop after it")
        self.found = ahocorasick.Automaton()
        for s in self.id:
            self.found.add_word(s, (len(s) - 1, s))
        self.found.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.words, self.raw = Words(self), Raw(self)

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for a stretch of a few characters."""
        parts, score = list(text), self.score.get
        gains = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, g in enumerate(gains):
                if g is not None and (best is None or g > best):
                    best, at = g, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1])

    def fits(self, left: str, right: str) -> bool:
        """Whether the two stay apart, and whole, when their joint text is merged; with an empty ``left``, whether ``right`` stays whole."""
        key = (left, right)
        got = self.agree.get(key)
        if got is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            got = self.agree[key] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def prefix(self, piece: str) -> str | None:
        """The longest piece that begins ``piece`` and is shorter; its first character at least, which need not be a piece."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.id), None)
        return self.shorter[piece]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text; characters that are no piece stand alone."""
        longest = list(text)
        for end, (back, piece) in self.found.iter(text):  # ends rise, so the last piece from a place is the longest
            longest[end - back] = piece
        agree, n = self.agree, len(text)
        failed = bytearray(n // 8 + 1)  # a bit for each place that no encoding goes through
        stepped_back = False
        out: list[str] = []
        at, last, try_ = 0, "", longest[0] if text else None
        while at < n:
            while try_ is not None:
                fits = agree.get((last, try_))
                if fits is None:
                    fits = self.fits(last, try_)
                if fits:
                    end = at + len(try_)
                    if not (stepped_back and failed[end >> 3] >> (end & 7) & 1):
                        break
                try_ = self.prefix(try_)
            if try_ is None:
                failed[at >> 3] |= 1 << (at & 7)
                stepped_back = True
                at -= len(last)
                try_ = self.prefix(out.pop())
                last = out[-1] if out else ""
                continue
            out.append(try_)
            at, last = end, try_
            if at < n:
                try_ = longest[at]
        return out

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join([self.raw[s] for s in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; nothing for an empty one."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, WORD.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, end: int):
    def run(batches):
        code, tail = codec(path), np.array([end], np.int32).tobytes()
        for batch in released(batches):
            for at, rows, data, offs in text_slices(batch, "text"):
                raw = data.tobytes()
                found = [code.encode(raw[a:b].decode("utf-8", "replace")) + tail for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str, end: int = 2) -> DataFrame:
    """(doc_id, ids) of all rows of ``docs(doc_id, text)``, each with the end id.

    Null and empty texts have the end id alone. Nothing is shuffled; rows with one id, or none, are rows of their own, an empty
    table gives no rows, and other columns are left aside. Bytes that are not UTF-8 count as U+FFFD.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(model, end), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches):
        library = codec(path).library
        for batch in released(batches):
            ids = batch.column(1)
            flat, lengths = ids.flatten().to_numpy(), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            texts = [library.decode(flat[b - n : b].tolist()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            known = ids.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pc.if_else(known, pa.array(texts, pa.string()), None)], ["doc_id", "ids", "decoded"])

    return run


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens(doc_id, ids)`` with the text ``decoded`` from the ids; null for null ids. Control ids, such as the end id, give no text."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, ids array<int>, decoded string")
