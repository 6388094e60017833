"""Exact, memoised encoding with the tokenizers library."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from docquarry.llm import textkit
from docquarry.llm.common import kept

SPACE = 32
#: Characters that never join an ASCII letter before them into one token (the apostrophe does).
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that are white space or may begin a character of white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Pieces that one call to the library encodes.
CALL = 5_000


class Memo:
    """Token ids of pieces by 128-bit keys: an open-addressing table whose look-ups run over whole arrays."""

    def __init__(self, most: int):
        self.bits = (2 * most - 1).bit_length()
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slot = np.zeros(1 << self.bits, np.int32)  # entry + 1
        self.one, self.two = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.n, self.n_ids = np.zeros(4096, np.uint32), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of every key, or -1."""
        mask = np.uint64(len(self.slot) - 1)
        at = (one & mask).astype(np.int64)
        got = self.slot[at] - 1
        open_ = np.flatnonzero((got >= 0) & ((self.one[got] != one) | (self.two[got] != two)))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            got[open_] = self.slot[at[open_]] - 1
            x = got[open_]
            open_ = open_[(x >= 0) & ((self.one[x] != one[open_]) | (self.two[x] != two[open_]))]
        return got

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Keep new, distinct keys with the ids of each, joined."""
        n, m = self.n + len(one), self.n_ids + len(ids)
        for name in ("one", "two", "begin", "count"):
            setattr(self, name, _grown(getattr(self, name), n))
        self.ids = _grown(self.ids, m)
        self.one[self.n : n], self.two[self.n : n], self.count[self.n : n], self.ids[self.n_ids : m] = one, two, count, ids
        self.begin[self.n : n] = self.n_ids + np.cumsum(count) - count
        at, entry = (one & np.uint64(len(self.slot) - 1)).astype(np.int64), np.arange(self.n + 1, n + 1, dtype=np.int32)
        while len(at):
            free = self.slot[at] == 0
            self.slot[at[free]] = entry[free]
            left = self.slot[at] != entry  # taken before, or by another of the new ones
            at, entry = (at[left] + 1) & (len(self.slot) - 1), entry[left]
        self.n, self.n_ids = n, m


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each piece, from its length, first and last eight bytes (all of a piece up to 16) and a hash of longer ones."""
    size = ends - starts
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    cut = (8 * np.maximum(8 - size, 0)).astype(np.uint64)  # bits that are not of the piece
    first = (word[starts + 8] << cut) >> cut
    last = (word[ends] >> cut) << cut
    rest = size.astype(np.uint64) * textkit.STEP[20]
    if len(long := np.flatnonzero(size > 16)):
        rest[long] += textkit.word_hashes(data, starts[long], ends[long])
    return textkit.mix(textkit.mix(first + textkit.STEP[21]) + last * textkit.STEP[22] + rest), textkit.mix(first * textkit.STEP[23] + textkit.mix(last ^ textkit.STEP[24]) + rest)


class Encoder:
    """Token ids of whole texts, as ``Tokenizer.encode`` gives them.

    Both public vocabularies never join a space to what stands before it, nor punctuation to a letter, so a text may be
    cut before each single space that follows and precedes other characters, and before punctuation that follows a
    letter; the pieces repeat and their ids are kept (at most ``most`` pieces). The strings of special tokens in a text are
    those tokens; a text that holds one is encoded as a whole.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.special = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memo = Memo(most)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i in range(0, len(texts), CALL):
            found += [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _of_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each piece has."""
        one, two = keys(data, starts, ends)
        memo = self.memo
        entry, raw = memo.find(one, two), data.tobytes()
        while len(new := np.flatnonzero(entry < 0)):
            new = new[np.unique(one[new], return_index=True)[1]]
            if memo.n + len(new) > memo.most:
                if memo.n:
                    memo.clear()
                    entry[:] = -1
                    continue
                memo = Memo(2 * len(new))  # one very long text: a table for it alone
            ids, count = self._plain([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            memo.add(one[new], two[new], ids, count)
            entry = memo.find(one, two)
        n = memo.count[entry].astype(np.int64)
        return memo.ids[np.repeat(memo.begin[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The joined ids of the texts ``data[offs[i]:offs[i + 1]]`` (UTF-8), each followed by ``end``, and where each text's begin."""
        rows = len(offs) - 1
        border = data == SPACE
        blank = _blank_after(data, np.flatnonzero(border[:-1] & BLANK[data[1:]]))
        border[1:] |= STOPS[data[1:]] & LETTER[data[:-1]]
        careful = set((np.searchsorted(offs, blank, "right") - 1).tolist())
        raw = data.tobytes()
        special = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                special.add(int(np.searchsorted(offs, at, "right")) - 1)
                at = raw.find(token, at + 1)
        for i in sorted(careful | special):
            a, b = int(offs[i]), int(offs[i + 1])
            border[a:b] = False
            if i not in special:
                border[a + np.array(_careful(raw[a:b].decode("utf-8", "replace")), np.int64)] = True
        border[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        whole = np.zeros(len(starts), bool)
        if special:
            whole[np.searchsorted(starts, offs[sorted(special)])] = True
        ids, n = self._of_pieces(data, starts[~whole], ends[~whole])
        if special:
            n_all = np.zeros(len(starts), np.int64)
            n_all[~whole] = n
            other, n_all[whole] = self._plain([raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in sorted(special)])
            all_ids, of = np.zeros(int(n_all.sum()), np.uint32), np.repeat(whole, n_all)
            all_ids[~of], all_ids[of] = ids, other
            ids, n = all_ids, n_all
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)]
        if end is None:
            return ids, upto
        out = np.full(len(ids) + rows, end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(upto))] = ids
        return out, upto + np.arange(rows + 1)


def _blank_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those places ``at`` which white space follows (also of two or three bytes, after U+0020)."""
    x, y, z = (np.append(data, np.zeros(3, np.uint8))[at + k] for k in (1, 2, 3))
    general = (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F)
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    return at[(x <= 0x20) | two | (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & general | (x == 0xE3) & (y == 0x80) & (z == 0x80)]


def _careful(text: str) -> list[int]:
    """Byte places of spaces between two characters that are neither white space nor control characters."""
    import regex

    places, at, done = [], 0, 0
    for m in regex.finditer(r"(?V1)(?<=[^\s\p{C}\p{Z}]) (?=[^\s\p{C}\p{Z}])", text):
        at += len(text[done : m.start()].encode())
        done = m.start()
        places.append(at)
    return places


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, with the pieces it has encoded."""
    return kept(("encoder", path), lambda: Encoder(path))
