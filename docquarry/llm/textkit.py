"""Numpy kernels over the bytes of many texts at once: words, their hashes, shingles."""

from __future__ import annotations

import numpy as np


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


BYTE_CODE = _constants(256, 11)
PLACE = _constants(1, 12)[0]
GEAR = _constants(256, 13).astype(np.uint32)
STEP = _constants(64, 14)
#: Bytes of words hashed at once (a longer word is hashed alone): each takes some 50 bytes meanwhile.
BLOCK = 1 << 18

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space (space, \t \n \v \f \r).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all of their bits are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the (lower-cased) bytes, and where each text's words begin among them."""
    is_word = kind[data]
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    upto = np.cumsum(size)
    powers = np.cumprod(np.full(int(size.max()), PLACE, np.uint64))
    sums = np.zeros(len(size), np.uint64)
    at = 0
    while at < len(size):
        before = int(upto[at] - size[at])
        end = max(at + 1, int(np.searchsorted(upto, before + BLOCK, "right")))
        part = size[at:end]
        first = upto[at:end] - part - before
        place = np.arange(int(upto[end - 1]) - before) - np.repeat(first, part)
        sums[at:end] = np.add.reduceat(BYTE_CODE[data[place + np.repeat(starts[at:end], part)]] * powers[place], first)
        at = end
    return mix(sums + size.astype(np.uint64))


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text; a text of fewer words, but not none, is one run.

    Returns the hashes and where each text's runs begin among them.
    """
    count = np.diff(at)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    long = count >= n
    out = np.zeros(int(begin[-1]), np.uint64)
    if long.any():
        first = np.repeat(at[:-1][long] - (np.cumsum(runs[long]) - runs[long]), runs[long]) + np.arange(int(runs[long].sum()))
        sums = np.zeros(len(first), np.uint64)
        for k in range(n):
            sums += hashes[first + k] * STEP[k]
        out[np.repeat(long, runs)] = mix(sums)
    for i in np.flatnonzero(~long & (count > 0)):
        part = hashes[at[i] : at[i + 1]]
        out[begin[i]] = mix((part * STEP[: len(part)]).sum(dtype=np.uint64, keepdims=True) + STEP[40 + len(part)])[0]
    return out, begin


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    data = LOWER[data]
    starts, ends, at = words(data, offs, kind)
    all_, begin = shingles(word_hashes(data, starts, ends), at, n)
    sets = [np.unique(all_[begin[i] : begin[i + 1]]) for i in range(len(offs) - 1)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_digests(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; 0 for an empty one."""
    has = np.diff(begin) > 0
    one, two = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
    if has.any():
        at = begin[:-1][has]
        one[has] = np.add.reduceat(mix(sets + STEP[50]), at)
        two[has] = np.add.reduceat(mix(sets ^ STEP[51]) * STEP[52], at)
    return one.view(np.int64), two.view(np.int64)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash over the last 16 bytes at every byte, h = (h << 2) + code, by doubling."""
    h = GEAR[data]
    step = 1
    while step < 16:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(2 * step)
        h = h + shifted
        step *= 2
    return h
