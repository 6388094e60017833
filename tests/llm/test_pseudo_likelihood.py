"""The window network against plain loops and finite differences; counts and scores against the corpus."""

import random
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import pseudo_likelihood as lm


def small(side=3, n=40, seed=1):
    rng = np.random.default_rng(seed)
    n_words = side * (side - 1)
    v = lm.Vocabulary(np.arange(n_words, dtype=np.uint64), np.arange(n_words, 0, -1), np.zeros(1 << lm.CELL_BITS, np.uint8), 100)
    assert v.side == side
    w = [x.astype(np.float64) for x in lm.start(v)]
    for x in w:
        x += 0.3 * rng.standard_normal(x.shape)
    return w, rng.integers(0, n_words + 1, n), rng.integers(0, side * side + 1, (n, 2 * lm.WINDOW)), side


def plain(w, ids, near, side):
    emb, hid, cls, inner, cb, wb = w
    out = []
    for i, c in zip(ids, near, strict=True):
        h = np.tanh(np.concatenate([emb[j] for j in c]) @ hid)
        share = lambda z: np.exp(z) / np.exp(z).sum()
        if not i:
            out.append(np.log(share(h @ cls + cb)[0]))
            continue
        k, at = 1 + (i - 1) % (side - 1), (i - 1) // (side - 1)
        out.append(np.log(share(h @ cls + cb)[k]) + np.log(share(h @ inner[k] + wb[k])[at]))
    return np.array(out)


def test_forward_equals_a_plain_loop():
    w, ids, near, side = small()
    assert np.allclose(lm.forward(w, ids, near, side), plain(w, ids, near, side))


def test_step_goes_along_the_gradient():
    w, ids, near, side = small()
    assert (np.exp(lm.forward(w, np.arange(side * (side - 1) + 1), np.repeat(near[:1], side * (side - 1) + 1, axis=0), side)).sum()) == pytest.approx(1)
    after, rate, eps = [x.copy() for x in w], 1e-6, 1e-5
    lm.forward(after, ids, near, side, rate)
    uses = np.bincount(near.ravel(), minlength=len(w[0]))
    of_class = np.bincount(lm.places(ids, side)[0], minlength=side)
    scale = [np.sqrt(np.maximum(uses, 1))[:, None], np.sqrt(len(ids)), np.sqrt(len(ids)), np.sqrt(np.maximum(of_class, 1))[:, None, None], np.sqrt(len(ids)), np.sqrt(np.maximum(of_class, 1))[:, None]]
    for k, x in enumerate(w):
        moved = (after[k] - x) / rate * scale[k]
        for place in random.Random(k).sample(list(np.ndindex(x.shape)), 12 if x.size > 12 else x.size):
            up, down = [y.copy() for y in w], [y.copy() for y in w]
            up[k][place] += eps
            down[k][place] -= eps
            want = (plain(up, ids, near, side).sum() - plain(down, ids, near, side).sum()) / (2 * eps)
            assert moved[place] == pytest.approx(want, abs=2e-4 * max(1, abs(want)))


def test_contexts():
    near = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5]), 9)
    assert near.tolist() == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 5, 9], [9, 4, 9, 9]]


def words(seed, n, names):
    draw = random.Random(seed)
    return " ".join(draw.choice(names) for _ in range(n))


def test_counts_are_those_of_the_corpus(spark):
    names = [f"w{i}" for i in range(50)] + ["a", "A", "a-word-of-more-than-sixteen-letters"]
    texts = [words(i, 200, names[: 10 + i]) for i in range(40)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    v = lm.count_words(docs, least=3, most=20)
    want = Counter(w.lower() for t in texts for w in (t or "").split())
    assert v.n_words == sum(want.values()) and sorted(v.counts.tolist(), reverse=True) == sorted(want.values(), reverse=True)[:20]
    raw = [w.encode() for w in want]
    hashes = lm._words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, len(b" ".join(raw))]))[0]
    ids = v.ids(hashes)
    for i, h, n in zip(ids, hashes, want.values(), strict=True):
        assert i == 0 or v.counts[i - 1] == n
        if i == 0:
            assert abs(np.exp2(v.cells[h >> np.uint64(64 - lm.CELL_BITS)] / 8) - 1 - n) <= 0.05 * n + 0.05
    assert v.rest == sum(n for i, n in zip(ids, want.values(), strict=True) if i == 0)


def test_scores(spark):
    names = [f"name{i}" for i in range(3000)]
    line = "the cat sat on the mat and looked at the dog "
    rows = [(i, line * 20) for i in range(60)] + [(100 + i, words(i, 100, names)) for i in range(60)]
    rows += [(200, " ".join(random.Random(1).sample(line.split() * 20, 200))), (201, " ".join(f"unseen{i}" for i in range(200))), (202, ""), (203, None), (None, line), (0, line * 20), (204, line * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    only = spark.createDataFrame([(i, t) for i, t in rows if i is None or i < 200], "doc_id long, text string")
    got = {}
    for r in lm.score(docs, lm.train(only.coalesce(1), step=128)).collect():  # small steps, as the corpus is small
        got.setdefault(r.doc_id, r)
    assert got[0].score > got[200].score > got[201].score  # in order, shuffled, unseen
    assert max(got[i].score for i in range(100, 160)) > got[201].score and min(got[i].score for i in range(100, 160)) > got[201].score
    assert got[202].n_words == got[203].n_words == 0 and got[202].score == got[203].score == 0
    assert got[0].score == pytest.approx(got[0].pseudo_log_likelihood / got[0].n_words) and got[204].n_words == 55_000
    assert lm.score(docs.limit(0)).count() == 0
