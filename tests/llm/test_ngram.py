"""The n-gram join against brute force, with regions that pivots have to divide."""

import random

import numpy as np
import pytest

from docquarry.llm import common, ngram_join


def family(draw, base, n, changes):
    """``n`` texts, each made of an earlier one by exchanging some words."""
    texts = [base]
    while len(texts) < n:
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, changes)):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def some_texts(seed, families, n, length, changes):
    draw = random.Random(seed)
    texts = []
    for f in range(families):
        texts += family(draw, " ".join(f"f{f}w{draw.randrange(10**6)}" for _ in range(draw.randint(length // 2, length))), n, changes)
    draw.shuffle(texts)
    return texts


def shingles(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(sets, t):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= round(100 * t) * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def coded(sets):
    code = {s: i + 1 for i, s in enumerate(sorted(set().union(*sets)))}
    return [np.array(sorted(code[x] for x in s), np.uint64) for s in sets]


@pytest.mark.parametrize("t", [0.8, 0.9])
@pytest.mark.parametrize("seed", range(4))
def test_forest_equals_brute_force(t, seed):
    sets = [shingles(x, 3) for x in some_texts(seed, 5, 30, 120, 4) + some_texts(seed + 9, 40, 1, 30, 0)]
    want, root = components(sets, t), list(range(len(sets)))
    links = ngram_join.forest(coded(sets), t, pivots=4)
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= round(100 * t) * len(sets[a] | sets[b]) and root[a] != root[b]
        x, y = root[a], root[b]
        root = [min(x, y) if v in (x, y) else v for v in root]
    assert root == want


@pytest.mark.parametrize(("t", "most"), [(0.8, 6), (0.9, 6), (0.8, 1000)])
def test_join_equals_brute_force_by_way_of_pivots(spark, t, most):
    texts = some_texts(7, 4, 25, 150, 6) + some_texts(8, 20, 1, 60, 0) + ["", "one"]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, t, most).collect()}
    assert got == dict(enumerate(components([shingles(x, 3) for x in texts], t)))


def test_keep_first(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base, "a"), (1, base, "a"), (1, "other " * 9, "b"), (2, base + " x", "c"), (3, "", "d"), (4, None, "e"), (None, base, "f"), (5, "quite another text that nobody else has", "g"), (5, "quite another text that nobody else has", "g")]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in kept) == [(0, "f"), (1, "b"), (3, "d"), (4, "e"), (5, "g")]


def test_filter_lets_all_members_through(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.dq_maybe for r in common.maybe_in(spark.range(6000).withColumnRenamed("id", "doc_id"), ids).collect()}
    assert len(got) == 6000 and all(got[i] for i in range(0, 3000, 3)) and sum(got.values()) < 1600


def test_sketches_differ_in_no_more_cells_than_sets_in_shingles():
    draw = np.random.default_rng(3)
    for n, m, both in [(0, 5, 0), (40, 300, 20), (900, 1000, 850), (1000, 3000, 900), (2500, 2600, 2400), (800, 900, 0)]:
        some = draw.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(some[:n]), np.unique(np.concatenate([some[:both], some[n : n + m - both]]))
        x, y = ngram_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        apart = len(np.setxor1d(a, b))
        assert ngram_join.sketch_distance(x, y) == ngram_join.sketch_distance(y, x) <= apart
        assert both or n < 100 or ngram_join.sketch_distance(x, y) > (n + m) / 9


def test_chance_shingles_chain_no_unrelated_texts(spark, monkeypatch):
    draw, held, real = random.Random(5), [], ngram_join._region_links
    seam = [" ".join(f"s{i}x{j}" for j in range(8)) for i in range(61)]
    texts = [f"{seam[i]} {' '.join(f'w{draw.randrange(10**9)}' for _ in range(100))} {seam[i + 1]}" for i in range(60)]
    texts += [texts[7] + " more", texts[7] + " more of it"]
    monkeypatch.setattr(ngram_join, "_region_links", lambda found, *rest: held.append(found.count()) or real(found, *rest))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()}
    assert got == {i: i if i < 60 else 7 for i in range(62)}
    assert held == [3]


def test_an_id_with_several_texts_keeps_its_links(spark):
    texts = some_texts(11, 1, 2, 80, 1)
    rows = [(1, texts[0]), (1, "quite another text " * 3), (2, texts[1]), (3, "one two three four five six seven")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.8).collect()
    assert {r.component_id for r in got if r.doc_id in (2,)} == {1} and {r.component_id for r in got if r.doc_id == 3} == {3}


def regions_of(spark, monkeypatch, texts, n, t):
    """The sets of all regions, and the component of each text."""
    held, real = [], ngram_join._region_links
    monkeypatch.setattr(ngram_join, "_region_links", lambda found, *rest: held.append(found.count()) or real(found, *rest))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, t).collect()}
    return sum(held), got


def test_linked_sets_meet_in_a_cell_though_some_are_left_out():
    draw = np.random.default_rng(4)
    for t in (0.85, 0.9, 0.95):
        lows = ngram_join._rings(t)
        for n in [5, 12, 30, 60, 90, 130, 200, 333, 500, 800] * 12:
            apart = int((1 - t) * n)  # |A| = n, |B| = n - apart: as far from one another as linked sets can be
            a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(draw.integers(0, apart + 1))
            new = (apart - drop) // 2
            b = np.unique(np.concatenate([draw.permutation(a)[drop + new :], draw.integers(0, 2**63, new, dtype=np.uint64)]))
            if len(np.intersect1d(a, b)) < t * len(np.union1d(a, b)):
                continue
            keys, owner = ngram_join._cell_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), t, lows)
            assert len(np.intersect1d(keys[owner == 0], keys[owner == 1])), (t, n, drop, new)


@pytest.mark.parametrize("t", [0.8, 0.9])
def test_crowd_forest_spans_what_sketches_allow(t):
    texts = some_texts(3, 6, 20, 300, 9) + some_texts(4, 30, 1, 900, 0)
    sets = coded([shingles(x, 3) for x in texts])
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    size, drawn = np.diff(begin), ngram_join.sketches(np.concatenate(sets), begin)

    def roots(links):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if v in (x, y) else v for v in root]
        return root

    share = (1 - t) / (1 + t)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if min(size[i], size[j]) >= t * max(size[i], size[j]) - 1e-6 and ngram_join.sketch_distance(drawn[i], drawn[j]) <= share * (size[i] + size[j]) + 1e-6]
    found = ngram_join.crowd_forest(size, drawn, t)
    assert roots(found) == roots(near) and len(found) == len(sets) - len(set(roots(near)))


def test_a_crowd_with_a_rare_shingle_in_common_is_no_region(spark, monkeypatch):
    draw = random.Random(6)
    texts = [f"{' '.join(f'w{draw.randrange(10**9)}' for _ in range(100))} the very same eight words in all of these" for _ in range(40)]
    texts += [texts[7] + " more", texts[7] + " more of it"]
    monkeypatch.setattr(ngram_join, "frequent", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    held, got = regions_of(spark, monkeypatch, texts, 5, 0.8)
    assert got == {i: i if i < 40 else 7 for i in range(42)}
    assert held == 3


def test_copies_count_once_in_a_region(spark, monkeypatch):
    draw = random.Random(8)
    seam = [" ".join(f"s{i}x{j}" for j in range(8)) for i in range(14)]
    once = [f"{seam[i]} {' '.join(f'w{draw.randrange(10**9)}' for _ in range(100))} {seam[i + 1]} {seam[i + 2]}" for i in range(12)]
    monkeypatch.setattr(ngram_join, "frequent", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    held, got = regions_of(spark, monkeypatch, once * 20, 5, 0.8)
    assert got == {i: i % 12 for i in range(240)}
    assert held == 0


def test_a_common_passage_makes_no_region_of_cells(spark, monkeypatch):
    draw = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    passage = " ".join(words)
    texts = [f"{passage} {' '.join(f'w{draw.randrange(10**9)}' for _ in range(90))}" for _ in range(60)]
    texts += [texts[7] + " more", texts[7] + " more of it"]
    held, got = regions_of(spark, monkeypatch, texts, 3, 0.9)
    assert got == {i: i if i < 60 else 7 for i in range(62)}
    assert held == 3


def test_keep_first_of_copies_with_a_passage_in_common(spark, monkeypatch):
    draw, held, real = random.Random(10), [], ngram_join._region_links
    once = [f"{' '.join(f'w{draw.randrange(10**9)}' for _ in range(80))} the same words stand at the end of all" for _ in range(25)]
    once[20] = once[3] + " now"
    monkeypatch.setattr(ngram_join, "frequent", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(ngram_join, "_region_links", lambda found, *rest: held.append(found.count()) or real(found, *rest))
    kept = ngram_join.keep_first(spark.createDataFrame(list(enumerate(once * 3)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(25) if i != 20]
    assert held == [2]
