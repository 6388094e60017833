"""Embedding near-dedup where lists are full: every link counts, whatever the size of the groups."""

import numpy as np

from docquarry.llm import embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def brute(x, label):
    near = (unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return near.sum(axis=1), root


def check(spark, x, label):
    rows = [(i, v.tolist(), int(l), 1) for i, (v, l) in enumerate(zip(x, label, strict=True))]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, component int")).collect()}
    links, root = brute(x, label)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    return links


def test_two_groups_with_full_lists_keep_all_links(spark):
    rng = np.random.default_rng(2)
    a = unit(rng.standard_normal(32))
    side = rng.standard_normal(32)
    side = unit(side - (side @ a) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    x = np.vstack([unit(c + 0.012 * rng.standard_normal((40, 32))) for c in (a, b)])
    assert check(spark, x, np.zeros(80, int)).sum() > 4000


def test_groups_of_many_sizes(spark):
    rng = np.random.default_rng(5)
    sizes, parts, label = (5, 12, 13, 40, 90, 200), [], []
    for k, n in enumerate(sizes):
        parts.append(unit(unit(rng.standard_normal(24)) + 0.055 * rng.standard_normal((n, 24))))
        label += [10**12 + k % 2] * n
    check(spark, np.vstack(parts), np.array(label))


def test_odd_vectors(spark):
    big, inf = [1e300, 1e300], [float("inf"), 1.0]
    rows = [(1, big, 1), (2, [1e-300, 1e-300], 1), (3, inf, 1), (4, [1.0, None], 1), (5, [1.0, 1.0, 1.0], 1), (6, [], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (9, [-0.0, 1.0], 1), (10, [0.0, 2.0], 1)]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert len(got) == len(rows) and found[3] == (0, 3) and found[4] == (0, 4) and found[5] == (0, 5) and found[6] == (0, 6) and found[7] == (0, 7) and found[None] == (0, None)
    assert found[1][1] == found[2][1] == found[8][1] == 1 and found[9] == (1, 9) and found[10] == (1, 9)
