"""The stored vector index against full scans, and the similarity join against all pairs."""

import numpy as np
import pytest

from docquarry.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, dims=16, groups=12, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    x[::97] = 0
    x[5::50] = x[5]
    return x


@pytest.fixture(scope="module")
def case(spark):
    x = clustered(1500)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], SCHEMA).repartition(5)
    return x, vectors, vector_index.build(vectors)


def asked(vectors):
    return vectors.where("vec_id % 20 = 0").selectExpr("vec_id as qid", "embedding as q")


def test_exact_search_equals_a_full_scan(spark, case):
    _, vectors, index = case
    want = {(r.qid, r.vec_id, r.rank): round(r.score, 5) for r in retrieval.dense(vectors, asked(vectors), 7).collect()}
    for probe in (1, 3, 1000):
        got = {(r.qid, r.vec_id, r.rank): round(r.score, 5) for r in vector_index.search(index, asked(vectors), 7, probe).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-5 for x in got)


def test_few_cells_find_most_and_cells_are_pruned(spark, case):
    _, vectors, index = case
    assert vector_index.recall(index, asked(vectors).where("qid > 0"), 10, 8) >= 0.95
    probe = vector_index.probes_for(index, asked(vectors), 10)
    assert 1 <= probe <= 16 < len(index.centroids)
    plan = vector_index.search(index, asked(vectors), 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_stored_index_is_read_back(spark, case):
    _, vectors, index = case
    again = vector_index.load(spark, index.path)
    assert np.allclose(again.centroids, index.centroids) and again.entries.count() == 1500
    row = again.entries.where("cell >= 0").first()
    x = np.asarray(row.embedding) / np.linalg.norm(row.embedding)
    code = np.frombuffer(row.code, np.int8) * again.step + again.centroids[row.cell]
    assert np.linalg.norm(x - code) <= row.error


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    monkeypatch.setattr(vector_index, "ASKED", 10)
    x = clustered(400, groups=2, seed=4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = vector_index.build(vectors, 3)
    assert index.blocks.max() > 2
    want = {(r.qid, r.vec_id, r.rank) for r in retrieval.dense(vectors, asked(vectors), 5).collect()}
    assert {(r.qid, r.vec_id, r.rank) for r in vector_index.search(index, asked(vectors), 5).collect()} == want
    assert_links(x, index, 0.97)


def assert_links(x, index, t):
    norm = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    sim = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= t)) if i < j}
    got = [(r.a, r.b) for r in vector_index.similar_links(index, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("t", [0.6, 0.9, 0.99])
def test_similar_links_are_all_pairs(case, t):
    assert_links(case[0], case[2], t)


def test_empty_and_zero_tables(spark):
    assert vector_index.build(spark.createDataFrame([(1, None)], SCHEMA)) is None
    index = vector_index.build(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], SCHEMA))
    got = vector_index.search(index, spark.createDataFrame([(7, [1.0, 0.0])], "qid long, q array<double>"), 1).collect()
    assert [(r.qid, r.vec_id, r.score) for r in got] == [(7, 1, 0.0)]
    assert vector_index.similar_links(index, 0.5).count() == 0
