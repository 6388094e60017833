"""Whitening against numpy over the whole fit list, with exact integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import whitening


def brute(rows):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = np.array([[float(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    deviation = [sum((n * v - s) ** 2 for v, s in zip(x, sums)) for _, x in kept]
    return kept, n, sums, cov, deviation


def check(spark, rows, most=16):
    schema = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame(rows, schema), most).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.createDataFrame(rows, schema).collect()]
    kept, n, sums, cov, deviation = brute(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == k * len(kept) and set(got.component) == set(range(1, k + 1))
    assert (got.n == n).all() and (got.identity_error < 1e-6).all() and got.identity_error.nunique() == 1
    wide = got.groupby(["vec_id", "deviation", "component"], dropna=False)["whitened"].first().unstack()
    want_deviation = {(i, d) for (i, _), d in zip(kept, deviation)}
    assert {(r.vec_id, r.deviation) for r in got.itertuples()} == want_deviation
    by_id = {i: x for i, x in kept}
    for (vec_id, _), row in wide.iterrows():
        x = np.array([(n * v - s) / n for v, s in zip(by_id[vec_id], sums)])
        want = np.abs(x @ axes[:, :k]) / np.sqrt(values[:k])
        assert np.allclose(np.abs(row.to_numpy()), want, atol=1e-6)
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values[:k] / np.trace(cov), rtol=1e-6)


def test_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows)


def test_repeats_nulls_and_low_rank(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(300)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "n": F.lit("b"), "v": F.lit(None)}))
    ids = {r.vec_id for r in got.select("vec_id").distinct().collect()}
    assert ids == {*range(40), *range(100, 400)}
    check(spark, [r for r in rows if r[0] != 904])


def test_tables_without_directions(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0


def test_deviations_are_exact():
    rng = np.random.default_rng(5)
    for top, n in ((100, 50), (1 << 20, 10**6), (1 << 20, 10**9), (1 << 40, 10**6)):
        x = rng.integers(-top, top, (5, 4))
        sums = [int(v) * (n // 5) for v in x.sum(axis=0)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
