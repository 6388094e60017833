"""Whitening of embeddings: principal directions from MLlib's distributed singular values, all sums exact."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import save

SCALE, SHIFT = 64.0, 1_000_000
#: Directions with less than this part of the largest variance are rounding, not data, and are left out.
LEAST = 1e-11
LONGS = 1 << 62


def _quantise(batches):
    for batch in batches:
        ids, col = batch.columns
        values = col.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * values)
        bad = ~(np.abs(x) < LONGS)
        of = np.repeat(np.arange(len(lengths)), lengths)
        good = col.is_valid().to_numpy(zero_copy_only=False).copy()
        good[of[bad]] = False
        rows = np.flatnonzero(good)
        kept = x[good[of]].astype(np.int64) + SHIFT
        offs = np.concatenate([[0], np.cumsum(lengths[rows])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(offs), pa.array(kept))], ["vec_id", "x"])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): each entry c as floor(64 c) + 1,000,000; rows without a vector or with null or non-finite entries, or entries beyond 2^62, go."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_quantise, "vec_id long, x array<long>")


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dims)


def _sums(dims: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                low = _matrix(batch.column(0), dims)
                high = low >> 32  # two halves, as a sum of many large entries does not fit into 64 bits
                halves = zip(high.sum(axis=0).tolist(), (low - (high << 32)).sum(axis=0).tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str((a << 32) + b) for a, b in halves])], ["dim", "s"])

    return run


def _centred(mean: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), len(mean)) - mean
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(mean), dtype=np.int32)), pa.array(x.ravel()))], ["v"])

    return run


def _row_matrix(rows: DataFrame) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n x - S)^2 of each row: squares of halves in 64 bits, or Python's integers beyond them."""
    dims = max(1, len(sums))
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < LONGS:
        d = np.abs(n * x - np.array(sums, np.int64))
        most = int(d.max(initial=0))
        if most * most * dims < LONGS:
            return (d * d).sum(axis=1).tolist()
        if most < 1 << 50 and dims < 1 << 11:
            high, low = d >> 25, d & (1 << 25) - 1
            parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
            return [(a << 50) + (b << 26) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def _deviation_sum(n: int, sums: list[int]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                total = sum(deviations(_matrix(batch.column(0), len(sums)), n, sums))
                yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["total"])

    return run


@dataclass
class Whitening:
    """What was fitted: n vectors, their sums, variances of the directions (columns of ``axes``), and the whole variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.variances)


def fit(distinct: DataFrame, most: int = 16) -> Whitening | None:
    """Fit on the distinct vectors ``x`` (all of one length): at most ``most`` directions with a variance; None without any.

    One pass sums, one forms the Gram matrix of the centred rows (MLlib's tree aggregation) and one adds the exact
    deviations up. The driver gets sums and a matrix of the dimensions, never rows.
    """
    n = distinct.count()
    dims = distinct.select(F.size("x").alias("d")).first()
    if n < 2 or not dims.d:
        return None
    sums = [int(r.s) for r in distinct.select("x").mapInArrow(_sums(dims.d), "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    found = _row_matrix(distinct.select("x").mapInArrow(_centred(mean), "v array<double>")).computeSVD(dims.d, computeU=False)
    variances = np.asarray(found.s.toArray()) ** 2 / n
    keep = np.flatnonzero(variances > LEAST * variances.max(initial=0.0))[:most]
    if not len(keep):
        return None
    parts = distinct.select("x").mapInArrow(_deviation_sum(n, sums), "total string").select(F.col("total").cast("decimal(38,0)").alias("total"))
    total = parts.agg(F.sum("total").alias("t")).first().t
    return Whitening(n, sums, variances[keep], found.V.toArray()[:, keep], float(Fraction(int(total), n**3)))


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance (divisor n) minus the identity."""
    mean, scaled = w.mean, w.scaled

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = (_matrix(batch.column(0), len(mean)) - mean) @ scaled
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))], ["v"])

    cov = _row_matrix(distinct.select("x").mapInArrow(run, "v array<double>")).computeCovariance().toArray() * ((w.n - 1) / w.n)
    return float(np.abs(cov - np.eye(len(cov))).max())


def _apply(w: Whitening, error: float):
    mean, scaled, k = w.mean, w.scaled, len(w.variances)
    explained = w.variances / w.total

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(1), len(mean))
            v = (x - mean) @ scaled
            spread = [d if d < 1 << 63 else None for d in deviations(x, w.n, w.sums)]
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n)), pa.array(spread, pa.int64()).take(at), pa.array(v.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """Whitened coordinates of all valid rows of ``vectors(vec_id, embedding)``: a row per vector and component.

    Returns vec_id, component (from 1), n (distinct vectors), deviation (null where it exceeds a long), whitened,
    explained and identity_error. Equal vectors count once in the fit, so a vector that a third of all rows repeat weighs
    as one; equal rows and rows with a null id keep their own results. Vectors whose length is not the most frequent one (of
    equals the greatest) are left out. Tables that are empty, or hold fewer than two distinct vectors, give no rows; directions
    without variance give no component, so fewer than ``most`` may come. Other columns of the input are left aside.
    """
    rows = save(quantised(vectors), "whiten-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths.d)
    distinct = save(rows.select("x").distinct(), "whiten-fit")
    w = fit(distinct, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "x").mapInArrow(_apply(w, identity_error(distinct, w)), schema)
