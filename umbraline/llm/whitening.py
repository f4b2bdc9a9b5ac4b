"""Whitening of integer vectors by a tall and skinny QR (TSQR).

The rows are centred by exact integer sums.  Each partition reduces its centred rows to a
triangular factor, block by block; factors are merged in a tree until one is left; the
singular values and right vectors of the last give the principal axes.  The covariance
matrix is never formed, so small eigenvalues keep their digits.

A factor has as many numbers as a covariance matrix; only the last one reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import WIDE, integers, largest, matrix, usable

COMPONENTS = 4
#: Factors that are merged by one task.
FAN = 16
#: Singular values below this share of the largest count as zero.
RANK = 1e-12


@dataclass
class Axes:
    """Principal axes of the fit list: what whitening needs."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # (dimensions, components)
    values: np.ndarray  # eigenvalues
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)[0] @ self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``x - sums / n`` in double precision, and ``n * x - sums`` exactly."""
    kind = np.int64 if largest(x) * n + max(map(abs, sums), default=0) < WIDE else object
    exact = x.astype(kind) * n - np.array(sums, kind)
    return (exact / n).astype(float), exact


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exactly; None where a long can't hold one."""
    top = largest(exact)
    if top * top * exact.shape[1] >= WIDE:
        exact = exact.astype(object)
    return [int(v) if v < 2**63 else None for v in (exact * exact).sum(1)]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and sums of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.int64)
                n += len(x)
                total += (x if largest(x) * len(x) < WIDE else x.astype(object)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *map(int, total)], pa.decimal128(38, 0))], names=["place", "value"])

    found = {r["place"]: int(r["value"]) for r in fit.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    return found.get(-1, 0), [found.get(d, 0) for d in range(width)]


def triangular(fit: DataFrame, n: int, sums: list[int], fan: int = FAN) -> np.ndarray:
    """The triangular factor of all centred rows of ``fit`` (one column of integer vectors)."""
    width = len(sums)
    schema = "id long, factor array<double>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                factor = np.linalg.qr(np.vstack([factor, centred(matrix(batch.column(0), np.int64), n, sums)[0]]), mode="r")
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.ravel()], pa.list_(pa.float64()))], names=["id", "factor"])

    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        own = [np.array(f).reshape(-1, width) for f in group.column("factor").to_pylist()]
        return pa.table({"id": pa.array([group.column("id")[0].as_py() // fan], pa.int64()), "factor": pa.array([np.linalg.qr(np.vstack(own), mode="r").ravel()], pa.list_(pa.float64()))})

    factors = cut(fit.mapInArrow(local, schema))
    while factors.count() > 1:  # ids fall by the fan each time
        factors = cut(factors.groupBy(F.floor(F.col("id") / fan).alias("node")).applyInArrow(merged, schema))
    last = factors.first()
    return np.array(last["factor"]).reshape(-1, width) if last else np.zeros((0, width))


def _identity_error(fit: DataFrame, axes: Axes) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(axes.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                w = axes.whitened(matrix(batch.column(0), np.int64))
                total += np.concatenate([(w.T @ w).ravel(), w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["place", "value"])

    total = np.zeros(k * k + k)
    for r in fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[r["place"]] = r["value"] / axes.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_axes(fit: DataFrame, width: int, components: int = COMPONENTS, fan: int = FAN) -> Axes:
    """Axes of ``fit``, one column of distinct integer vectors, which must be materialised.

    At most ``components`` axes, by falling eigenvalue; an axis without variance is none.
    The largest entry of each is positive.
    """
    n, sums = _sums(fit, width)
    if not n:
        return Axes(0, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    _, s, right = np.linalg.svd(triangular(fit, n, sums, fan), full_matrices=False)
    k = int(min(components, (s > RANK * s[0]).sum())) if s[0] > 0 else 0
    vectors = right[:k].T
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)]) if k else vectors
    axes = Axes(n, sums, vectors, s[:k] ** 2 / n, s[:k] ** 2 / max((s * s).sum(), 5e-324))
    axes.identity_error = _identity_error(fit, axes) if k else 0.0
    return axes


def whiten(rows: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that takes part and each axis.

    ``usable`` says which rows do.  Components become integers floor(256 * x), and each
    distinct integer vector counts once when the axes are fitted; equal vectors are found
    before they are shuffled.  ``deviation`` is exact (null beyond a long).  There are up to
    ``components`` axes, fewer if the vectors vary in fewer dimensions: a table of equal vectors,
    or of one, gives no rows, and neither does an empty one.  Repeated rows stay; ids may be
    null; other columns are not read.
    """
    kept, width = usable(rows, "vec_id")
    fit = cut(kept.select(integers(F.col("vector")).alias("x")).distinct())
    axes = fit_axes(fit, width, components, fan)
    k, kind = len(axes.values), kept.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows * k
            if m:
                x = matrix(batch.column(1), np.int64)
                each = pa.array(np.repeat(np.arange(len(x)), k), pa.int64())
                deviation = pa.array(deviations(centred(x, axes.n, axes.sums)[1]), pa.int64())
                columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, axes.n), pa.int64()), deviation.take(each)]
                columns += [pa.array(v, pa.float64()) for v in (axes.whitened(x).ravel(), np.tile(axes.explained, len(x)), np.full(m, axes.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return kept.select("vec_id", integers(F.col("vector")).alias("x")).mapInArrow(run, schema)


__all__ = ["Axes", "centred", "deviations", "fit_axes", "triangular", "whiten"]
