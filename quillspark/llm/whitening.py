"""Whitening of embeddings by a one-sided Jacobi SVD.

Vectors become fixed-point whole numbers, so that their count and sums are exact whatever the partitions. Centred rows are
compressed blockwise to one triangular factor by TSQR: each task folds its batches into a factor of its own, and factors meet in
groups of ``FAN_IN`` until one is left. Plane rotations then orthogonalise that factor's columns, by rounds of disjoint pairs; the
rotations together are the components and the columns' lengths their standard deviations, small ones as accurate as large ones.
Only sums and factors, whose size is the dimension's, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed

#: Factors that one task stacks, and sweeps of rotations at most.
FAN_IN, SWEEPS = 64, 60
_FACTOR = "place long, factor binary"


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` vectors of exact ``sums``; ``axes`` has a unit component in each column, ``deviations`` what x deviates
    along each, both by falling deviation; ``total`` is the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    deviations: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, from the exact n * x - sums."""
        return (self.n * x - np.array(self.sums, np.int64)) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / self.deviations


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fixed_point(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """id and x, floor(scale * component) + shift, of the rows whose vector is there, not empty and finite throughout."""
    whole = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(vector_col, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift).cast("long"))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole).select(F.col(id_col).alias("id"), x.alias("x"))


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components in columns, lengths of a's columns along them), by falling length: rotations of pairs of columns until all are
    at right angles. In a round each column has one partner, so a round's rotations are done together."""
    d = a.shape[1]
    columns, v = np.array(a.T, np.float64, order="C"), np.eye(d)  # a column of each in a row, where it lies together
    seats, right = np.arange(d + d % 2), np.finfo(float).eps * np.sqrt(max(d, 16))
    for _ in range(SWEEPS if d > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            p, q = p[(p < d) & (q < d)], q[(p < d) & (q < d)]
            x, y = columns[p], columns[q]
            xx, yy, xy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", x, y)
            (open_,) = np.nonzero(np.abs(xy) > right * np.sqrt(xx) * np.sqrt(yy))
            if len(open_):
                turned, p, q, x, y = True, p[open_], q[open_], x[open_], y[open_]
                zeta = (yy[open_] - xx[open_]) / (2 * xy[open_])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = (1 / np.hypot(1.0, t))[:, None]
                s = c * t[:, None]
                columns[p], columns[q] = c * x - s * y, s * x + c * y
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    lengths = np.linalg.norm(columns, axis=1)
    order = np.argsort(-lengths, kind="stable")
    v = v[order].T
    # The largest entry of a component is positive, so that its sign doesn't hang on the order of rotations.
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0), lengths[order]


def _sums(dim: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + _matrix(b.column("x"), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n), pa.int64()), pa.array(total)], ["i", "n", "s"])

    return of


def _packed(factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.astype("<f8").tobytes()])], ["place", "factor"])


def _stacked(factors: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """The triangular factor of all rows of ``factors``, as many rows at a time as make the work matrix a few times as high as wide."""
    held, rows, least = [np.empty((0, dim))], 0, max(4 * dim, 1024)
    for f in factors:
        held, rows = [*held, f], rows + len(f)
        if rows > least:
            held = [np.linalg.qr(np.concatenate(held), mode="r")]
            rows = len(held[0])
    return np.linalg.qr(np.concatenate(held), mode="r")


def _triangular(x: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    dim = len(sums)
    mean = Whitening(n, sums, np.empty((dim, 0)), np.empty(0), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _packed(_stacked((mean.centred(_matrix(b.column("x"), dim)) for b in batches), dim))

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"factor": [_stacked((np.frombuffer(f, "<f8").reshape(-1, dim) for f in table["factor"].to_pylist()), dim).tobytes()], "place": pa.array([table["place"][0].as_py() // FAN_IN], pa.int64())}).select(["place", "factor"])

    found = checkpointed(x.mapInArrow(rows, _FACTOR))
    while (found.agg(F.max("place")).first()[0] or 0) >= FAN_IN:
        found = checkpointed(found.groupBy(F.floor(F.col("place") / FAN_IN).alias("group")).applyInArrow(meet, _FACTOR))
    return _stacked((np.frombuffer(r["factor"], "<f8").reshape(-1, dim) for r in found.orderBy("place").collect()), dim)


def fit(x: DataFrame, components: int) -> Whitening | None:
    """Of (id, x) rows of one dimension; None for no rows."""
    dim = x.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return None
    found = {r["i"]: r for r in x.mapInArrow(_sums(dim), "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    n, sums = found[0]["n"], tuple(found[i]["s"] for i in range(dim))
    axes, lengths = jacobi(_triangular(x, n, sums))
    # Directions in which nothing varies can't be scaled to one.
    kept = min(components, int((lengths > max(n, dim) * np.finfo(float).eps * max(lengths[0], 1e-300)).sum()))
    deviations = lengths / np.sqrt(n)
    return Whitening(n, sums, axes[:, :kept], deviations[:kept], float((deviations**2).sum()))


def identity_error(x: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity. Whitened rows are centred already, so products are
    taken as they are and what is left of a mean, by rounding, comes off in the end."""
    k, dim = len(w.deviations), len(w.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            z = w.whiten(_matrix(b.column("x"), dim))
            total += np.column_stack((z.T @ z, z.sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    if not k:
        return 0.0
    rows = x.mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r["s"] for r in rows]).reshape(k, k + 1) / w.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n, deviation (decimal: the exact sum over dimensions of (n * x - sums) squared), whitened and explained (arrays by
    component) and identity_error of every vector that takes part, x being its fixed-point form (see ``fixed_point``).

    Edge cases: vectors that are null, empty or hold null or non-finite entries take no part; nor do those of another length than
    the commonest (the longer, of two), since they have no covariance with the others. Null ids and repeated rows count as rows. No
    more components are given than there are directions that vary: none for one vector, or for many that are alike. An empty
    table gives no rows; other columns are not read.
    """
    x = fixed_point(vectors, scale, shift, id_col, vector_col)
    common = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    kind = dict(vectors.dtypes)[id_col]
    if common is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    dim = common["dim"]
    x = x.where(F.size("x") == dim)
    w = fit(x, components)
    sums = np.array(w.sums, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("x"), dim)
            away = w.n * m - sums
            if dim * float(np.abs(away).max(initial=0)) ** 2 < 2**62:
                exact = pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = pa.array([sum(c * c for c in r) for r in away.tolist()], pa.decimal128(38, 0))
            z = w.whiten(m)
            ends = pa.array(np.arange(len(m) + 1) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), exact, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    explained = F.array(*[F.lit(float(d * d / w.total)) for d in w.deviations]).cast("array<double>")
    found = x.mapInArrow(rows, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return found.select(F.col("id").alias(id_col), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(x, w)).alias("identity_error"))
