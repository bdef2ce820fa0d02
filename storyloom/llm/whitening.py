"""Embedding whitening by polarisation.

Components are scaled to whole numbers x = floor(256 * c), so every sum is exact. The covariance comes from
squares alone: for each dimension and for the sum of each pair of dimensions the squares of the centred
values are added up, and cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. Tasks centre by the whole number
nearest to the mean, z = x - m; as the sums of z are known exactly too, what is left of the mean is put right
in whole numbers: sum((n x - S)^2) = n^2 sum(z^2) - n (sum z)^2. Only dimensions squared sums reach the driver,
which divides them once and calls eigh.

The fit list has each distinct vector once. Tasks add up their own rows, and Spark adds up the tasks' sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import cut, quoted

#: Whole steps in a component of 1.
STEPS = 256
#: Squares of larger centred values are added as Python's numbers, which have no bound.
_NARROW = 1 << 24
#: Rows squared at once: their sums stay below 2^62.
_ROWS = 1 << 10
#: Eigenvalues below this share of the largest are rounding of a variance of zero.
_ZERO = 1e-13


@dataclass
class Whitening:
    """What is fitted: n vectors, their sums, and the covariance's eigenvalues (falling) and eigenvectors (columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def rank(self) -> int:
        """Components with a variance above zero."""
        return int((self.eigenvalues > _ZERO * max(self.eigenvalues.max(initial=0.0), 0.0)).sum()) if self.n else 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S over n, in double precision from whole numbers."""
        return _scaled(x, self.n, self.sums).astype(np.float64) / self.n

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        k = min(k, self.rank)
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def _largest(x: np.ndarray) -> int:
    """The largest absolute value, as Python's number."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: as 64-bit numbers where they fit, else as Python's."""
    if _largest(x) * n + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part: x = floor(256 c) + 0 as longs.

    Left out are vectors that are null, empty, hold a null or non-finite component, or are of another length than
    most (of several such lengths the shortest counts). Further columns are not looked at.
    """
    usable = F.expr("size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    given = vectors.select(quoted(vectors, vec_id).alias("vec_id"), quoted(vectors, embedding).cast("array<double>").alias("v")).where(usable)
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    of_length = given.where(F.size("v") == (lengths[0].n if lengths else 0))
    return of_length.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))


def _summed(frame: DataFrame, made: Callable[[np.ndarray], list[int]], dim: int) -> list[int]:
    """Exact column sums of made(x) over all vectors x of frame: one row of sums a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), _ROWS):
                own = made(x[at : at + _ROWS])
                total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            limbs = [[(t >> 60 * k) & ((1 << 60) - 1) if k < 3 else t >> 180 for t in total] for k in range(4)]  # the last one has the sign
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(v, pa.int64()) for v in limbs]], names=["at", "a", "b", "c", "d"])

    parts = frame.select("x").mapInArrow(run, "at int, a long, b long, c long, d long")
    exact = parts.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "abcd"])
    return [sum(int(v) << 60 * k for k, v in enumerate(r[1:])) for r in sorted(exact.collect())]


def _squares(x: np.ndarray, middle: np.ndarray) -> list[int]:
    """Sums of z, of z_i^2 and, for each pair i < j in order, of (z_i + z_j)^2, where z = x - middle."""
    dim = x.shape[1]
    if _largest(x) + _largest(middle) >= _NARROW:
        z = x.astype(object) - middle.astype(object)
        sums = [z.sum(0), (z * z).sum(0), *[((z[:, i : i + 1] + z[:, i + 1 :]) ** 2).sum(0) for i in range(dim - 1)]]
    else:
        z = x - middle
        sums = [z.sum(0), np.einsum("ij,ij->j", z, z)]
        for i in range(dim - 1):
            both = z[:, i : i + 1] + z[:, i + 1 :]
            sums.append(np.einsum("ij,ij->j", both, both))
    return [int(v) for s in sums for v in s]


def fit(fit_list: DataFrame) -> Whitening:
    """The covariance (divisor n) of a column x of distinct whole vectors of one length, and its eigenvectors.

    An eigenvector's largest component (the first of several) is positive. No vectors give n = 0.
    """
    first = fit_list.select(F.size("x").alias("dim")).limit(1).collect()
    if not first:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    dim = first[0].dim
    n, *sums = _summed(fit_list, lambda x: [len(x), *map(int, (x.astype(object) if _largest(x) >= 1 << 50 else x).sum(0))], dim)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    every = _summed(fit_list, lambda x: _squares(x, middle), dim)
    rest, squares = every[:dim], iter(every[2 * dim :])
    # sum((n x - S)^2) by dimension, then by the sum of two dimensions; cov = what polarisation leaves, over n^3.
    own = [n * n * q - n * r * r for q, r in zip(every[dim : 2 * dim], rest)]
    covariance = np.diag([float(Fraction(q, n**3)) for q in own])
    for i in range(dim):
        for j in range(i + 1, dim):
            both = n * n * next(squares) - n * (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = float(Fraction(both - own[i] - own[j], 2 * n**3))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(0)
    return Whitening(n, sums, covariance, values, vectors * np.sign(vectors[largest, np.arange(dim)]))


def identity_error(fit_list: DataFrame, model: Whitening, k: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened rows."""
    k = min(k, model.rank)
    if not k:
        return 0.0
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = model.project(_matrix(batch.column(0), dim), k)
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "s"])

    rows = fit_list.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    means = np.array([r.s for r in rows]) / model.n
    return float(np.abs(means[k:].reshape(k, k) - np.outer(means[:k], means[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each of
    the first k components.

    Components are numbered from 1 by falling eigenvalue; those without any variance (all, if there is one
    distinct vector only) have no rows. deviation is exact and null where it doesn't fit 64 bits. Which rows take
    part: see whole_vectors(); rows of one id, or repeated ones, get rows each; a null id stays null. Components
    beyond 2^55 saturate at the ends of 64 bits. An empty table gives no rows. Vectors of d dimensions cost
    d^2 / 2 squares each and d^2 / 2 sums on the driver.
    """
    given = cut(whole_vectors(vectors, vec_id, embedding))
    fit_list = cut(given.select("x").distinct())
    model = fit(fit_list)
    error, dim = identity_error(fit_list, model, k), len(model.sums)
    k = min(k, model.rank)
    trace = float(np.trace(model.covariance))
    id_type = given.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            y = _scaled(x, model.n, model.sums)
            if y.dtype == object or _largest(y) ** 2 * dim >= 1 << 63:
                exact = [int(d) if d < 1 << 63 else None for d in (y.astype(object) ** 2).sum(1)]
            else:
                exact = (y * y).sum(1)
            w = model.project(x, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    if not k:
        given = given.limit(0)
    made = given.mapInArrow(run, f"vec_id {id_type}, deviation long, w array<double>") if dim else given.selectExpr("vec_id", "0L AS deviation", "cast(array() AS array<double>) AS w")
    shares = F.array(*[F.lit(float(e) / trace) for e in model.eigenvalues[:k]]).cast("array<double>")
    rows = made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
