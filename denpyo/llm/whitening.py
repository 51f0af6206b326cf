"""Whitening of embeddings by a covariance from exact squares.

Method: no product of two dimensions is ever summed. For every dimension, and for the sum of every
pair of dimensions, the squares of the centred values are added up as integers. With the variance
of a sum, 2 cov(i, j) = var(i + j) - var(i) - var(j) (polarisation), which gives the whole matrix
for `eigh`. All sums are exact, so they do not depend on the order or the partitions of the rows.

An entry c becomes the integer x = floor(64 c) + 1,000,000. One pass counts the vectors and adds up
each dimension; the next one centres at the integer next to the mean and squares. What separates
that integer from the mean, less than one, is a fraction of known integers and is accounted for
exactly. Tasks add 64-bit numbers as long as these can not overflow and Python's integers beyond;
sums travel as six limbs of 32 bits, which Spark adds.

A third pass whitens: the centred vector, projected on the unit eigenvectors and divided by the
standard deviations. Its covariance is measured in the same way rows are written, again over all rows.

What the driver holds is the matrix, as large as the square of the dimensions, whatever the number of rows.

Results by case: vectors that are null, empty or hold null or non-finite entries (or entries beyond
2^50, which no 64-bit x could hold) are dropped, as are those of another length than most;
repeated rows and null ids are rows of their own; equal eigenvalues may be numbered in any order.
A component without variance (no more than rounding leaves of the largest eigenvalue) has null as
`whitened`, a deviation beyond 64 bits is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean

#: x = floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
#: Entries beyond this size take no part.
LARGEST = 2.0 ** 50
#: Components given, and vectors of one batch of output.
COMPONENTS, ROWS = 32, 1024
#: Limbs of a sum: together 192 bits.
LIMBS, LIMB = 6, 32
_LIMB_NAMES = [f"limb{i}" for i in range(LIMBS)]
_SUMS = "key INT, " + ", ".join(f"{n} LONG" for n in _LIMB_NAMES)


class Fit(NamedTuple):
    """What is known of the vectors: their number, exact sums, and the whitening directions."""

    count: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one in each column
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The integer next to the mean of each dimension."""
        return np.array([_nearest(s, self.count) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """count * (mean - centre), exactly."""
        return [s - self.count * int(c) for s, c in zip(self.sums, self.centre)]

    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.values) * np.finfo(np.float64).eps * max(self.values[0], 0)

    def directions(self, components: int) -> np.ndarray:
        """Eigenvectors over the standard deviations; columns without variance are zero."""
        scale = np.where(self.usable(), np.sqrt(np.maximum(self.values, 1e-300)), np.inf)
        return (self.vectors / scale)[:, :components]


def _nearest(total: int, count: int) -> int:
    return (2 * total + count) // (2 * count)


def _integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their x-vectors)."""
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column), size).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(len(rows), size)
    good = (np.abs(flat) < LARGEST).all(axis=1)  # false for NaN, which nulls become
    return rows[good], np.floor(STEPS * flat[good]).astype(np.int64) + OFFSET


def _safe(values: np.ndarray, power: int, terms: int) -> np.ndarray:
    """The values as 64-bit numbers if a sum of so many of their powers fits, else as Python's."""
    most = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
    return values if most ** power * terms < 1 << 62 else values.astype(object)


def _limbs(sums: list[int]) -> pa.RecordBatch:
    columns = [pa.array(range(len(sums)), pa.int32())]
    rest = list(sums)
    for _ in range(LIMBS - 1):
        columns.append(pa.array([r & (1 << LIMB) - 1 for r in rest], pa.int64()))
        rest = [r >> LIMB for r in rest]
    return pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.int64())], ["key", *_LIMB_NAMES])


def _added(vectors: DataFrame, column: str, size: int, totals) -> list[int]:
    """Sums over all vectors: `totals` gives those of the x-vectors of a batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sums = None
        for batch in batches:
            _, x = _integers(batch.column(0), size)
            if len(x):
                own = totals(x)
                sums = own if sums is None else [a + b for a, b in zip(sums, own)]
        if sums:
            yield _limbs(sums)

    parts = bounded(vectors).select(F.col(column)).mapInArrow(task, _SUMS)
    rows = parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in _LIMB_NAMES]).orderBy("key").collect()
    return [sum(int(r[n]) << LIMB * i for i, n in enumerate(_LIMB_NAMES)) for r in rows]


def _linear(x: np.ndarray) -> list[int]:
    """The number of vectors and the sum of each dimension."""
    return [len(x), *map(int, _safe(x, 1, len(x)).sum(axis=0))]


def _squares(centre: np.ndarray):
    """Sums of the squares of centred values: all dimensions, then the sums of all pairs (i < j)."""

    def totals(x: np.ndarray) -> list[int]:
        z = x - centre
        most = _safe(2 * z, 2, len(z))
        z = np.ascontiguousarray((z if most.dtype != object else z.astype(object)).T)
        out = [(z * z).sum(axis=1)]
        for i in range(len(z) - 1):
            both = z[i] + z[i + 1:]
            both *= both
            out.append(both.sum(axis=1))
        return [int(v) for sums in out for v in sums]

    return totals


def covariance(count: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance from the sums of squares (as `_squares` orders them) of values whose sums are `rest`.

    n^2 var = n * squares - sum^2 for every dimension and every pair's sum, in integers; a quotient of
    integers is rounded once.
    """
    size = len(rest)
    own = [count * squares[i] - rest[i] ** 2 for i in range(size)]
    out = np.empty((size, size))
    at = size
    for i in range(size):
        out[i, i] = own[i] / count ** 2
        for j in range(i + 1, size):
            both = count * squares[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * count ** 2)
            at += 1
    return out


def fit(vectors: DataFrame, column: str = "embedding") -> Fit | None:
    """Count, sums and eigenvectors of all vectors that take part; None if there are none."""
    # As many groups as there are lengths.
    most = vectors.groupBy(F.size(column).alias("size")).count().filter("size > 0").orderBy(
        F.desc("count"), F.desc("size")).first()
    if most is None:
        return None
    count, *sums = _added(vectors, column, most["size"], _linear) or [0]
    if not count:
        return None
    start = Fit(count, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    matrix = covariance(count, start.rest, _added(vectors, column, most["size"], _squares(start.centre)))
    values, directions = np.linalg.eigh(matrix)
    return Fit(count, sums, values[::-1].copy(), np.ascontiguousarray(directions[:, ::-1]), float(np.trace(matrix)))


def _whitened(model: Fit, components: int):
    """Function from x-vectors to their whitened components."""
    centre, shift = model.centre, np.array([r / model.count for r in model.rest])
    directions = model.directions(components)
    return lambda x: ((x - centre) - shift) @ directions


def identity_error(vectors: DataFrame, model: Fit, components: int = COMPONENTS, column: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over all vectors."""
    size, usable = len(model.sums), np.flatnonzero(model.usable()[:components])
    project = _whitened(model, components)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        products, sums = np.zeros((len(usable), len(usable))), np.zeros(len(usable))
        for batch in batches:
            _, x = _integers(batch.column(0), size)
            w = project(x)[:, usable]
            products += w.T @ w
            sums += w.sum(axis=0)
        k = len(usable)
        yield pa.RecordBatch.from_pydict({
            "i": np.r_[np.repeat(np.arange(k), k), np.arange(k)].astype(np.int32),
            "j": np.r_[np.tile(np.arange(k), k), np.full(k, -1)].astype(np.int32), "v": np.r_[products.ravel(), sums]})

    parts = bounded(vectors).select(F.col(column)).mapInArrow(task, "i INT, j INT, v DOUBLE")
    total, mean = np.zeros((len(usable), len(usable))), np.zeros(len(usable))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row for each pair of components
        if r.j < 0:
            mean[r.i] = r.v / model.count
        else:
            total[r.i, r.j] = r.v / model.count
    return float(np.abs(total - np.outer(mean, mean) - np.eye(len(usable))).max(initial=0.0))


SCHEMA = "vec_id LONG, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


def whiten(vectors: DataFrame, model: Fit | None = None, components: int = COMPONENTS,
           column: str = "embedding") -> DataFrame:
    """A row (SCHEMA) for each vector (vec_id, column) that takes part and each of the first components.

    `deviation` is the sum over dimensions of (n x - S)^2, `explained` the component's share of the
    variance, `identity_error` that of these vectors' whitened components.
    """
    model = model or fit(vectors, column)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    size, count, centre = len(model.sums), model.count, model.centre
    rest = np.array(model.rest, object)
    project, given = _whitened(model, components), min(components, size)
    usable = model.usable()[:given]
    explained = model.values[:given] / model.trace if model.trace > 0 else np.zeros(given)
    error = identity_error(vectors, model, components, column)

    def deviations(x: np.ndarray) -> list[int | None]:
        z = x - centre
        most = count * max(abs(int(z.min())), abs(int(z.max()))) + max(map(abs, rest))
        y = count * z - rest.astype(np.int64) if most ** 2 * size < 1 << 62 else count * z.astype(object) - rest
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows, x = _integers(batch.column(1), size)
            ids = batch.column(0).take(pa.array(rows))
            for at in range(0, len(x), ROWS):
                own = x[at:at + ROWS]
                each = pa.array(np.repeat(np.arange(len(own)), given))
                flat = project(own).ravel()
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(own)).take(each), pa.array(np.tile(np.arange(1, given + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(flat), count, np.int64)), pa.array(deviations(own), pa.int64()).take(each),
                    pa.array(flat, mask=~np.tile(usable, len(own))), pa.array(np.tile(explained, len(own))),
                    pa.array(np.full(len(flat), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    return rows.mapInArrow(task, SCHEMA)
