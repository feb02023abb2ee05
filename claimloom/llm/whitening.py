"""Embedding whitening with a covariance from polarised variances, exact until the last division.

An entry c counts as the integer ``floor(64 * c) + 1000000``; a row whose vector is null or
holds a null or non-finite entry is left out.  The covariance is that of the distinct integer
vectors.  Two passes over them, both sums of integers that combine before the shuffle: the
totals of every dimension, whose means rounded to integers are the centres; then the squares of
the centred value of every dimension and of the sum of every two dimensions.  What rounding took
from a mean is put back in integers.  Since Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b),
differences of these variances are the covariances; each is divided once, into the nearest
double, and ``numpy.linalg.eigh`` gives the components.

The driver holds a number for every two dimensions and no vector.  Squares are cut into an upper
and a lower part, so their sums fit decimals at any size.  A third pass over the distinct
vectors measures how far the covariance of the whitened values is from the identity.

Defined results: vectors of another length than the most frequent one (ties: the longer) and
entries beyond 2^62 / 64 are left out like null ones; repeated rows count once in the
covariance and all get a result; components without variance (at most rounding of the largest)
have null as whitened value; with no variance at all ``explained`` is 0; ``deviation`` is
null beyond 38 digits; with fewer dimensions than asked for there are as many components; a
null id stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import durable

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16

_SAFE = 1 << 62
_LOW = 60
#: Rows that one step of a task holds as a matrix.
_ROWS = 4096


def packed(vectors: pa.Array) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Of a column of lists: which rows are whole, their lengths, and their integers as bytes.

    Integers below 2^31 take four bytes, which equal vectors do alike.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), lengths)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False) * SCALE
    good = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~(np.abs(values) < _SAFE)]] = False
    ends = np.cumsum(lengths)
    kept, sizes, data = np.flatnonzero(good), [], []
    for r in kept:
        whole = np.floor(values[ends[r] - lengths[r] : ends[r]]).astype(np.int64) + SHIFT
        narrow = not len(whole) or int(np.abs(whole).max()) < 1 << 31
        sizes.append(len(whole))
        data.append(whole.astype("<i4" if narrow else "<i8").tobytes())
    return kept, sizes, data


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of rows of ``dims`` entries each."""
    found = column.to_pylist()
    if all(len(x) == 4 * dims for x in found):
        return np.frombuffer(b"".join(found), "<i4").reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(x, "<i4" if len(x) == 4 * dims else "<i8").astype(np.int64) for x in found])


def _bound(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def totals(x: np.ndarray) -> np.ndarray:
    """The exact sum of every column, as Python integers."""
    if _bound(x) * len(x) >= _SAFE:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def squares(d: np.ndarray) -> list[np.ndarray]:
    """For every dimension: the exact sum of its squares, then of those of its sum with each later one."""
    if (2 * _bound(d)) ** 2 * len(d) >= _SAFE:
        d = d.astype(object)
    found = []
    for i in range(d.shape[1]):
        pairs = d[:, i:].copy()
        pairs[:, 1:] += d[:, i : i + 1]
        found.append((pairs * pairs).sum(axis=0).astype(object))
    return found


def covariances(n: int, rest: list[int], q: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix from sums of squares about the centres.

    ``rest`` is what the sum of each dimension differs from n times its centre.
    """
    dims = len(rest)
    spread = {(i, j): n * q[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for i, j in q}
    found = np.zeros((dims, dims))
    for i in range(dims):
        found[i, i] = spread[i, i] / (n * n)
        for j in range(i + 1, dims):
            found[i, j] = found[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n * n)
    return found


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, unpacked(part.column(part.num_columns - 1), dims)


def _parts(values: dict[tuple[int, int], int], rows: int) -> pa.RecordBatch:
    """Sums of one task, each as upper * 2^60 + lower."""
    wide = pa.decimal128(38, 0)
    keys = list(values)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in keys], pa.int32()),
            pa.array([j for _, j in keys], pa.int32()),
            pa.array([rows] * len(keys), pa.int64()),
            pa.array([Decimal(values[k] >> _LOW) for k in keys], wide),
            pa.array([Decimal(values[k] & ((1 << _LOW) - 1)) for k in keys], wide),
        ],
        ["i", "j", "n", "upper", "lower"],
    )


def _summed(parts: DataFrame) -> tuple[int, dict[tuple[int, int], int]]:
    """Rows and sums over all tasks; the driver gets one number for every key."""
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).collect()
    return max((r["n"] for r in rows), default=0), {(r["i"], r["j"]): (int(r["upper"]) << _LOW) + int(r["lower"]) for r in rows}


_PARTS = "i int, j int, n long, upper decimal(38,0), lower decimal(38,0)"


def whitened(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every whole row and component."""
    spark = rows.sparkSession
    kind = rows.schema[vec_id].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, data = packed(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dims", "x"])

    source = rows.select(rows[vec_id].alias("vec_id"), rows[vector].cast("array<double>").alias("vector"))
    whole = durable(source.mapInArrow(pack, f"vec_id {kind}, dims int, x binary"))
    common = whole.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    if not dims:
        return spark.createDataFrame([], result)
    fitted = whole.where(F.col("dims") == dims).select("x")
    fit = durable(fitted.distinct())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, np.zeros(dims, object)
        for _, x in _matrices(batches, dims):
            seen, total = seen + len(x), total + totals(x)
        if seen:
            yield _parts({(i, i): int(total[i]) for i in range(dims)}, seen)

    n, sums = _summed(fit.mapInArrow(add_up, _PARTS))
    total = [sums[i, i] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found = 0, None
        for _, x in _matrices(batches, dims):
            own = squares(x - np.array(centre, np.int64))
            seen, found = seen + len(x), own if found is None else [a + b for a, b in zip(found, own, strict=True)]
        if found is not None:
            yield _parts({(i, i + k): int(v) for i, line in enumerate(found) for k, v in enumerate(line)}, seen)

    matrix = covariances(n, rest, _summed(fit.mapInArrow(square, _PARTS))[1])
    values, vectors = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    # Either sign is right; the largest entry is made positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    filled = values > dims * np.finfo(float).eps * max(float(values[0]), 0.0)
    axes = np.where(filled, vectors / np.sqrt(np.where(filled, values, 1.0)), 0.0)
    explained = np.where(filled, values, np.maximum(values, 0.0)) / trace if trace > 0 else np.zeros(len(order))
    offset = np.array([r / n for r in rest])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - np.array(centre, np.int64)) - offset) @ axes

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(order) + 1, len(order)))
        for _, x in _matrices(batches, dims):
            y = project(x)
            found[:-1] += y.T @ y
            found[-1] += y.sum(axis=0)
        a, b = np.indices(found.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(found.ravel())], ["a", "b", "value"])

    products = fit.mapInArrow(multiply, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value")).collect()
    measured = np.zeros((len(order) + 1, len(order)))
    for r in products:
        measured[r["a"], r["b"]] = r["value"] / n
    away = np.abs(measured[:-1] - np.outer(measured[-1], measured[-1]) - np.eye(len(order)))
    identity_error = float(away[np.ix_(filled, filled)].max()) if filled.any() else 0.0

    def deviations(x: np.ndarray) -> pa.Array:
        d = x - np.array(centre, np.int64)
        if (n * _bound(d) + n) ** 2 * dims < _SAFE:
            apart = n * d - np.array(rest, np.int64)
            return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
        apart = n * d.astype(object) - np.array(rest, object)
        found = (apart * apart).sum(axis=1)
        return pa.array([Decimal(v) if v < 10**38 else None for v in map(int, found)], pa.decimal128(38, 0))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(order)
        for part, x in _matrices(batches, dims):
            again = pa.array(np.repeat(np.arange(len(x)), k))
            many = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(many, n, np.int64)),
                    deviations(x).take(again),
                    pa.array(project(x).ravel(), mask=np.tile(~filled, len(x))),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(many, identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole.where(F.col("dims") == dims).select("vec_id", "x").mapInArrow(describe, result)
