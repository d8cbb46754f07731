"""Whitening of embeddings by an exact integer scatter matrix, summed from bit planes.

Entries become integers, floor(`SCALE` * c). The model is fitted on each distinct integer
vector once, however often it is repeated. Per dimension the smallest entry is taken off,
so that entries are sums of bits; bit p of dimension a over 64 rows is one word, and

    sum of y_a * y_b  =  sum over bits p, q of 2^(p+q) * popcount(plane(a, p) & plane(b, q))

A dimension of ones gives the sums and the number of rows along the way. Every task adds
up its own rows; what it returns has the size of the matrix. The matrix is centred as
integers, n * sum(y_a y_b) - sum(y_a) sum(y_b), before the first rounding, so neither the
mean nor the number of rows takes digits off the covariance.

Rows without vec_id stay and keep it null. Rows whose vector is null or holds null or
non-finite entries go, and so do empty vectors and vectors of another length than most
distinct ones have (of lengths as common, the smaller counts): they share no dimensions
with the rest. Repeated rows are returned as often as they come. Entries beyond a long
take its ends. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnledger.storage import staging_path

SCALE = 256
COMPONENTS = 4
# Rows packed at a time: planes of 256 words.
BLOCK = 1 << 14
# Sums travel in parts of 32 bits; six of them hold the product of two longs over any
# number of rows.
LIMB_BITS, LIMBS = 32, 6
LARGEST_LONG = (1 << 63) - 1
LARGEST_DOUBLE = 1.7976931348623157e308


def integers(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries, as longs."""
    own = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"))

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST_DOUBLE)

    good = own.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """(rows, dimensions) of a column of lists of one length."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def ranges(fitted: DataFrame, length: int) -> tuple[list[int], list[int]]:
    """Smallest and largest entry of each dimension; a row per dimension leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                least, most = x.min(axis=0), x.max(axis=0)
                low = least if low is None else np.minimum(low, least)
                high = most if high is None else np.maximum(high, most)
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["d", "low", "high"]
            )

    found = (
        fitted.select("x").mapInArrow(run, "d long, low long, high long")
        .groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()  # one row per dimension
    )
    by_dimension = {r.d: r for r in found}
    return [by_dimension[d].low for d in range(length)], [by_dimension[d].high for d in range(length)]


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """(planes, words) of unsigned longs: the bits of each column of `y`, lowest first,
    over all rows; the last word is filled up with zeros."""
    rows, dims = y.shape
    words = -(-rows // 64)
    padded = np.zeros((dims, words * 64), np.uint64)
    padded[:, :rows] = y.T
    starts = np.concatenate([[0], np.cumsum(bits)])
    planes = np.empty((starts[-1], words), np.uint64)
    for p in range(max(bits)):
        some = np.flatnonzero(np.array(bits) > p)
        plane = ((padded[some] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        planes[starts[some] + p] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return planes


def cross_products(planes: np.ndarray, bits: list[int], total: np.ndarray) -> None:
    """Add the sums of products of all pairs of columns, a <= b, to the object array
    `total`, by counting the bits that two planes share."""
    starts = np.concatenate([[0], np.cumsum(bits)])
    # Weighted counts of one block fit a long, unless entries take most of a long.
    kind = np.int64 if 2 * max(bits) + (64 * planes.shape[1]).bit_length() < 63 else object
    weights = np.array([1 << p for b in bits for p in range(b)], kind)
    for a, (start, width) in enumerate(zip(starts, bits)):
        right, ends = planes[start:], (starts[a:-1] - start).astype(np.intp)
        line = np.zeros(len(bits) - a, kind)
        for p in range(width):
            shared = np.bitwise_count(right & planes[start + p]).sum(axis=1, dtype=np.int64)
            line += np.add.reduceat(shared.astype(kind) * weights[start:], ends) * (1 << p)
        total[a, a:] += line.astype(object)


def scatter(fitted: DataFrame, low: list[int], high: list[int]) -> list[list[int]]:
    """Sums of products of the entries above `low`, as exact integers; the last row and
    column belong to a dimension of ones. Half a matrix leaves each task."""
    bits = [max(1, (h - l).bit_length()) for l, h in zip(low, high)] + [1]
    dims = len(bits)
    # Differences of longs, modulo 2^64, are exact as unsigned longs.
    base = np.array(low, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        held, rows = [], 0

        def reduce() -> None:
            x = np.concatenate(held)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK].view(np.uint64) - base
                ones = np.ones((len(part), 1), np.uint64)
                cross_products(bit_planes(np.hstack([part, ones]), bits), bits, total)

        for batch in batches:
            if batch.num_rows:
                held.append(np.ascontiguousarray(matrix(batch)))
                rows += batch.num_rows
            if rows >= BLOCK:
                reduce()
                held, rows = [], 0
        if held:
            reduce()
        upper = np.triu_indices(dims)
        sums = [int(v) for v in total[upper]]
        if any(sums):
            parts = [[s >> LIMB_BITS * k & (1 << LIMB_BITS) - 1 for s in sums] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0] * dims + upper[1]), *[pa.array(p, pa.int64()) for p in parts]],
                names=["cell", *[f"l{k}" for k in range(LIMBS)]],
            )

    limbs = [f"l{k}" for k in range(LIMBS)]
    found = (
        fitted.select("x")
        .mapInArrow(run, "cell long, " + ", ".join(f"{c} long" for c in limbs))
        .groupBy("cell").agg(*[F.sum(c).alias(c) for c in limbs])
        .collect()  # half of dimensions squared
    )
    out = [[0] * dims for _ in range(dims)]
    for r in found:
        a, b = divmod(r.cell, dims)
        out[a][b] = out[b][a] = sum(r[c] << LIMB_BITS * k for k, c in enumerate(limbs))
    return out


@dataclass
class Whitening:
    """Components of the covariance of n distinct integer vectors."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    # (components, dimensions), and per component its eigenvalue, 0 for none.
    axes: np.ndarray
    values: np.ndarray
    # Eigenvalues over the trace; None where no entry varies.
    explained: list[float | None]
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): centred, projected and scaled; without variance not a number."""
        size = max(abs(v) for v in self.low + self.high)
        if 2 * self.n * size <= LARGEST_LONG:
            centred = (x * self.n - np.array(self.sums, np.int64)) / float(self.n)
        else:
            wide = x.astype(object) * self.n - np.array(self.sums, object)
            centred = (wide / self.n).astype(float)
        # Row by row sums: they do not depend on the rows of a batch.
        parts = [(centred * axis).sum(axis=1) for axis in self.axes]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.stack(parts, axis=1) / np.sqrt(np.where(self.values > 0, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - sums)^2, exactly."""
        size = max(abs(v) for v in self.low + self.high)
        most = size * max(size * len(self.sums), sum(map(abs, self.sums)))
        wide = x if most <= LARGEST_LONG else x.astype(object)
        squares = (wide * wide).sum(axis=1).tolist()
        crossed = (wide * np.array(self.sums, wide.dtype)).sum(axis=1).tolist()
        n, rest = self.n, sum(s * s for s in self.sums)
        return [n * n * q - 2 * n * r + rest for q, r in zip(squares, crossed)]


def _components(n: int, low: list[int], high: list[int], products: list[list[int]], count: int) -> Whitening:
    dims = len(low)
    above = products[-1][:dims]
    # Quotients of integers are rounded once.
    centred = np.array(
        [[(n * products[a][b] - above[a] * above[b]) / (n * n) for b in range(dims)] for a in range(dims)]
    )
    values, axes = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[:count]
    values, axes = values[order], axes[:, order].T
    # The largest entry of an axis is positive, so that reruns agree.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    trace = sum(n * products[a][a] - above[a] ** 2 for a in range(dims)) / (n * n)
    values = np.where(values > dims * np.finfo(float).eps * trace, values, 0.0)
    explained = [float(v / trace) if trace else None for v in values]
    return Whitening(n, [s + n * l for s, l in zip(above, low)], low, high, axes, values, explained)


def _identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, from
    the whitened values themselves: Spark centres and merges them as it goes."""
    some = np.flatnonzero(model.values > 0)
    if not len(some):
        return None
    names = [f"w{i}" for i in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = model.project(matrix(batch))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(w[:, i])) for i in some], names=names
                )

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = fitted.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    row = found.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first `components` components of the distinct vectors of `integers`; None
    without any vector."""
    spark = rows.sparkSession
    path = staging_path(spark, "distinct-vectors")
    rows.select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    lengths = distinct.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "length").first()
    if first is None:
        return None
    fitted = distinct.filter(F.size("x") == first.length)
    low, high = ranges(fitted, first.length)
    model = _components(first.n, low, high, scatter(fitted, low, high), components)
    model.identity_error = _identity_error(fitted, model)
    return model


SCHEMA = (
    "component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, deviation_exact decimal(38,0)"
)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of `integers` and component, without a shuffle.

    `deviation` is null where it goes beyond a long; `deviation_exact` has 38 digits.
    `whitened` is null for a component without variance.
    """
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            places = pa.array(np.repeat(np.arange(batch.num_rows), count))
            far = model.deviations(x)
            near = pa.array([d if d <= LARGEST_LONG else None for d in far], pa.int64())
            exact = pa.array([Decimal(d) if d < 10**38 else None for d in far], pa.decimal128(38, 0))
            white = model.project(x).ravel()
            total = len(white)
            of_all = lambda values, kind: pa.array(list(values) * batch.num_rows, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(places),
                    of_all(range(1, count + 1), pa.int32()),
                    pa.array(np.full(total, model.n)),
                    near.take(places),
                    pa.array(white, mask=np.isnan(white)),
                    of_all(model.explained, pa.float64()),
                    pa.array([model.identity_error] * total, pa.float64()),
                    exact.take(places),
                ],
                names=["vec_id", *[c.split()[0] for c in SCHEMA.split(", ")]],
            )

    own = rows.filter(F.size("x") == len(model.low))
    return own.mapInArrow(run, schema)


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE,
             column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact) of `vectors`, fitted on themselves."""
    rows = integers(vectors, scale, column)
    return whiten(rows, fit(rows, components))
