"""Lloyd's rounds on integer vectors, with Ptolemaic lower bounds from fixed pivots.

For any four points of Euclidean space, Ptolemy's inequality says

    d(x, c) * d(p, s)  >=  | d(x, p) * d(c, s) - d(x, s) * d(c, p) |

Pivots p, s are fixed, so d(x, p) and d(x, s) are cached with every vector, and each round
needs only the distances of the few centroids to the pivots for a lower bound on every
distance between a vector and a centroid. A vector is compared, with integers, to the
centroid of the lowest bound, then to the others in the order of their bounds until the
next bound is above the best distance found. Bounds are rounded down by more than all
roundings together can have raised them, and a centroid goes out only if its bound is
strictly above, so ties are decided exactly, and results are those of all comparisons.

Pivots decide the work, never the result. They are the centroids that the same rounds
give on a bounded sample (`PILOT` vectors): where a centroid of all vectors lies near a
pivot p, the inequality is nearly an equation. Each pivot is paired with the pivots
farthest from it, and a centroid is bounded by the pairs of its nearest pivot.

Rows without vec_id stay; among the starting centroids they come last. Rows whose vector
is null, has another length or holds null or non-finite entries go. Repeated rows are
vectors of their own. If there are fewer vectors than centroids, each is a centroid. Entries
beyond a long take its ends; sums stay exact, and `distance` or a total beyond a long is
null. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.whitening import LARGEST_LONG, integers, matrix
from turnledger.storage import staging_path

SCALE = 64
LENGTH = 64
CLUSTERS = 16
ROUNDS = 3
# Vectors that the pivots are chosen from, on the driver.
PILOT = 1024
# Pivots that each pivot is paired with.
PARTNERS = 3
# A cached distance is off by 2^-24 of itself at most, a product of it and an own distance
# by little more; sixteen times as much is taken off.
SLACK = 2.0**-20
# Entries up to here have distances that fit a long at any usual length.
SMALL = 1 << 26


def small(x: np.ndarray) -> bool:
    return -SMALL <= x.min(initial=0) and x.max(initial=0) <= SMALL


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; longs if they fit, else Python integers."""
    if not (small(x) and small(c) and x.shape[1] <= 1 << 8):
        x, c = x.astype(object), c.astype(object)
    apart = x - c
    return (apart * apart).sum(axis=1)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(rows, points) of distances as doubles."""
    parts = [np.sqrt(squared(x, p[None, :]).astype(float)) for p in points]
    return np.stack(parts, axis=1) if parts else np.empty((len(x), 0))


@dataclass
class Pivots:
    """Fixed points and fixed pairs of them, `pairs[i]` those that begin with point i."""

    points: np.ndarray
    pairs: list[list[int]]

    @classmethod
    def of(cls, points: np.ndarray, partners: int = PARTNERS) -> Pivots:
        points = np.unique(points, axis=0)
        apart = distances(points, points)
        order = np.argsort(-apart, axis=1, kind="stable")[:, :partners]
        return cls(points, [[int(s) for s in line if apart[p, s] > 0] for p, line in enumerate(order)])

    def bounds(self, cached: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """(rows, centroids): squared distances are not below these. `cached` are the
        distances of the rows to the points."""
        own, apart = distances(centroids, self.points), distances(self.points, self.points)
        out = np.zeros((len(cached), len(centroids)))
        for c, line in enumerate(own):
            p = int(line.argmin())
            for s in self.pairs[p]:
                left, right = cached[:, p] * line[s], cached[:, s] * line[p]
                least = (np.abs(left - right) - SLACK * (left + right)) / apart[p, s]
                np.maximum(out[:, c], least, out=out[:, c])
        return out * out * (1 - SLACK)


def nearest(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray,
            pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, comparisons): the nearest centroid of each row, ties
    to the smaller number, and how many exact distances that took."""
    least = pivots.bounds(cached, centroids)
    order = np.argsort(least, axis=1, kind="stable")
    cluster = order[:, 0].copy()
    best = squared(x, centroids[cluster])
    compared = len(x)
    rows = np.arange(len(x))
    for k in range(1, len(centroids)):
        # A double of `best` may be rounded down by less than one part in 2^52.
        near = best[rows].astype(float) * (1 + 2.0**-50)
        rows = rows[least[rows, order[rows, k]] <= near]
        if not len(rows):
            break
        c = order[rows, k]
        d = squared(x[rows], centroids[c])
        if d.dtype != best.dtype:
            d, best = d.astype(object), best.astype(object)
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c[better]
        compared += len(rows)
    return cluster, best, compared


def moved(centroids: np.ndarray, counts: list[int], sums: list[list[int]]) -> np.ndarray:
    """Componentwise floor of the means; empty clusters stay."""
    lines = [[s // n for s in line] if n else own.tolist() for own, n, line in zip(centroids, counts, sums)]
    return np.array(lines, np.int64).reshape(centroids.shape)


def pilot_pivots(sample: np.ndarray, start: np.ndarray, rounds: int) -> Pivots:
    """Pivots from the rounds on a sample; any point would do."""
    centroids = start
    for _ in range(rounds):
        d = distances(sample, centroids)
        cluster = d.argmin(axis=1)
        counts = np.bincount(cluster, minlength=len(centroids)).tolist()
        sums = [[sum(v) for v in zip(*sample[cluster == c].tolist())] for c in range(len(centroids))]
        centroids = moved(centroids, counts, sums)
    return Pivots.of(centroids)


def exact(values, kind=pa.int64()) -> pa.Array:
    """Longs; null where an integer is beyond a long."""
    return pa.array([int(v) if int(v) <= LARGEST_LONG else None for v in values.tolist()], kind)


@dataclass
class Clustering:
    """What the rounds leave: staged vectors with their cached distances, the pivots and
    the centroids."""

    staged: DataFrame
    pivots: Pivots
    centroids: np.ndarray


def _staged(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(vec_id, x, cached): written once, read by every round."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cached = distances(matrix(batch), pivots.points).astype(np.float32)
                width = cached.shape[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(cached) + 1, dtype=np.int32) * width), pa.array(cached.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("x"), lists], names=["vec_id", "x", "cached"]
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    path = staging_path(spark, "pivot-distances")
    rows.mapInArrow(run, f"vec_id {kind}, x array<long>, cached array<float>").write.parquet(path)
    return spark.read.parquet(path)


def _round(found: Clustering) -> tuple[list[int], list[list[int]]]:
    """Counts and sums of the clusters: each task returns one row per cluster and dimension."""
    centroids, pivots = found.centroids, found.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                cluster, _, _ = nearest(x, matrix(batch, "cached").astype(float), centroids, pivots)
                counts += np.bincount(cluster, minlength=len(centroids))
                wide = x if small(x) else x.astype(object)
                for c in np.unique(cluster):
                    sums[c] += wide[cluster == c].sum(axis=0).astype(object)
        for c in np.flatnonzero(counts):
            totals = [int(counts[c]), *sums[c].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(totals), c, np.int32)),
                    pa.array(np.arange(-1, len(totals) - 1, dtype=np.int32)),
                    pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0)),
                ],
                names=["cluster", "d", "total"],
            )

    totals = (
        found.staged.select("x", "cached").mapInArrow(run, "cluster int, d int, total decimal(38,0)")
        .groupBy("cluster", "d").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
        .collect()  # clusters times dimensions and one
    )
    counts, sums = [0] * len(centroids), [[0] * centroids.shape[1] for _ in centroids]
    for r in totals:
        if r.d < 0:
            counts[r.cluster] = int(r.total)
        else:
            sums[r.cluster][r.d] = int(r.total)
    return counts, sums


def cluster_rounds(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
                   length: int = LENGTH, seed: str = "1", pilot: int = PILOT,
                   column: str = "embedding") -> Clustering | None:
    """The centroids after `rounds` rounds; None without any vector.

    They start as the `clusters` vectors with the smallest sha256 of `seed`:vec_id, ties
    by the vector.
    """
    rows = integers(vectors, scale, column).filter(F.size("x") == length)
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")), 256)
    drawn = (
        rows.withColumn("hash", F.when(F.col("vec_id").isNotNull(), hashed))
        .orderBy(F.asc_nulls_last("hash"), "x").limit(max(pilot, clusters)).collect()
    )
    if not drawn:
        return None
    sample = np.array([r.x for r in drawn], np.int64)
    start = sample[:clusters]
    pivots = pilot_pivots(sample, start, rounds)
    found = Clustering(_staged(rows, pivots), pivots, start)
    for _ in range(rounds):
        found.centroids = moved(found.centroids, *_round(found))
    return found


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assigned(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, compared): each vector with its nearest centroid, the
    squared distance and the number of exact distances per row of its batch."""
    centroids, pivots = found.centroids, found.pivots
    kind = found.staged.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, best, compared = nearest(
                    matrix(batch), matrix(batch, "cached").astype(float), centroids, pivots
                )
                share = np.full(batch.num_rows, compared / batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), exact(best), pa.array(share)],
                    names=["vec_id", "cluster", "distance", "compared"],
                )

    return found.staged.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, compared double")


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    found = cluster_rounds(vectors, **options)
    if found is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    spark = vectors.sparkSession
    path = staging_path(spark, "clusters")
    assigned(found).drop("compared").write.parquet(path)
    rows = spark.read.parquet(path)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.count("distance") == F.count("*")
    totals = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.when(whole, wide).alias("total")).collect()}
    known = [totals.get(c, Decimal(0)) for c in range(len(found.centroids))]
    every = None if None in known else sum(known)

    def literal(value):
        fits = value is not None and value <= LARGEST_LONG
        return F.lit(int(value) if fits else None).cast("long")

    place = F.col("cluster") + 1
    return rows.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[literal(t) for t in known]), place).alias("cluster_inertia"),
        literal(every).alias("inertia"),
        F.element_at(F.array(*[F.lit(digest(c)) for c in found.centroids]), place).alias("centroid_sha256"),
    )
