"""Approximate nearest neighbours with learned partitions.

On a bounded sample the graph of nearest neighbours is built exactly and cut into parts
of equal size with few edges between them. A small classifier learns from the vectors in
which parts a vector's neighbours lie. It then sends every vector of the table to its
most probable part, and every query to its most probable parts; the vectors there are
ranked by their exact inner products in double precision.

Parts are cut into blocks of bounded size on both sides, so a crowded part is many small
tasks. A query goes to parts until the classifier is sure to `CERTAINTY` that they hold
its neighbours and until they hold enough candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger.llm.common import keep

NEIGHBOURS = 20
# Vectors that the index is fitted on at most.
SAMPLE = 8192
PARTS = 32
# Neighbours in the graph.
DEGREE = 16
HIDDEN = 128
# A part may be larger than the mean by this share.
SLACK = 0.05
CERTAINTY = 0.94
# Candidates, and queries, of a part that meet in one task.
BLOCK = 8192
SEED = 23


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """(rows, degree): the rows with the largest inner products, not the row itself."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 512] = np.argpartition(-near, degree - 1, axis=1)[:, :degree] if degree else 0
    return out


def _halves(x: np.ndarray, rows: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    """Rows cut along their widest direction, again and again, into equal parts."""
    if parts == 1:
        yield rows
        return
    own = x[rows] - x[rows].mean(axis=0)
    direction = np.linalg.eigh(own.T @ own)[1][:, -1]
    order = rows[np.argsort(own @ direction, kind="stable")]
    left = parts // 2
    cut = len(order) * left // parts
    yield from _halves(x, order[:cut], left)
    yield from _halves(x, order[cut:], parts - left)


def partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK,
              rounds: int = 12) -> np.ndarray:
    """Part of each row: balanced, with few edges between parts.

    Begins with equal cuts along the widest directions. Then rows move, those that gain
    most first, to the part that has most of their neighbours, while it has room; a full
    part takes a row in exchange for one that wants to go the other way.
    """
    part = np.empty(len(x), np.int64)
    for k, rows in enumerate(_halves(x, np.arange(len(x)), parts)):
        part[rows] = k
    a = np.repeat(np.arange(len(x)), graph.shape[1])
    b = graph.ravel()
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    for _ in range(rounds):
        links = np.zeros((len(x), parts))
        np.add.at(links, (a, part[b]), 1)
        np.add.at(links, (b, part[a]), 1)
        want = links.argmax(axis=1)
        gain = links.max(axis=1) - links[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=parts)
        waiting: dict[tuple[int, int], list[int]] = {}
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            old, new = int(part[row]), int(want[row])
            if sizes[new] < room:
                part[row] = new
                sizes[old] -= 1
                sizes[new] += 1
                moved += 1
            elif waiting.get((new, old)):
                other = waiting[new, old].pop()
                part[row], part[other] = new, old
                moved += 2
            else:
                waiting.setdefault((old, new), []).append(row)
        if moved < len(x) // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer: probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.w1, self.b1, self.w2, self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def learn_router(x: np.ndarray, goal: np.ndarray, hidden: int = HIDDEN, epochs: int = 30,
                 batch: int = 256, rate: float = 3e-3, seed: int = SEED) -> Router:
    """Cross entropy against the shares of parts among a row's neighbours, by Adam."""
    rng = np.random.default_rng(seed)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    d, k = x.shape[1], goal.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d) , (d, hidden)) * np.sqrt(d) / 4, np.zeros(hidden),
         rng.normal(0, np.sqrt(1 / hidden), (hidden, k)), np.zeros(k)]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, step = order[at : at + batch], step + 1
            hid = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = hid @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            dh = (dz @ p[2].T) * (hid > 0)
            slopes = [x[rows].T @ dh, dh.sum(axis=0), hid.T @ dz, dz.sum(axis=0)]
            speed = rate * (1 - epoch / epochs)
            for i, slope in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * slope
                v[i] = 0.999 * v[i] + 0.001 * slope**2
                p[i] = p[i] - speed * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit_router(x: np.ndarray, parts: int = PARTS) -> Router:
    """From a sample of vectors, in the order given."""
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x)
    part = partition(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    goal[np.arange(len(x)), part] += 1
    return learn_router(x, goal / goal.sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles that are neither null nor zero, without null or
    non-finite components, and of the length that most of these have."""
    largest = 1.7976931348623157e308
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= largest)
    good = own.filter("vec_id IS NOT NULL AND size(v) > 0").filter(
        F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    first = lengths.first()
    return good.filter(F.size("v") == (first.n if first else 0))


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, parts: int = PARTS,
           sample: int = SAMPLE, certainty: float = CERTAINTY, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` nearest vectors found, by
    inner product, ties to the smaller vec_id; fewer only if there are fewer candidates.

    `is_query` is a condition on vec_id. Every valid vector (see `valid`) but those with
    the query's own vec_id is a candidate. Rows that share a vec_id are one candidate,
    which counts by its largest score; a query id with several vectors asks with the
    smallest of them. An empty table gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    drawn = (
        rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").limit(sample)
    )
    x = np.array([r.v for r in drawn.collect()])  # at most `sample` vectors
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Broadcasts hold plain arrays: their values are not pickled with the code.
    sent = spark.sparkContext.broadcast(fit_router(x, parts).arrays())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
                part = Router(*sent.value).probabilities(x).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(part)], names=["vec_id", "v", "part"]
                )

    indexed = keep(rows.mapInArrow(assign, "vec_id long, v array<double>, part int"))
    count = len(sent.value[-1])
    ids = indexed.groupBy("part").agg(
        F.count("*").alias("rows"), F.approx_count_distinct("vec_id").alias("ids")
    ).collect()  # a row per part
    sizes, distinct = np.zeros(count, np.int64), np.zeros(count)
    for r in ids:
        sizes[r.part], distinct[r.part] = r.rows, r.ids
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
            p = Router(*sent.value).probabilities(x)
            order = np.argsort(-p, axis=1, kind="stable")
            sure = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            # Twice what is needed, as distinct ids are only estimated.
            held = np.cumsum(distinct[order], axis=1)
            need = 1 + ((sure < certainty) | (held < 2 * k + 2)).sum(axis=1)
            for n in range(count):
                some = np.flatnonzero(need > n)
                if len(some):
                    own = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("vec_id"), own.column("v"), pa.array(order[some, n].astype(np.int32))],
                        names=["vec_id", "v", "part"],
                    )

    routed = keep(asked.mapInArrow(route, "vec_id long, v array<double>, part int"))
    asks = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    # Blocks by a hash of the id: all rows of an id in a part are in the same block.
    blocks = lambda sizes: F.element_at(
        F.array(*[F.lit(max(1, -(-int(n) // block))) for n in sizes]), F.col("part") + 1
    )
    c_blocks, q_blocks = blocks(sizes), blocks([asks.get(i, 0) for i in range(count)])
    own_block = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    candidates = indexed.withColumn("c", own_block(c_blocks)).withColumn("q", every_block(q_blocks))
    queries = routed.withColumn("q", own_block(q_blocks)).withColumn("c", every_block(c_blocks))

    def nearest(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(held):
            held = held.sort_values("vec_id", kind="stable")
            ids, matrix = held.vec_id.to_numpy(), np.stack(held.v.to_numpy())
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            step = max(1, (1 << 22) // len(ids))
            for at in range(0, len(asks), step):
                some = asks.iloc[at : at + step]
                own = some.vec_id.to_numpy()
                scores = np.stack(some.v.to_numpy()) @ matrix.T
                # Rows of one id count by their largest score.
                scores, names = np.maximum.reduceat(scores, first, axis=1), ids[first]
                scores[names[None, :] == own[:, None]] = -np.inf
                for q, line in zip(own, scores):
                    least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                    best = np.flatnonzero((line >= least) & (line > -np.inf))
                    best = best[np.lexsort((names[best], -line[best]))][:k]
                    out["query_id"].append(np.full(len(best), q))
                    out["vec_id"].append(names[best])
                    out["score"].append(line[best])
        return pd.DataFrame({
            c: np.concatenate(x) if x else np.empty(0, np.int64 if c != "score" else float)
            for c, x in out.items()
        })

    keys = ["part", "c", "q"]
    found = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
