"""Document quality from trusted positives and unlabelled web text.

Positive-unlabelled learning: a linear model over hashed byte trigrams and levels of
repetition minimises the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss. The class prior is estimated from positives and unlabelled
documents alone: a first model tells the two apart, and on documents it has not seen
the smallest ratio of "share of unlabelled above t" to "share of positives above t",
with a margin for small samples, bounds the share of positives among the unlabelled.

The fit uses bounded samples; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import bounded_batches, crc_fold, map_batches, text_or_empty

# Feature columns of the trigram hash.
FEATURES = 2048
# Columns on repetition, and the words that are looked at together.
REPETITION = 40
WINDOW = 64
# Trusted positives, and as many unlabelled documents, that a fit reads at most.
SAMPLE = 5000
THRESHOLD = 0.3
# Folds of doc_id; fold 0 is held out.
FOLDS = 5
SEED = 17
# Bytes hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 20


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Square roots of hashed byte trigram counts, of length 1."""
    data = np.frombuffer(b"  " + text.encode("utf-8", "surrogatepass") + b"  ", np.uint8)
    counts = np.zeros(size)
    shift = np.uint32(32 - size.bit_length() + 1)
    for at in range(0, len(data) - 2, BLOCK):
        x = data[at : at + BLOCK + 2].astype(np.uint32)
        key = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
        counts += np.bincount(key * np.uint32(2654435761) >> shift, minlength=size)
    return np.append(np.sqrt(counts / counts.sum()), repetition(text)).astype(np.float32)


def _levels(value: float) -> list[float]:
    """One for each of ten levels that a share reaches."""
    return [float(value >= k / 10) for k in range(1, 11)]


def repetition(text: str) -> list[float]:
    """Shares of words that repeat the word before, of words seen before in the same
    window, in the worst window, and of lines seen before; in levels of a tenth, small so
    that they weigh like a trigram. All zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * REPETITION
    again = sum(map(str.__eq__, words, words[1:])) / len(words)
    windows = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    seen = [1 - len(set(w)) / len(w) for w in windows]
    lines = text.splitlines()
    levels = [again, sum(seen) / len(seen), max(seen), 1 - len(set(lines)) / len(lines)]
    return [0.1 * x for share in levels for x in _levels(share)]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str) -> float:
        z = float(features(text, len(self.weights) - REPETITION) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None,
            steps: int = 1200, batch: int = 256, rate: float = 0.005, decay: float = 1e-2,
            seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam. Without a prior, a plain model of positive against
    unlabelled; with one, of the non-negative risk. Where the negative part of a batch's
    risk falls below zero, the step goes up its slope instead, as the method has it."""
    rng = np.random.default_rng(seed)
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    w, b = np.zeros(positive.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = (positive[rng.integers(0, len(positive), batch)] - mean) / spread
        u = (unlabelled[rng.integers(0, len(unlabelled), batch)] - mean) / spread
        p_score, u_score = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # Slopes of the logistic loss: score - 1 for a positive, score for a negative.
        if prior is None:
            dp, du = p_score - 1, u_score
        else:
            risk = -np.log(1 - u_score + 1e-12).mean() + prior * np.log(1 - p_score + 1e-12).mean()
            if risk >= 0:
                dp, du = prior * (p_score - 1) - prior * p_score, u_score
            else:
                dp, du = prior * p_score, -u_score
        slope = np.append(p.T @ dp / batch + u.T @ du / batch + decay * w,
                          dp.mean() + du.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    w = w / spread
    return w, b - float(mean @ w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled; each half is scored by a model of the
    other half."""
    halves = []
    for fit, held in ((0, 1), (1, 0)):
        w, b = descend(positive[fit::2], unlabelled[fit::2], None, steps=400)
        p, u = np.sort(positive[held::2] @ w + b), np.sort(unlabelled[held::2] @ w + b)
        levels = np.quantile(p, np.linspace(0, 0.9, 91))
        above_p = 1 - np.searchsorted(p, levels, "left") / len(p)
        above_u = 1 - np.searchsorted(u, levels, "left") / len(u)
        margin = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
        best = np.argmin((above_u + margin) / above_p)
        halves.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(halves), 0.05, 0.99))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all say quality 1."""
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("lowest"))
        .filter("lowest = 1")
        .select("doc_id")
    )


def _sample(ids: DataFrame, n: int) -> DataFrame:
    """The n ids with the smallest hash: a bounded result, the same on each run."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n)


def drawn_vectors(learn: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, positive, vector): one row of `learn` for each row of `wanted`, whatever
    rows share an id. Of several texts under an id the one with the smallest hash counts,
    so the choice does not depend on partitions.

    Tasks keep one vector per wanted row, at most 2 * sample of them, and only these are
    shuffled.
    """
    def run(batches):
        least: dict[tuple[int, bool], tuple[int, bytes]] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "positive", "hash", "text"))
            for doc_id, positive, text_hash, text in zip(*columns):
                known = least.get((doc_id, positive))
                if known is None or text_hash < known[0]:
                    least[doc_id, positive] = text_hash, features(text).astype(np.float16).tobytes()
        keys, found = zip(*least), zip(*least.values())
        if least:
            arrays = [*(pa.array(k) for k in keys), *(pa.array(f) for f in found)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "positive", "hash", "vector"])

    # At most 2 * sample ids, so the texts stay where they are.
    rows = learn.join(F.broadcast(wanted), "doc_id").select(
        "doc_id", "positive", F.xxhash64("text").alias("hash"), "text"
    )
    per_task = map_batches(rows, run, "doc_id long, positive boolean, hash long, vector binary")
    picked = per_task.groupBy("doc_id", "positive").agg(F.min(F.struct("hash", "vector")).alias("one"))
    return picked.select("doc_id", "positive", "one.vector")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE,
        prior: float | None = None) -> QualityModel:
    """Fit on documents out of the held-out fold: at most `sample` trusted positives and
    `sample` unlabelled documents, one row each. Without either the model scores all texts
    0.5."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    learn = learn.filter(crc_fold("doc_id", folds) != 0)
    ids = learn.select("doc_id").distinct()
    wanted = _sample(trusted(labels).join(ids, "doc_id", "left_semi"), sample).withColumn(
        "positive", F.lit(True)
    ).unionByName(_sample(ids, sample).withColumn("positive", F.lit(False)))
    drawn = drawn_vectors(learn, wanted).toArrow()
    if not drawn.num_rows:
        return QualityModel(np.zeros(FEATURES + REPETITION), 0.0, prior or 0.5)
    drawn = drawn.sort_by([("positive", "ascending"), ("doc_id", "ascending"), ("vector", "ascending")])
    x = np.frombuffer(b"".join(drawn.column("vector").to_pylist()), np.float16).reshape(-1, FEATURES + REPETITION)
    flags = drawn.column("positive").to_numpy()
    positive, unlabelled = x[flags].astype(np.float32), x[~flags].astype(np.float32)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(FEATURES + REPETITION), 0.0, prior or 0.5)
    if prior is None:
        prior = estimate_prior(positive, unlabelled) if min(len(positive), len(unlabelled)) > 3 else 0.5
    weights, bias = descend(positive, unlabelled, prior)
    return QualityModel(weights, bias, prior)


def scorer(model: QualityModel):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score_quality(docs: DataFrame, model: QualityModel, folds: int = FOLDS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Null texts score like empty ones; rows without doc_id are not held out; repeated rows
    stay repeated; an empty table gives no row. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        scorer(model)(text_or_empty()).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score at least `threshold`.

    Null texts score like empty ones, repeated rows stay or go together, an empty table
    gives no row, and other columns, however they are named, are kept as they are.
    """
    bounded_batches(docs.sparkSession)
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__llm_score", scorer(model)(text_or_empty()))
    return marked.filter(F.col("__llm_score") >= threshold).select(*names)
