"""Ridge regression from moments: one pass over the rows for any number of models.

A ridge model only needs means and covariances of the features and the label. They are
aggregated once, per fold of the rows where there are folds. Moments of rows that do not
overlap add up, so the model without a fold is solved from the moments of the other folds,
for every penalty, and its error on the fold is a formula of that fold's moments.

Covariances are centred as they are summed and merged, so large means take no digits off
them. The solution is that of Spark's own linear regression on standardised features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions.keys import hash_fraction
from turnledger.operators.scoring import LinearModel


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and covariances over n; the label comes last."""

    features: tuple[str, ...]
    rows: int
    mean: np.ndarray
    covariance: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        rows = self.rows + other.rows
        apart = other.mean - self.mean
        share = other.rows / rows
        return Moments(
            self.features,
            rows,
            self.mean + apart * share,
            self.covariance * (1 - share) + other.covariance * share
            + np.outer(apart, apart) * share * (1 - share),
        )

    def ridge(self, penalty: float) -> LinearModel:
        """The model with the least squared error plus `penalty`, features in units of
        their standard deviation and the label in units of its own. A feature without
        spread gets coefficient 0; so do all if the label has none."""
        spread = np.sqrt(np.maximum(np.diag(self.covariance), 0.0))
        used = np.flatnonzero(spread[:-1] > 0) if spread[-1] > 0 else np.empty(0, int)
        unit = self.covariance / np.outer(*[np.where(spread > 0, spread, 1.0)] * 2)
        system = unit[np.ix_(used, used)] + penalty / (spread[-1] or 1.0) * np.eye(len(used))
        coefficients = np.zeros(len(self.features))
        coefficients[used] = np.linalg.solve(system, unit[used, -1]) * spread[-1]
        return LinearModel(
            self.features, tuple(self.mean[:-1].tolist()), tuple(spread[:-1].tolist()),
            tuple(coefficients.tolist()), float(self.mean[-1]),
        )

    def rmse(self, model: LinearModel) -> float:
        """Root of the mean squared error of the model on the rows of these moments."""
        std = np.array([s if s != 0 else 1.0 for s in model.std])
        slopes = np.append(-np.array(model.coefficients) / std, 1.0)
        at_mean = model.intercept + float(
            ((self.mean[:-1] - np.array(model.mean)) / std) @ np.array(model.coefficients)
        )
        squared = slopes @ self.covariance @ slopes + (self.mean[-1] - at_mean) ** 2
        return float(np.sqrt(max(squared, 0.0)))


def fold_of(keys: Sequence[str], folds: int, seed: int = K.SPLIT_SEED + 1) -> Column:
    """A fold that depends on the keys only: another one than the split's draw."""
    return F.floor(hash_fraction(keys, seed) * folds).cast("int")


def moments(rows: DataFrame, label: str, features: Sequence[str] = K.FEATURE_COLUMNS,
            fold: Column | None = None) -> dict[int, Moments]:
    """Moments per fold (fold 0 without one) in one aggregate; rows with a null count
    nowhere, and a fold without rows is left out."""
    names = [*features, label]
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    narrow = rows.select((fold if fold is not None else F.lit(0)).alias("fold"), *values).dropna()
    size = range(len(names))
    pairs = [(i, j) for i in size for j in size if i <= j]
    found = narrow.groupBy("fold").agg(
        F.count("*").alias("rows"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in size],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in found.collect():  # a row per fold
        covariance = np.zeros((len(names), len(names)))
        for i, j in pairs:
            covariance[i, j] = covariance[j, i] = r[f"c{i}_{j}"]
        out[r.fold] = Moments(tuple(features), r.rows, np.array([r[f"m{i}"] for i in size]), covariance)
    return out


def fit_ridge(rows: DataFrame, label: str, features: Sequence[str] = K.FEATURE_COLUMNS,
              penalty: float = 0.1) -> LinearModel:
    """The model as a formula, which scores batches and streams alike."""
    found = moments(rows, label, features)
    if not found:
        raise ValueError("no complete rows to fit on")
    return found[0].ridge(penalty)


def best_penalty(by_fold: dict[int, Moments], penalties: Sequence[float]) -> tuple[float, dict[float, float]]:
    """(penalty, mean rmse of each): the penalty whose models, each fitted without a fold,
    err least on that fold; the first of equal ones."""
    if len(by_fold) < 2:
        raise ValueError("cross validation needs rows in two folds")
    errors = {p: [] for p in penalties}
    for fold, held in by_fold.items():
        rest = reduce(lambda a, b: a + b, [m for f, m in by_fold.items() if f != fold])
        for p in penalties:
            errors[p].append(held.rmse(rest.ridge(p)))
    means = {p: float(np.mean(e)) for p, e in errors.items()}
    return min(penalties, key=means.get), means
