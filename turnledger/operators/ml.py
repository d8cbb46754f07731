"""Regressors that predict token counts.

Fits run on narrow numeric tables (`turns.training_rows`): no text is cached or sent
anywhere. Only fitted coefficients and a handful of metrics reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.operators.ridge import best_penalty, fold_of, moments


def assembler(features: Sequence[str] = K.FEATURE_COLUMNS) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip")


def scaler() -> StandardScaler:
    """Zero mean and unit sample standard deviation."""
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def ridge(reg_param: float = 0.1) -> LinearRegression:
    return LinearRegression(regParam=reg_param, elasticNetParam=0.0, maxIter=100, solver="normal")


def boosted_trees(max_iter: int = 50) -> GBTRegressor:
    return GBTRegressor(maxIter=max_iter, maxDepth=5, stepSize=0.1, seed=K.SPLIT_SEED)


def forest(num_trees: int = 50, max_depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=1, seed=K.SPLIT_SEED
    )


def pipeline(regressor: Estimator, label: str = K.LABEL_COLUMN,
             features: Sequence[str] = K.FEATURE_COLUMNS) -> Pipeline:
    regressor = regressor.copy().setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=[assembler(features), scaler(), regressor])


def regression_metrics(predictions: DataFrame, label: str | Column,
                       prediction: str | Column = "prediction",
                       keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2, mape and rows (per key) in one pass over the predictions.

    r2 relates the squared errors to the spread of the label; it is null when the
    label does not vary. mape skips rows with label 0.
    """
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    errors = predictions.select(*keys, y.alias("_y"), (y - p).alias("_e"))
    squared = F.sum(F.col("_e") * F.col("_e"))
    spread = F.var_pop("_y") * F.count("_e")
    return errors.groupBy(*keys).agg(
        F.sqrt(squared / F.count("_e")).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"),
        F.when(spread > 0, 1 - squared / spread).alias("r2"),
        (F.avg(F.when(F.col("_y") != 0, F.abs(F.col("_e") / F.col("_y")))) * 100).alias("mape"),
        F.count("_e").alias("rows"),
    )


@contextmanager
def kept(rows: DataFrame):
    """Keep narrow rows in memory or on disk while models are fitted on them."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


@dataclass
class Fitted:
    """A fitted pipeline with its metrics on the test rows."""

    name: str
    model_type: str
    target: str
    model: PipelineModel
    metrics: dict[str, float]
    seconds: float
    extra: dict[str, float] = field(default_factory=dict)

    def row(self) -> tuple:
        m = self.metrics
        return (
            self.name, self.model_type, self.target, m["rmse"], m["mae"], m["r2"],
            int(m["rows"]), round(self.seconds, 2), self.extra.get("best_reg_param"),
        )


METRICS_SCHEMA = (
    "model_name string, model_type string, target string, rmse double, mae double, r2 double, "
    "test_rows long, training_time_seconds double, best_reg_param double"
)


def metrics_frame(spark: SparkSession, fitted: Sequence[Fitted]) -> DataFrame:
    """One row per model; ready to be appended to the event table."""
    return spark.createDataFrame([f.row() for f in fitted], METRICS_SCHEMA)


def fit(name: str, regressor: Estimator, train: DataFrame, test: DataFrame,
        label: str = K.LABEL_COLUMN, features: Sequence[str] = K.FEATURE_COLUMNS) -> Fitted:
    started = time.perf_counter()
    model = pipeline(regressor, label, features).fit(train)
    seconds = time.perf_counter() - started
    metrics = regression_metrics(model.transform(test), label).first().asDict()
    return Fitted(name, type(regressor).__name__, label, model, metrics, seconds)


def cross_validate(train: DataFrame, test: DataFrame, label: str = K.LABEL_COLUMN,
                   features: Sequence[str] = K.FEATURE_COLUMNS, folds: int = 3,
                   reg_params: Sequence[float] = (0.01, 0.1, 1.0),
                   keys: Sequence[str] = ("record_id", "turn_index"),
                   name: str = "cv_ridge_token_count") -> Fitted:
    """Ridge with the penalty of the lowest cross-validated rmse.

    One pass over the rows gives the moments of every fold, from which all models of the
    grid are solved and judged; only the chosen penalty is fitted as a pipeline. Folds
    depend on `keys`, so reruns choose the same.
    """
    started = time.perf_counter()
    chosen, errors = best_penalty(moments(train, label, features, fold_of(keys, folds)), reg_params)
    spent = time.perf_counter() - started
    best = fit(name, ridge(chosen), train, test, label, features)
    extra = {"best_reg_param": float(chosen), "cv_rmse": errors[chosen]}
    return Fitted(name, "CrossValidatedRidge", label, best.model, best.metrics, best.seconds + spent, extra)


# Rows of a narrow table that a partition should hold while trees are fitted on it: every
# level of every tree is a job with a task for each partition, and the driver gets a result
# of each task.
FIT_ROWS = 50_000
# Rows that it should hold where there are more such partitions than cores.
MOST_FIT_ROWS = 1_000_000


def few_partitions(rows: DataFrame, count: int, ordered: bool = False) -> DataFrame:
    """`count` kept rows in no more partitions than they fill: one for each `FIT_ROWS`, and
    beyond the cores of the session one for each `MOST_FIT_ROWS`. Tables in fewer stay as
    they are.

    Partitions are joined where they are kept, without a shuffle. `ordered` rows are shuffled
    evenly and sorted inside of a partition instead: which of them a fit samples for its
    thresholds does then not depend on where they are kept.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-count // MOST_FIT_ROWS), min(cores, -(-count // FIT_ROWS)))
    if wanted >= rows.rdd.getNumPartitions():
        return rows
    if ordered:
        return rows.repartition(wanted).sortWithinPartitions(*rows.columns)
    return rows.coalesce(wanted)


def select_model(train: DataFrame, test: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS,
                 threshold: float = K.RIDGE_R2_THRESHOLD, label: str = K.LABEL_COLUMN,
                 gbt_iterations: int = 50) -> tuple[Fitted, list[Fitted]]:
    """(best, all): ridge, and boosted trees as well if the r2 of ridge is below the
    threshold; boosted trees win only with a higher r2. Give kept rows: the trees are fitted
    on narrow rows of their own, in few partitions."""
    first = fit(f"ridge_{label}", ridge(), train, test, label, features)
    tried, best = [first], first
    if first.metrics["r2"] is None or first.metrics["r2"] < threshold:
        narrow = train.select(*features, label)
        with kept(few_partitions(narrow, narrow.count(), ordered=True)) as own:
            second = fit(f"gbt_{label}", boosted_trees(gbt_iterations), own, test, label, features)
        tried.append(second)
        if best.metrics["r2"] is None or (second.metrics["r2"] or 0.0) > best.metrics["r2"]:
            best = second
    return best, tried


def fit_segments(train: DataFrame, label: str, features: Sequence[str],
                 segments: Sequence[str] = tuple(K.SEGMENT_BASELINE), segment: str = "segment",
                 max_iter: int = 50) -> dict[str, PipelineModel]:
    """One boosted-trees model per segment that has rows.

    One count tells how many rows each segment has. The models are fitted at the same
    time, each on narrow rows of its own that are kept while it is fitted: a fit is
    hundreds of short jobs one after the other, which leave most of a cluster idle. Give
    kept rows: they are read once for each segment.
    """
    counts = {r[segment]: r["count"] for r in train.groupBy(segment).count().collect() if r[segment] in segments}

    def one(name: str) -> PipelineModel:
        rows = train.filter(F.col(segment) == name).select(*features, label)
        with kept(few_partitions(rows, counts[name])) as own:
            return pipeline(boosted_trees(max_iter), label, features).fit(own)

    names = [s for s in segments if s in counts]
    if not names:
        return {}
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(train.sparkSession)(one), names)))


def score_segments(df: DataFrame, models: dict[str, PipelineModel],
                   segment: str = "segment") -> DataFrame:
    """Every row scored by the model of its segment.

    The input is filtered once per segment and each row is scored once. Give it narrow
    feature rows (kept or from a table), so that no text is read three times.
    """
    scored = [
        model.transform(df.filter(F.col(segment) == name)).drop("raw_features", "features")
        for name, model in models.items()
    ]
    result = scored[0]
    for part in scored[1:]:
        result = result.unionByName(part)
    return result


def feature_importances(spark: SparkSession, model: PipelineModel,
                        features: Sequence[str]) -> DataFrame:
    """feature, importance of a fitted tree model; one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
