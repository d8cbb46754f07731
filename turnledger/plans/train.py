"""Processed turns -> fitted token models and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.operators import ml
from turnledger.operators.sampling import in_first_part
from turnledger.operators.turns import training_rows

KEYS = ["record_id", "turn_index"]


def model_rows(turns: DataFrame) -> DataFrame:
    """Keys, features, labels and `in_train`, which is true for 80 % of the turns."""
    columns = list(dict.fromkeys(KEYS + K.FEATURE_COLUMNS + [K.LABEL_COLUMN, K.OPT_LABEL_COLUMN]))
    rows = training_rows(turns).select(*columns)
    return rows.withColumn("in_train", in_first_part(KEYS))


def train_and_test(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("in_train"), rows.filter("NOT in_train")


def train(spark: SparkSession, processed: str, models_dir: str | None = None,
          features: Sequence[str] = K.FEATURE_COLUMNS, folds: int = 3,
          threshold: float = K.RIDGE_R2_THRESHOLD) -> tuple[str, DataFrame]:
    """Fit the raw-token, shortened-token and cross-validated models.

    Returns the name of the best model and one metrics row per model; saves every
    model below `models_dir` if given.
    """
    rows = model_rows(spark.read.parquet(processed))
    with ml.kept(rows):
        dataset_size = rows.count()
        train_rows, test_rows = train_and_test(rows)
        best, fitted = ml.select_model(train_rows, test_rows, features, threshold)
        fitted.append(
            ml.fit("ridge_opt_token_count", ml.ridge(), train_rows, test_rows,
                   K.OPT_LABEL_COLUMN, features)
        )
        fitted.append(ml.cross_validate(train_rows, test_rows, features=features, folds=folds))
    if models_dir is not None:
        for f in fitted:
            ml.save(f.model, f"{models_dir.rstrip('/')}/{f.name}")
    metrics = ml.metrics_frame(spark, fitted).withColumn("dataset_size", F.lit(dataset_size))
    return best.name, metrics
