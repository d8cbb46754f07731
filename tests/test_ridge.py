import numpy as np
import pytest
from pyspark.sql import functions as F

from test_ml import closed_form, rows  # noqa: F401
from turnledger import constants as K
from turnledger.operators import ml, ridge, scoring, turns as T


@pytest.mark.parametrize("label", [K.LABEL_COLUMN, K.OPT_LABEL_COLUMN])
@pytest.mark.parametrize("penalty", [0.01, 1.0])
def test_moments_give_the_model_of_spark(spark, rows, label, penalty):  # noqa: F811
    data = T.training_rows(rows)
    fitted = ml.pipeline(ml.ridge(penalty), label, K.FEATURE_COLUMNS).fit(data)
    formula = ridge.fit_ridge(data, label, penalty=penalty)
    both = scoring.score(fitted.transform(data).withColumnRenamed("prediction", "theirs"), formula)
    assert both.filter(F.abs(F.col("theirs") - F.col("prediction")) > 1e-6).count() == 0
    error = ml.regression_metrics(both, label).first().rmse
    assert ridge.moments(data, label)[0].rmse(formula) == pytest.approx(error, rel=1e-6, abs=1e-7)


def test_moments_of_folds_add_up(spark, rows):  # noqa: F811
    far = T.training_rows(rows).withColumn("char_count", F.col("char_count") + 1_000_000_000)
    whole = ridge.moments(far, "token_count", K.NO_LEAK_COLUMNS)[0]
    parts = ridge.moments(far, "token_count", K.NO_LEAK_COLUMNS, ridge.fold_of(["record_id", "turn_index"], 4))
    assert set(parts) == {0, 1, 2, 3} and sum(p.rows for p in parts.values()) == whole.rows == 600
    merged = parts[2] + parts[0] + parts[3] + parts[1]
    assert np.allclose(merged.mean, whole.mean, rtol=1e-12)
    # Sums of squares as they are would be off by hundreds here.
    assert np.allclose(merged.covariance, whole.covariance, rtol=1e-7, atol=1e-6)


def test_penalty_is_that_of_refitted_models(spark, rows):  # noqa: F811
    data = T.training_rows(rows)
    fold = ridge.fold_of(["record_id", "turn_index"], 3)
    features, label, grid = K.NO_LEAK_COLUMNS, K.OPT_LABEL_COLUMN, (0.01, 0.1, 30.0)
    chosen, errors = ridge.best_penalty(ridge.moments(data, label, features, fold), grid)
    numbered = data.withColumn("fold", fold)
    for penalty in grid:
        rmse = []
        for k in range(3):
            model = ml.pipeline(ml.ridge(penalty), label, features).fit(numbered.filter(F.col("fold") != k))
            rmse.append(ml.regression_metrics(model.transform(numbered.filter(F.col("fold") == k)), label).first().rmse)
        assert errors[penalty] == pytest.approx(np.mean(rmse), rel=1e-6)
    assert chosen == min(errors, key=errors.get) and chosen != 30.0


def test_one_pass_for_the_whole_grid(spark, rows):  # noqa: F811
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid", "moments")
    by_fold = ridge.moments(T.training_rows(rows), K.LABEL_COLUMN, fold=ridge.fold_of(["record_id"], 5))
    ridge.best_penalty(by_fold, [10.0**-k for k in range(8)])
    jobs = tracker.getJobIdsForGroup("grid")
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 2


def test_odd_rows(spark):
    schema = "record_id string, turn_index int, x double, z double, token_count double"
    rows = [("a", i, float(i), 3.0, 2.0 * i + 1) for i in range(30)] + [("n", 0, None, 3.0, 1.0), ("n", 1, 1.0, 3.0, None)]
    df = spark.createDataFrame(rows, schema)
    model = ridge.fit_ridge(df, "token_count", ["x", "z"], 0.0)
    assert model.coefficients[1] == 0.0 and model.std[1] == 0.0
    got = df.filter("x = 7").select(model.predict().alias("p")).first().p
    assert got == pytest.approx(15.0)
    flat = ridge.fit_ridge(df.withColumn("token_count", F.lit(4.0)), "token_count", ["x", "z"])
    assert flat.coefficients == (0.0, 0.0) and flat.intercept == 4.0
    with pytest.raises(ValueError):
        ridge.fit_ridge(df.limit(0), "token_count", ["x"])
    with pytest.raises(ValueError):
        ridge.best_penalty(ridge.moments(df, "token_count", ["x"]), [0.1])
