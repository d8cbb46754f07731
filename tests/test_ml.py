import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from turnledger import constants as K
from turnledger.operators import ml, scoring, turns as T
from turnledger.plans.train import model_rows, train, train_and_test
from turnledger.sources.tables import write_parquet


@pytest.fixture(scope="module")
def rows(spark):
    """Numeric turns with a noisy linear label and a feature without spread."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(600):
        words = int(rng.integers(1, 200))
        chars = words * 6 + int(rng.integers(0, 40))
        data.append(
            (f"r{i // 4}", i % 4, chars, words, int(rng.integers(1, 9)), chars / words, 4,
             bool(rng.integers(0, 2)), words, words - int(rng.integers(0, 9)))
        )
    return spark.createDataFrame(
        data,
        "record_id string, turn_index int, char_count int, word_count int, sentence_count int, "
        "avg_word_length double, conversation_turn_count int, has_code_block boolean, "
        "token_count int, optimized_token_count int",
    ).cache()


def closed_form(x, y, penalty):
    """Ridge on standardised features, label in units of its standard deviation."""
    spread = x.std(axis=0, ddof=1)
    used = spread > 0
    z = (x[:, used] - x[:, used].mean(axis=0)) / spread[used]
    n, scale = len(y), y.std(ddof=1)
    w = np.linalg.solve(z.T @ z / n + penalty / scale * np.eye(used.sum()), z.T @ (y - y.mean()) / n)
    return used, z @ w + y.mean()


def test_ridge_agrees_with_closed_form(spark, rows):
    data = T.training_rows(rows)
    model = ml.pipeline(ml.ridge(), "optimized_token_count", K.NO_LEAK_COLUMNS).fit(data)
    got = model.transform(data).orderBy("record_id", "turn_index").toPandas()
    x = got[K.NO_LEAK_COLUMNS].to_numpy(float)
    y = got["optimized_token_count"].to_numpy(float)
    _, want = closed_form(x, y, 0.1)
    assert np.abs(got["prediction"] - want).max() < 0.05


def test_metrics_in_one_pass(spark):
    pairs = [(1.0, 2.0), (3.0, 2.5), (4.0, 4.0), (0.0, 1.0)]
    m = ml.regression_metrics(spark.createDataFrame(pairs, "y double, prediction double"), "y").first()
    y, p = np.array(pairs).T
    assert m.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean())) and m.mae == pytest.approx(np.abs(y - p).mean())
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.mape == pytest.approx((np.abs((y - p) / np.where(y == 0, 1, y))[y != 0]).mean() * 100)
    flat = ml.regression_metrics(spark.createDataFrame([(1.0, 1.0)], "y double, prediction double"), "y").first()
    assert flat.r2 is None


def test_training_job_saves_and_reloads(spark, rows, tmp_path):
    write_parquet(rows, f"{tmp_path}/turns")
    best, metrics = train(spark, f"{tmp_path}/turns", f"{tmp_path}/models", folds=2)
    got = {r.model_name: r for r in metrics.collect()}
    assert best == "ridge_token_count"
    assert set(got) == {"ridge_token_count", "ridge_opt_token_count", "cv_ridge_token_count"}
    assert got["ridge_token_count"].r2 > 0.99 and isinstance(got["ridge_token_count"].r2, float)
    assert got["cv_ridge_token_count"].best_reg_param in (0.01, 0.1, 1.0)
    # The model of the shortened count comes first, then the others.
    first = scoring.load_token_model(spark, f"{tmp_path}/models")
    again = PipelineModel.load(f"{tmp_path}/models/ridge_opt_token_count")
    data = T.training_rows(rows)
    a, b = (m.transform(data).agg(F.sum("prediction")).first()[0] for m in (first, again))
    assert a == b
    second = scoring.load_token_model(spark, f"{tmp_path}/models", ["absent", "cv_ridge_token_count"])
    assert len(second.stages) == 3
    with pytest.raises(FileNotFoundError):
        scoring.load_token_model(spark, f"{tmp_path}/none")


def test_formula_equals_pipeline(spark, rows):
    data = T.training_rows(rows)
    model = ml.pipeline(ml.ridge()).fit(data)
    linear = scoring.LinearModel.of(model)
    both = scoring.score(model.transform(data).withColumnRenamed("prediction", "p"), linear)
    assert both.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0
    one = scoring.score_with_model(data, model).first()
    assert one.input_tokens == max(1, round(one.prediction))


def test_gbt_is_tried_only_below_the_threshold(spark, rows):
    part, test = train_and_test(model_rows(rows))
    best, tried = ml.select_model(part, test)
    assert [f.name for f in tried] == ["ridge_token_count"] and best is tried[0]
    best, tried = ml.select_model(part, test, K.NO_LEAK_COLUMNS, threshold=1.1, gbt_iterations=2)
    assert [f.name for f in tried] == ["ridge_token_count", "gbt_token_count"]
    assert best.metrics["r2"] == max(f.metrics["r2"] for f in tried)


def test_trees_are_fitted_in_few_partitions(spark, rows, monkeypatch):
    """Every level of every tree sends the driver a result of each partition."""
    part, test = train_and_test(model_rows(rows.repartition(40)))
    fit, trained = ml.fit, {}

    def watched(name, regressor, train, *others):
        trained[name] = train.rdd.getNumPartitions(), train.count()
        return fit(name, regressor, train, *others)

    monkeypatch.setattr(ml, "fit", watched)
    count = part.count()
    select = lambda: ml.select_model(part, test, K.NO_LEAK_COLUMNS, threshold=1.1, gbt_iterations=1)
    select()
    assert trained["gbt_token_count"] == (1, count)
    # More rows than one partition should hold: the cores of the session, here 4, and no more.
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    monkeypatch.setattr(ml, "MOST_FIT_ROWS", 200)
    select()
    assert trained["gbt_token_count"] == (4, count)
    # Beyond them as few as hold the rows, evenly.
    monkeypatch.setattr(ml, "MOST_FIT_ROWS", 60)
    dealt = ml.few_partitions(part, count, ordered=True)
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(sizes) == -(-count // 60) and max(sizes) <= 80
    assert dealt.exceptAll(part).count() == 0 and part.exceptAll(dealt).count() == 0


def test_segments_and_importances(spark, rows):
    data = T.training_rows(rows).withColumn(
        "segment", F.when(F.col("has_code_block"), "code").otherwise("general")
    )
    models = ml.fit_segments(data, "token_count", K.NO_LEAK_COLUMNS, max_iter=2)
    assert set(models) == {"code", "general"}
    scored = ml.score_segments(data, models)
    assert scored.count() == data.count()
    assert {r.segment for r in ml.regression_metrics(scored, "token_count", keys=["segment"]).collect()} == set(models)
    forest = ml.pipeline(ml.forest(5, 4), "token_count", K.NO_LEAK_COLUMNS).fit(data)
    importances = {r.feature: r.importance for r in ml.feature_importances(spark, forest, K.NO_LEAK_COLUMNS).collect()}
    assert sum(importances.values()) == pytest.approx(1.0) and max(importances, key=importances.get) == "char_count"


def test_rounding_of_tokens(spark):
    df = spark.createDataFrame([(0.4,), (2.5,), (3.5,), (-7.0,), (None,)], "prediction double")
    got = [(r.input_tokens, r.output_tokens) for r in scoring.add_token_columns(df).collect()]
    # Halves go to the even number, and 1.5 x 1 = 1.5 -> 2.
    assert got == [(1, 2), (2, 3), (4, 6), (1, 2), (None, None)]


def test_feature_defaults(spark):
    df = spark.createDataFrame([(30.0, 60.0)], "num_words double, context_len double")
    r = scoring.add_feature_defaults(df).first()
    assert (r.char_count, r.word_count, r.sentence_count, r.avg_word_length) == (60.0, 30.0, 2.0, 2.0)
    assert (r.conversation_turn_count, r.turn_index, r.has_code_block_int) == (1.0, 0.0, 0.0)


def test_scoring_ignores_columns_that_are_named_like_features(spark):
    from catalog.inputs import MODEL

    df = spark.createDataFrame([("Why is the sky blue?", 1e9)], "prompt string, char_count double")
    a = scoring.score_prompts(df, MODEL).first()
    b = scoring.score_prompts(df.drop("char_count"), MODEL).first()
    assert a.input_tokens == b.input_tokens and a.char_count == 1e9 and a.question_flag == 1


def test_batch_summary_without_success(spark):
    df = spark.createDataFrame([(None, None)], "input_tokens long, output_tokens long")
    r = scoring.batch_summary(df).first()
    assert (r.input_tokens, r.failed, r.success_rate) == (None, 1, 0.0)


def test_hybrid(spark):
    df = spark.createDataFrame([("code", 100.0), ("question", 0.0), ("general", 50.0)], "segment string, prediction double")
    got = [r.point_estimate for r in scoring.hybrid_estimate(df).collect()]
    assert got == pytest.approx([760.0, 210.0, 320.0])
    r = scoring.hybrid_estimate(df).first()
    assert r.lower_bound == pytest.approx(532.0) and r.upper_bound == pytest.approx(1140.0)
