"""Token predictions for prompts, in batch and on streams.

A fitted ridge pipeline is one linear formula, so it is applied as a column
expression with its coefficients as literals: no vectors are built and the same
expression runs on a stream. `score_with_model` applies any other fitted pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.functions import text as tx
from turnledger.functions.money import request_cost

MODEL_ORDER = ("ridge_opt_token_count", "ridge_token_count", "cv_ridge_token_count")


@dataclass(frozen=True)
class LinearModel:
    """Standardised linear formula over `features`."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    @classmethod
    def of(cls, model: PipelineModel) -> LinearModel:
        """The formula inside a fitted assembler - scaler - linear regression pipeline."""
        assembler, scaler, regression = model.stages
        return cls(
            tuple(assembler.getInputCols()),
            tuple(map(float, scaler.mean)),
            tuple(map(float, scaler.std)),
            tuple(map(float, regression.coefficients)),
            float(regression.intercept),
        )

    def predict(self) -> Column:
        """Features without spread contribute nothing: they are divided by 1 and have
        coefficient 0."""
        terms = [
            (F.col(f).cast("double") - F.lit(m)) / F.lit(s if s != 0 else 1.0) * F.lit(c)
            for f, m, s, c in zip(self.features, self.mean, self.std, self.coefficients)
        ]
        return reduce(lambda a, b: a + b, terms, F.lit(0.0)) + F.lit(self.intercept)


def add_request_features(df: DataFrame, text: str = "prompt") -> DataFrame:
    """text_len, context_len, num_words, avg_word_len, question_flag of trimmed text."""
    prompt = tx.unicode_trim(text)
    return df.withColumns(
        {
            "text_len": F.length(prompt).cast("double"),
            "context_len": F.length(prompt).cast("double"),
            "num_words": tx.num_words(text).cast("double"),
            "avg_word_len": tx.mean_word_length(text),
            "question_flag": tx.question_flag(text).cast("double"),
        }
    )


def add_feature_defaults(df: DataFrame) -> DataFrame:
    """Complete the model features from whatever the input has.

    A feature is taken from the first of its names that is a column, else derived
    from the others, else a constant.
    """
    def first_of(*names: str, default: Column) -> Column:
        present = [F.col(n).cast("double") for n in names if n in df.columns]
        return present[0] if present else default

    chars = first_of("char_count", "text_len", "context_len", default=F.lit(0.0))
    words = first_of("word_count", "num_words", default=F.lit(0.0))
    return df.withColumns(
        {
            "char_count": chars,
            "word_count": words,
            "sentence_count": first_of(
                "sentence_count",
                default=F.greatest(F.lit(1.0), words / K.WORDS_PER_SENTENCE),
            ),
            "avg_word_length": first_of(
                "avg_word_length",
                "avg_word_len",
                default=chars / F.greatest(F.lit(1.0), words),
            ),
            "conversation_turn_count": first_of("conversation_turn_count", default=F.lit(1.0)),
            "turn_index": first_of("turn_index", default=F.lit(0.0)),
            "has_code_block_int": first_of("has_code_block_int", default=F.lit(0.0)),
        }
    )


def add_token_columns(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """input_tokens and output_tokens: whole numbers, at least 1, halves to even; null
    where there is no prediction."""
    whole = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(1), F.rint(c).cast("long")))
    return (
        df.withColumn("input_tokens", whole(F.col(prediction)))
        .withColumn("output_tokens", whole(F.col("input_tokens") * K.OUTPUT_PER_INPUT))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def score(df: DataFrame, model: LinearModel) -> DataFrame:
    """Rows with model features -> prediction and token columns."""
    return add_token_columns(df.withColumn("prediction", model.predict()))


def score_with_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    return add_token_columns(model.transform(df).drop("raw_features", "features"))


def score_prompts(prompts: DataFrame, model: LinearModel, text: str = "prompt") -> DataFrame:
    """The full answer to a prompt request: tokens, cost, shortened prompt, savings.

    A projection over the prompts, usable on a batch or a stream.
    """
    # The input is kept in one struct, so that a column that happens to be named like
    # a model feature does not replace the feature of the request.
    bare = prompts.select(
        F.struct(*prompts.columns).alias("_input"), tx.unicode_trim(text).alias("_trimmed")
    )
    request = add_feature_defaults(add_request_features(bare, "_trimmed"))
    answered = (
        score(request, model)
        .withColumn("estimated_cost", request_cost("input_tokens", "output_tokens"))
        .withColumn("optimized_prompt", tx.shorten_prompt("_trimmed"))
    )
    return answered.select(
        "_input.*",
        "input_tokens",
        "output_tokens",
        "total_tokens",
        "estimated_cost",
        "optimized_prompt",
        tx.percent_less(
            tx.estimate_tokens("_trimmed"), tx.estimate_tokens("optimized_prompt")
        ).alias("token_savings_percent"),
        tx.percent_less(F.length("_trimmed"), F.length("optimized_prompt")).alias(
            "compression_percent"
        ),
        F.col("question_flag").cast("int").alias("question_flag"),
    )


def hybrid_estimate(df: DataFrame, segment: str = "segment",
                    prediction: str = "prediction") -> DataFrame:
    """Blend of the baseline of the segment and the model: point_estimate,
    lower_bound, upper_bound."""
    baseline = F.lit(None).cast("double")
    for name, tokens in K.SEGMENT_BASELINE.items():
        baseline = F.when(F.col(segment) == name, F.lit(tokens)).otherwise(baseline)
    return (
        df.withColumn(
            "point_estimate", baseline * K.BASELINE_WEIGHT + F.col(prediction) * K.MODEL_WEIGHT
        )
        .withColumn("lower_bound", F.col("point_estimate") * K.LOWER_FACTOR)
        .withColumn("upper_bound", F.col("point_estimate") * K.UPPER_FACTOR)
    )


def batch_summary(scored: DataFrame, input_tokens: str = "input_tokens",
                  output_tokens: str = "output_tokens") -> DataFrame:
    """One row about a scored batch; rows without a prediction count as failed."""
    success = F.col(input_tokens).isNotNull()
    return scored.agg(
        F.sum(input_tokens).alias("_in"),
        F.sum(F.when(success, F.col(output_tokens))).alias("_out"),
        F.count("*").alias("batch_size"),
        F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"),
    ).select(
        F.when(F.col("successful") > 0, F.expr("_in div successful")).alias("input_tokens"),
        F.when(F.col("successful") > 0, F.expr("_out div successful")).alias("output_tokens"),
        "batch_size",
        "successful",
        "failed",
        F.when(F.col("batch_size") > 0, F.col("successful") / F.col("batch_size") * 100)
        .otherwise(F.lit(0.0))
        .alias("success_rate"),
    )


def load_token_model(spark: SparkSession, models_dir: str,
                     order: Sequence[str] = MODEL_ORDER) -> PipelineModel:
    """The first model of `order` that exists below `models_dir`."""
    for name in order:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{models_dir.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            return PipelineModel.load(path.toString())
    raise FileNotFoundError(f"no token model below {models_dir}")
