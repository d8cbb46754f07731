"""Prompt requests scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from turnledger.operators.scoring import LinearModel, score_prompts


def scored(prompts: DataFrame, model: LinearModel, text: str = "prompt",
           partitions: int | None = None) -> DataFrame:
    """The batch answer of `scoring.score_prompts`; it keeps no state.

    `partitions` spreads the rows of a trigger that has few but large files.
    """
    if partitions is not None:
        prompts = prompts.repartition(partitions)
    return score_prompts(prompts, model, text)


def start_scoring(answers: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        answers.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
