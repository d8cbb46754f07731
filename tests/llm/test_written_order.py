import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from turnledger.llm import curriculum, packing


@pytest.fixture
def written(spark, tmp_path):
    """600 documents in six files whose sizes are not in the order of their names."""
    size = F.element_at(F.array(*map(F.lit, (20, 400, 60, 900, 5, 200))), (F.col("id") / 100).cast("int") + 1)
    docs = spark.range(0, 600, 1, 6).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), size), lambda k: F.hash("id", k))).alias("text")
    )
    docs.write.parquet(str(tmp_path / "docs"))
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "docs")) == 6
    return spark.read.parquet(str(tmp_path / "docs"))


def test_order_survives_a_reread_of_files(spark, written):
    assert [r.doc_id for r in written.collect()] != list(range(600))
    got = curriculum.as_written(written)
    assert got.columns == written.columns
    assert [r.doc_id for r in got.collect()] == list(range(600))


def test_the_packing_stage_keeps_the_order(spark, written, monkeypatch):
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs: real(docs, pool_tokens=1))
    rows = dict(corpus_pipeline.STAGES)["token-id output"](spark, written, "").orderBy("pack_id").collect()
    order = [d for r in rows for d in r.doc_ids]
    assert order == sorted(order) and set(order) == set(range(600))


def test_frames_without_files_stay(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in curriculum.as_written(docs).collect()] == [(2, "b"), (1, "a")]
