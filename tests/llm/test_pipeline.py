import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from test_shingle_join import smallest_of_groups
from turnledger.llm import curriculum, decontaminate, packing, quality
from turnledger.llm.common import table

SF = "/root/testdata/sf0.001"
STEPS = dict(corpus_pipeline.STAGES)


def test_each_stage_does_its_work(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    assert list(STEPS) == ["quality classifier", "simhash near-dedup", "benchmark decontamination",
                           "mixing to target weights", "token-id output"]
    good = STEPS["quality classifier"](spark, docs, SF)
    model = quality.fit(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in good.collect()} == {i for i, r in rows.items() if model.score(r.text or "") >= 0.3}
    single = STEPS["simhash near-dedup"](spark, good, SF)
    left = sorted((r.doc_id, r.text) for r in good.collect())
    groups = smallest_of_groups([t for _, t in left], corpus_pipeline.SIMILARITY)
    assert sorted(r.doc_id for r in single.collect()) == sorted(left[i][0] for i in groups)
    clean = STEPS["benchmark decontamination"](spark, single, SF)
    items = [decontaminate.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {r.doc_id for r in single.collect() if any(i in decontaminate.normal(r.text) for i in items)}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    mixed = STEPS["mixing to target weights"](spark, clean, SF)
    copies = {r.doc_id: r.copies for r in curriculum.mix(clean).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert good.columns == single.columns == clean.columns == mixed.columns == docs.columns
    packed = STEPS["token-id output"](spark, mixed, SF).collect()
    encode = packing.encoder(open(packing.VOCABULARY, "rb").read())
    tokens = sum(len(encode(r.text)) + 1 for r in mixed.collect())
    assert sum(r.n_tokens for r in packed) == tokens
    assert all(len(np.frombuffer(r.ids, "<u2")) == packing.ROW_TOKENS for r in packed)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} and so on" for i in range(60_000))
    base = "The harbour office keeps a list of boats that come in at night and leave by day."
    rows = [(1, base, "en", "a", 80), (1, base, "en", "a", 80), (2, base, "en", "b", 80), (3, None, None, None, None),
            (None, base, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (4, "", "en", "a", 0),
            (5, long, "en", "a", len(long)), (6, long + " end", None, "a", 1), (7, " \t", "", "", 0), (8, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["fp", "label", "copies", "size", "position", "part", "component", "text_id", "score", "ids", "a", "set", "bitmap"]
    return docs.withColumns({c: F.lit(1) for c in clash})


def test_stages_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    good = STEPS["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns and good.count() <= docs.count()
    single = STEPS["simhash near-dedup"](spark, docs, SF)
    # The null and the empty texts are one group, each copy joins the smallest id.
    assert sorted(r.doc_id for r in single.collect()) == [1, 3, 5, 8] and single.columns == docs.columns
    clean = STEPS["benchmark decontamination"](spark, single, SF)
    assert clean.count() == 4 and clean.columns == docs.columns
    for rows in (docs, clean):
        mixed = STEPS["mixing to target weights"](spark, rows, SF)
        copies = curriculum.mix(rows).agg(F.sum("copies")).first()[0]
        assert mixed.columns == docs.columns and mixed.count() == copies
        path = f"{tmp_path}/{rows is docs}"
        mixed.write.parquet(path)
        packed = STEPS["token-id output"](spark, spark.read.parquet(path), SF).collect()
        encode = packing.encoder(open(packing.VOCABULARY, "rb").read())
        assert sum(r.n_tokens for r in packed) == sum(len(encode(r.text or "")) + 1 for r in spark.read.parquet(path).collect())


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and out.count() > 0
