import pytest
from pyspark.sql import functions as F

from turnledger.llm.rollups import Rollup, deltas, revised


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


@pytest.fixture
def docs(spark):
    rows = [(1, "a", "en", 5), (2, "a", "en", 7), (3, None, "de", 2), (4, "b", None, None), (4, "b", None, None)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n long").withColumn("tokenizer", F.lit("clash"))


def test_inserts_deletes_and_revisions(spark, docs, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.commit("in", deltas(docs, F.col("n"), "t1", 1))
    assert totals(rollup) == {("a", "en", "t1"): (2, 12), (None, "de", "t1"): (1, 2), ("b", None, "t1"): (2, 0)}
    assert rollup.commit("out", [deltas(docs.filter("doc_id = 1"), F.col("n"), "t1", -1)])
    assert rollup.commit("new", revised(docs.filter("doc_id = 2"), (F.col("n"), "t1"), (F.col("n") * 2, "t2")))
    expected = {("a", "en", "t2"): (1, 14), (None, "de", "t1"): (1, 2), ("b", None, "t1"): (2, 0)}
    assert totals(rollup) == expected
    # Repeated batches, also from another handle on the folder, count nothing twice.
    assert not rollup.commit("out", deltas(docs.filter("doc_id = 1"), F.col("n"), "t1", -1))
    assert not Rollup(spark, str(tmp_path / "r")).commit("in", deltas(docs, F.col("n"), "t1", 1))
    assert totals(rollup) == expected and rollup.batches() == ["in", "new", "out"]
    assert list((tmp_path / "r" / "staged").iterdir()) == []


def test_a_lost_race_leaves_the_first_batch(spark, docs, tmp_path):
    first, second = Rollup(spark, str(tmp_path / "r")), Rollup(spark, str(tmp_path / "r"))
    real = second.committed
    assert first.commit("x", deltas(docs, F.col("n"), "t", 1))
    calls = []
    second.committed = lambda b: bool(calls.append(b)) if not calls else real(b)
    assert not second.commit("x", deltas(docs, F.col("n"), "t", 1))
    assert totals(first)[("a", "en", "t")] == (2, 12)


def test_empty_batches_and_names(spark, docs, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert rollup.commit("none", deltas(docs.limit(0), F.col("n"), "t", 1)) and totals(rollup) == {}
    with pytest.raises(ValueError):
        rollup.commit("a/b", deltas(docs, F.col("n"), "t", 1))
