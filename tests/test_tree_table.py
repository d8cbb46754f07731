import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.operators import ml
from turnledger.operators.tree_table import Node, Trees, node_statistics, node_table

NAMES = ["a", "b", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(50, 20, 900), rng.integers(0, 6, 900)
    y = np.where(a > 40, 3 * a, 7) + 10 * b + rng.normal(0, 2, 900)
    data = [(i, float(a[i]), int(b[i]), 4, float(y[i])) for i in range(900)]
    return spark.createDataFrame(data, "i int, a double, b int, flat int, y double").cache()


def fitted(rows, regressor):
    return ml.pipeline(regressor, "y", NAMES).fit(rows)


@pytest.mark.parametrize("regressor", [lambda: ml.boosted_trees(6), lambda: ml.forest(5, 7)], ids=["boosted", "forest"])
def test_expression_equals_transform(spark, rows, regressor):
    model = fitted(rows, regressor())
    trees = Trees.of(model)
    scored = model.transform(rows).withColumn("p", trees.predict())
    assert scored.filter("p IS NULL OR abs(p - prediction) > 1e-9").count() == 0
    table = node_table(spark, trees)
    sizes = [t.numNodes for t in model.stages[-1].trees]
    assert [r["count"] for r in table.groupBy("tree").count().orderBy("tree").collect()] == sizes
    assert table.filter("(feature IS NULL) != (prediction IS NOT NULL)").count() == 0


def test_leaves_of_boosted_trees_are_means_of_what_is_left(spark, rows):
    trees = Trees.of(fitted(rows, ml.boosted_trees(5)))
    stats = node_statistics(rows, trees, "y")
    both = node_table(spark, trees).join(stats, ["tree", "node"], "left")
    assert both.filter("rows IS NULL").count() == 0
    assert both.filter("feature IS NULL AND abs(mean - prediction) > 1e-6").count() == 0
    assert both.filter("feature IS NOT NULL AND gain <= 0 OR feature IS NULL AND gain IS NOT NULL").count() == 0
    at_root = {r.tree: r for r in both.filter("node = 1").collect()}
    assert {r.rows for r in at_root.values()} == {900}
    whole = rows.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")).first()
    assert at_root[0]["mean"] == pytest.approx(whole.m) and at_root[0].variance == pytest.approx(whole.v)


def test_statistics_against_a_plain_walk(spark, rows):
    trees = Trees(
        ("a", "b"), (50.0, 0.0), (0.1, 1.0), (1.0, 0.5),
        ((Node(1, 0, -1.0), Node(2, prediction=20.0), Node(3, 1, 2.0), Node(6, prediction=180.0), Node(7, prediction=230.0)),
         (Node(1, prediction=4.0),)),
        boosted=True,
    )
    passed = {}
    for r in rows.collect():
        path = [1, 2] if (r.a - 50) * 0.1 <= -1 else [1, 3, 6 if r.b <= 2 else 7]
        for n in path:
            passed.setdefault((0, n), []).append(r.y)
        first = {2: 20.0, 6: 180.0, 7: 230.0}[path[-1]]
        passed.setdefault((1, 1), []).append(2 * (r.y - first))
    got = {(r.tree, r.node): r for r in node_statistics(rows, trees, "y").collect()}
    assert set(got) == set(passed)
    for key, values in passed.items():
        assert got[key].rows == len(values)
        assert got[key]["mean"] == pytest.approx(np.mean(values)) and got[key].variance == pytest.approx(np.var(values))
    left, right = passed[0, 6], passed[0, 7]
    after = (len(left) * np.var(left) + len(right) * np.var(right)) / len(passed[0, 3])
    assert got[0, 3].gain == pytest.approx(np.var(passed[0, 3]) - after) and got[0, 2].gain is None


def test_rows_without_a_number_have_no_score(spark):
    trees = Trees(("a",), (0.0,), (1.0,), (1.0,), ((Node(1, 0, 1.0), Node(2, prediction=5.0), Node(3, prediction=9.0)),))
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 1.0), (float("nan"), 1.0)], "a double, y double")
    assert [r.p for r in df.select(trees.predict().alias("p")).collect()] == [5.0, 9.0, None, None]
    got = {r.node: r.rows for r in node_statistics(df, trees, "y").collect()}
    assert got == {1: 1, 2: 1}
    assert node_statistics(df.limit(0), trees, "y").count() == 0


def test_scores_on_a_stream(spark, rows, tmp_path):
    model = fitted(rows, ml.boosted_trees(3))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").select("i", Trees.of(model).predict().alias("p"))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").join(model.transform(rows), "i")
    assert got.count() == 900 and got.filter("abs(p - prediction) > 1e-9").count() == 0
