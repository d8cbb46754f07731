"""Fitted trees as tables: nodes as rows, scores as a column expression, and what rows say
at every node.

Nodes are numbered like a heap: the root is 1, the children of n are 2n and 2n + 1, so that
the nodes a row has passed follow from its leaf. All that is sent with a plan is the model,
whose size its number and depth of trees bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)$")
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):$")


@dataclass(frozen=True)
class Node:
    """A split (rows with `feature` up to `threshold` go to 2n) or a leaf (no feature)."""

    node: int
    feature: int | None = None
    threshold: float | None = None
    prediction: float | None = None


@dataclass(frozen=True)
class Trees:
    """An ensemble over numeric features: the weighted sum of what its trees predict.

    A threshold is compared to `(feature - mean) * factor`. `boosted` trees are fitted to
    what the trees before them leave over.
    """

    features: tuple[str, ...]
    mean: tuple[float, ...]
    factor: tuple[float, ...]
    weights: tuple[float, ...]
    trees: tuple[tuple[Node, ...], ...]
    boosted: bool = False

    @classmethod
    def of(cls, model: PipelineModel) -> Trees:
        """The trees of a pipeline of `ml.pipeline`, read from the text that Spark prints of
        them, which has every number in full."""
        assembler, scaler, fitted = model.stages
        lines = [line.strip() for line in fitted.toDebugString.splitlines()[1:] if line.strip()]
        trees, weights, rest = [], [], iter(lines)
        for head in rest:
            weights.append(float(_TREE.match(head).group(1)))
            trees.append(tuple(_nodes(rest, 1)))
        boosted = type(fitted).__name__.startswith("GBT")
        if not boosted:
            weights = [1 / len(trees)] * len(trees)
        spread = [float(s) for s in scaler.std]
        return cls(
            tuple(assembler.getInputCols()), tuple(float(m) for m in scaler.mean),
            tuple(1 / s if s else 0.0 for s in spread), tuple(weights), tuple(trees), boosted,
        )

    def leaves(self) -> Column:
        """Per tree the position (see `_laid_out`) of the leaf that a row comes to, null for
        a row with a feature that is null or not a number, which a pipeline skips."""
        laid = self._laid_out()
        feature, threshold, left, right = (_literal(laid[k], t) for k, t in (
            ("feature", "int"), ("threshold", "double"), ("left", "int"), ("right", "int")))
        steps = F.sequence(F.lit(1), F.lit(laid["depth"])) if laid["depth"] else F.array().cast("array<int>")

        def walk(x: Column, root: Column) -> Column:
            return F.aggregate(steps, root, lambda n, _: F.when(
                F.get(x, F.get(feature, n)) <= F.get(threshold, n), F.get(left, n)
            ).otherwise(F.get(right, n)))

        x = F.array(*[
            (F.col(f).cast("double") - m) * k for f, m, k in zip(self.features, self.mean, self.factor)
        ])
        # One lambda variable for the features: they are computed once, not at every node.
        found = F.transform(F.array(x), lambda v: F.when(
            ~F.exists(v, lambda one: one.isNull() | F.isnan(one)),
            F.transform(_literal(laid["roots"], "int"), lambda root: walk(v, root)),
        ))
        return F.get(found, F.lit(0))

    def predict(self) -> Column:
        """The score of a row from its features: built-ins only, in a batch or on a stream."""
        value = _literal(self._laid_out()["prediction"], "double")
        parts = F.zip_with(self.leaves(), _literal(self.weights, "double"),
                           lambda n, w: F.get(value, n) * w)
        return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)

    def _laid_out(self) -> dict:
        """Columns of all nodes, one tree after the other. A leaf leads to itself."""
        at, roots = {}, []
        for t, tree in enumerate(self.trees):
            roots.append(len(at))
            for n in sorted(tree, key=lambda n: n.node):
                at[t, n.node] = (len(at), n)
        nodes = [(t, i, n) for (t, _), (i, n) in at.items()]
        child = lambda t, i, n, c: i if n.feature is None else at[t, 2 * n.node + c][0]
        return {
            "roots": roots,
            "depth": max(n.node.bit_length() - 1 for _, _, n in nodes),
            "tree": [t for t, _, _ in nodes],
            "node": [n.node for _, _, n in nodes],
            "feature": [n.feature or 0 for _, _, n in nodes],
            "threshold": [0.0 if n.threshold is None else n.threshold for _, _, n in nodes],
            "left": [child(t, i, n, 0) for t, i, n in nodes],
            "right": [child(t, i, n, 1) for t, i, n in nodes],
            "prediction": [0.0 if n.prediction is None else n.prediction for _, _, n in nodes],
        }


def _nodes(lines: Iterator[str], node: int) -> Iterator[Node]:
    """A node and all below it, from lines in the order of a walk."""
    line = next(lines)
    if line.startswith("Predict:"):
        yield Node(node, prediction=float(line.split(":")[1]))
        return
    split = _SPLIT.match(line)
    if split is None:
        raise ValueError(f"not a split of a numeric feature: {line}")
    yield Node(node, int(split.group(1)), float(split.group(2)))
    yield from _nodes(lines, 2 * node)
    next(lines)  # the line that opens the other side
    yield from _nodes(lines, 2 * node + 1)


def _literal(values: Sequence[float], kind: str) -> Column:
    """An array that the optimizer folds to one literal; an element each would make plans
    of thousands of expressions."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def node_table(spark: SparkSession, trees: Trees) -> DataFrame:
    """(tree, node, parent, depth, feature, threshold, weight, prediction), a row per node.

    Thresholds are in units of the feature. The root has no parent, a leaf no feature and
    threshold, a split no prediction.
    """
    rows = [
        (
            t, n.node, n.node // 2 or None, n.node.bit_length() - 1,
            None if n.feature is None else trees.features[n.feature],
            None if n.feature is None else n.threshold / trees.factor[n.feature] + trees.mean[n.feature],
            trees.weights[t], n.prediction,
        )
        for t, tree in enumerate(trees.trees) for n in tree
    ]
    return spark.createDataFrame(
        rows, "tree int, node long, parent long, depth int, feature string, threshold double, "
        "weight double, prediction double",
    )


def node_statistics(rows: DataFrame, trees: Trees, label: str) -> DataFrame:
    """(tree, node, rows, mean, variance, gain): what the rows that pass a node say of it.

    `mean` and `variance` are those of what the tree is fitted to: the label, or, for a
    boosted tree after the first, twice what the trees before it leave over (the slope of
    the squared error). `gain` is by how much the split lowers the variance, null for a
    leaf. On the rows of a fit without resampling, the mean of a leaf is its prediction.

    Rows without a label or with a feature that is no number are left out; nodes that no
    row passes give no row. Rows are summed up by leaf where they are read, a row per
    (tree, leaf) and task is shuffled, and splits are summed up from their leaves.
    """
    laid = trees._laid_out()
    node, value, weights = (_literal(laid["node"], "bigint"), _literal(laid["prediction"], "double"),
                            _literal(trees.weights, "double"))
    y = F.col(label).cast("double")
    found = rows.select(y.alias("_y"), trees.leaves().alias("_leaves")).filter(
        "_y IS NOT NULL AND NOT isnan(_y) AND _leaves IS NOT NULL"
    )
    if trees.boosted:
        parts = F.zip_with("_leaves", weights, lambda n, w: F.get(value, n) * w)
        found = found.select("_y", "_leaves", parts.alias("_parts"))
        before = lambda t: F.aggregate(F.slice("_parts", 1, t), F.lit(0.0), lambda a, b: a + b)
        target = lambda t: F.when(t == 0, F.col("_y")).otherwise(2 * (F.col("_y") - before(t)))
    else:
        target = lambda t: F.col("_y")
    met = found.select(F.inline(F.transform("_leaves", lambda n, t: F.struct(
        t.alias("tree"), F.get(node, n).alias("leaf"), target(t).alias("_t")))))
    by_leaf = met.groupBy("tree", "leaf").agg(
        F.count("*").alias("_n"), F.avg("_t").alias("_mean"), F.var_pop("_t").alias("_var")
    )
    # The nodes on the way to a leaf are its number without its last bits.
    up = F.transform(F.sequence(F.lit(0), F.lit(laid["depth"])), lambda k: F.call_function("shiftright", F.col("leaf"), k))
    passed = by_leaf.withColumn("node", F.explode(F.filter(up, lambda n: n > 0)))
    n, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")
    nodes = passed.groupBy("tree", "node").agg(
        n.alias("rows"), mean.alias("mean"),
        (F.sum(F.col("_n") * F.col("_var")) / n).alias("_within"),
        F.collect_list(F.struct("_n", "_mean")).alias("_leaves"),
    )
    # Leaves of one tree: few. Squares are taken around the mean, so large labels stay exact.
    between = F.aggregate(
        "_leaves", F.lit(0.0),
        lambda total, leaf: total + leaf["_n"] * (leaf["_mean"] - F.col("mean")) * (leaf["_mean"] - F.col("mean")),
    ) / F.col("rows")
    nodes = nodes.select("tree", "node", "rows", "mean", (F.col("_within") + between).alias("variance"))
    children = nodes.filter("node > 1").groupBy("tree", F.expr("shiftright(node, 1)").alias("node")).agg(
        F.sum(F.col("rows") * F.col("variance")).alias("_left_over")
    )
    return nodes.join(children, ["tree", "node"], "left").select(
        "tree", "node", "rows", "mean", "variance",
        (F.col("variance") - F.col("_left_over") / F.col("rows")).alias("gain"),
    )
