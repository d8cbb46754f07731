"""Connected components by randomised contraction.

Each round every node picks, out of itself and its neighbours, the node with the
smallest hash; edges are rewritten to the picks, and loops and repeats go. The number
of nodes shrinks by a constant share per round whatever the shape of the graph, so a
long path takes no more rounds than a star. A node's neighbours are only reduced to
one minimum, which is combined before the shuffle: a hub costs nothing extra.

Edges are written as tables between the rounds. A checkpoint would hand on what the
planner knows about the columns, and what is known of a smaller and a larger end grows
fourfold with each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import keep, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    `edges` holds pairs of non-null longs in any direction, repeats and loops allowed.
    The component is one of its nodes. An empty input gives an empty result.
    """
    left = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter("a < b")
        .distinct(),
        "edges",
    )
    picks: list[DataFrame] = []
    while not left.isEmpty():
        salt = len(picks)
        both = F.explode(
            F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        )
        pick = (
            left.select(both.alias("e"))
            .select(F.col("e.a").alias("node"), F.col("e.b").alias("near"))
            .groupBy("node")
            .agg(F.min(F.struct(F.xxhash64("near", F.lit(salt)).alias("h"), "near")).alias("n"))
            .select(
                "node",
                F.least(
                    F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), F.col("node").alias("near")),
                    "n",
                )["near"].alias("pick"),
            )
        )
        pick = keep(pick)
        picks.append(pick)
        of_a = pick.select(F.col("node").alias("a"), F.col("pick").alias("pick_a"))
        of_b = pick.select(F.col("node").alias("b"), F.col("pick").alias("pick_b"))
        left = written(
            left.join(of_a, "a")
            .join(of_b, "b")
            .select(
                F.least("pick_a", "pick_b").alias("a"), F.greatest("pick_a", "pick_b").alias("b")
            )
            .filter("a < b")
            .distinct(),
            "edges",
        )
    if not picks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    result = picks.pop()
    while picks:
        # What the earlier round picked may have picked again; else it stays. Each round is
        # kept: the plan of the result does not hold those of all rounds.
        later = result.select(F.col("node").alias("pick"), F.col("pick").alias("last"))
        result = keep(
            picks.pop()
            .join(later, "pick", "left")
            .select("node", F.coalesce("last", "pick").alias("pick"))
        )
    return result.select("node", F.col("pick").alias("component"))
