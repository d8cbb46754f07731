import re

import pytest
from pyspark.sql import functions as F

from turnledger.llm.curriculum import curriculum, in_training_order, mix, position


def plain_targets(sizes):
    """Shares by weight, cut and shared anew until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in cut)
        free = [s for s in names if s not in cut]
        goal = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if goal[s] > 3 * sizes[s]}
        if not above:
            return goal | {s: 3 * sizes[s] for s in cut}
        cut |= above


ROWS = (
    [(i, "one two three four five " * (i % 7 + 1), "a" if i % 3 else "hot") for i in range(400)]
    + [(1000 + i, "w " * 30, "tiny") for i in range(4)]
    + [(2000 + i, "x\ty\nz", None) for i in range(50)]
    + [(3000, None, "empty"), (3001, "", "empty"), (3002, " \n", "a"), (None, "a b c", "é"), (5, "x y", "hot"),
       (5, "x y", "hot"), (4000, "long " * 20_000, "z"), (4001, "w " * 5, "Z")]
)


def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit("clash"), "slice": F.lit(1), "target": F.lit(None).cast("double")})


def test_targets_and_taken_words(spark):
    got = mix(docs(spark)).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for d, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal, taken, largest = plain_targets(sizes), {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size == len(r.positions) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(r.size, largest.get(r.source, 0))
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree(spark):
    plan = lambda parts: sorted((str(tuple(r)) for r in mix(docs(spark).repartition(parts)).collect()))
    assert plan(1) == plan(5)


def test_positions_invert_the_demand(spark):
    schedule = (0.2, 2.0, 1.0, 0.0, 0.8)
    demand = lambda t: sum(
        (min(max(t - k / 4, 0), 1 / 4) * (2 * a + (b - a) * 4 * min(max(t - k / 4, 0), 1 / 4)) / 2)
        for k, (a, b) in enumerate(zip(schedule, schedule[1:]))
    )
    df = spark.range(0, 101).select((F.col("id") / 100).alias("share"), F.lit(0).alias("rank"))
    for r in df.select("share", position(F.col("share"), F.col("rank"), (schedule,)).alias("at")).collect():
        assert demand(r.at) / demand(1) == pytest.approx(r.share, abs=1e-9)


def test_curriculum_repeats_rows_in_order(spark):
    source = docs(spark)
    out = curriculum(source)
    assert out.columns == source.columns
    plan = {}
    for r in mix(source).collect():
        plan.setdefault(r.doc_id, []).extend(r.positions)
    rows = [r.doc_id for r in out.collect()]
    assert {d: rows.count(d) for d in plan if plan[d]} == {d: len(p) for d, p in plan.items() if p}
    single = [d for d in rows if len(plan[d]) == 1]
    assert [plan[d][0] for d in single] == sorted(plan[d][0] for d in single)
    order = [r.doc_id for r in in_training_order(mix(source)).collect() if r.copies == 1]
    assert [plan[d][0] for d in order if len(plan[d]) == 1] == sorted(plan[d][0] for d in order if len(plan[d]) == 1)


def test_empty_table(spark):
    none = docs(spark).limit(0)
    assert mix(none).collect() == [] and curriculum(none).collect() == []
