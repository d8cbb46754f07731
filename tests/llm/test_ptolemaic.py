import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnledger.llm import ptolemaic as pt


def plain(rows, clusters=16, rounds=3, scale=64, length=64):
    """Sorted result rows, all comparisons made with Python integers."""
    kept = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(scale * float(c))))) for c in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        near = [k for _, k in assign()]
        for k in range(len(centroids)):
            own = [x for (_, x), n in zip(kept, near) if n == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own)]
    found = assign()
    inertia = [sum(d for d, n in found if n == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda n: n if n < 1 << 63 else None
    whole = lambda ds: None if any(d >= 1 << 63 for d in ds) else long(sum(ds))
    per = [whole([d for d, n in found if n == k]) for k in range(len(centroids))]
    total = whole([d for d, _ in found])
    return sorted(((i, k, long(d), per[k], total, sha[k]) for (i, _), (d, k) in zip(kept, found)), key=repr)


def result(df, **options):
    return sorted(map(tuple, pt.clustered(df, **options).collect()), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_against_all_comparisons(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 64))
    x = (centres[rng.integers(0, 9, 700)] + spread * rng.normal(size=(700, 64))).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).withColumns({"x": F.lit(1), "cluster": F.lit("c"), "hash": F.lit(0)})
    got = result(df.repartition(5), pilot=64)
    assert got == plain([(i, v) for i, v in enumerate(x)])
    assert got == result(df.repartition(2), pilot=500)  # pivots change no result


def test_copies_ties_and_null_ids(spark):
    # Few distinct vectors on a small grid: most distances tie, most centroids are equal.
    rng = np.random.default_rng(5)
    rows = [(i if i % 11 else None, v) for i, v in enumerate((rng.integers(-1, 2, (240, 3)) / 64).tolist())]
    rows += [(500, [0.5, 0.5, 0.5])] * 120
    assert result(frame(spark, rows, "double"), length=3) == plain(rows, length=3)


def test_vectors_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.1]), (2, [0.5, 0.25]), (9, [1.0, -2.0])]
    bad = [(3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = frame(spark, good + bad, "double")
    assert result(df, length=2) == plain(good)
    assert result(df.limit(0)) == [] and result(df) == []


def test_very_large_entries(spark):
    rows = [(i, [s * 10.0**e, float(i)]) for i, (s, e) in enumerate([(1, 300), (-1, 300), (1, 15), (-1, 15), (1, 6), (3, 0), (2, 0)])]
    got = result(frame(spark, rows, "double"), length=2, clusters=3)
    assert got == plain(rows, clusters=3) and any(r[2] is None for r in got)


def test_bounds_are_below_and_spare_comparisons():
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (16, 64))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 64))
    pivots = pt.pilot_pivots(x[:400], x[:16], 3)
    cached = pt.distances(x, pivots.points).astype(np.float32).astype(float)
    centroids = pt.pilot_pivots(x, x[:16], 3).points
    least = pivots.bounds(cached, centroids)
    true = np.stack([pt.squared(x, c[None, :]) for c in centroids], axis=1)
    assert (least <= true).all()
    cluster, best, compared = pt.nearest(x, cached, centroids, pivots)
    assert (cluster == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert compared < 0.2 * true.size
    # Centroids at pivots: the inequality is an equation, up to what is taken off.
    at = pivots.bounds(cached, pivots.points)
    assert (at > 0.99 * cached**2 - 1).all()
