from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnledger.llm import whitening as wh
from turnledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]


def plain(rows, scale=256, components=4):
    """{(vec_id, x): (deviation, whitened)}, n, explained: sums of Python integers."""
    xs = [(i, tuple(int(np.floor(scale * float(c))) for c in v)) for i, v in rows]
    fitted = sorted({x for _, x in xs})
    n, d = len(fitted), len(fitted[0])
    sums = [sum(x[a] for x in fitted) for a in range(d)]
    far = np.array([[n * x[a] - sums[a] for a in range(d)] for x in fitted], object)
    cov = ((far.T @ far) / (n * n) / n).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in xs:
        dev = [n * c - s for c, s in zip(x, sums)]
        w = (np.array(dev, object) / n).astype(float) @ axes / np.sqrt(values)
        out[i, x] = (sum(c * c for c in dev), w)
    return out, n, values / np.trace(cov), xs


def check(got, rows, **options):
    want, n, explained, xs = plain(rows, **options)
    signs = None
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation_exact), {}).setdefault(r.component, []).append(r)
    assert sum(len(v) for c in by_row.values() for v in c.values()) == len(explained) * len(rows)
    for i, x in xs:
        dev, w = want[i, x]
        mine = by_row[i, Decimal(dev)]
        line = np.array([mine[c + 1][0].whitened for c in range(len(explained))])
        signs = np.sign(line * w) if signs is None else signs
        assert np.allclose(line, signs * w, atol=1e-8)
        for c, e in enumerate(explained):
            r = mine[c + 1][0]
            assert (r.n, r.deviation) == (n, dev if dev < 1 << 63 else None)
            assert r.explained == pytest.approx(e, rel=1e-9) and r.identity_error < 1e-9


def test_query_against_plain_integers(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = QUERIES["op11_bit_sliced_whitening"](spark, SF)
    assert out.columns == COLUMNS
    check(out.collect(), rows)


def test_repeats_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 97 if i % 9 else None, (rng.normal(size=5) * [1, 3, 0, 0.2, 40]).tolist()) for i in range(300)]
    rows += [(7, rows[0][1])] * 500  # a crowd of copies counts once in the fit
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    df = df.withColumns({c: F.lit("x") for c in ["x", "n", "component", "whitened"]}).repartition(7)
    got = wh.whitened(df)
    assert got.schema["vec_id"].dataType.simpleString() == "int"
    check(got.collect(), rows)


def test_vectors_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.25]), (2, [-3.0, 2.5]), (2, [-3.0, 2.5])]
    bad = [(3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    check(wh.whitened(df, components=2).collect(), good, components=2)
    assert wh.whitened(df.limit(0)).collect() == []
    assert wh.whitened(df.filter("vec_id = 3")).collect() == []


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5, 1.0])] * 3, "vec_id long, embedding array<double>")
    got = wh.whitened(one).collect()
    assert len(got) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = wh.whitened(line).collect()
    assert {r.component: r.explained for r in got}[1] == pytest.approx(1.0)
    assert all((r.whitened is None) == (r.component > 1) for r in got)


def test_entries_up_to_the_ends_of_a_long(spark):
    rows = [(i, v) for i, v in enumerate([[1e300, 1.0], [-1e300, 2.0], [3e15, -4.0], [0.0, 0.5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {r.vec_id: r.x for r in wh.integers(df).collect()}
    assert x[0][0] == 2**63 - 1 and x[1][0] == -(2**63)
    got = {(r.vec_id, r.component): r for r in wh.whitened(df).collect()}
    n, sums = 4, [sum(v[a] for v in x.values()) for a in range(2)]
    for i, v in x.items():
        exact = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        r = got[i, 1]
        assert r.deviation_exact == (exact if exact < 10**38 else None) and (r.deviation is None) == (exact >= 1 << 63)
    assert got[0, 1].identity_error < 1e-9


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for rows, bits in ((1, [1, 3]), (64, [8, 1, 63]), (200, [5, 64, 2, 33])):
        y = np.stack([rng.integers(0, 1 << b, rows, dtype=np.uint64, endpoint=False) if b < 64 else rng.integers(0, 2**64 - 1, rows, dtype=np.uint64) for b in bits], axis=1)
        total = np.zeros((len(bits), len(bits)), object)
        wh.cross_products(wh.bit_planes(y, bits), bits, total)
        wide = y.astype(object)
        assert (np.triu(wide.T @ wide) == total).all()
