import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import quality


def corpus(n=2500):
    """Good texts of words, bad ones of signs, capitals or one word again and again."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            text = [w + "***" for w in text] if kind == 0 else [w.upper() + "!!" for w in text] if kind == 1 else [text[0]] * 60
        docs.append((i, " ".join(text), good))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").withColumns({"score": F.lit("clash"), "positive": F.lit(0)})
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, labelled)
    got = {r.doc_id: r for r in quality.score_quality(df.repartition(3), model).collect()}
    truth = {i: good for i, _, good in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in got if got[i].held_out]
    right = [(got[i].predicted == 1) == truth[i] for i in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.95
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    # Labels of the held-out fold and labels of 0 change nothing.
    other = labelled.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & (F.col("quality") == 1))
    assert np.allclose(quality.fit(df, other).weights, model.weights)


def test_prior_of_a_mixture():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        positive = rng.normal(1.5, 1, (2000, 4))
        unlabelled = np.where(rng.random((2000, 1)) < share, rng.normal(1.5, 1, (2000, 4)), rng.normal(-1.5, 1, (2000, 4)))
        assert quality.estimate_prior(positive, unlabelled) == pytest.approx(share, abs=0.08)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "some words"), (3, "x" * 2_500_000), (4, "퟿ é 日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (4, 1), (4, 1)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted(labels).collect()] == [4]
    model = quality.fit(df, labels)
    got = quality.score_quality(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert not next(r for r in got if r.doc_id is None).held_out
    blank = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score_quality(df, blank).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), quality.fit(df.limit(0), labels)).collect() == []


def test_one_row_of_each_id_is_drawn(spark):
    """A third of all rows under one id, some of them equal: a row counts, the same one
    whatever the partitions."""
    rows = [(7, f"text {i % 60} of the crowd") for i in range(1500)] + [(i, f"plain words {i}") for i in range(100, 3100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(7, True), (7, False), (150, False), (4000, True)], "doc_id long, positive boolean")
    draw = lambda parts: {
        (r.doc_id, r.positive): bytes(r.vector)
        for r in quality.drawn_vectors(df.repartition(parts), wanted).collect()
    }
    got = draw(1)
    assert set(got) == {(7, True), (7, False), (150, False)} and quality.drawn_vectors(df, wanted).count() == 3
    assert got == draw(5) == draw(8) and got[7, True] == got[7, False]
    first = df.filter("doc_id = 7").orderBy(F.xxhash64("text")).first().text
    assert got[7, True] == quality.features(first).astype(np.float16).tobytes()


def test_features_against_plain_counts():
    for text in ("", "a", "The cat sat. The cat sat!", "é 日本 é"):
        data = b"  " + text.encode() + b"  "
        counts = [0] * quality.FEATURES
        for a, b, c in zip(data, data[1:], data[2:]):
            counts[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 21] += 1
        want = np.sqrt(np.array(counts) / sum(counts))
        got = quality.features(text)
        assert np.allclose(got[: quality.FEATURES], want, atol=1e-6) and np.linalg.norm(want) == pytest.approx(1)
    words = "one two two three one two".split()
    text = " ".join(words)
    again, seen = 1 / 6, 1 - 3 / 6
    level = lambda share: [0.1 * (share >= k / 10) for k in range(1, 11)]
    assert quality.repetition(text) == pytest.approx(level(again) + level(seen) + level(seen) + level(0.0))
