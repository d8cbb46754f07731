import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnledger.llm import simhash
from turnledger.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=3):
    """component_id by doc position, from all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return sorted(
        ((d, f"{fps[i]:016x}", smallest.get(root(i))) for i, (d, _) in enumerate(rows)), key=str
    )


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéXY") for _ in range(rng.randint(1, 6)))
    rows, base = [], [word() for _ in range(300)]
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(300)] = word()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(200 + i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 50])))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, rows[0][1]), (303, rows[0][1])]
    rows += [(None, rows[0][1]), (None, "quite alone"), (None, "quite alone"), (304, "x" * 300_000)]
    return rows


def test_matches_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"fp": F.lit("clash"), "component": F.lit(1), "key": F.lit(2)}
    )
    got = [tuple(r) for r in simhash.near_duplicates(docs.repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("parts", [4, 5])
def test_links_of_planted_fingerprints(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    close = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), False)) for b in base for _ in range(8)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in [*map(int, base), *close]})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, parts=parts, block=16).collect()
    mask = 2**64 - 1
    joined = {frozenset(x) for x in _sets(fps, [(r.a, r.b) for r in found])}
    every = [(x, y) for x in fps for y in fps if x < y and ((x ^ y) & mask).bit_count() <= 3]
    assert joined == {frozenset(x) for x in _sets(fps, every)}


def _sets(nodes, edges):
    group = {n: {n} for n in nodes}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return {id(g): g for g in group.values()}.values()


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7777, 7777)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert len(got) == 301 + 200
    assert len({got[i] for i in range(301)}) == 1
    assert len({got[1000 + i] for i in range(200)}) == 1


def test_radii_cover_the_distance():
    rng = np.random.default_rng(1)
    costs = [np.cumsum(rng.integers(1, 50, (4, 200)), axis=0) for _ in range(4)]
    radii = simhash.allocate(costs, 4)
    assert ((radii + 1).sum(axis=1) == 4).all()
    best = np.full(200, np.inf)
    for a in range(-1, 4):
        for b in range(-1, 4):
            for c in range(-1, 4):
                d = 4 - a - b - c - 4
                if -1 <= d <= 3:
                    best = np.minimum(best, sum(k[r] if r >= 0 else 0 for k, r in zip(costs, (a, b, c, d))))
    assert (best == sum(np.where(r >= 0, k[np.maximum(r, 0), np.arange(200)], 0) for k, r in zip(costs, radii.T))).all()


def test_counts_around_values():
    counts = np.random.default_rng(2).integers(0, 9, 64)
    near = simhash.around(counts, 6, 3)
    for r in range(4):
        for v in (0, 5, 63):
            assert near[r, v] == sum(c for w, c in enumerate(counts) if (v ^ w).bit_count() <= r)


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, i % 7) for i, (d, t) in enumerate(rows)], "doc_id long, text string, part int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    expected = {c for _, _, c in brute(rows) if c is not None}
    assert sorted(k for k in kept if k is not None) == sorted(expected)
    assert kept.count(None) == 1


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_texts_become_one(spark):
    """Copies of at least 0.88 go with their base, texts of at most 0.6 stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, near, apart = [], 0, 0
    for group in range(40):
        base = [word() for _ in range(rng.randint(100, 500))]
        rows.append((group * 100, group, " ".join(base)))
        for i in range(1, 5):
            text = list(base)
            for at in rng.sample(range(len(text)), max(1, len(text) * rng.choice([1, 8, 15]) // 100)):
                text[at] = word()
            text = " ".join(text)
            like = similarity(" ".join(base), text)
            if like >= 0.88 or like <= 0.6:
                near, apart = near + (like >= 0.88), apart + (like <= 0.6)
                rows.append((group * 100 + i, group if like >= 0.88 else None, text))
    assert near > 20 and apart > 40
    rows += [(9000, None, "a b"), (9001, None, "a c"), (9002, 9002, ""), (9003, 9002, None), (9004, 9002, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, w0 long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs.repartition(5), similarity=0.8).collect()}
    lost = {(d, g) for d, g, _ in rows if d not in kept}
    assert all(g is not None for _, g in lost)
    copies = {d for d, g, _ in rows if g is not None and d not in (9002,) and d % 100}
    assert len(copies & kept) <= 1 and {d for d, _, _ in rows} - copies <= kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_first(docs).collect() == []
