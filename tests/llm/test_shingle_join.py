import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_simhash import plain_fingerprint, shingles
from turnledger.llm import shingle_join, simhash
from turnledger.llm.common import text_or_empty


def texts():
    """Copies on both sides of 0.8, short and long; a crowd of near copies; texts that
    share a passage."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, passage = [], [word() for _ in range(25)]
    for _ in range(50):
        base = [word() for _ in range(rng.choice([6, 13, 14, 30, 60, 150, 400]))]
        rows.append(base)
        for _ in range(3):
            text = list(base)
            for _ in range(rng.choice([1, 1, 2, len(base) // 40 + 1])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1])] = rng.choice([[word()], [], [word(), word()]])
            rows.append(text)
    crowd = [word() for _ in range(120)]
    for _ in range(80):
        text = list(crowd)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            text[at] = word()
        rows.append(text)
    rows += [passage + [word() for _ in range(rng.randint(2, 60))] for _ in range(60)]
    return [" ".join(r) for r in rows] + ["", None, " ", "a b", "a c"]


def smallest_of_groups(rows, like):
    """Places of the first text of each group, by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [plain_fingerprint(t) for t in rows]
    sets = [shingles(t) if (t or "").split() else None for t in rows]
    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= like * len(sets[i] | sets[j])
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {root(i) for i in range(len(rows))}


def test_the_stage_links_by_five_word_shingles(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    kept = sorted(r.doc_id for r in stage(spark, docs.repartition(3), "").collect())
    assert kept == sorted(smallest_of_groups(rows, 0.8)) and len(kept) < len(smallest_of_groups(rows, 2))


def met_rows(spark, rows, blocks=1):
    """Rows (shingle, text_id, size, at, label, shingles) as `candidates` takes them."""
    data = [
        (s, blocks, i % blocks, i, size, at, label, bytearray(shingle_join.bitmap(np.array(found, np.uint64))))
        for s, i, size, at, label, found in rows
    ]
    return spark.createDataFrame(data, "shingle long, blocks int, cell int, text_id long, size int, at int, label long, bitmap binary")


def test_a_crowd_is_not_compared_in_full(spark):
    same = [k << 16 for k in range(100)]
    rows = [(s, i, 100, 0, 7 if i < 400 else i, same) for i in range(402) for s in (1, 2)]
    met = met_rows(spark, rows)
    assert shingle_join.candidates(met, 0.8, False).count() == 2 * shingle_join.HUBS
    assert shingle_join.candidates(met, 0.8, True).count() == 2 * 400 + 1


def test_texts_that_share_one_shingle_give_no_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(5, i, 40, 0, i, [1 << 16, *rng.integers(1 << 17, 1 << 62, 39).tolist()]) for i in range(3000)]
    twin = rows[17][5]
    rows += [(5, 3000, 40, 0, 3000, twin), (5, 3001, 41, 0, 3001, [*twin, 3 << 20])]
    want = {(17, 3000), (17, 3001), (3000, 3001)}
    for blocks in (1, 4):
        got = shingle_join.candidates(met_rows(spark, rows, blocks), 0.8, True).collect()
        assert want <= {(r.a, r.b) for r in got} and len(got) < 10


@pytest.mark.parametrize("every", [False, True])
def test_blocks_meet_each_pair_once(spark, every):
    rows = [(9, i, 10, 0, i % 6, [1 << 16, 2 << 16]) for i in range(60)]
    found = shingle_join.candidates(met_rows(spark, rows, 4), 0.8, every).collect()
    got = sorted((r.a, r.b) for r in found)
    assert all((r.a_label, r.b_label) == (r.a % 6, r.b % 6) for r in found)
    if every:
        assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 6 != j % 6]
    else:
        hubs = 4 * shingle_join.HUBS
        assert got == sorted((h, i) for h in range(hubs) for i in range(h + 1, 60) if h % 4 == i % 4 and h % 6 != i % 6)


def test_crowded_shingles_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    heads = shingle_join.prefixes(
        docs.select(shingle_join.text_id().alias("text_id"), text_or_empty().alias("text")), 0.8, 5, 42
    )
    met = shingle_join.meeting(heads).collect()
    cells = Counter((r.shingle, r.cell) for r in met if r.blocks > 1)
    assert len(cells) > 20 and max(cells.values()) < 48
    kept = sorted(r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect())
    assert kept == sorted(smallest_of_groups(rows, 0.8))


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 300, 4000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        x, y = (np.frombuffer(shingle_join.bitmap(v), np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shingle_sets_and_prefixes():
    text = "One two THREE two one two three two one two three"
    sets = shingle_join.shingle_set(text, 5, 1)
    words = text.lower().split()
    assert len(sets) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert np.array_equal(sets, shingle_join.shingle_set(text.upper().replace(" ", "\n "), 5, 1))
    assert len(shingle_join.shingle_set("a b", 5, 1)) == 1 and not len(shingle_join.shingle_set(" ", 5, 1))
    assert [shingle_join.prefix_length(n, 0.8) for n in (0, 1, 5, 9, 10)] == [0, 1, 2, 2, 3]
    assert simhash.SIMILAR_WORDS == 5 and corpus_pipeline.SIMILARITY == 0.8
