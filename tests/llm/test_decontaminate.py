import random

from pyspark.sql import functions as F

from turnledger.llm.decontaminate import Finder, Item, Myers, contaminated, drop_contaminated, normal, pieces


def distance_table(pattern, text, anchored=False):
    """Last row of the plain edit distance table, for passages ending anywhere."""
    row = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return row[1:]


def test_distances_match_the_table():
    rng = random.Random(4)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 120)))
        for anchored in (False, True):
            assert list(Myers(p).distances(t, anchored)) == distance_table(p, t, anchored)


def test_pieces_cover_the_item():
    for n in (1, 5, 16, 17, 100, 394):
        for errors in {0, n // 16, n // 3}:
            cut = pieces("x" * (n - 1) + "y", errors)
            assert "".join(p for _, p in cut) == "x" * (n - 1) + "y" and all(p for _, p in cut)
            assert len(cut) == errors + 1


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz")
        elif kind == 1:
            text.insert(at, rng.choice("abcxyz"))
        else:
            del text[at]
    return "".join(text)


def test_finds_what_the_table_finds():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdxyz") for _ in range(rng.randint(2, 8))) for _ in range(40)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [Item(i, some(rng.randint(5, 40)), 0) for i in range(12)]
    for item in items:
        item.errors = int(0.06 * len(item.text))
    finder = Finder(items)
    for trial in range(80):
        item = rng.choice(items)
        text = f"{some(rng.randint(0, 60))} {edited(rng, item.text, rng.randint(0, item.errors + 4))} {some(9)}"
        text = normal(text)
        got = {n: (d, s, e) for n, d, s, e in finder.matches(text)}
        for n, other in enumerate(items):
            best = min(distance_table(other.text, text))
            assert (n in got) == (best <= other.errors)
            if n in got:
                d, s, e = got[n]
                assert d == best == distance_table(other.text, text[s:e], True)[-1]


def test_tables(spark):
    item = "It was thonre that the item of benchmark stood in the whole text of a document once"
    rows = [
        (1, "before " + item + " after"),
        (2, "before " + item.upper().replace(" ", "\n ") + "."),
        (3, "before " + item.replace("stood", "stopd").replace("once", "nce")),
        (3, "before " + item.replace("stood", "stopd").replace("once", "nce")),
        (4, item.replace("benchmark", "something else entirely")),
        (5, None), (6, ""), (None, item), (7, "y" * 500_000 + item), (8, item * 2000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, "  "), (None, "nothing like it, nowhere")],
                                  "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 10, 0), (2, 10, 0), (3, 10, 2), (3, 10, 2), (7, 10, 0), (8, 10, 0), (None, 10, 0)], key=str)
    assert sorted(map(str, got)) == sorted(
        str((r.doc_id, r.item_id, r.distance)) for r in contaminated(docs, bench, limit=30).collect()
    )
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6]
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == len(rows)
