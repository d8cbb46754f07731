import random

import numpy as np
from pyspark.sql import functions as F

from turnledger.llm import packing


def plain_best_fit(sizes, capacity):
    """Room left in each row, with a search over all rows."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        sizes = [rng.randint(1, capacity) for _ in range(300)]
        rows = packing.best_fit(sizes, capacity)
        assert sorted(i for row in rows for i in row) == list(range(300))
        assert sorted(capacity - sum(sizes[i] for i in row) for row in rows) == plain_best_fit(sizes, capacity)


def test_nothing_is_lost(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["over", "naïve", "日本", "x1", "\n"]) for _ in range(rng.choice([0, 1, 40, 3000]))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (7777, "a b" * 30_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    packed = packing.pack(docs, row_tokens=512, pool_tokens=20_000).collect()
    encode = packing.encoder(open(packing.VOCABULARY, "rb").read())
    found = {}
    for r in packed:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 512 and r.cu_seqlens[0] == 0
        assert r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens:] == packing.SEPARATOR).all()
        assert len(r.doc_ids) == len(r.pieces) == len(r.cu_seqlens) - 1
        for doc, piece, s, e in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[s:e].tolist() == list(range(e - s))
            found.setdefault(doc, {})[piece] = ids[s:e].tolist()
    assert len({r.pack_id for r in packed}) == len(packed)
    for doc, text in rows:
        whole = [t for k in sorted(found[doc]) for t in found[doc][k]]
        assert whole == [*encode(text or ""), packing.SEPARATOR]
        assert sorted(found[doc]) == list(range(len(found[doc])))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
