import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from turnledger.llm import kd_shards as kd
from turnledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TREE = ["__llm_d0", "__llm_d1", "__llm_d2", *kd.TIES]


def plain_shards(rows, shards):
    """Shard of each row, by sorting every node whole. `rows` hold positions, ties and
    size in the order of TREE."""
    out = [0] * len(rows)
    extent = lambda some, d: max(rows[i][d] for i in some) - min(rows[i][d] for i in some)
    whole = [extent(range(len(rows)), d) for d in range(3)] if rows else []

    def split(some, first, count):
        if count == 1 or not some:
            for i in some:
                out[i] = first
            return
        widths = [extent(some, d) / whole[d] if whole[d] else 0.0 for d in range(3)]
        axis = widths.index(max(widths))
        some = sorted(some, key=lambda i: (rows[i][axis], *rows[i][3:6]))
        goal, seen, at = sum(rows[i][6] for i in some) * (count // 2), 0, 0
        while (seen + rows[some[at]][6]) * count < goal:
            seen += rows[some[at]][6]
            at += 1
        if goal - seen * count >= (seen + rows[some[at]][6]) * count - goal:
            at += 1
        split(some[:at], first, count // 2)
        split(some[at:], first + count // 2, count - count // 2)

    split(list(range(len(rows))), 0, shards)
    return out


def expected(docs, shards=40, dimensions=kd.DIMENSIONS):
    """Counter of (doc_id, size, crc, shard)."""
    rows = kd.keyed(docs.coalesce(1), dimensions).collect()
    keys = [(*[r[c] for c in TREE], r["__llm_size"]) for r in rows]
    crc = [zlib.crc32((r.text or "").encode()) for r in rows]
    size = [len((r.text or "").encode()) + 16 for r in rows]
    return Counter(zip([r.doc_id for r in rows], size, crc, plain_shards(keys, shards)))


def check(got, want, shards=40):
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def crowded(spark):
    """A source with most rows, a text on a third of them, a row that repeats whole."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["ab", "č", "def", "gh"]) for _ in range(n))
    rows = [(i, words(rng.randint(0, 60)), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "x", "y", None])) for i in range(900)]
    rows += [(1000 + i, "one text of many", "en", "hot") for i in range(500)]
    rows += [(7, "the same row", "en", "hot")] * 300
    rows += [(None, None, None, None)] * 20 + [(5, "", "fr", "x"), (6, words(3000), "fr", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_query_against_sorted_nodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES["op13_kd_tree_shards"](spark, SF)
    assert [c for c, _ in out.dtypes] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(out.collect(), expected(docs))


def test_crowds_are_cut_to_equal_bytes(spark):
    docs = crowded(spark)
    clash = docs.withColumns({c: F.lit("x") for c in ["shard", "size", "node", "slot", "cell", "place"]})
    got = kd.assign(clash.repartition(6)).collect()
    check(got, expected(docs))
    again = kd.assign(docs.repartition(3)).collect()
    of = lambda rows: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows)
    assert of(again) == of(got)


def test_cuts_are_off_by_half_a_document(spark):
    docs = crowded(spark).filter("doc_id IS NULL OR doc_id <> 6")  # one above the target
    sizes, largest = Counter(), 0
    for r in kd.assign(docs).collect():
        sizes[r.shard] += r["size"]
        largest = max(largest, r["size"])
    target = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(s - target) <= largest for s in sizes.values()) and largest < target / 4


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_any_number_of_shards(spark, shards):
    docs = crowded(spark)
    check(kd.assign(docs, shards).collect(), expected(docs, shards), shards)


def test_target_bytes_and_tiny_tables(spark):
    docs = spark.createDataFrame([(i, "x" * 84, "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    got = kd.assign(docs, target_bytes=1000).collect()
    assert Counter(r.shard for r in got) == Counter({s: 10 for s in range(6)})
    one = kd.assign(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0 and one[0]["size"] == 100
    assert kd.assign(docs.limit(0)).collect() == []


def test_other_dimensions(spark):
    docs = crowded(spark).withColumn("score", F.col("doc_id") / 7).withColumn("far", F.lit(2**62) * (F.col("doc_id") % 2))
    dims = ("score", "far", "lang")
    got = kd.assign(docs, 8, dimensions=dims).collect()
    check(got, expected(docs, 8, dims), 8)


def test_written_shards_hold_the_documents(spark, tmp_path):
    docs = crowded(spark).withColumn("shard", F.lit("own"))
    column = kd.write_shards(docs.repartition(4), f"{tmp_path}/out", 8, max_rows_per_file=150)
    assert column == "shard_"
    back = spark.read.parquet(f"{tmp_path}/out")
    rows = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))
    assert rows(back) == rows(docs)
    of = Counter((r.doc_id, r.text_crc32, r.shard) for r in kd.assign(docs, 8).collect())
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")
    assert Counter(map(tuple, back.select("doc_id", crc, column).collect())) == of
