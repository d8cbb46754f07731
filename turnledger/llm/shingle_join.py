"""Pairs of texts whose sets of word shingles have a given Jaccard similarity, exactly.

Shingles are put in one order for all texts: rare before common, by a table of counts of
fixed size (how good the counts are changes the work, not the result). Two sets of
similarity s or more share a shingle among the first n - ceil(s * n) + 1 of each, so only
texts that meet in such a prefix are compared.

Texts that meet are first compared by a bitmap: each shingle of a set turns one of
`BITMAP` bits over, so the bits in which two bitmaps differ are at most the shingles in
which the sets differ. Pairs that differ in too many bits go where they meet, and are
never written; the others are decided by the exact overlap of the two sets.

Pairs are wanted for what they connect. Texts that are connected already are not compared:
first every text that meets others is compared to the `HUBS` smallest of them, then, with
the groups that this has joined, every pair of texts of different groups. A large group of
near copies thus costs its size and not its square. Where many texts share a shingle, they
are dealt to blocks of about `BLOCK` texts, each task holds one, and the texts of other
blocks pass by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import keep, map_batches, release, text_or_empty, written
from turnledger.llm.components import components

# Counts of shingles: fixed size, whatever the input.
SLOTS = 1 << 16
# Bits of the bitmaps.
BITMAP = 512
# Texts of a block that all others of it are compared to before any other pair.
HUBS = 4
# Texts of one shingle, or partners of one text, that a task holds or sees on their own.
BLOCK = 4096
# Pairs held in memory at a time.
PAIRS = 1 << 20
PAIR = ["a", "b", "a_label", "b_label"]


def shingle_set(text: str, words: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words (of the whole sequence, if
    shorter); words as in `simhash.fingerprint`. Empty without any word."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), seed)], np.uint64)
    single = np.array([digest(t, seed) for t in tokens], np.uint64)
    count = len(tokens) - words + 1
    z = np.zeros(count, np.uint64)
    for k in range(words):
        z = (z ^ single[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(31)
    return np.unique(z)


def prefix_length(size: int, similarity: float) -> int:
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def slot_counts(texts: DataFrame, words: int, seed: int) -> np.ndarray:
    """Shingles of all texts by slot: at most SLOTS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            found = [slots(shingle_set(t, words, seed)) for t in batch.column("text").to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    found = map_batches(texts.select("text"), run, "slot long, n long")
    rows = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """Which of the bits an odd number of the shingles belongs to."""
    bits = np.bincount((shingles >> np.uint64(16)).astype(np.int64) & (BITMAP - 1), minlength=BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def prefixes(texts: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """(text_id, size, prefix, bitmap) per distinct text with words."""
    sent = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, words, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            ids, sizes, heads, bits = [], [], [], []
            for i, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingle_set(text, words, seed)
                if len(found):
                    order = np.lexsort((found, counts[slots(found)]))
                    ids.append(i)
                    sizes.append(len(found))
                    heads.append(found[order[: prefix_length(len(found), similarity)]].view(np.int64))
                    bits.append(bitmap(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                    pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                ],
                names=["text_id", "size", "prefix", "bitmap"],
            )

    found = map_batches(texts, run, "text_id long, size int, prefix array<long>, bitmap binary")
    return found.groupBy("text_id").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "bitmap")])


def meeting(heads: DataFrame) -> DataFrame:
    """(shingle, blocks, cell, text_id, size, at): rows of prefixes whose shingle is in
    another prefix too, with the place in the prefix, and the block of the shingle that
    the text is dealt to."""
    rows = heads.select("text_id", "size", F.posexplode("prefix").alias("at", "shingle"))
    crowded = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    blocks = crowded.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(written(blocks, "crowded-shingles"), "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("text_id", "shingle"), "blocks").cast("int"))
    columns = ["shingle", "blocks", "cell", "text_id", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, if nothing has met it yet
        last = None
        for batch in batches:
            key = batch.column("shingle").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            same = np.empty(len(key), bool)
            same[0], same[1:] = last is not None and key[0] == last, key[1:] == key[:-1]
            # A text in a block of its own meets those of the other blocks.
            take = same | (batch.column("blocks").to_numpy(zero_copy_only=False) > 1)
            take[:-1] |= same[1:]
            if same[0] and held is not None:
                yield held
            held = None if take[-1] else batch.slice(len(key) - 1, 1)
            last = key[-1]
            if take.any():
                yield batch.filter(pa.array(take))

    placed = dealt.select(*columns).repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", "text_id")
    return placed.mapInArrow(run, "shingle long, blocks int, cell int, text_id long, size int, at int")


def possible(size_a, at_a, size_b, at_b, similarity: float) -> np.ndarray:
    """Whether sets can be similar whose first common shingle is at these places."""
    rest = 1 + np.minimum(size_a - at_a - 1, size_b - at_b - 1)
    return rest * (1 + similarity) >= similarity * (size_a + size_b) - 1e-6


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple, bool]]:
    """(held, passing, own): the rows of a block and rows to compare them to. The rows of
    a block come first and are held; `own` rows are part of them, the others follow in
    pieces as they come. Rows are numbers (text_id, size, at, label) and bitmaps."""
    last, held, open_ = None, [], False
    together = lambda parts: tuple(np.concatenate(p) for p in zip(*parts))
    for batch in batches:
        if not batch.num_rows:
            continue
        read = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "bitmap"}
        numbers = np.stack([read[c].astype(np.int64) for c in ("text_id", "size", "at", "label")], axis=1)
        bits = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), np.uint64).reshape(len(numbers), -1)
        key = np.stack([read["shingle"], read["cell"].astype(np.int64), (~read["indexed"]).astype(np.int64)], axis=1)
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(key)]):
            block = (key[s, 0], key[s, 1])
            if block != last:
                if open_:
                    rows = together(held)
                    yield rows, rows, True
                last, held, open_ = block, [], False
            piece = (numbers[s:e], bits[s:e])
            if not key[s, 2]:
                held.append(piece)
                open_ = True
            elif held:
                held = [together(held)]
                if open_:
                    yield held[0], held[0], True
                    open_ = False
                yield held[0], piece, False
    if open_:
        rows = together(held)
        yield rows, rows, True


def candidates(met: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(a, b, a_label, b_label), a < b, of different groups that share a prefix's shingle
    and may be similar: `every` pair, or each text with the `HUBS` smallest of its block of
    the shingle. `met` is `meeting` with the columns label and bitmap."""
    apart = (1 - similarity) / (1 + similarity)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=PAIR
        )

    def compare(held: tuple, passing: tuple, own: bool) -> np.ndarray:
        """(pairs, 4) of text ids and labels."""
        (x, x_bits), (y, y_bits) = held, passing
        ok = (x[None, :, 3] != y[:, None, 3]) & possible(
            x[None, :, 1], x[None, :, 2], y[:, None, 1], y[:, None, 2], similarity
        )
        i, j = np.nonzero(ok)
        if own:
            i, j = i[y[i, 0] > x[j, 0]], j[y[i, 0] > x[j, 0]]
        differ = np.bitwise_count(y_bits[i] ^ x_bits[j]).sum(axis=1, dtype=np.int64)
        near = differ <= apart * (y[i, 1] + x[j, 1]) + 1e-6
        one, two = y[i[near]][:, [0, 3]], x[j[near]][:, [0, 3]]
        swap = one[:, 0] > two[:, 0]
        one[swap], two[swap] = two[swap], one[swap]
        return np.stack([one[:, 0], two[:, 0], one[:, 1], two[:, 1]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for held, passing, own in by_block(batches):
            if not every:
                held = tuple(c[:HUBS] for c in held)
            step = max(1, PAIRS // len(held[0]))
            for at in range(0, len(passing[0]), step):
                pairs = compare(held, tuple(c[at : at + step] for c in passing), own)
                if len(pairs):
                    found.append(pairs)
                    count += len(pairs)
                if count > PAIRS:
                    yield batch_of(found)
                    found, count = [], 0
        if found:
            yield batch_of(found)

    columns = ["text_id", "size", "at", "label", "bitmap"]
    # A text stays in its block and passes by those after it, so each pair meets once.
    last = F.col("blocks") - 1 if every else F.col("cell")
    rows = met.select("shingle", F.explode(F.sequence("cell", last)).alias("to"), "cell", *columns)
    rows = rows.select("shingle", F.col("to").alias("cell"), (F.col("to") == F.col("cell")).alias("indexed"), *columns)
    placed = rows.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", F.desc("indexed"), "text_id")
    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR)).distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a_label, b_label) of the pairs whose sets have the similarity.

    One set travels with each pair; that of `a` comes once for all its pairs, unless some
    text has more than `BLOCK` of them: then pairs are dealt to as many tasks as that text
    needs. `pairs` is read more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = None, None
        for batch in batches:
            right = []
            names = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            for a, salt, b, value in zip(*names, batch.column("set")):
                found = np.frombuffer(value.as_buffer(), np.uint64)
                if b is None:
                    # Batches do not outlive their turn.
                    own, of = found.copy(), (a, salt)
                    right.append(False)
                    continue
                assert of == (a, salt)
                common = len(np.intersect1d(own, found, assume_unique=True))
                right.append(common * (1 + similarity) >= similarity * (len(own) + len(found)) - 1e-6)
            yield batch.select(PAIR[2:]).filter(pa.array(right, pa.bool_()))

    most = pairs.groupBy("a").count().agg(F.max("count").alias("n")).first().n or 0
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(-(-most // BLOCK) or 1)).cast("int"))
    columns = ["a", "salt", "b", *PAIR[2:], "set"]
    partners = salted.join(sets.withColumnRenamed("text_id", "b"), "b").select(*columns)
    heads = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("text_id", "a"), "a")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("b", *PAIR[2:])]
    rows = partners.unionByName(heads.select("a", "salt", "set", *nothing))
    placed = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return map_batches(placed, run, "a_label long, b_label long")


def joined(docs: DataFrame, groups: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """(a, b): groups to be joined. `groups` has (text_id, label) of each distinct text,
    text_id as `text_id` gives it; they join exactly as all pairs of texts with the
    similarity or more ask for."""
    texts = docs.select(text_id().alias("text_id"), text_or_empty().alias("text"))
    heads = keep(prefixes(texts, similarity, words, seed))
    met = keep(meeting(heads.select("text_id", "size", "prefix")))
    bitmaps = heads.select("text_id", "bitmap").join(met.select("text_id").distinct(), "text_id", "left_semi")
    label_of = keep(groups.join(bitmaps, "text_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words, seed).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), pa.array(found, pa.binary())], names=["text_id", "set"]
            )

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Sets of the texts of `pairs`, hashed where the texts are if their ids are few."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct(), "compared-texts")
        found = map_batches(texts.join(wanted, "text_id", "left_semi"), run, "text_id long, set binary")
        return keep(found.groupBy("text_id").agg(F.first("set").alias("set")))

    def edges(every: bool) -> DataFrame:
        # Shuffles of a step go before the next one begins: each may hold as much as the texts.
        pairs = keep(candidates(met.join(label_of, "text_id"), similarity, every))
        release(docs.sparkSession)
        sets = sets_of(pairs)
        release(docs.sparkSession)
        found = similar(pairs, sets, similarity)
        return keep(found.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())

    # What the first links join is one group before any other pair is looked at.
    first = edges(every=False)
    of = components(first).select(F.col("node").alias("label"), F.col("component").alias("new"))
    label_of = keep(
        label_of.join(of, "label", "left")
        .select("text_id", F.coalesce("new", "label").alias("label"), "bitmap")
    )
    release(docs.sparkSession)
    return first.unionByName(edges(every=True))


def text_id():
    """A long that tells texts apart."""
    return F.xxhash64(text_or_empty())
