"""Near duplicates by SimHash and generalised pigeonhole search.

Two fingerprints within `distance` bits are found like this. The bits are grouped into
parts so that correlated bits share a part. A fingerprint that probes part i within
radius r_i finds every partner, as long as the radii plus one add up to `distance` + 1
(a radius of -1 leaves a part out). Which radii are cheapest depends on the
fingerprint: the exact number of fingerprints around each value of each part is known
from one count per value, and dynamic programming picks the radii that meet the fewest.
A crowded value is thus avoided by looking a bit further elsewhere.

Only distinct fingerprints take part. Links inside a bucket are reduced to a spanning
forest where they are found, so a large group of near copies never becomes all its
pairs; every link still holds its two ends together. Crowded buckets are cut into blocks
of indexed fingerprints.

Three of 64 bits is a tight bound: of texts that share 80 to 85 % of their five-word
shingles it links one in twelve. With a `similarity`, `keep_first` also links all texts
whose sets of five-word shingles have it, exactly (see `shingle_join`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnledger.llm.common import keep, map_batches, release, text_or_empty
from turnledger.llm.components import components
from turnledger.llm.shingle_join import joined, text_id

BITS = 64
# Links at this many differing bits or fewer.
DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
# The second search: sets of shingles of so many words.
SIMILAR_WORDS = 5
# Parts of the 64 bits. The tables below have 2^(64 / parts) entries a part: 2 MB in all
# at four parts, whatever the input.
PARTS = 4
# Indexed fingerprints of one bucket that one task compares at most.
BLOCK = 4096
# Comparisons held in memory at a time.
PAIRS = 1 << 20


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash over word shingles as an unsigned 64-bit number; 0 without any word."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), seed)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = [0, *ends[: -words].tolist()]
        stops = (ends[words - 1 :] - 1).tolist()
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, stops)]
    return int(majority(np.array(hashes, "<u8")[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows of (rows, longs) have set, as longs."""
    ones = np.zeros(BITS * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED,
                 with_text: bool = False) -> DataFrame:
    """(doc_id, fp): a row for each row of documents; fp is the fingerprint as a long.
    Null and empty texts have fingerprint 0. `with_text` adds text_id."""
    own = ["doc_id", *(["text_id"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, own), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=[*own, "fp"],
            )

    source = docs.select(
        F.col("doc_id").cast("long"), text_id().alias("text_id"), text_or_empty().alias("text")
    ).select(*own, "text")
    return map_batches(source, run, ", ".join(f"{c} long" for c in [*own, "fp"]))


def group_bits(together: np.ndarray, rows: int, parts: int = PARTS) -> list[list[int]]:
    """Bits in `parts` groups of near equal size, correlated bits in the same group.

    `together[i, j]` counts the fingerprints that have both bits. A group starts with the
    free bit that is correlated most in total and takes, one by one, the free bit most
    correlated with the group.
    """
    share = together / max(rows, 1)
    alone = np.diag(share)
    spread = np.sqrt(np.maximum(alone * (1 - alone), 1e-12))
    strength = np.abs((share - np.outer(alone, alone)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(free, key=lambda b: (strength[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            nearest = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def project(fps: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """The value of some bits of each fingerprint, packed."""
    out = np.zeros(len(fps), np.int64)
    for at, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def around(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """(radius + 1, values): how many fingerprints lie within r bits of each value.

    Distances are exact: one bit after the other, the counts at distance r are those
    that agree on the bit at distance r plus those that differ on it at distance r - 1.
    """
    values = np.arange(len(counts))
    at = np.zeros((radius + 1, len(counts)), np.int64)
    at[0] = counts
    for bit in range(width):
        flipped = at[:, values ^ (1 << bit)]
        at[1:] += flipped[:-1]
    return np.cumsum(at, axis=0)


def allocate(costs: list[np.ndarray], budget: int) -> np.ndarray:
    """Radii (rows, parts) with the smallest total cost; radii + 1 add up to `budget`.

    `costs[i][r]` is the cost of each row for radius r in part i; radius -1 is free.
    """
    rows = costs[0].shape[1]
    best = np.full((budget + 1, rows), np.inf)
    best[0] = 0
    chosen = []
    for cost in costs:
        new, take = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for used in range(budget + 1):
            for r in range(-1, used):
                total = best[used - r - 1] + (cost[r] if r >= 0 else 0)
                better = total < new[used]
                new[used][better] = total[better]
                take[used][better] = r
        best = new
        chosen.append(take)
    radii, left, every = np.empty((rows, len(costs)), np.int8), np.full(rows, budget), np.arange(rows)
    for i in range(len(costs) - 1, -1, -1):
        radii[:, i] = chosen[i][left, every]
        left = left - radii[:, i] - 1
    return radii


def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with at most `radius` bits set."""
    found = [0]
    level = [0]
    for _ in range(radius):
        level = sorted({m | 1 << b for m in level for b in range(width) if not m >> b & 1})
        found += level
    return np.array(found, np.int64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between longs, those of a star for each connected component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]


def _co_occurrence(fps: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """How often two bits are set together, and the number of fingerprints: 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(key).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            total += bits.T @ bits
            rows += len(fp)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(BITS), BITS)),
                    pa.array(np.tile(np.arange(BITS), BITS)),
                    pa.array(total.ravel().astype(np.int64)),
                    pa.array(np.full(BITS * BITS, rows, np.int64)),
                ],
                names=["i", "j", "n", "rows"],
            )

    sums = (
        fps.select(key)
        .mapInArrow(run, "i long, j long, n long, rows long")
        .groupBy("i", "j")
        .agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        .collect()  # 4,096 rows
    )
    together, rows = np.zeros((BITS, BITS)), 0
    for r in sums:
        together[r.i, r.j] = r.n
        rows = r.rows
    return together, rows


def _part_counts(fps: DataFrame, groups: list[list[int]], key: str) -> list[np.ndarray]:
    """Fingerprints by part and value. Bounded by parts * 2^width, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(g), np.int64) for g in groups]
        for batch in batches:
            fp = batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64)
            for total, bits in zip(totals, groups):
                total += np.bincount(project(fp, bits), minlength=len(total))
        for i, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), i, np.int32)),
                    pa.array(some.astype(np.int64)),
                    pa.array(total[some]),
                ],
                names=["part", "value", "n"],
            )

    found = (
        fps.select(key)
        .mapInArrow(run, "part int, value long, n long")
        .groupBy("part", "value")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = [np.zeros(1 << len(g), np.int64) for g in groups]
    part, value, n = (found.column(c).to_numpy() for c in ("part", "value", "n"))
    for i, count in enumerate(counts):
        count[value[part == i]] = n[part == i]
    return counts


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, block: int = BLOCK,
          key: str = "fp") -> DataFrame:
    """(a, b): pairs of `fp` that connect exactly what links within `distance` bits of
    the column `key` connect. `fps` has distinct rows of these longs. Each task returns,
    of the links that it found, a star for each group that they connect.
    """
    spark = fps.sparkSession
    groups = group_bits(*_co_occurrence(fps, key), parts)
    shared = spark.sparkContext.broadcast((groups, _part_counts(fps, groups, key)))
    # What travels with a row: the fingerprint looked up comes first.
    columns = [key, *([] if key == "fp" else ["fp"])]
    node = columns.index("fp")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, counts = shared.value
        near = [around(c, len(g), distance) for c, g in zip(counts, groups)]
        shifts = [masks(len(g), distance) for g in groups]
        sizes = [[int((popcount(m) <= r).sum()) for r in range(distance + 1)] for m in shifts]

        def rows(bucket, cell, data, indexed):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket),
                    pa.array(cell.astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in data.T],
                    pa.array(np.full(len(data), indexed)),
                ],
                names=["bucket", "cell", *columns, "indexed"],
            )

        for batch in batches:
            data = as_longs(batch, columns)
            fp = data[:, 0]
            values = [project(fp, g) for g in groups]
            # The probes of a radius cost as well, not only what they meet.
            costs = [
                n[:, v] + np.array(size)[:, None] for n, v, size in zip(near, values, sizes)
            ]
            radii = allocate(costs, distance + 1)
            cell_of = (fp ^ (fp >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for i, (value, count, shift) in enumerate(zip(values, counts, shifts)):
                cells = -(-count // block)
                # Alone in its bucket, a fingerprint may still be met from nearby values.
                yield rows(
                    value << 3 | i, cell_of.astype(np.int64) % cells[value], data, True
                )
                for r in range(distance + 1):
                    asks = np.flatnonzero(radii[:, i] == r)
                    if not len(asks):
                        continue
                    for m in shift[popcount(shift) <= r]:
                        target = value[asks] ^ m
                        # Nobody there, or only the fingerprint itself.
                        some = count[target] > (1 if m == 0 else 0)
                        target, source = target[some], asks[some]
                        if not len(target):
                            continue
                        copies = cells[target]
                        spot = np.repeat(np.arange(len(target)), copies)
                        first = np.cumsum(copies) - copies
                        yield rows(
                            target[spot] << 3 | i, np.arange(len(spot)) - first[spot],
                            data[source[spot]], False,
                        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def reduce() -> None:
            nonlocal held
            if found:
                found[:] = [forest(*(np.concatenate(x) for x in zip(*found)))]
                held = len(found[0][0])

        for index, ask in buckets(batches, columns):
            step = max(1, PAIRS // max(1, len(index)))
            for at in range(0, len(ask), step):
                some = ask[at : at + step]
                i, j = np.nonzero(popcount(some[:, None, 0] ^ index[None, :, 0]) <= distance)
                differ = some[i, node] != index[j, node]
                i, j = i[differ], j[differ]
                found.append((some[i, node].view(np.int64), index[j, node].view(np.int64)))
                held += len(i)
                if held > PAIRS:
                    reduce()
                    if held > PAIRS // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, found[0])), names=["a", "b"])
                        found.clear()
                        held = 0
        reduce()
        if found and held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found[0])), names=["a", "b"])

    longs = ", ".join(f"{c} long" for c in columns)
    placed = fps.select(*columns).mapInArrow(
        probes, f"bucket long, cell int, {longs}, indexed boolean"
    )
    dealt = placed.repartition("bucket", "cell").sortWithinPartitions(
        "bucket", "cell", F.desc("indexed")
    )
    return dealt.mapInArrow(verify, "a long, b long")


def as_longs(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """(rows, columns) of unsigned longs."""
    read = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(read, axis=1).view(np.uint64)


def buckets(batches: Iterator[pa.RecordBatch],
            columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexed, asking) rows of each bucket that has both; they come sorted by bucket.
    Askers of a bucket are passed on in pieces, so only one block is held."""
    none = np.empty((0, len(columns)), np.uint64)
    last, index, held = None, none, []
    for batch in batches:
        key, cell, indexed = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "indexed")
        )
        data = as_longs(batch, columns)
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        for s, e in zip([0, *new], [*new, len(key)]):
            if s == e:
                continue
            bucket = (key[s], cell[s])
            if bucket != last:
                last, held, index = bucket, [], none
            own, asks = data[s:e][indexed[s:e]], data[s:e][~indexed[s:e]]
            if len(own):
                held.append(own)
            if len(asks):
                if held:
                    index = np.concatenate([index, *held])
                    held = []
                if len(index):
                    yield index, asks


def grouped(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE_WORDS,
            seed: int = SEED, parts: int = PARTS, similarity: float | None = None,
            similar_words: int = SIMILAR_WORDS) -> DataFrame:
    """(doc_id, fp, component, component_id) for every row of `docs`: fingerprint, the
    group as one of its fingerprints, and the group's smallest doc_id. With `similarity`
    texts whose sets of `similar_words` words have it are linked as well."""
    marked = keep(fingerprints(docs, words, seed, with_text=similarity is not None))
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(distinct, distance, parts)
    label = components(found)
    if similarity is not None:
        # Plans end here and there, so that none holds the tables of all the steps.
        named = keep(
            distinct.select("fp").join(label.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("label"))
        )
        release(docs.sparkSession)
        groups = keep(marked.select("text_id", "fp").distinct().join(named, "fp").select("text_id", "label"))
        wider = components(joined(docs, groups, similarity, similar_words, seed)).select(
            F.col("node").alias("label"), F.col("component").alias("wider")
        )
        label = keep(
            named.join(wider, "label", "left")
            .select(F.col("fp").alias("node"), F.coalesce("wider", "label").alias("component"))
        )
        release(docs.sparkSession)
        marked = marked.select("doc_id", "fp")
    named = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id that chains of links reach, the row's own
    included. Null and empty texts have fingerprint zero and link like any other; rows
    without doc_id take part, and get null only if nothing they reach has a doc_id.
    Repeated rows stay repeated; an empty table gives no row. Other columns are not read.
    """
    return grouped(docs, **options).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, all columns: the row with the smallest
    doc_id. Groups hold together by the links of `near_duplicates`; with `similarity`,
    also by pairs of texts whose sets of five-word shingles have it. Rows that share a
    doc_id are one document, of which the row with the smallest columns stays. A group in which no row has a doc_id keeps one row as well."""
    found = keep(grouped(docs, **options))
    by_id = found.filter("component_id IS NOT NULL").select(F.col("component_id").alias("__llm_id"))
    kept = docs.join(by_id.distinct(), docs["doc_id"] == F.col("__llm_id"), "left_semi")

    # Without any id, a group is told by its fingerprints; the smallest one stays.
    nameless = docs.filter("doc_id IS NULL")

    words, seed = options.get("words", SHINGLE_WORDS), options.get("seed", SEED)

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="uint64").astype("int64")

    by_fp = found.filter("component_id IS NULL").groupBy("component").agg(
        F.min("fp").alias("__llm_fp")
    )
    marked = nameless.withColumn("__llm_of", fp_of(text_or_empty()))
    rest = marked.join(by_fp, F.col("__llm_of") == F.col("__llm_fp"), "left_semi")

    columns = sorted(c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant")
    order = [F.col(f"`{c}`").asc_nulls_first() for c in columns]

    def one(df: DataFrame, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return df.withColumn("__llm_place", place).filter("__llm_place = 1").select(*names)

    names = [F.col(f"`{c}`") for c in docs.columns]
    return one(kept, "doc_id").unionByName(one(rest, "__llm_of"))
