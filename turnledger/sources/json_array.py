"""Elements of JSON array files, in parallel inside each file.

A reader that parses a whole array file needs one task and the memory for all of it.
Here the file is read as text in pieces that end at `}`. Such pieces can be read from
any block of the file, but what a bracket means depends on the quotes and brackets
before it. So the file is read twice, and its text is neither staged nor shuffled:

1. Each task sums up its blocks for both states a block may begin in, outside and inside
   of a string: quotes, change of depth, and the lowest depths with how often and where
   they occur. Such sums combine in the order of the blocks, one small row for each, so
   they tell the state in which every block begins and how many elements end before it.
2. Each task cuts its blocks, whose state is known now, where the depth is back to 1.

Only the pieces of elements that lie across the border of two blocks are shuffled. Both
reads go over the same splits, also if executors come or go between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnledger.storage import staging_path

BLOCK = ["file", "block"]
# Change of depth by byte.
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
# Bytes of text that are looked at together.
SLICE = 4 << 20
# The lowest depths of a block that are kept: 1, where elements end, may lie two above the
# lowest, as the text behind the last element counts as a piece that ends with `}`.
LEVELS = 3
# Blocks whose states are sent to all tasks (about 100 bytes each); of more, the states
# are joined.
SENT_BLOCKS = 100_000

_LEVELS = "array<struct<level:long,n:long,first:long,last:long>>"
_SUMS = (
    "file string, block long, quotes long, change_0 long, change_1 long, "
    f"levels_0 {_LEVELS}, levels_1 {_LEVELS}, opens boolean"
)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row (rising inside a block), value. The rows come from an RDD, which
    keeps its splits; a scan that is planned again takes other ones if the number of
    cores has changed."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    rows = read._jdf.toJavaRDD()
    return DataFrame(spark._jsparkSession.createDataFrame(rows, read._jdf.schema()), spark)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """(file and block, their rows) of a batch, in slices of bounded size."""
    files, blocks = batch.column("file"), batch.column("block").to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    sizes = np.cumsum(pa.compute.binary_length(batch.column("value")).to_numpy(), dtype=np.int64)
    change = (np.diff(codes) != 0) | (np.diff(blocks) != 0) | (np.diff(sizes // SLICE) != 0)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (files[a].as_py(), int(blocks[a])), batch.slice(a, b - a)


def _text(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some pieces, each with its `}` again, and the places of these."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset: values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    ends = offsets[1:] - offsets[0]
    return np.insert(data, ends, ord("}")), ends + np.arange(len(ends))


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes before which there is an even number of backslashes."""
    at = np.flatnonzero(data == ord('"'))
    after = at[(at > 0) & (data[at - 1] == ord("\\"))]
    if not len(after):
        return at
    others = np.flatnonzero(data != ord("\\"))
    before = np.searchsorted(others, after) - 1
    run = after - 1 - np.where(before >= 0, others[before], -1)
    return np.setdiff1d(at, after[run % 2 == 1], assume_unique=True)


def _depths(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At the end of each piece: quotes until there, and depth if the text begins outside
    and if it begins inside of a string."""
    quotes = _quotes(data)
    step = STEP[data]
    signs = np.flatnonzero(step)
    step = step[signs].astype(np.int64)
    odd = np.searchsorted(quotes, signs) % 2 == 1
    place = np.searchsorted(signs, ends)
    return (
        np.searchsorted(quotes, ends),
        np.cumsum(np.where(odd, 0, step))[place],
        np.cumsum(np.where(odd, step, 0))[place],
    )


class _Sums:
    """What is summed up over a block, for both states it may begin in."""

    def __init__(self, first: str) -> None:
        self.quotes, self.change, self.levels = 0, [0, 0], [{}, {}]
        self.opens = first.lstrip("﻿ \t\r\n\f\v").startswith("[")

    def add(self, values: pa.Array, rows: np.ndarray) -> None:
        quotes, *depths = _depths(*_text(values))
        odd = self.quotes % 2
        for state in (0, 1):
            # In the text added, the string is open if it was until here.
            depth = self.change[state] + depths[state ^ odd]
            outside = (quotes + (state ^ odd)) % 2 == 0
            self.change[state] = int(depth[-1])
            self._lowest(self.levels[state], depth[outside], rows[outside])
        self.quotes += int(quotes[-1])

    @staticmethod
    def _lowest(found: dict[int, list[int]], depth: np.ndarray, rows: np.ndarray) -> None:
        if not len(depth):
            return
        lowest = min([int(depth.min()), *found])
        for level in range(lowest, lowest + LEVELS):
            at = rows[depth == level]
            if len(at):
                n, first, _ = found.get(level, (0, int(at[0]), 0))
                found[level] = [n + len(at), first, int(at[-1])]
        for level in [x for x in found if x >= lowest + LEVELS]:
            del found[level]

    def row(self, key: tuple[str, int]) -> dict:
        levels = [
            [dict(zip(("level", "n", "first", "last"), (k, *v))) for k, v in sorted(x.items())]
            for x in self.levels
        ]
        return {
            "file": key[0], "block": key[1], "quotes": self.quotes, "opens": self.opens,
            **{f"change_{s}": self.change[s] for s in (0, 1)},
            **{f"levels_{s}": levels[s] for s in (0, 1)},
        }


def _sum_up(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            for here, part in _runs(batch):
                if here != key:
                    if sums is not None:
                        yield pa.RecordBatch.from_pylist([sums.row(key)], schema)
                    key, sums = here, _Sums(part.column("value")[0].as_py())
                sums.add(part.column("value"), part.column("row").to_numpy())
        if sums is not None:
            yield pa.RecordBatch.from_pylist([sums.row(key)], schema)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, element, value of the elements that begin and end in one block."""
    key, begun = None, []
    for batch in batches:
        for here, part in _runs(batch):
            if here != key:
                key, begun = here, []
                first = {c: part.column(c)[0].as_py() for c in ("in_string", "depth", "element", "whole")}
                inside, depth, element, whole = first.values()
            data, ends = _text(part.column("value"))
            quotes, outer, inner = _depths(data, ends)
            level = depth + (inner if inside else outer)
            cuts = ends[(level == 1) & ((quotes + inside) % 2 == 0)] + 1
            inside, depth = bool((inside + quotes[-1]) % 2), int(level[-1])
            if not len(cuts):
                begun.append(data.tobytes())
                continue
            before = b"".join(begun)
            begun = [data[cuts[-1]:].tobytes()]
            offsets = np.concatenate([[0], cuts + len(before)]).astype(np.int64)
            text = pa.py_buffer(before + data[: cuts[-1]].tobytes())
            values = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), text])
            numbers = pa.array(np.arange(element, element + len(cuts)))
            element += len(cuts)
            # An element that began in a block before is put together elsewhere.
            skipped = 0 if whole else 1
            whole = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * (len(cuts) - skipped), pa.string()), numbers[skipped:],
                 values[skipped:].cast(pa.string())],
                names=["file", "element", "value"],
            )


def _before(column: str) -> Column:
    """Sum over the blocks before this one in the file."""
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(blocks), F.lit(0))


def _block_starts(sums: DataFrame) -> DataFrame:
    """file, block, in_string, depth, element: the state in which each block begins and the
    number of elements that end before; whole: no element is open there; first, last: rows
    of the first and last end of an element in it; opens: it begins with an array; change
    of depth; beyond: pieces that end outside of the array."""
    state = lambda name: F.when(F.col("in_string"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    beyond = F.filter("levels", lambda x: x["level"] + F.col("depth") < 1)
    return (
        sums.withColumn("in_string", _before("quotes") % 2 == 1)
        .withColumns({"change": state("change"), "levels": state("levels")})
        .withColumn("depth", _before("change"))
        .withColumn("ends", F.get(F.filter("levels", lambda x: x["level"] + F.col("depth") == 1), 0))
        .withColumn("n", F.coalesce("ends.n", F.lit(0)))
        .select(
            *BLOCK, "in_string", "depth", "change", "opens",
            _before("n").alias("element"),
            "n",
            (first | ((F.col("depth") == 1) & ~F.col("in_string"))).alias("whole"),
            F.coalesce("ends.first", F.lit(-1)).alias("first"),
            F.coalesce("ends.last", F.lit(-1)).alias("last"),
            F.aggregate(beyond, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("beyond"),
        )
    )


def _require_complete(starts: DataFrame) -> None:
    """The text after the last `}` of a file counts as a piece that ends with one more:
    a complete array leaves depth -1, and no other piece ends outside of it. JSON lines
    leave it as well, but do not begin with `[`."""
    ends = starts.groupBy("file").agg(
        F.sum("change").alias("depth"), F.sum("beyond").alias("beyond"),
        F.min_by("opens", "block").alias("opens"),
    )
    broken = ends.filter("depth <> -1 OR beyond <> 1 OR NOT opens").limit(5).collect()
    if broken:
        raise ValueError(f"not complete JSON arrays: {[r.file for r in broken]}")


def _across(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Elements that lie across the borders of blocks, put together of their pieces."""
    head = ~F.col("whole") & (F.col("row") <= F.col("first"))
    parts = (
        pieces.join(starts, BLOCK)
        .filter(head | (F.col("row") > F.col("last")))
        .withColumn("element", F.col("element") + F.when(head, 0).otherwise(F.col("n")))
    )
    return (
        parts.groupBy("file", "element")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("parts"),
            F.bool_or(F.col("row") == F.col("first")).alias("complete"),
        )
        .filter("complete")
        .select("file", "element", F.concat(F.array_join(F.col("parts")["value"], "}"), F.lit("}")).alias("value"))
    )


def array_elements(spark: SparkSession, path: str, sent_blocks: int = SENT_BLOCKS) -> DataFrame:
    """file, element (0, 1, ...), value: the objects of JSON array files, each as JSON
    text on one line, unknown fields and explicit nulls included.

    The sums of the blocks, a row each, are staged in the shared folder. Raises ValueError
    if a file is cut off or not an array; a job that meets an element that is not valid
    JSON fails with the element's number. The states of up to `sent_blocks` blocks are
    sent to all tasks; beyond that pieces are joined to them, which shuffles the text.
    """
    pieces = _pieces(spark, path)
    staged = staging_path(spark, "json-array")
    fields = spark.createDataFrame([], _SUMS).toArrow().schema
    pieces.mapInArrow(_sum_up(fields), _SUMS).write.parquet(f"{staged}/sums")
    _block_starts(spark.read.parquet(f"{staged}/sums")).write.parquet(f"{staged}/starts")
    starts = spark.read.parquet(f"{staged}/starts")
    _require_complete(starts)
    blocks, divided = starts.agg(F.count("*"), F.count_if(~F.col("whole"))).first()
    starts = starts.drop("change", "opens", "beyond")
    if blocks <= sent_blocks:
        starts = F.broadcast(starts)
        placed = pieces.join(starts, BLOCK)
    else:
        placed = pieces.join(starts, BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "row")
    elements = placed.select(*BLOCK, "in_string", "depth", "element", "whole", "value").mapInArrow(
        _cut, "file string, element long, value string"
    )
    if divided:
        elements = elements.unionByName(_across(pieces, starts))
    one_line = F.regexp_replace(F.regexp_replace("value", r"^[\s,\[]+", ""), r"[\r\n]\s*", "")
    # Brackets and quotes that match do not make an object yet.
    broken = F.concat(F.lit("not valid JSON: element "), "element", F.lit(" of "), "file")
    return elements.withColumn("value", one_line).select(
        "file", "element",
        F.when(F.get_json_object("value", "$").isNull(), F.raise_error(broken))
        .otherwise(F.col("value")).alias("value"),
    )
