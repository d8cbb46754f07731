"""Shards of near equal bytes from a K-d tree over the metadata of documents.

A node of the tree stands for a range of shards. It is cut along its widest dimension,
at the weighted quantile that gives each side the bytes of its shards (40 shards: half
and half, down to 5 as 2 and 3), until every leaf is one shard of the target bytes. The
width of a dimension is its extent in the node over its extent in the whole table; of
equally wide ones the first counts.

All nodes of a level are cut together, and no row moves for it. Where a row lies is a
condition on its metadata, evaluated next to the scan; the quantiles come from histograms
of at most `CELLS` cells a node, summed in the tasks first. The cell that the quantile
falls into is cut into cells again until it is a single row; the cut is before or after
that row, whichever is nearer. So a cut is off by half a document at most.

Rows of equal metadata are told apart by a hash of the text, one of all that counts about
the row, and its number in the staged table. A source, a text or a document that holds a
third of all rows is thus cut like any other range, and equal texts of one value stay side
by side. Rows that are equal throughout may change places; the result does not show it.

The slots of a shard are numbered over sorted partitions of all shards together: one task
never holds a shard.

Null texts count as empty, null ids and null metadata are values like others. Repeated
rows are documents of their own. An empty table gives no row; in a tiny one some shards
stay empty, and a document above the target fills a shard alone or takes its neighbours'
bytes. Columns other than doc_id, text and the dimensions are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from turnledger.llm.common import text_or_empty
from turnledger.storage import staging_path

SHARDS = 40
# What a row counts besides its text.
ROW_BYTES = 16
DIMENSIONS = ("source", "lang", "doc_id")
# Cells of a histogram; those of all nodes of a level reach the driver.
CELLS = 1 << 10
# Positions are at most this far from zero, so that differences fit a long.
FARTHEST = 1 << 61
TIES = ["__llm_text", "__llm_all", "__llm_row"]


def _positions(docs: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """Each dimension as a long: numbers as they are, anything else by a hash."""
    out = []
    for name in dimensions:
        column = F.col(f"`{name}`")
        if isinstance(docs.schema[name].dataType, NumericType):
            # Whole numbers are cut to the range as longs, of which a double has too few digits.
            whole = docs.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
            number = column.cast("long") if whole else F.floor(column.cast("double"))
            number = F.coalesce(number, F.lit(0))
            out.append(F.least(F.greatest(number, F.lit(-FARTHEST)), F.lit(FARTHEST)))
        else:
            out.append(F.shiftright(F.xxhash64(column.cast("string")), 2))
    return out


def keyed(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """All columns, and under names of their own: size, crc32 of the text, a position per
    dimension, and the ties. The row number is only fixed once the result is written."""
    text = text_or_empty().cast("binary")
    positions = {f"__llm_d{i}": p for i, p in enumerate(_positions(docs, dimensions))}
    every = F.xxhash64(F.col("doc_id").cast("string"), text, *[F.col(f"`{d}`").cast("string") for d in dimensions])
    return docs.withColumns(
        {
            "__llm_size": (F.octet_length(text) + ROW_BYTES).cast("long"),
            "__llm_crc": F.crc32(text),
            **positions,
            TIES[0]: F.shiftright(F.xxhash64(text), 2),
            TIES[1]: F.shiftright(every, 2),
            TIES[2]: F.monotonically_increasing_id(),
        }
    )


@dataclass
class Cut:
    """Rows up to `key` along an axis go left; the row at `key` too, if `closed`."""

    axis: list[str]
    key: tuple[int, ...]
    closed: bool

    def left(self) -> Column:
        own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(self.axis)])
        at = F.struct(*[F.lit(k).cast("long").alias(f"k{i}") for i, k in enumerate(self.key)])
        return own <= at if self.closed else own < at


@dataclass
class Node:
    """The shards `first` to `first` + `count` - 1."""

    first: int
    count: int
    cut: Cut | None = None
    sides: list[Node] = field(default_factory=list)

    def shard(self) -> Column:
        """The first shard of the leaf that a row lies in."""
        if self.cut is None:
            return F.lit(self.first)
        return F.when(self.cut.left(), self.sides[0].shard()).otherwise(self.sides[1].shard())


@dataclass
class Search:
    """Where in a node the quantile is known to lie: rows whose axis begins with the
    values `known` and whose next column is from `low` to `high`."""

    node: Node
    total: int
    axis: list[str]
    low: int
    high: int
    known: list[int] = field(default_factory=list)
    # Bytes of the node's rows below this place.
    before: int = 0

    @property
    def goal(self) -> int:
        """Bytes of the left side, times the shards of the node."""
        return self.total * (self.node.count // 2)

    def inside(self) -> Column:
        out = F.col("node") == self.node.first
        for name, value in zip(self.axis, self.known):
            out &= F.col(name) == value
        return out & F.col(self.axis[len(self.known)]).between(self.low, self.high)

    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - (CELLS.bit_length() - 1))

    def value(self, after: int = 0) -> Column:
        return F.col(self.axis[min(len(self.known) + after, len(self.axis) - 1)])

    def cell(self) -> Column:
        return F.shiftright(self.value() - F.lit(self.low), self.shift())

    def narrow(self, cells: list) -> bool:
        """Go on to the cell that reaches the goal; true once the node is cut."""
        count = self.node.count
        for c in sorted(cells, key=lambda c: c.cell):
            if (self.before + c.bytes) * count >= self.goal:
                break
            self.before += c.bytes
        if c.rows == 1:
            short = self.goal - self.before * count
            key = tuple(c[f"key{i}"] for i in range(len(self.axis)))
            self.node.cut = Cut(self.axis, key, closed=short >= c.bytes * count - short)
            return True
        if c.least == c.most:
            self.known.append(c.least)
            self.low, self.high = c.next_least, c.next_most
        else:
            self.low, self.high = c.least, c.most
        return False


def _by_node(searches: list[Search], of) -> Column:
    return F.coalesce(*[F.when(s.inside(), of(s)) for s in searches])


def _cut_all(rows: DataFrame, searches: list[Search]) -> None:
    """Cut the nodes of a level: a histogram of each per pass, at most `CELLS` times as
    many rows told apart by each."""
    while searches:
        # Of a single row the smallest values are its key.
        keys = [f"key{i}" for i in range(len(searches[0].axis))]
        measured = rows.select(
            "node",
            F.col("__llm_size").alias("size"),
            _by_node(searches, Search.cell).alias("cell"),
            _by_node(searches, Search.value).alias("value"),
            _by_node(searches, lambda s: s.value(after=1)).alias("next"),
            *[_by_node(searches, lambda s, i=i: F.col(s.axis[i])).alias(k) for i, k in enumerate(keys)],
        ).filter("cell IS NOT NULL")
        found = measured.groupBy("node", "cell").agg(
            F.sum("size").alias("bytes"),
            F.count("*").alias("rows"),
            F.min("value").alias("least"), F.max("value").alias("most"),
            F.min("next").alias("next_least"), F.max("next").alias("next_most"),
            *[F.min(k).alias(k) for k in keys],
        ).collect()  # CELLS rows for each of at most half as many nodes as shards
        cells: dict[int, list] = {}
        for r in found:
            cells.setdefault(r.node, []).append(r)
        searches = [s for s in searches if not s.narrow(cells[s.node.first])]


def tree(rows: DataFrame, shards: int, dimensions: int) -> Node:
    """The tree over a written table with the columns of `keyed`. Two passes a level and
    one more per 1,024 rows to tell apart; all read narrow columns only."""
    root = Node(0, shards)
    axes = [f"__llm_d{i}" for i in range(dimensions)]
    level, whole = [root], None
    while any(n.count > 1 for n in level):
        numbered = rows.withColumn("node", root.shard())
        ends = [f(F.col(a)).alias(f"{a}_{n}") for a in axes for n, f in (("least", F.min), ("most", F.max))]
        extents = {
            r.node: r
            for r in numbered.groupBy("node").agg(F.sum("__llm_size").alias("bytes"), *ends).collect()
        }
        whole = extents.get(0) if whole is None else whole
        searches = []
        for node in level:
            r = extents.get(node.first)
            if node.count == 1 or r is None:
                continue

            def width(axis: str) -> float:
                of = lambda x: x[f"{axis}_most"] - x[f"{axis}_least"]
                return of(r) / of(whole) if of(whole) else 0.0

            axis = max(axes, key=width)
            low, high = r[f"{axis}_least"], r[f"{axis}_most"]
            searches.append(Search(node, r.bytes, [axis, *TIES], low, high))
        _cut_all(numbered, searches)
        below = []
        for s in searches:
            left = s.node.count // 2
            s.node.sides = [Node(s.node.first, left), Node(s.node.first + left, s.node.count - left)]
            below += s.node.sides
        level = below
    return root


def _narrow(dimensions: Sequence[str]) -> list[str]:
    return ["__llm_size", "__llm_crc", *[f"__llm_d{i}" for i in range(len(dimensions))], *TIES]


def _count(rows: DataFrame, shards: int, target_bytes: int | None) -> int:
    if target_bytes is None:
        return shards
    total = rows.agg(F.sum("__llm_size").alias("n")).first().n or 0
    return max(1, -(-total // target_bytes))


def assign(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None,
           dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    size is the bytes of the text and 16; law is `bytes`; slot counts the rows of a shard
    from 0, in the order of a hash. grown_shard is null: the tree of one more shard is
    another one. With `target_bytes` the number of shards follows the bytes.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "shard-keys")
    keyed(docs, dimensions).select("doc_id", *_narrow(dimensions)).write.parquet(path)
    rows = spark.read.parquet(path)
    root = tree(rows, _count(rows, shards, target_bytes), len(dimensions))

    # In order over all shards; the written number tells file and place in it.
    ordered = rows.select("doc_id", "__llm_size", "__llm_crc", root.shard().alias("shard"), *TIES[1:])
    order = ["shard", *TIES[1:]]
    path = staging_path(spark, "shard-order")
    (
        ordered.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "__llm_size", "__llm_crc", "shard", F.monotonically_increasing_id().alias("place"))
        .write.parquet(path)
    )
    # A task numbers its rows from its own number times 2^33.
    placed = spark.read.parquet(path).withColumn("task", F.shiftright("place", 33))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    path = staging_path(spark, "shard-offsets")
    (
        placed.groupBy("task", "shard").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
        .withColumn("earlier", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select("task", "shard", (F.col("earlier") - F.col("first")).alias("shift"))
        .write.parquet(path)
    )
    # One row per task and shard: its written size tells the planner how to join it.
    return placed.join(spark.read.parquet(path), ["task", "shard"]).select(
        "doc_id",
        F.col("__llm_size").alias("size"),
        F.col("__llm_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, target_bytes: int | None = None,
                 dimensions: Sequence[str] = DIMENSIONS, max_rows_per_file: int = 1_000_000) -> str:
    """Write the documents, all columns, to a folder per shard of `path`; the files of a
    shard hold them in the order of `assign`'s slots. Texts are staged and shuffled once.
    Returns the folder column: `shard`, with underscores if a column has that name."""
    spark = docs.sparkSession
    staged = staging_path(spark, "shard-documents")
    keyed(docs, dimensions).write.parquet(staged)
    rows = spark.read.parquet(staged)
    root = tree(rows, _count(rows, shards, target_bytes), len(dimensions))
    name = "shard"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    order = [F.col(name), *[F.col(c) for c in TIES[1:]]]
    (
        rows.withColumn(name, root.shard())
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .drop(*_narrow(dimensions))
        .write.partitionBy(name).option("maxRecordsPerFile", max_rows_per_file).parquet(path)
    )
    return name
