"""Mixing sources to target weights along a curriculum.

Targets: sources share all words by weight, none beyond `repeats` times its own size;
what is cut there goes to the others by weight until none is above. Inside a source,
documents come in the order of a hash; each is taken as often as the target holds the
source's size, and those at the beginning of the order once more, up to the target.

Positions: the share of a source in the stream changes over the training from a weight
at the beginning to one at the end, in straight pieces. Its integral is the cumulative
demand for words of the source; the position of a document is where the demand reaches
the words of the source that come before its middle, found by inverting the integral.

Everything is done with DataFrame expressions. Running sums go by source and slice of
the hash, then by document inside a slice, so that one source with a third of all rows
is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger.llm.common import WORDS, text_or_empty

REPEATS = 3
# Slices of a source: hexadecimal digits of the hash, 16 slices each.
SLICE_DIGITS = 3
# Weight of a source over the training, as factors of its mean: at equal steps from the
# beginning to the end. Sources alternate between the schedules in their order.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))


def _key(column: str) -> Column:
    """A text that orders like the value and has nulls last, unlike any value."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(
        F.concat(F.lit("0"), F.col(column).cast("string"))
    )


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source_key, source_size, rank, target) from (source_key, source_size): one row
    each, so a window over all of them holds no more rows than there are sources.

    With sources in the order of size per weight, the first k are cut at `repeats`
    times their size and the others share the rest by weight; k is the smallest number
    for which no other source is above.
    """
    every = Window.orderBy("source_key")
    weighed = sizes.withColumn("rank", F.row_number().over(every) - 1).withColumn(
        "weight", F.col("rank") % 3 + 1
    )
    most = F.col("source_size") * repeats
    order = Window.orderBy(most / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = (
        weighed.withColumn("most", most)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("cut", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("cut")) / (F.col("weights") - F.col("gone")))
        .withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("gone", "level"))).over(whole)["level"]
    return cut.withColumn("level", level).select(
        "source_key",
        "source_size",
        "rank",
        F.least(F.coalesce(F.col("level") * F.col("weight"), "most"), "most").cast("double").alias("target"),
    )


def position(share: Column, rank: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Where in the training, from 0 to 1, a source has been asked for `share` of all
    that it gives. The weight is linear between its points, so its integral is solved by
    the root of a quadratic in the piece that the share falls into."""

    def inverse(points: Sequence[float]) -> Column:
        step = 1 / (len(points) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(points, points[1:])]
        whole, done, found = sum(areas), 0.0, None
        for k, (a, b, area) in enumerate(zip(points, points[1:], areas)):
            rest = share * whole - done
            slope = (b - a) / step
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
            # The stable form of the root, which also holds for a slope of zero.
            at = k * step + 2 * rest / F.greatest(F.lit(a) + root, F.lit(1e-12))
            found = F.when(share * whole <= done + area, at) if found is None else found.when(
                share * whole <= done + area, at
            )
            done += area
        return F.least(F.greatest(found.otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(1.0))

    turn = rank % len(schedules)
    chosen = F.when(turn == 0, inverse(schedules[0]))
    for k, points in enumerate(schedules[1:], 1):
        chosen = chosen.when(turn == k, inverse(points))
    return chosen


def mix(docs: DataFrame, repeats: int = REPEATS,
        schedules: Sequence[Sequence[float]] = SCHEDULES, digits: int = SLICE_DIGITS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, positions) for every row.

    size counts the words of the text (null: 0); copies is how often the document is
    taken, taken is copies * size, positions has the place in the training, from 0 to 1,
    of each copy. Texts without words are taken as often as their place says, with no
    words. Repeated rows count each; among rows with the same doc_id, size and source
    the copies go to any of them. A null source is a source, the last one. An empty
    table gives no row; other columns are not read.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        _key("source").alias("source_key"),
        F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"),
    ).withColumn("slice", F.substring("hash", 1, digits))
    slices = sized.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    goal = targets(slices.groupBy("source_key").agg(F.sum("slice_size").alias("source_size")), repeats)
    earlier = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    placed = starts.join(goal, "source_key").select(
        "source_key", "slice", "start", "source_size", "target", "rank"
    )
    inside = (
        Window.partitionBy("source_key", "slice")
        .orderBy("hash", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    middle = F.col("start") + F.col("until") - F.col("size") / 2
    more = (F.col("ratio") - F.col("rounds")) * F.col("source_size")
    return (
        sized.withColumn("until", F.sum("size").over(inside))
        .join(placed, ["source_key", "slice"])
        .withColumn("ratio", F.least(ratio, F.lit(float(repeats))))
        .withColumn("rounds", F.floor("ratio"))
        .withColumn("middle", middle)
        .withColumn("copies", (F.col("rounds") + (F.col("middle") < more).cast("long")).cast("int"))
        .withColumn("k", F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn(
            "positions",
            F.coalesce(
                F.transform(
                    "k",
                    lambda k: position(
                        F.least((F.col("middle") + k * F.col("source_size")) / F.col("target"), F.lit(1.0)),
                        F.col("rank"),
                        schedules,
                    ),
                ),
                F.array().cast("array<double>"),
            ),
        )
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), "positions",
        )
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The rows of `mix`, range-sorted by the first position; those not taken come last."""
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, as the training meets them: each as many times as
    it is taken, range-sorted by position. Rows that share a doc_id follow the same plan
    row by row."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    size = F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long")
    keyed = docs.withColumns({
        "__llm_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "__llm_source": _key("source"),
        "__llm_size": size,
    })
    among = ["__llm_id", "__llm_source", "__llm_size"]
    plan = mix(docs, **options).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__llm_id"),
        _key("source").alias("__llm_source"),
        F.col("size").alias("__llm_size"),
        "positions",
    )
    # Rows that agree in all three are told apart by their place among them.
    number = F.row_number().over(Window.partitionBy(*among).orderBy(F.lit(1)))
    by_place = F.row_number().over(Window.partitionBy(*among).orderBy(F.size("positions").desc()))
    planned = plan.withColumn("__llm_place", by_place).withColumnRenamed("positions", "__llm_positions")
    return (
        keyed.withColumn("__llm_place", number)
        .join(planned, [*among, "__llm_place"])
        .withColumn("__llm_position", F.explode("__llm_positions"))
        .repartitionByRange("__llm_position", "__llm_id")
        .sortWithinPartitions("__llm_position", "__llm_id")
        .select(*columns)
    )


def as_written(docs: DataFrame) -> DataFrame:
    """The rows of files that Spark has written, in the order of the frame written.

    A scan deals files out by size. Their order is that of the part numbers in their names
    and of the rows inside; the rows are range-sorted by these. Frames that are not read
    from files come back as they are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    try:
        file = docs.metadataColumn("_metadata")
        marked = docs.select(
            *columns,
            F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).try_cast("long").alias("__llm_part"),
            file["file_name"].alias("__llm_file"),
            file["row_index"].alias("__llm_row"),
        )
        marked.schema  # resolves the columns
    except AnalysisException:
        return docs
    place = ["__llm_part", "__llm_file", "__llm_row"]
    return marked.repartitionByRange(*place).sortWithinPartitions(*place).select(*columns)
