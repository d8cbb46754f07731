"""Exact-size samples and splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger import constants as K
from turnledger.functions.keys import hash_fraction


# Groups that candidates for the last places are dealt to before the last choice.
SALTS = 256


def _step(hash_: Column) -> Column:
    """Number of the step, rising with the hash, in which a hash lies. A step is at most
    a 64th of what lies below it, so there are about 3,000 of them."""
    whole = (hash_ * float(1 << 48)).cast("long")
    bits = F.length(F.bin(whole))
    # Seven leading bits; shiftright takes its distance from an expression only in SQL.
    return bits * 128 + F.call_function("shiftright", whole, F.greatest(bits - 7, F.lit(0)))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = K.SPLIT_SEED) -> DataFrame:
    """The `n` rows with the smallest key hashes (all rows if there are fewer); of rows that
    share the last key those with the smallest hashes of the whole row.

    A plain `limit(n)` before a write makes every task ship n rows to one task. Here the
    rows of each step of hashes are counted first, from key columns only, which tells in
    which step the n-th smallest lies. A second pass takes the rows up to this step. Those
    before it are all in the sample and spread over tasks; only those inside of it, about
    n / 64 unless many share a key, are ordered, in groups first.
    """
    hash_ = hash_fraction(keys, seed)
    steps = df.select(_step(hash_).alias("step")).groupBy("step").agg(F.count("*").alias("rows"))
    until_here = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        steps.withColumn("until", F.sum("rows").over(until_here))
        .filter(F.col("until") >= n)
        .agg(F.min_by(F.struct("step", (n - F.col("until") + F.col("rows")).alias("wanted")), "step"))
        .scalar()
    )
    hashed = F.xxhash64(*[f"`{c}`" for c, t in df.dtypes if "map<" not in t and t != "variant"])
    order = [hash_, *keys, "_row_hash"]
    found = (
        df.withColumn("_last", last)
        .filter(F.coalesce(_step(hash_) <= F.col("_last.step"), F.lit(True)))
        .withColumn("_tail", F.coalesce(_step(hash_) == F.col("_last.step"), F.lit(False)))
        .withColumn("_row_hash", hashed)
    )
    chosen = ~F.col("_tail") | (F.col("_place") <= F.col("_last.wanted"))
    for salt in (F.spark_partition_id() % SALTS, F.lit(0)):
        group = F.when(F.col("_tail"), salt.cast("long")).otherwise(F.col("_row_hash"))
        place = F.row_number().over(Window.partitionBy("_tail", "_group").orderBy(*order))
        found = found.withColumn("_group", group).withColumn("_place", place).filter(chosen)
    return found.drop("_last", "_tail", "_row_hash", "_group", "_place")


def in_first_part(keys: Sequence[str], share: float = 0.8, seed: int = K.SPLIT_SEED) -> Column:
    """True for the given share of the rows, chosen by key hash."""
    return hash_fraction(keys, seed) < share


def split_rows(df: DataFrame, keys: Sequence[str], share: float = 0.8,
               seed: int = K.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test): map-only, and the same again when a task is repeated."""
    first = in_first_part(keys, share, seed)
    return df.filter(first), df.filter(~first)
