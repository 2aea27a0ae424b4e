"""Membership of keys by a stored Bloom filter first, and exactly only for what it lets through.

The filter is a small table: a key's hash picks a block of 32,768 bits and a few bits of
it.  Its size is set by the number of keys and bounded, so it is broadcast, and rows are tested
where they lie.  A row whose bits are not all set is surely no member and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block, as the built-in bitmaps have; most blocks: a filter is 64 MB at most.
BLOCK_BITS, MOST_BLOCKS = 1 << 15, 1 << 14


@dataclass(frozen=True)
class KeyFilter:
    """``blocks(block, bits)`` of ``size`` blocks, and how many bits a key sets."""

    blocks: DataFrame
    size: int
    hashes: int


def _spot(columns: Sequence[str], n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.col(c) for c in columns])


def key_filter(keys: DataFrame, columns: Sequence[str], bits: int = 16, hashes: int = 5, count: int | None = None, most: int = MOST_BLOCKS) -> KeyFilter:
    """The filter of the keys' ``columns``, ``bits`` bits for each of ``count`` keys (counted if not given).

    With 16 bits and 5 hashes about one other key in 500 passes.  Beyond ``most`` blocks bits are shared
    by more keys and more others pass; none that is a key is ever refused.  Nulls are values.
    """
    n = keys.count() if count is None else count
    size = max(1, min(most, -(-n * bits // BLOCK_BITS)))
    block = F.pmod(_spot(columns, 0), F.lit(size))
    spots = F.array(*[F.pmod(_spot(columns, i + 1), F.lit(BLOCK_BITS)) for i in range(hashes)])
    rows = keys.select(block.alias("block"), F.explode(spots).alias("spot")).distinct()
    return KeyFilter(rows.groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits")), size, hashes)


def store(found: KeyFilter, path: str) -> None:
    found.blocks.withColumns({"size": F.lit(found.size), "hashes": F.lit(found.hashes)}).coalesce(1).write.mode("overwrite").parquet(path)


def stored(spark: SparkSession, path: str) -> KeyFilter:
    """A filter that was stored; that of no keys lets nothing through."""
    rows = spark.read.parquet(path)
    first = rows.select("size", "hashes").first()
    return KeyFilter(rows.select("block", "bits"), *(tuple(first) if first else (1, 1)))


def tested(rows: DataFrame, columns: Sequence[str], found: KeyFilter, name: str = "may") -> DataFrame:
    """Adds whether the filter lets a row through."""
    blocks = F.broadcast(found.blocks.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))  # at most MOST_BLOCKS * 4 KB
    asked = rows.withColumn("__at", F.pmod(_spot(columns, 0), F.lit(found.size)))
    spots = [F.pmod(_spot(columns, i + 1), F.lit(BLOCK_BITS)).cast("int") for i in range(found.hashes)]
    byte = lambda s: F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(s, 3) + 1, F.lit(1))), 16, 10).cast("int")
    lit = lambda s: F.call_function("shiftright", byte(s), F.pmod(s, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    may = F.col("__bits").isNotNull()
    for s in spots:
        may = may & lit(s)
    joined = asked.join(blocks, F.col("__at") == F.col("__block"), "left")
    return joined.withColumn(name, F.coalesce(may, F.lit(False))).drop("__at", "__block", "__bits")


def _met(rows: DataFrame, keys: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    other = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)])
    return rows.join(other, [rows[c].eqNullSafe(other[f"__k{i}"]) for i, c in enumerate(columns)], how)


def within(rows: DataFrame, keys: DataFrame, columns: Sequence[str], found: KeyFilter) -> DataFrame:
    """The rows whose ``columns`` stand in ``keys``: only those the filter lets through are joined."""
    return _met(tested(rows, columns, found, "__may").where("__may").drop("__may"), keys, columns, "left_semi")


def without(rows: DataFrame, keys: DataFrame, columns: Sequence[str], found: KeyFilter) -> DataFrame:
    """The rows whose ``columns`` don't stand in ``keys``: those the filter refuses are out of it at once."""
    known = tested(rows, columns, found, "__may")
    sure = known.where(~F.col("__may")).drop("__may")
    return sure.unionByName(_met(known.where("__may").drop("__may"), keys, columns, "left_anti"))
