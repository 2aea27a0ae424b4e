"""Ranks and running sums over a whole table without a task that holds it: key ranges and their offsets.

Ranges are cut by a key and, where one value of it fills more than a range (a hub, a
date, a small integer, nulls), by the columns that break ties as well, so rows that
share a key are spread as others are.  Only rows equal in key and all ties stay together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key range; sampled keys for each range where the key is no number; most ranges, whose bounds stand in the plan.
RANGE_ROWS, SAMPLED, MOST_RANGES = 1 << 20, 64, 1 << 14
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Cells:
    """Where a table is cut: ``cuts`` of the key, and ``finer`` cuts of (key, ties) for the ``hot`` keys, or for all keys if there are no cuts."""

    keys: tuple[str, ...]
    kinds: tuple[str, ...]
    cuts: tuple
    hot: tuple
    finer: tuple

    def of(self) -> Column:
        """The row's cell, a number that grows with (key, ties), nulls first."""
        key = F.col(self.keys[0])
        coarse = place(key, self.cuts, self.kinds[0])
        if not self.finer:
            return coarse.cast("long")
        whole = F.struct(*[F.col(c).cast(k).alias(f"c{i}") for i, (c, k) in enumerate(zip(self.keys, self.kinds))])
        fine = below(whole, self.finer, self.kinds)
        if self.hot:
            named = [v for v in self.hot if v is not None]
            is_hot = key.isin(*named) if named else F.lit(False)
            is_hot = F.coalesce(is_hot, F.lit(False)) | key.isNull() if None in self.hot else F.coalesce(is_hot, F.lit(False))
            fine = F.when(is_hot, fine).otherwise(0)
        return (coarse * (len(self.finer) + 1) + fine).cast("long")


def _is_nan(x) -> bool:
    return isinstance(x, float) and math.isnan(x)


def cells(df: DataFrame, key: str, ties: Sequence[str] = (), ranges: int | None = None) -> Cells:
    """At most ``ranges`` cells, and as many again for keys that fill more than one, all about equally full.

    Numbers are cut at the quantiles of a mergeable sketch; other keys at those of the
    ``SAMPLED`` * ranges rows with the smallest digests, a uniform sample of that size.  A number that is two
    quantiles in a row is hot, and its rows are cut by such a sample of (key, ties).
    Without ``ranges``, there is one for each RANGE_ROWS rows and at least one for each shuffle partition.
    """
    kinds = dict(df.dtypes)
    keys = tuple(dict.fromkeys([key, *ties]))
    held = df.select(*keys)
    number = kinds[key] in _NUMBERS
    fixed = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked: list[Column] = [F.count("*").alias("n"), F.count(key).alias("known")]
    grid = lambda k: F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], 10 * k).alias("q")
    seen = held.agg(*asked, *[grid(fixed)] * number).first()
    n, void = seen["n"], seen["n"] - seen["known"]
    ranges = ranges or min(MOST_RANGES, max(fixed, n // RANGE_ROWS))
    named = tuple(kinds[c] for c in keys)
    if not number:
        rows = held.select(key).where(F.col(key).isNotNull()).distinct() if len(keys) == 1 else held
        finer = _sampled(rows, keys, SAMPLED * ranges)
        return Cells(keys, named, (), (), finer) if len(keys) > 1 else Cells(keys, named, tuple(r[0] for r in finer), (), ())
    found = (seen["q"] if ranges == fixed else held.agg(grid(ranges)).first()["q"]) or []
    often = Counter(x for x in found if not _is_nan(x))
    hot = [v for v, times in often.items() if times > 1] + [None] * (void * ranges > n > 0)
    finer: tuple = ()
    if hot and len(keys) > 1 and ranges > 1:
        share = sum(often[v] for v in hot if v is not None) + void * ranges // max(n, 1)
        mine = held.where(F.col(key).isin(*[v for v in hot if v is not None]) | (F.col(key).isNull() if None in hot else F.lit(False)))
        finer = _sampled(mine, keys, SAMPLED * share)
    return Cells(keys, named, tuple(sorted(often)), tuple(hot) if finer else (), finer)


def _sampled(rows: DataFrame, keys: Sequence[str], size: int) -> tuple:
    """Every SAMPLED-th of the ``size`` rows with the smallest digests, in order (nulls first)."""
    some = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(size).orderBy(*keys)
    return tuple(dict.fromkeys(map(tuple, some.collect()[SAMPLED::SAMPLED])))


def place(value: Column, cuts: Sequence, kind: str) -> Column:
    """How many of the sorted ``cuts`` are below the value (null: -1)."""
    if not cuts:
        return F.when(value.isNull(), -1).otherwise(0)
    return F.when(value.isNull(), -1).otherwise(_count_below(value, cuts, lambda x: F.lit(x).cast(kind)))


def below(value: Column, cuts: Sequence[tuple], kinds: Sequence[str]) -> Column:
    """How many of the sorted tuples are below the struct; null fields come first."""
    if not cuts:
        return F.lit(0)
    return _count_below(value, cuts, lambda row: F.struct(*[F.lit(x).cast(k).alias(f"c{i}") for i, (x, k) in enumerate(zip(row, kinds))]))


def _count_below(value: Column, cuts: Sequence, literal: Callable[..., Column]) -> Column:
    """Looked up in two steps of about sqrt(n)."""
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    listed = lambda xs: F.array(*[literal(x) for x in xs])
    lasts, inner = listed(g[-1] for g in groups), F.array(*[listed(g) for g in groups])
    whole = F.size(F.filter(lasts, lambda c: c < value))
    within = F.transform(F.array(whole), lambda k: F.when(k == len(groups), len(cuts)).otherwise(k * step + F.size(F.filter(F.get(inner, k), lambda c: c < value))))
    return within[0]


def dense_index(df: DataFrame, key: str, name: str = "idx", ranges: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Adds the 0-based rank of each row by ``key`` (nulls first), then ``ties``, without a single-partition sort.

    Rows are cut into cells, ranked inside each, and shifted by the sizes of
    earlier cells: a table of one row a cell.
    """
    cut = df.withColumn("__range", cells(df, key, ties, ranges).of())
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    ahead = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties)) - 1
    ranked = cut.withColumn("__inside", inside).join(F.broadcast(ahead), "__range")
    return ranked.withColumn(name, (F.col("__inside") + F.col("__ahead")).cast("long")).drop("__range", "__inside", "__ahead")


def rank_within(df: DataFrame, group: str, order: Sequence[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds each row's 0-based rank among the rows of its ``group`` by ``order`` (nulls first).

    A group that fills more than a cell is ranked cell by cell, shifted by its rows in
    earlier cells; rows of all other groups are in one.
    """
    found = cells(df, group, order, ranges)
    line = Window.partitionBy(group).orderBy(*order)
    if not found.finer:
        return df.withColumn(name, (F.row_number().over(line) - 1).cast("long"))
    cut = df.withColumn("__cell", found.of())
    held = cut.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select(F.col(group).alias("__g"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead")).where("__ahead > 0")
    inside = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order)) - 1
    ranked = cut.withColumn("__inside", inside)
    ranked = ranked.join(ahead, ranked[group].eqNullSafe(ahead["__g"]) & (ranked["__cell"] == ahead["__c"]), "left")
    return ranked.withColumn(name, (F.col("__inside") + F.coalesce("__ahead", F.lit(0))).cast("long")).drop("__cell", "__inside", "__g", "__c", "__ahead")


def running_total(df: DataFrame, order: str, value: str, by: Sequence[str] = (), name: str = "ahead", ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows by ``order`` among those with the same ``by``; equal keys of one group must not repeat.

    Sums run inside key ranges, and the totals of earlier ranges are added: one row a group and range.
    """
    cut = df.withColumn("__range", cells(df, order, ranges=ranges).of())
    sums = cut.groupBy(*by, "__range").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*by, "__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__ahead"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(ahead, [*by, "__range"]).withColumn(name, (F.col("__inside") + F.col("__ahead")).cast("long")).drop("__range", "__inside", "__ahead")
