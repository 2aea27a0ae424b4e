"""Time series that meet samples: each node's steps are numbered by time, and an ask fetches its last few by place.

No array holds a node's whole history: the number of steps at or before the asked
time comes from one as-of join, and the wanted places from an equi-join on (key, place),
so an ask moves as many steps as it keeps, and a key with most of all steps is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranges import rank_within
from loomgraph.operators.sampling import Sample
from loomgraph.operators.structure import as_of


def numbered_steps(steps: DataFrame, key: str, time: str, values: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``(key, t, place, values...)``: places from 0 by time, then values; steps without key or time go.

    Written as a table bucketed by (key, place), it is fetched from without a shuffle.
    """
    rows = steps.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("t"), *values)
    return rank_within(rows, "key", ["t", *values], "place", ranges)


def steps_until(numbered: DataFrame, asks: DataFrame, values: Sequence[str], most: int, since: Column | None = None, before: bool = False) -> DataFrame:
    """The last ``most`` steps at or before each ask's time: ``asks(key, until, ...)`` with ``nth`` from 0, ``t`` and the values.

    ``before`` takes strictly earlier steps only; ``since``, an expression over the ask, drops
    older ones.  Asks without a step have no row; asks that repeat are answered each.
    """
    limit = F.col("until") - 1 if before else F.col("until")
    asked = asks.withColumn("__limit", limit)
    facts = numbered.select("key", F.col("t").alias("__limit"), "place")
    seen = as_of(facts, asked.select("key", "__limit").distinct(), "key", "__limit", "place", early=False)
    found = asked.join(seen.where(F.col("place").isNotNull()).select("key", "__limit", F.col("place").alias("__last")), ["key", "__limit"])
    first = F.greatest(F.lit(0), F.col("__last") - (most - 1))
    picks = found.withColumn("place", F.explode(F.sequence(first, F.col("__last")))).withColumn("__first", first)
    rows = picks.join(numbered, ["key", "place"])
    rows = rows.where(F.col("t") >= since) if since is not None else rows
    return rows.select(*asks.columns, (F.col("place") - F.col("__first")).cast("int").alias("nth"), "t", *values)


def series_of(steps: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``steps_until`` rows as one row an ask: arrays ``t`` and of each value in order, of at most as many steps as were asked for."""
    g = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nth", "t", *values))).alias("__s"))
    return g.select(*by, *[F.col(f"__s.{c}").alias(c) for c in ("t", *values)])


def sample_series(sample: Sample, seeds: DataFrame, node_set: str, numbered: DataFrame, values: Sequence[str], most: int) -> DataFrame:
    """``(seed, node, t, values...)``: what each sampled node of a set has up to its own seed's time ``seeds(seed, ts)``; empty arrays where there is nothing."""
    kind = numbered.schema["key"].dataType
    mine = sample.nodes.where(F.col("node_set") == node_set).select("seed", "node").join(seeds.select("seed", F.col("ts").alias("until")).distinct(), "seed")
    steps = steps_until(numbered, mine.select("seed", "node", F.col("node").cast(kind).alias("key"), "until"), values, most)
    arrays = series_of(steps, ["seed", "node"], values)
    kinds = dict(arrays.dtypes)
    whole = mine.select("seed", "node").join(arrays, ["seed", "node"], "left")
    return whole.select("seed", "node", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("t", *values)])
