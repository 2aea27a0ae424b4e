"""Adjacency as a table: every node's edges numbered in a fixed order, found by (node, place).

A sampler that knows a node's degree can name the places of the neighbours it wants
without reading the list, and fetches them by one equi-join on (node, place).  A
hub's list is spread by place, so an arrival moves as many rows as it keeps.
Stored, both tables are bucketed, and no edge is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET
from loomgraph.operators.ranges import rank_within, running_total


@dataclass(frozen=True)
class Adjacency:
    """``edges(node, place, neighbor, ekey, ets)``, places from 0 by time (nulls last), neighbour and key; ``degrees(node, degree)``."""

    edges: DataFrame
    degrees: DataFrame


def adjacency(edges: DataFrame, reverse: bool = False, key: str | None = None, stamp: str | None = None, ranges: int | None = None) -> Adjacency:
    """The numbered lists of an edge set, followed backward with ``reverse``.

    ``key`` names the column that tells parallel edges apart, ``stamp`` the time they
    are sorted by; without one ``ets`` is null.  Edges equal in all of these are interchangeable.
    """
    a, b = (TARGET, SOURCE) if reverse else (SOURCE, TARGET)
    ekey = (F.col(key) if key else F.concat_ws("-", SOURCE, TARGET)).cast("string")
    ets = F.col(stamp) if stamp else F.lit(None).cast("long")
    rows = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbor"), ekey.alias("ekey"), ets.alias("ets"))
    degrees = rows.groupBy("node").agg(F.count("*").alias("degree"))
    order = ["neighbor", "ekey"]
    if stamp:
        rows, order = rows.withColumn("untimed", F.col("ets").isNull()), ["untimed", "ets", *order]
    placed = rank_within(rows, "node", order, "place", ranges)
    return Adjacency(placed.select("node", "place", "neighbor", "ekey", "ets"), degrees)


def store(found: Adjacency, name: str, buckets: int, folder: str | None = None) -> Adjacency:
    """Saves the lists as tables: ``<name>_edges`` bucketed by (node, place), ``<name>_degrees`` by node, with ``start``, the node's first row in an order by node.

    Each bucket is one sorted file, so joins on those keys read the edges as they lie.  The files
    go to ``folder``, or to the session's warehouse.
    """
    spark = found.edges.sparkSession

    def save(rows: DataFrame, table: str, *keys: str) -> None:
        out = rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
        (out.option("path", f"{folder}/{table}") if folder else out).saveAsTable(table)

    save(found.edges, f"{name}_edges", "node", "place")
    save(running_total(found.degrees, "node", "degree", name="start"), f"{name}_degrees", "node")
    return stored(spark, name)


def stored(spark: SparkSession, name: str) -> Adjacency:
    """The tables that ``store`` saved under the name."""
    return Adjacency(spark.table(f"{name}_edges"), spark.table(f"{name}_degrees"))


def distinct_places(width: int, size: Column, draw: Callable[[Column], Column]) -> Column:
    """``width`` different places of 0 .. ``size`` - 1 in ascending order, all of them if there are no more.

    ``draw(j)`` is a random non-negative long for the j-th choice.  It is taken modulo
    the places left and counts through those not yet taken, so every set of places is equally
    likely.  Work grows with the square of the width and not with the size.
    """
    free = lambda taken, j: F.aggregate(taken, draw(j) % F.greatest(size - j, F.lit(1)), lambda x, c: x + F.when(c <= x, 1).otherwise(0))
    chosen = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.array().cast("array<long>"), lambda taken, j: F.array_sort(F.array_append(taken, free(taken, j).cast("long"))))
    return F.when(size <= width, first_places(width, size)).otherwise(chosen)


def first_places(width: int, size: Column) -> Column:
    """The first ``width`` places, at most ``size``."""
    return F.when(size > 0, F.sequence(F.lit(0).cast("long"), F.least(size, F.lit(width)).cast("long") - 1)).otherwise(F.array().cast("array<long>"))
