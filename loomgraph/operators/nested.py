"""Samples with their features as one row each: per set a struct of arrays, edges as indices into them.

``(seed, nodes struct<set: struct<id, features...>>, edges struct<set: struct<source, target>>)``.
The arrays of a set are aligned; nodes stand by hop and key, so a seed is the first of its own set, and an edge's ends
are places in the arrays of its two node sets.  Parquet keeps every leaf as a column of
its own, so a reader of two features reads those two.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.sampling import Sample, node_order


def nested(sample: Sample, graph: Graph, features: dict[str, Sequence[str]]) -> DataFrame:
    """One row for each sample, with the named features of its nodes.

    Features are joined by key last; a node that the graph does not have has nulls.  All sets meet in one
    shuffle by seed.  Node sets of the graph without nodes in a sample, and edge sets without edges, have
    empty arrays.  A sample is a row, so its plan's widths bound it.
    """
    placed = node_order(sample, visits=True).withColumn("idx", F.col("idx").cast("int"))
    parts, kept = [], {}
    for i, n in enumerate(graph.schema.node_sets):
        wanted = list(features.get(n, ()))
        mine = placed.where(F.col("node_set") == n).select("seed", "idx", F.col("node").alias("id"))
        if wanted:
            rows = graph.nodes[n].select(F.col(graph.key(n)).cast("string").alias("id"), *wanted)
            mine = mine.join(rows, "id", "left")
        parts.append(mine.select("seed", F.struct("idx", "id", *wanted).alias(f"n{i}")))
        kept[f"n{i}"] = ("nodes", n, ["id", *wanted])
    ends = lambda n, c: placed.where(F.col("node_set") == n).select("seed", F.col("node").alias(c), F.col("idx").alias(f"{c}_idx"))
    for i, (n, e) in enumerate(graph.schema.edge_sets.items()):
        mine = sample.edges.where(F.col("edge_set") == n).join(ends(e.source, SOURCE), ["seed", SOURCE]).join(ends(e.target, TARGET), ["seed", TARGET])
        parts.append(mine.select("seed", F.struct(F.col(f"{SOURCE}_idx").alias(SOURCE), F.col(f"{TARGET}_idx").alias(TARGET)).alias(f"e{i}")))
        kept[f"e{i}"] = ("edges", n, [SOURCE, TARGET])
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = rows.groupBy("seed").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in kept])
    sets = {k: [F.struct(*[F.col(f"{c}.{f}").alias(f) for f in fields]).alias(n) for c, (kind, n, fields) in kept.items() if kind == k] for k in ("nodes", "edges")}
    return whole.select("seed", *[F.struct(*columns).alias(k) for k, columns in sets.items() if columns])


def write_nested(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").parquet(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """The samples at ``path``; only the leaves that are used later are read."""
    return spark.read.parquet(path)


def nested_nodes(samples: DataFrame, node_set: str, features: Sequence[str] = ()) -> DataFrame:
    """``(seed, idx, id, features...)`` of one node set, a row each."""
    leaves = [F.col(f"nodes.{node_set}.{f}") for f in ("id", *features)]
    return samples.select("seed", F.posexplode(F.arrays_zip(*leaves)).alias("idx", "__n")).select("seed", "idx", *[F.col("__n")[f].alias(f) for f in ("id", *features)])


def nested_edges(samples: DataFrame, edge_set: str) -> DataFrame:
    """``(seed, source, target)`` of one edge set: places of its ends."""
    leaves = [F.col(f"edges.{edge_set}.{c}") for c in (SOURCE, TARGET)]
    return samples.select("seed", F.explode(F.arrays_zip(*leaves)).alias("__e")).select("seed", F.col("__e")[SOURCE].alias(SOURCE), F.col("__e")[TARGET].alias(TARGET))
