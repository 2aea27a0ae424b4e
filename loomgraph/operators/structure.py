"""Operators that reshape a graph: reversal, adjacency lists, merging, ids, dangling edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.ranges import cells, dense_index, running_total
from loomgraph.schema import EdgeSet, GraphSchema, creation_time


def reverse_edges(g: Graph) -> Graph:
    """Every edge set with source and target swapped; edge features stay."""
    es = {n: EdgeSet(s.target, s.source, s.features) for n, s in g.schema.edge_sets.items()}
    flipped = {n: d.select(F.col(TARGET).alias(SOURCE), F.col(SOURCE).alias(TARGET), *[c for c in d.columns if c not in (SOURCE, TARGET)]) for n, d in g.edges.items()}
    return replace(g, schema=GraphSchema(g.schema.node_sets, es), edges=flipped)


def adjacency_list(edges: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """``(source, neighbors)``: each source's edges as an array sorted by target, then features."""
    entry = F.struct(TARGET, *features)
    return edges.groupBy(SOURCE).agg(F.array_sort(F.collect_list(entry)).alias("neighbors"))


def flat_edges(adjacency: DataFrame) -> DataFrame:
    """The edges of adjacency lists, one row each."""
    return adjacency.select(SOURCE, F.explode("neighbors").alias("e")).select(SOURCE, "e.*")


def indexed_edges(edges: DataFrame, source_ids: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Edge keys replaced by dense numbers from ``ids(id, idx)``; edges with an unknown end go."""
    s, t = source_ids.select(F.col("id").alias("__s"), F.col("idx").alias("source_idx")), target_ids.select(F.col("id").alias("__t"), F.col("idx").alias("target_idx"))
    return edges.join(s, edges[SOURCE] == s["__s"]).join(t, edges[TARGET] == t["__t"]).drop("__s", "__t")


def block_starts(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree, start)``: where each node's block begins in an edge list sorted by source, zero degrees included."""
    n = edges.groupBy(F.col(SOURCE).alias("id")).agg(F.count("*").alias("degree"))
    d = ids.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running_total(d, "id", "degree", name="start")


def sorted_edges(edges: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Edges with ``place``, their number in the order by source, target and ``ties``."""
    return dense_index(edges, SOURCE, "place", ties=[TARGET, *ties])


def without_dangling(edges: DataFrame, source_ids: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Edges whose two ends exist: a left-semi join on each."""
    s, t = source_ids.select(F.col("id").alias("__s")), target_ids.select(F.col("id").alias("__t"))
    return edges.join(s, edges[SOURCE] == s["__s"], "left_semi").join(t, edges[TARGET] == t["__t"], "left_semi")


def dangling(edges: DataFrame, source_ids: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``(side, id)`` of each missing end; keys of two types are shown as text."""
    s, t = source_ids.select(F.col("id").alias("__s")), target_ids.select(F.col("id").alias("__t"))
    a = edges.join(s, edges[SOURCE] == s["__s"], "left_anti").select(F.lit("source").alias("side"), F.col(SOURCE).alias("id"))
    b = edges.join(t, edges[TARGET] == t["__t"], "left_anti").select(F.lit("target").alias("side"), F.col(TARGET).alias("id"))
    if a.schema["id"].dataType != b.schema["id"].dataType:
        a, b = (d.select("side", F.col("id").cast("string").alias("id")) for d in (a, b))
    return a.unionByName(b).distinct()


def undirected_simple(edges: DataFrame) -> DataFrame:
    """Each unordered pair once: parallel and reverse edges merge, self loops stay."""
    return edges.select(F.least(SOURCE, TARGET).alias("a"), F.greatest(SOURCE, TARGET).alias("b")).distinct()


def homogenize(g: Graph, node_sets: Sequence[str], edge_sets: Sequence[str], keys: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Node sets of one feature schema as one set, numbered on from set to set.

    Returns ``nodes(idx, node_set, id, features...)`` and ``edges(edge_set, source, target)`` over
    the shifted numbers.  Sets whose features differ raise ValueError.
    """
    if len({tuple(sorted(set(g.nodes[n].columns) - {keys[n]})) for n in node_sets}) > 1:
        raise ValueError("the node sets have different features")
    ids, parts, sizes = {}, [], {}
    for n in node_sets:
        d = g.nodes[n].withColumnRenamed(keys[n], "id")
        sizes[n] = d.agg(F.count("*").alias("n"))
    running = None
    for n in node_sets:
        d = dense_index(g.nodes[n].withColumnRenamed(keys[n], "id"), "id")
        if running is not None:
            d = d.crossJoin(F.broadcast(running)).withColumn("idx", F.col("idx") + F.col("n")).drop("n")
        ids[n] = d.select("id", "idx")
        parts.append(d.select("idx", F.lit(n).alias("node_set"), F.col("id").cast("string").alias("id"), *[c for c in d.columns if c not in ("id", "idx")]))
        running = sizes[n] if running is None else running.select(F.col("n").alias("m")).crossJoin(sizes[n]).select((F.col("m") + F.col("n")).alias("n"))
    es = []
    for n in edge_sets:
        s = g.schema.edge_sets[n]
        e = indexed_edges(g.edges[n].select(SOURCE, TARGET), ids[s.source], ids[s.target])
        es.append(e.select(F.lit(n).alias("edge_set"), F.col("source_idx").alias(SOURCE), F.col("target_idx").alias(TARGET)))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, es)


def merge_samples(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples as one block-diagonal graph.

    ``nodes(seed, node_set, node)`` become ``(node_set, idx, seed, node)`` with numbers that
    run on over the seeds in order; edges point at those numbers.  Offsets are running
    sums over one row per seed and set, taken within ranges of seeds.
    """
    inside = F.row_number().over(Window.partitionBy("seed", "node_set").orderBy("node")) - 1
    local = nodes.withColumn("i", inside)
    counts = local.groupBy("node_set", "seed").agg(F.count("*").alias("n"))
    offsets = running_total(counts, "seed", "n", ["node_set"]).select("node_set", "seed", "ahead")
    numbered = local.join(offsets, ["node_set", "seed"]).select("node_set", (F.col("i") + F.col("ahead")).alias("idx"), "seed", "node")
    s = numbered.select(F.col("node_set").alias("source_set"), "seed", F.col("node").alias(SOURCE), F.col("idx").alias("source_idx"))
    t = numbered.select(F.col("node_set").alias("target_set"), "seed", F.col("node").alias(TARGET), F.col("idx").alias("target_idx"))
    joined = edges.join(s, ["source_set", "seed", SOURCE]).join(t, ["target_set", "seed", TARGET])
    return numbered, joined.select("edge_set", "seed", "source_idx", "target_idx")


def padded(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """A set of ``nodes(idx)`` and ``edges(source_idx, target_idx)`` filled up with sentinels.

    Sentinel edges join the last node with itself.  At least one node slot must be
    spare; running out of slots raises ValueError.
    """
    n, e = nodes.count(), edges.count()
    if n >= max_nodes or e > max_edges:
        raise ValueError(f"{n} nodes and {e} edges do not fit {max_nodes} and {max_edges}")
    spark = nodes.sparkSession
    more = spark.range(n, max_nodes).select(F.col("id").cast("long").alias("idx"))
    loops = spark.range(max_edges - e).select(F.lit(max_nodes - 1).cast("long").alias("source_idx"), F.lit(max_nodes - 1).cast("long").alias("target_idx"))
    return nodes.unionByName(more, allowMissingColumns=True), edges.unionByName(loops, allowMissingColumns=True)


def unpadded(nodes: DataFrame, edges: DataFrame, real_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Sentinels removed: nodes below the real count, edges with both ends below it."""
    return nodes.where(F.col("idx") < real_nodes), edges.where((F.col("source_idx") < real_nodes) & (F.col("target_idx") < real_nodes))


def edge_lookup(edges: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``(source, target, edge)`` of queried pairs: the largest edge key, -1 where there is none."""
    known = edges.groupBy(SOURCE, TARGET).agg(F.max(key).alias("__k"))
    return queries.join(known, [SOURCE, TARGET], "left").select(SOURCE, TARGET, F.coalesce("__k", F.lit(-1)).alias("edge"))


def propagate_timestamps(edges: DataFrame, source_times: DataFrame | None, target_times: DataFrame | None) -> DataFrame:
    """Edges with ``ts``: the later of their ends' times (``times(id, ts)``); one side may be None.

    Both sides missing, or an edge that has the column already, raise ValueError.
    """
    if "ts" in edges.columns:
        raise ValueError("the edges have a ts already")
    if source_times is None and target_times is None:
        raise ValueError("neither end has a time")
    out, found = edges, []
    for times, end, name in ((source_times, SOURCE, "__a"), (target_times, TARGET, "__b")):
        if times is not None:
            t = times.select(F.col("id").alias(f"{name}k"), F.col("ts").alias(name))
            out = out.join(t, out[end] == t[f"{name}k"], "left").drop(f"{name}k")
            found.append(F.col(name))
    stamp = F.greatest(*found) if len(found) > 1 else found[0]
    return out.withColumn("ts", stamp).drop("__a", "__b")


def with_creation_times(g: Graph, edge_set: str) -> DataFrame:
    """The edge set with ``ts`` from the schema: its own creation time, else the later of its ends' creation times.

    Sets without any of the three raise ValueError.
    """
    e, edges = g.schema.edge_sets[edge_set], g.edges[edge_set]
    own = creation_time(e.features)
    if own:
        return edges.withColumn("ts", F.col(own))
    times = []
    for n in (e.source, e.target):
        born = creation_time(g.schema.node_sets[n].features)
        times.append(g.nodes[n].select(F.col(g.key(n)).alias("id"), F.col(born).alias("ts")) if born else None)
    return propagate_timestamps(edges, *times)


def as_of(facts: DataFrame, asks: DataFrame, key: str, time: str, value: str, early: bool = True, ranges: int | None = None) -> DataFrame:
    """``(key, time, ask, value)``: the last ``value`` of each key at or before the asked time.

    Before a key's first fact it is the first with ``early``, else null; null values are no
    facts, and of several at one time the largest counts.  ``ask`` is the column of
    that name of ``asks``, null without one; asks that repeat are answered each.
    One union and one window instead of a range join.  A key that fills more than a
    range of rows is cut by time, and the last value is carried from range to range.
    """
    known = facts.where(F.col(value).isNotNull()).select(key, F.col(time).alias("__t"), F.lit(0).alias("__q"), F.col(value).alias("__v"), F.lit(None).cast("long").alias("__i"))
    ask = F.col("ask") if "ask" in asks.columns else F.lit(None).cast("long")
    both = known.unionByName(asks.select(key, F.col(time).alias("__t"), F.lit(1).alias("__q"), F.lit(None).cast(dict(facts.dtypes)[value]).alias("__v"), ask.alias("__i")))
    found = cells(both, key, ["__t"], ranges)
    cell = ["__cell"] * bool(found.finer)
    both = both.withColumn("__cell", found.of()) if cell else both
    w = Window.partitionBy(key, *cell).orderBy("__t", "__q", "__v")
    fact = F.when(F.col("__q") == 0, F.struct("__t", "__v"))
    last = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(fact).over(Window.partitionBy(key))["__v"]
    if cell:
        ends = both.groupBy(F.col(key).alias("__k"), F.col("__cell").alias("__c")).agg(F.max(fact).alias("__last"), F.min(fact).alias("__first"))
        line = Window.partitionBy("__k").orderBy("__c")  # one row a cell of the key
        carried = F.last(F.col("__last")["__v"], ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select("__k", "__c", carried.alias("__before"), F.min("__first").over(Window.partitionBy("__k"))["__v"].alias("__start"))
        both = both.withColumn("__inside", last)
        both = both.join(ends, both[key].eqNullSafe(ends["__k"]) & (both["__cell"] == ends["__c"]))
        last, first = F.coalesce("__inside", "__before"), F.col("__start")
    answer = F.coalesce(last, first) if early else last
    return both.withColumn("__r", answer).where("__q = 1").select(key, F.col("__t").alias(time), F.col("__i").alias("ask"), F.col("__r").alias(value))
