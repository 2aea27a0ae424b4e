"""k-hop neighbourhood sampling in long form.

A sample is rows, not an object: ``sample_nodes(seed, node_set, node)`` and
``sample_edges(seed, edge_set, source, target)``.  Each hop joins the frontier with
an edge set and keeps the first ``width`` neighbours of each arrival by an order
that depends on keys alone, so results are the same under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.adjacency import Adjacency, adjacency, distinct_places, first_places
from loomgraph.operators.structure import as_of
from loomgraph.schema import GraphSchema
from loomgraph.session import cut


@dataclass(frozen=True)
class Step:
    """One hop of a plan: an edge set followed forward or backward, and the hops after it."""

    edge_set: str
    reverse: bool
    node_set: str
    width: int | None
    then: tuple[Step, ...] = ()


@dataclass(frozen=True)
class SamplingPlan:
    seed_set: str
    steps: tuple[Step, ...]

    def described(self) -> str:
        def lines(steps, depth):
            for s in steps:
                yield f"{'  ' * depth}{'<-' if s.reverse else '->'} {s.edge_set} -> {s.node_set} (width {s.width})"
                yield from lines(s.then, depth + 1)

        return "\n".join([self.seed_set, *lines(self.steps, 1)])


def hop_plan(schema: GraphSchema, seed_set: str, hops: int = 3, width: int | Sequence[int] | None = 5, reverse: bool = True, only: Sequence[str] | None = None) -> SamplingPlan:
    """The plan that follows every edge set touching the current node set, sorted by name, ``hops`` times.

    ``width`` may differ by hop; None is unbounded.  ``only`` restricts the edge sets.
    """

    def grow(node_set: str, depth: int) -> tuple[Step, ...]:
        if depth >= hops:
            return ()
        w = width[depth] if isinstance(width, (list, tuple)) else width
        out = []
        for name in sorted(schema.edge_sets):
            e = schema.edge_sets[name]
            if only is not None and name not in only:
                continue
            if e.source == node_set:
                out.append(Step(name, False, e.target, w, grow(e.target, depth + 1)))
            if reverse and e.target == node_set:
                out.append(Step(name, True, e.source, w, grow(e.source, depth + 1)))
        return tuple(out)

    return SamplingPlan(seed_set, grow(seed_set, 0))


def hash_order(*parts: Column, salt: str = "loom") -> Column:
    """A key-only random order: the MD5 of salt and keys, the same in other SQL engines."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]))


def hash_long(*parts: Column, salt: str = "loom") -> Column:
    """The first 60 bits of the digest of salt and keys."""
    return F.conv(F.substring(hash_order(*parts, salt=salt), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Sample:
    """``nodes(seed, node_set, node, hop)`` and ``edges(seed, edge_set, source, target)``, both sets."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Sampler:
    """Samples a graph along a plan.

    ``order``: "first" keeps the smallest (timestamp,) targets, "hash" a uniform
    choice: places in the node's list are drawn from key digests and only those rows are
    fetched, so a hub's list is not read.  ``stored`` gives stored lists by (edge set, reverse);
    both orders then fetch from them without shuffling edges.  ``temporal`` maps edge sets to their timestamp column:
    only edges no later than the seed's time are followed; sets without one are
    followed as they are.  ``mask_set`` names the edge set whose edge the seeds may
    leave out.  Without replacement nodes are a set, and each arrival of a node is
    expanded; ``distinct_frontier`` expands each node of a hop once.  ``keep_hops``
    computes each hop once and keeps it in the shared checkpoint folder: on a large
    graph the next hops and the result then start there instead of joining again.
    """

    graph: Graph
    plan: SamplingPlan
    order: str = "first"
    temporal: dict[str, str] = field(default_factory=dict)
    mask_set: str | None = None
    edge_key: dict[str, str] = field(default_factory=dict)
    distinct_frontier: bool = True
    salt: str = "loom"
    keep_hops: bool = False
    stored: dict[tuple[str, bool], Adjacency] = field(default_factory=dict)

    def __post_init__(self):
        if self.temporal and self.mask_set:
            raise ValueError("masking and temporal sampling exclude each other")

    def sample(self, seeds: DataFrame) -> Sample:
        """``seeds(seed[, node][, ts][, masked])``: sample id, start node, time limit, edge key to leave out."""
        start = seeds.withColumn("node", F.col("node")) if "node" in seeds.columns else seeds.withColumn("node", F.col("seed"))
        carried = [c for c in ("ts", "masked") if c in seeds.columns]
        front = start.select("seed", "node", *carried)
        nodes = [front.select("seed", F.lit(self.plan.seed_set).alias("node_set"), F.col("node").cast("string").alias("node"), F.lit(0).alias("hop"))]
        edges: list[DataFrame] = []

        def walk(steps, frontier: DataFrame, path: str, depth: int):
            for n, step in enumerate(steps):
                here = f"{path}/{n}"
                hop = self._follow(frontier, step, here, carried).select("seed", SOURCE, TARGET, *carried)
                hop = cut(hop) if self.keep_hops else hop
                a, b = (TARGET, SOURCE) if step.reverse else (SOURCE, TARGET)
                edges.append(hop.select("seed", F.lit(step.edge_set).alias("edge_set"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.lit(step.reverse).alias("r")))
                reached = hop.select("seed", F.col(b).alias("node"), *carried)
                nodes.append(reached.select("seed", F.lit(step.node_set).alias("node_set"), F.col("node").cast("string").alias("node"), F.lit(depth).alias("hop")))
                walk(step.then, reached.distinct() if self.distinct_frontier else reached, here, depth + 1)

        walk(self.plan.steps, front.distinct(), "", 1)
        every_node = reduce(DataFrame.unionByName, nodes).groupBy("seed", "node_set", "node").agg(F.min("hop").alias("hop"))
        if not edges:
            none = every_node.limit(0).select("seed", F.lit("").alias("edge_set"), F.lit("").alias(SOURCE), F.lit("").alias(TARGET))
            return Sample(every_node, none)
        every_edge = reduce(DataFrame.unionByName, edges).select(
            "seed", "edge_set", F.when(F.col("r"), F.col("b")).otherwise(F.col("a")).alias(SOURCE), F.when(F.col("r"), F.col("a")).otherwise(F.col("b")).alias(TARGET)
        )
        return Sample(every_node, every_edge.distinct())

    def _follow(self, frontier: DataFrame, step: Step, path: str, carried: list[str]) -> DataFrame:
        a, b = (TARGET, SOURCE) if step.reverse else (SOURCE, TARGET)
        key, stamp = self.edge_key.get(step.edge_set), self.temporal.get(step.edge_set)
        if step.width is not None and (self.order == "hash" or (step.edge_set, step.reverse) in self.stored):
            return self._fetch(frontier, step, path, carried)
        edges = self.graph.edges[step.edge_set]
        columns = [F.col(a), F.col(b)]
        columns.append((F.col(key) if key else F.concat_ws("-", SOURCE, TARGET)).cast("string").alias("__ekey"))
        if stamp:
            columns.append(F.col(stamp).alias("__ets"))
        side = edges.select(*columns)
        stamps = stamp and "ts" in carried
        masks = self.mask_set == step.edge_set and "masked" in carried
        ready = step.width is not None and self.order == "first"
        if ready:
            # The order does not depend on the seed, so a hub's list is cut before the join: what a time
            # limit leaves of a list sorted by time is its beginning, and a mask takes one keyed edge, or
            # without keys the parallel edges of one pair, at most as many as the largest pair so far has.
            line = Window.partitionBy(a).orderBy(*["__ets"] * bool(stamp), b, "__ekey")
            side = side.where(F.col("__ets").isNotNull()) if stamps else side
            side = side.withColumn("__n", F.row_number().over(line))
            if masks and not key:
                side = side.withColumn("__c", F.count("*").over(Window.partitionBy(a, b)))
                side = side.withColumn("__n", F.col("__n") - F.max("__c").over(line) + 1).drop("__c")
            side = side.where(F.col("__n") <= step.width + masks).drop("__n")
        joined = frontier.join(side, frontier["node"] == side[a])
        if stamps:
            joined = joined.where(F.col("__ets") <= F.col("ts"))
        if masks:
            joined = joined.where(~F.col("__ekey").eqNullSafe(F.col("masked").cast("string")))
        if step.width is None or (ready and not masks):
            return joined.drop("node")
        by = [F.col("__ets")] * bool(stamp) + [F.col(b), F.col("__ekey")]
        line = Window.partitionBy("seed", "node", *[c for c in carried if c == "ts"]).orderBy(*by)
        return joined.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= step.width).drop("__n", "node")


    def lists(self, step: Step, stamp: str | None = None) -> Adjacency:
        """The step's numbered neighbour lists, stored ones if there are any."""
        found = self.stored.get((step.edge_set, step.reverse))
        return found or adjacency(self.graph.edges[step.edge_set], step.reverse, self.edge_key.get(step.edge_set), stamp)

    def _fetch(self, frontier: DataFrame, step: Step, path: str, carried: list[str]) -> DataFrame:
        """A hop by places: how many edges an arrival may follow, which places it takes, and those rows.

        A time limit leaves the beginning of a list sorted by time.  A mask takes one edge, or
        without keys the parallel edges of a pair, which stand together: later places move up.
        """
        stamp = self.temporal.get(step.edge_set)
        lists = self.lists(step, stamp)
        front = frontier.join(lists.degrees.select(F.col("node").alias("__node"), F.col("degree").alias("__size")), F.col("node") == F.col("__node")).drop("__node")
        skip = lambda place: place
        if stamp and "ts" in carried:
            asks = front.select("node", "ts").distinct()
            seen = as_of(lists.edges.where(F.col("ets").isNotNull()).select("node", F.col("ets").alias("ts"), "place"), asks, "node", "ts", "place", early=False)
            front = front.drop("__size").join(seen.select("node", "ts", (F.coalesce("place", F.lit(-1)) + 1).alias("__size")), ["node", "ts"])
        if self.mask_set == step.edge_set and "masked" in carried:
            gone = lists.edges.select("node", F.col("ekey").alias("masked"), "place")
            asks = front.select("node", F.col("masked").cast("string").alias("masked")).distinct()
            gone = asks.join(gone, ["node", "masked"]).groupBy("node", "masked").agg(F.min("place").alias("__from"), F.count("*").alias("__gone"))
            match = (front["node"] == gone["node"]) & (front["masked"].cast("string") == gone["masked"])
            front = front.join(gone, match, "left").select(front["*"], "__from", F.coalesce("__gone", F.lit(0)).alias("__gone"))
            front = front.withColumn("__size", F.col("__size") - F.col("__gone"))
            skip = lambda place: place + F.when(place >= F.col("__from"), F.col("__gone")).otherwise(0)
        draw = lambda j: hash_long(F.lit(path), F.col("seed"), F.col("node"), j, salt=self.salt)
        size = F.col("__size")
        places = distinct_places(step.width, size, draw) if self.order == "hash" else first_places(step.width, size)
        hit = front.select("seed", "node", *carried, F.explode(F.transform(places, skip)).alias("place"))
        rows = hit.join(lists.edges.select("node", "place", "neighbor"), ["node", "place"])
        a, b = (TARGET, SOURCE) if step.reverse else (SOURCE, TARGET)
        return rows.select("seed", F.col("node").alias(a), F.col("neighbor").alias(b), *carried)


def sample_tree(sampler: Sampler, seeds: DataFrame) -> DataFrame:
    """Sampling with replacement: every visit is a node of its own.

    Each arrival draws ``width`` neighbours, the j-th at place md5(salt, path, j) modulo its degree
    in key order.  Returns ``(seed, path, node_set, node, parent)``; a path names
    the visit, its prefix the parent visit.
    """
    plan = sampler.plan
    start = seeds.select("seed", (F.col("node") if "node" in seeds.columns else F.col("seed")).alias("node"), F.lit("r").alias("path"))
    out = [start.select("seed", "path", F.lit(plan.seed_set).alias("node_set"), F.col("node").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"))]

    def walk(steps, frontier: DataFrame, depth: int):
        for n, step in enumerate(steps):
            if step.width is None:
                raise ValueError("sampling with replacement needs a width")
            lists = sampler.lists(step)
            degree = lists.degrees.select(F.col("node").alias("__a"), F.col("degree").alias("__d"))
            ranked = lists.edges.select(F.col("node").alias("__a"), F.col("neighbor").alias("__b"), F.col("place").alias("__i"))
            draws = frontier.join(degree, frontier["node"] == degree["__a"]).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(step.width - 1))))
            digest = hash_order(F.lit(n), F.col("seed"), F.col("path"), F.col("__j"), salt=sampler.salt)
            draws = draws.withColumn("__i", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("__d"))
            draws = draws.select("seed", F.col("node").alias("__from"), F.concat("path", F.lit(f"/{n}."), F.col("__j").cast("string")).alias("__path"), F.col("path").alias("__parent"), "__i")
            hit = draws.join(ranked, (draws["__from"] == ranked["__a"]) & (draws["__i"] == ranked["__i"]))
            reached = hit.select("seed", F.col("__b").alias("node"), F.col("__path").alias("path"), F.col("__parent").alias("parent"))
            out.append(reached.select("seed", "path", F.lit(step.node_set).alias("node_set"), F.col("node").cast("string").alias("node"), "parent"))
            walk(step.then, reached.select("seed", "node", "path"), depth + 1)

    walk(plan.steps, start, 0)
    return reduce(DataFrame.unionByName, out)


def first_ends(graph: Graph, step: Step, masks: bool) -> DataFrame:
    """``(__a, pairs, ends)``: for each node that has edges, the distinct ends of its first ``width`` edges as texts, and the first pairs
    ``(n, b, m)``, m being how many parallel edges count: with ``masks`` one pair more, so that any one of them can be left out."""
    if step.then or step.width is None:
        raise ValueError("one hop of a width is asked for")
    a, b = (TARGET, SOURCE) if step.reverse else (SOURCE, TARGET)
    pairs = graph.edges[step.edge_set].groupBy(F.col(a).alias("__a"), F.col(b).alias("b")).agg(F.least(F.count("*"), F.lit(step.width)).cast("int").alias("m"))
    pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("__a").orderBy("b"))).where(F.col("n") <= step.width + masks)
    lists = pairs.groupBy("__a").agg(F.sort_array(F.collect_list(F.struct("n", "b", "m"))).alias("pairs"))
    return lists.withColumn("ends", _ends_of(F.col("pairs"), step.width))


def _ends_of(pairs: Column, width: int) -> Column:
    taken = F.slice(F.flatten(F.transform(pairs, lambda x: F.array_repeat(x["b"], x["m"]))), 1, width)
    return F.transform(F.array_distinct(taken), lambda x: x.cast("string"))


def sample_ends(plan: SamplingPlan, mask_set: str, lists: Sequence[DataFrame], seeds: DataFrame, carry: Sequence[str] = ()) -> Sample:
    """What a ``Sampler`` with ``mask_set`` takes along a plan of one hop, for ``seeds(seed, node, source, target)`` of one row each,
    whose edges from ``source`` to ``target`` are left out.

    ``lists`` are the ``first_ends`` of the plan's steps, so a seed stays one row until its sample is written out, and nothing is
    gathered by seed.  The columns ``carry`` stand beside the seed in both tables.
    """
    own = F.col("node").cast("string")

    def met(rows: DataFrame, step: Step, held: DataFrame, name: str) -> DataFrame:
        """With the array ``name`` of the step's ends."""
        a, b = (TARGET, SOURCE) if step.reverse else (SOURCE, TARGET)
        rows = rows.join(held, rows["node"] == held["__a"], "left")
        ends = F.col("ends")
        if step.edge_set == mask_set:
            is_own = F.col("node").eqNullSafe(F.col(a)) & F.exists("pairs", lambda x: x["b"].eqNullSafe(F.col(b)))
            ends = F.when(is_own, _ends_of(F.filter("pairs", lambda x: ~x["b"].eqNullSafe(F.col(b))), step.width)).otherwise(ends)
        return rows.withColumn(name, F.coalesce(ends, F.array().cast("array<string>"))).drop("__a", "pairs", "ends")

    def as_nodes(step: Step, name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(step.node_set).alias("node_set"), x.alias("node")))

    def as_edges(step: Step, name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(step.edge_set).alias("edge_set"), (x if step.reverse else own).alias(SOURCE), (own if step.reverse else x).alias(TARGET)))

    def as_set(xs: Column, names: Sequence[str]) -> Column:
        """Ends of one step don't repeat, so only those of several that reach one set can."""
        return F.array_distinct(xs) if len(set(names)) < len(names) else xs

    rows, names = seeds, [f"__ends{n}" for n in range(len(plan.steps))]
    for step, held, name in zip(plan.steps, lists, names):
        rows = met(rows, step, held, name)
    itself = F.array(F.struct(F.lit(plan.seed_set).alias("node_set"), own.alias("node")))
    found = as_set(F.concat(itself, *[as_nodes(s, n) for s, n in zip(plan.steps, names)]), [plan.seed_set, *[s.node_set for s in plan.steps]])  # the start stands first
    links = as_set(F.concat(*[as_edges(s, n) for s, n in zip(plan.steps, names)]), [s.edge_set for s in plan.steps])
    nodes, edges = rows.select("seed", *carry, F.posexplode(found).alias("hop", "x")), rows.select("seed", *carry, F.explode(links).alias("x"))
    return Sample(nodes.select("seed", *carry, "x.node_set", "x.node", F.least("hop", F.lit(1)).alias("hop")), edges.select("seed", *carry, "x.edge_set", f"x.{SOURCE}", f"x.{TARGET}"))


def subgraph(sampler: Sampler, seeds: DataFrame) -> Sample:
    """One union graph around all seeds: a sample whose nodes are visited once a step."""
    one = seeds.select(F.lit(0).alias("seed"), (F.col("node") if "node" in seeds.columns else F.col("seed")).alias("node"))
    return sampler.sample(one)


def multi_subgraph(sampler: Sampler, seeds: DataFrame) -> Sample:
    """The union graph of each seed group by itself: ``seeds(seed, node)``."""
    return sampler.sample(seeds)


def with_features(sample: Sample, graph: Graph, node_set: str, features: Sequence[str]) -> DataFrame:
    """The sample's nodes of one set joined with their features, last, by key."""
    key = graph.key(node_set)
    mine = sample.nodes.where(F.col("node_set") == node_set).select("seed", "node")
    rows = graph.nodes[node_set].select(F.col(key).cast("string").alias("node"), *features)
    return mine.join(rows, "node").select("seed", "node", *features)


def node_order(sample: Sample, visits: bool = False) -> DataFrame:
    """Adds ``idx``, the node's dense number in its sample and set, by key; with ``visits`` by hop first, as they are reached."""
    line = Window.partitionBy("seed", "node_set").orderBy(*["hop"] * visits, "node")
    return sample.nodes.withColumn("idx", F.row_number().over(line) - 1)


def seed_labels(sample: Sample, seeds: DataFrame, seed_set: str) -> DataFrame:
    """``(seed, node_set, node, is_seed)``: marks each sample's own seeds, ``seeds(seed[, node])``, among its nodes."""
    own = seeds.select("seed", (F.col("node") if "node" in seeds.columns else F.col("seed")).cast("string").alias("node"), F.lit(seed_set).alias("node_set"), F.lit(1).alias("__own")).distinct()
    marked = sample.nodes.join(own, ["seed", "node_set", "node"], "left")
    return marked.select("seed", "node_set", "node", F.coalesce("__own", F.lit(0)).alias("is_seed"))


def packed(sample: Sample) -> DataFrame:
    """One row a sample: its nodes and edges as sorted arrays of structs."""
    n = sample.nodes.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("node_set", "node"))).alias("nodes"))
    e = sample.edges.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("edge_set", SOURCE, TARGET))).alias("edges"))
    return n.join(e, "seed", "left")


def typed_rows(sample: Sample, graph: Graph, properties: dict[str, Sequence[str]]) -> DataFrame:
    """Nodes and edges in one table: ``(seed, element, set_name, node, source, target, properties)``.

    A node set's named features are a JSON text; sets without any have an empty object.
    """
    none = F.lit(None).cast("string")
    out = [sample.edges.select("seed", F.lit("edge").alias("element"), F.col("edge_set").alias("set_name"), none.alias("node"), SOURCE, TARGET, F.lit("{}").alias("properties"))]
    for n in graph.schema.node_sets:
        mine = sample.nodes.where(F.col("node_set") == n)
        bag = F.lit("{}")
        if properties.get(n):
            rows = graph.nodes[n].select(F.col(graph.key(n)).cast("string").alias("node"), F.to_json(F.struct(*properties[n])).alias("bag"))
            mine, bag = mine.join(rows, "node", "left"), F.coalesce("bag", F.lit("{}"))
        out.append(mine.select("seed", F.lit("node").alias("element"), F.lit(n).alias("set_name"), "node", none.alias(SOURCE), none.alias(TARGET), bag.alias("properties")))
    return reduce(DataFrame.unionByName, out)


def hop_sql(plan_tables: Sequence[tuple[str, str, str, str, int]], seeds_sql: str, salt: str | None = None) -> str:
    """Spark SQL text of a chain of hops, each a CTE: (table, from column, to column, edge key, width).

    A hop's choice is made per parent node and shared by all seeds that reach it.
    """
    ctes = [f"h0 AS (SELECT seed, node FROM ({seeds_sql}))"]
    edges = []
    for i, (table, a, b, key, width) in enumerate(plan_tables, 1):
        order = f"md5(concat('{salt}|{i}|', {key})), {key}, {b}" if salt else f"{b}, {key}"
        ctes.append(f"e{i} AS (SELECT * FROM (SELECT {a} AS a, {b} AS b, row_number() OVER (PARTITION BY {a} ORDER BY {order}) AS n FROM {table}) t WHERE n <= {width})")
        ctes.append(f"h{i} AS (SELECT DISTINCT h.seed, e.a, e.b AS node FROM h{i - 1} h JOIN e{i} e ON h.node = e.a)")
        edges.append(f"SELECT seed, {i} AS hop, a AS source, node AS target FROM h{i}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(edges)}"
