"""Sampling semantics on a graph small enough to write the answers down."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import sampling as S


@pytest.fixture(scope="module")
def graph(spark):
    n1 = spark.createDataFrame([(0, 10), (1, 11)], "id long, f1 long")
    n2 = spark.createDataFrame([(0, 20), (1, 21), (2, 22)], "id long, f2 long")
    e11 = spark.createDataFrame([(1, 0)], "source long, target long")
    e12 = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "source long, target long")
    e22 = spark.createDataFrame([(0, 2)], "source long, target long")
    return Graph.from_frames({"n1": (n1, "id"), "n2": (n2, "id")}, {"e11": (e11, "n1", "n1"), "e12": (e12, "n1", "n2"), "e22": (e22, "n2", "n2")})


def found(sample):
    nodes, edges = {}, {}
    for r in sample.nodes.collect():
        nodes.setdefault(r["node_set"], set()).add(r["node"])
    for r in sample.edges.collect():
        edges.setdefault(r["edge_set"], set()).add((r["source"], r["target"]))
    return nodes, edges


def seeds(spark, **more):
    return spark.createDataFrame([(0, *more.values())], ", ".join(["seed long", *[f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in more.items()]]))


def test_one_hop(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 1, 2))
    nodes, edges = found(s.sample(seeds(spark)))
    assert nodes == {"n1": {"0", "1"}, "n2": {"0", "1"}}
    assert edges == {"e11": {("1", "0")}, "e12": {("0", "0"), ("0", "1")}}


def test_two_hops(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 2, 2))
    nodes, edges = found(s.sample(seeds(spark)))
    assert nodes == {"n1": {"0", "1"}, "n2": {"0", "1", "2"}}
    assert edges == {"e11": {("1", "0")}, "e12": {("0", "0"), ("0", "1")}, "e22": {("0", "2")}}


def test_masked_edge(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 1, 2), mask_set="e12")
    nodes, _ = found(s.sample(seeds(spark, masked="0-1")))
    assert nodes["n2"] == {"0", "2"}


def test_masking_excludes_time(graph):
    with pytest.raises(ValueError):
        S.Sampler(graph, S.hop_plan(graph.schema, "n1", 1, 2), mask_set="e12", temporal={"e12": "ts"})


def test_plan_is_sorted_by_edge_set(graph):
    assert [(s.edge_set, s.reverse) for s in S.hop_plan(graph.schema, "n1", 1).steps] == [("e11", False), ("e11", True), ("e12", False)]


@pytest.mark.parametrize(
    ("at", "nodes", "e1", "e2"),
    [
        (10, {"0"}, set(), set()),
        (20, {"0", "1"}, {("0", "1")}, set()),
        (25, {"0", "1", "2"}, {("0", "1"), ("0", "2")}, {("2", "0")}),
    ],
)
def test_causal(spark, at, nodes, e1, e2):
    n1 = spark.createDataFrame([(i,) for i in range(4)], "id long")
    a = spark.createDataFrame([(0, 1, 15), (0, 2, 25), (1, 3, 35)], "source long, target long, ts long")
    b = spark.createDataFrame([(2, 0), (3, 1)], "source long, target long")
    g = Graph.from_frames({"n1": (n1, "id")}, {"e1": (a, "n1", "n1"), "e2": (b, "n1", "n1")})
    s = S.Sampler(g, S.hop_plan(g.schema, "n1", 2, 2, reverse=False), temporal={"e1": "ts"})
    got_nodes, got_edges = found(s.sample(seeds(spark, ts=at)))
    assert got_nodes["n1"] == nodes
    assert (got_edges.get("e1", set()), got_edges.get("e2", set())) == (e1, e2)


def test_random_choice_is_stable_and_bounded(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 1, 1, reverse=False), order="hash")
    first = found(s.sample(seeds(spark)))
    g = Graph(graph.schema, graph.nodes, {n: d.repartition(5) for n, d in graph.edges.items()})
    again = found(S.Sampler(g, s.plan, order="hash").sample(seeds(spark)))
    assert first == again and len(first[1]["e12"]) == 1


def test_kept_hops_give_the_same_sample(spark, graph):
    plan = S.hop_plan(graph.schema, "n1", 2, 2)
    assert found(S.Sampler(graph, plan, keep_hops=True).sample(seeds(spark))) == found(S.Sampler(graph, plan).sample(seeds(spark)))


def test_replacement_makes_a_tree(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 1, 4, reverse=False))
    rows = S.sample_tree(s, seeds(spark)).collect()
    assert len(rows) == 1 + 4 and {r["node_set"] for r in rows} == {"n1", "n2"}


def test_no_python_and_no_cartesian_in_the_plan(spark, graph):
    s = S.Sampler(graph, S.hop_plan(graph.schema, "n1", 2, 2))
    plan = s.sample(seeds(spark)).edges._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("Scan ExistingRDD")[0] and "CartesianProduct" not in plan


def test_masks_without_edge_keys_take_parallel_edges(spark):
    """A hub's list is cut before the join, yet a mask that takes three parallel edges leaves enough."""
    from loomgraph.graph import Graph
    from loomgraph.operators import sampling as S

    n = spark.range(9)
    e = spark.createDataFrame([(0, 1)] * 3 + [(0, t) for t in range(2, 9)], "source long, target long")
    g = Graph.from_frames({"n": (n, "id")}, {"e": (e, "n", "n")})
    sampler = S.Sampler(g, S.hop_plan(g.schema, "n", 1, 2, reverse=False), mask_set="e")
    seeds = spark.createDataFrame([(0, "0-1"), (0, "0-2"), (0, "x")], "node long, masked string").select(F.col("masked").alias("seed"), "node", "masked")
    got = {(r["seed"], r["target"]) for r in sampler.sample(seeds).edges.collect()}
    assert got == {("0-1", "2"), ("0-1", "3"), ("0-2", "1"), ("x", "1")}
