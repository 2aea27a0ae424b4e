"""Distances by sketches and bounded searches against all-pairs search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import statistics


def all_pairs(nodes, pairs):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in nodes:
        d, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for b in near[a] - d.keys():
                d[b] = d[a] + 1
                queue.append(b)
        out[s] = d
    return out


def some_graph(kind):
    rnd = random.Random(3)
    if kind == "path":
        return list(range(11)), [(i, i + 1) for i in range(10)]
    nodes = list(range(60))
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(i, i + 1) for i in range(45, 50)] + [(50, 45), (55, 56), (5, 5), (3, 4), (4, 3)]
    return nodes, pairs


@pytest.mark.parametrize("kind", ["path", "mixed"])
def test_bounds_close_on_the_true_distances(spark, kind):
    nodes, pairs = some_graph(kind)
    d = all_pairs(nodes, pairs)
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    edges = spark.createDataFrame([*pairs, (nodes[0], 999)], "source long, target long")  # an end that is no node
    inside = edges.where("target < 999")
    far = {n: max(d[n].values()) for n in nodes}
    found = {r["id"]: (r["distance"], r["reached"]) for r in statistics.reach(ids, inside).collect()}
    assert found == {n: (far[n], len(d[n])) for n in nodes}
    bounds = {r["id"]: (r["lower"], r["upper"]) for r in statistics.eccentricity_bounds(ids, edges).collect()}
    assert bounds == {n: (far[n], far[n]) for n in nodes}
    want = {}
    for n in nodes:
        c = min(d[n])
        want[c] = (len(d[n]), max(far[n], want.get(c, (0, 0))[1]))
    assert {r["component"]: (r["n"], r["diameter"]) for r in statistics.diameters(ids, edges).collect()} == want


def test_coarse_sketches_never_say_too_much(spark):
    nodes, pairs = some_graph("mixed")
    d = all_pairs(nodes, pairs)
    ids, edges = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(pairs, "source long, target long")
    for r in statistics.reach(ids, edges, lg=4).collect():
        assert r["distance"] <= max(d[r["id"]].values())
    first = statistics.eccentricity_bounds(ids, edges, rounds=1, lg=4).collect()
    assert all(r["lower"] <= max(d[r["id"]].values()) <= r["upper"] for r in first)
    assert statistics.diameters(ids, edges, lg=4).agg(F.max("diameter")).first()[0] == max(max(x.values()) for x in d.values())


def test_no_nodes(spark):
    ids, edges = spark.createDataFrame([], "id long"), spark.createDataFrame([], "source long, target long")
    assert statistics.diameters(ids, edges).count() == 0 and statistics.reach(ids, edges).count() == 0
