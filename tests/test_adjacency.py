"""Neighbours by place: draws, stored lists, hubs; values as of a time for keys that fill many ranges."""

import bisect
import random
from collections import Counter
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import adjacency as A
from loomgraph.operators import sampling as S
from loomgraph.operators.ranges import cells
from loomgraph.operators.structure import as_of


def test_every_set_of_places_is_equally_likely(spark):
    draw = lambda j: S.hash_long(F.col("id"), j)
    rows = spark.range(7000).select(A.distinct_places(3, F.lit(6), draw).alias("p")).collect()
    found = Counter(tuple(r["p"]) for r in rows)
    assert set(found) == set(combinations(range(6), 3))
    chi = sum((n - 350) ** 2 / 350 for n in found.values())
    assert chi < 43.8  # 19 degrees of freedom, one in a thousand
    small = spark.range(5).select("id", A.distinct_places(3, F.col("id"), draw).alias("p"), A.first_places(3, F.col("id")).alias("f"))
    assert [r["p"] for r in small.where("id < 4").collect()] == [[], [0], [0, 1], [0, 1, 2]]
    assert all(len(set(r["p"])) == 3 == len(r["f"]) and max(r["p"]) < 4 for r in small.where("id = 4").collect())


@pytest.fixture(scope="module")
def hub(spark):
    """A node with 50,000 edges, 2,000 nodes that lead to it, and some with few."""
    to = spark.range(2000).select(F.col("id").alias("source"), F.lit(-1).cast("long").alias("target"))
    out = spark.range(50_000).select(F.lit(-1).cast("long").alias("source"), (F.col("id") + 10_000).alias("target"))
    few = spark.range(300).select((F.col("id") % 7 + 5000).alias("source"), (F.col("id") % 40 + 10_000).alias("target"))
    n = spark.range(70_000).select((F.col("id") - 1).alias("id"))
    e = to.unionByName(out).unionByName(few).withColumn("ekey", F.concat_ws("/", "source", "target", F.monotonically_increasing_id()))
    return Graph.from_frames({"n": (n, "id")}, {"e": (e, "n", "n")})


def test_a_hub_gives_each_arrival_its_own_few(spark, hub):
    plan = S.hop_plan(hub.schema, "n", 2, [1, 4], reverse=False)
    sampler = S.Sampler(hub, plan, order="hash", edge_key={"e": "ekey"})
    seeds = spark.range(2000).select(F.col("id").alias("seed"))
    edges = sampler.sample(seeds).edges.where("source = '-1'")
    counts = edges.groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("target").alias("d"))
    assert counts.where("n <> 4 OR d <> 4").count() == 0 and counts.count() == 2000
    assert edges.select("target").distinct().count() > 6500  # 8000 draws of 50,000
    placed = A.adjacency(hub.edges["e"], key="ekey", ranges=16).edges
    found = cells(hub.edges["e"], "source", ["target", "ekey"], 16)
    assert hub.edges["e"].groupBy(found.of().alias("c")).count().agg(F.max("count")).first()[0] < 50_000 / 6
    mine = placed.where("node = -1")
    assert mine.where("place <> neighbor - 10000").count() == 0 and mine.count() == 50_000


def _exchanges_over_edges(plan: str, table: str) -> list[str]:
    """Exchanges between the scans of a table and the join above them."""
    lines = [line for line in plan.splitlines() if line.strip(" :+-")]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            at = depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < at:
                    at = depth(up)
                    if "Join" in up:
                        break
                    found += [up] * ("Exchange" in up)
    return found


def test_stored_lists_are_joined_as_they_lie(spark, hub, tmp_path):
    plan = S.hop_plan(hub.schema, "n", 2, 3, reverse=False)
    plain = S.Sampler(hub, plan, order="hash", edge_key={"e": "ekey"})
    lists = A.store(A.adjacency(hub.edges["e"], key="ekey"), "loom_hub", 4, str(tmp_path))
    kept = replace(plain, stored={("e", False): lists})
    seeds = spark.range(5000, 5040).select(F.col("id").alias("seed"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = kept.sample(seeds).edges
        text = edges._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") >= 4 and _exchanges_over_edges(text, "loom_hub_edges") == []
        assert _exchanges_over_edges(text, "loom_hub_degrees") == []
        rows = lambda d: sorted(map(tuple, d.collect()))
        assert rows(edges) == rows(plain.sample(seeds).edges) != []
        first = replace(plain, order="first")
        assert rows(replace(first, stored=kept.stored).sample(seeds).edges) == rows(first.sample(seeds).edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    again = A.stored(spark, "loom_hub")
    starts = again.degrees.orderBy("node").collect()
    assert [r["start"] for r in starts] == [sum(x["degree"] for x in starts[:i]) for i in range(len(starts))][: len(starts)]
    for t in ("edges", "degrees"):
        spark.sql(f"DROP TABLE loom_hub_{t}")


def test_draws_respect_time_and_masks(spark):
    e = [(0, 10 + i, i if i % 5 else None, f"k{i}") for i in range(40)] + [(1, 9, 3, "p0"), (1, 9, 4, "p1"), (1, 8, 5, "p2")]
    edges = spark.createDataFrame(e, "source long, target long, ts long, ekey string")
    n = spark.range(60).select("id")
    g = Graph.from_frames({"n": (n, "id")}, {"e": (edges, "n", "n")})
    plan = S.hop_plan(g.schema, "n", 1, 6, reverse=False)
    seeds = spark.createDataFrame([(i, i % 2, i - 2) for i in range(60)], "seed long, node long, ts long")
    timed = S.Sampler(g, plan, order="hash", temporal={"e": "ts"}).sample(seeds).edges.collect()
    for i in range(60):
        may = {t for s, t, ts, _ in e if s == i % 2 and ts is not None and ts <= i - 2}
        mine = [int(r["target"]) for r in timed if r["seed"] == i]
        assert set(mine) <= may and len(mine) == min(6, len(may))
    masked = seeds.select("seed", "node", F.when(F.col("node") == 0, F.concat(F.lit("k"), F.col("seed") % 40)).otherwise("p1").alias("masked"))
    keyed = S.Sampler(g, S.hop_plan(g.schema, "n", 1, 39, reverse=False), order="hash", mask_set="e", edge_key={"e": "ekey"}).sample(masked).edges.collect()
    for i in range(0, 60, 2):
        assert {int(r["target"]) for r in keyed if r["seed"] == i} == {10 + j for j in range(40) if j != i % 40}
    pair = seeds.where("node = 1").select("seed", "node", F.lit("1-9").alias("masked"))  # both parallel edges
    plain = S.Sampler(g, plan, order="hash", mask_set="e").sample(pair).edges.collect()
    assert {r["target"] for r in plain} == {"8"} and len(plain) == 30


@pytest.mark.parametrize("ranges", [None, 16])
def test_as_of_of_one_key_with_all_facts(spark, ranges):
    rnd = random.Random(5)
    facts = [("hot", rnd.randrange(5000), float(i)) for i in range(3000)] + [("few", 10, 1.0), ("few", 20, 2.0), ("few", 15, None), (None, 5, 7.0)]
    asks = [("hot", rnd.randrange(-100, 5200), i) for i in range(500)] + [("few", t, 1000 + t) for t in (5, 10, 17, 99)] + [("none", 3, 2000), (None, 6, 2001)]
    f, a = spark.createDataFrame(facts, "k string, t long, v double"), spark.createDataFrame(asks, "k string, t long, ask long")
    both = f.select("k", "t").unionByName(a.select("k", "t"))
    if ranges:
        spread = both.groupBy(cells(both, "k", ["t"], ranges).of().alias("c")).count().collect()
        assert max(r["count"] for r in spread) < 3500 / 6
    for early in (True, False):
        found = {r["ask"]: r["v"] for r in as_of(f, a, "k", "t", "v", early, ranges).collect()}
        for k, t, i in asks:
            mine = sorted((x, v) for key, x, v in facts if key == k and v is not None)
            n = bisect.bisect_right(mine, (t, float("inf")))
            assert found[i] == (mine[n - 1][1] if n else mine[0][1] if mine and early else None), (k, t)
    assert as_of(f, a.drop("ask"), "k", "t", "v").where("ask IS NULL").count() == len(asks)
