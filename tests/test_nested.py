"""Nested samples and time series of samples against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import nested as N
from loomgraph.operators import sampling as S
from loomgraph.operators import series


@pytest.fixture(scope="module")
def shop(spark):
    users = spark.createDataFrame([(i, f"u{i}", float(i)) for i in range(6)], "id long, name string, age double")
    items = spark.createDataFrame([(i, [i, i + 1]) for i in range(4)], "id long, codes array<int>")
    buys = spark.createDataFrame([(u, (u * 3 + k) % 5) for u in range(6) for k in range(2)], "source long, target long")  # item 4 is no node
    likes = spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "source long, target long")
    return Graph.from_frames({"users": (users, "id"), "items": (items, "id")}, {"buys": (buys, "users", "items"), "likes": (likes, "users", "users")})


def test_nested_rows_hold_what_the_long_form_says(spark, shop, tmp_path):
    sample = S.Sampler(shop, S.hop_plan(shop.schema, "users", 2, 5)).sample(shop.ids("users").select(F.col("id").alias("seed")))
    N.write_nested(N.nested(sample, shop, {"users": ["name", "age"], "items": ["codes"]}), f"{tmp_path}/s")
    back = N.read_nested(spark, f"{tmp_path}/s")
    rows = {r["seed"]: r for r in back.collect()}
    assert set(rows) == set(range(6))
    nodes, edges = sample.nodes.collect(), sample.edges.collect()
    for seed, r in rows.items():
        users, items = r["nodes"]["users"], r["nodes"]["items"]
        assert users["id"][0] == str(seed)
        for n, held in (("users", users), ("items", items)):
            assert sorted(held["id"]) == sorted(x["node"] for x in nodes if x["seed"] == seed and x["node_set"] == n)
        assert users["name"] == [f"u{i}" for i in users["id"]] and users["age"] == [float(i) for i in users["id"]]
        assert items["codes"] == [None if i == "4" else [int(i), int(i) + 1] for i in items["id"]]
        for n, ends in (("buys", items), ("likes", users)):
            e = r["edges"][n]
            found = {(users["id"][a], ends["id"][b]) for a, b in zip(e["source"], e["target"])}
            assert found == {(x["source"], x["target"]) for x in edges if x["seed"] == seed and x["edge_set"] == n}
    flat = N.nested_nodes(back, "users", ["age"])
    assert flat.where("age <> CAST(id AS DOUBLE)").count() == 0 and flat.count() == sum(len(r["nodes"]["users"]["id"]) for r in rows.values())
    assert N.nested_edges(back, "likes").count() == sum(len(r["edges"]["likes"]["source"]) for r in rows.values())


def test_only_asked_leaves_are_read(spark, shop, tmp_path):
    sample = S.Sampler(shop, S.hop_plan(shop.schema, "users", 1, 5)).sample(shop.ids("users").select(F.col("id").alias("seed")))
    N.write_nested(N.nested(sample, shop, {"users": ["name", "age"]}), f"{tmp_path}/s")
    plan = N.nested_nodes(N.read_nested(spark, f"{tmp_path}/s"), "users", ["age"])._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "age" in read and "name" not in read and "buys" not in read


def test_samples_without_edges(spark, shop):
    lone = S.Sampler(shop, S.SamplingPlan("items", ())).sample(shop.ids("items").select(F.col("id").alias("seed")))
    rows = N.nested(lone, shop, {"items": ["codes"]}).collect()
    assert len(rows) == 4 and all(r["nodes"]["users"]["id"] == [] and r["edges"]["buys"]["source"] == [] for r in rows)


@pytest.mark.parametrize("ranges", [None, 16])
def test_last_steps_of_every_ask(spark, ranges):
    rnd = random.Random(2)
    steps = [("hot", rnd.randrange(900), i) for i in range(2000)] + [("few", 5, 1), ("few", 9, 2), ("few", 9, 3), (None, 1, 1), ("few", None, 4)]
    asks = [("hot", rnd.randrange(-5, 950), i) for i in range(60)] + [("few", t, 100 + t) for t in (4, 5, 8, 9)] + [("none", 5, 200)]
    frame = spark.createDataFrame(steps, "k string, at long, v long")
    asked = spark.createDataFrame([*asks, asks[0]], "key string, until long, ask long")
    numbered = series.numbered_steps(frame, "k", "at", ["v"], ranges)
    for before, since in ((False, None), (True, None), (False, F.col("until") - 3)):
        found: dict = {}
        for r in series.steps_until(numbered, asked, ["v"], 4, since, before).collect():
            found.setdefault(r["ask"], []).append((r["nth"], r["t"], r["v"]))
        for k, until, ask in asks:
            mine = sorted((t, v) for key, t, v in steps if key == k and t is not None and (t < until if before else t <= until))[-4:]
            mine = [x for x in mine if since is None or x[0] >= until - 3]
            got = [x[1:] for x in sorted(found.get(ask, []))]
            assert got == (sorted(mine * 2) if ask == asks[0][2] else mine), (k, until)


def test_samples_get_what_was_there_at_their_seeds_time(spark, shop):
    sample = S.Sampler(shop, S.hop_plan(shop.schema, "users", 1, 5, only=["likes"])).sample(spark.createDataFrame([(7, 0), (8, 0)], "seed long, node long"))
    seeds = spark.createDataFrame([(7, 10), (8, 30)], "seed long, ts long")
    steps = spark.createDataFrame([(1, t, float(t)) for t in range(0, 50, 10)], "id long, t long, v double")
    out = {(r["seed"], r["node"]): (r["t"], r["v"]) for r in series.sample_series(sample, seeds, "users", series.numbered_steps(steps, "id", "t", ["v"]), ["v"], 3).collect()}
    assert out == {(7, "0"): ([], []), (8, "0"): ([], []), (7, "1"): ([0, 10], [0.0, 10.0]), (8, "1"): ([10, 20, 30], [10.0, 20.0, 30.0])}
