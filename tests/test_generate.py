"""Generators, datasets and the command line."""

import pytest
from pyspark.sql import functions as F

from loomgraph.__main__ import main
from loomgraph.generate import synthetic as sy
from loomgraph.graph import Graph
from loomgraph.operators import datasets, validation
from loomgraph.operators.sampling import hop_plan
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet
from loomgraph.sources.native import write_graph

SCHEMA = GraphSchema(
    {
        "a": NodeSet({"id": Feature("BYTES", "PRIMARY_ID", is_text=True), "c": Feature("BYTES", "CATEGORICAL", is_text=True), "e": Feature("FLOAT_64", "EMBEDDING", (3,)), "r": Feature("INTEGER_64", "NUMERICAL", (None,))}),
        "b": NodeSet({"id": Feature("INTEGER_64", "PRIMARY_ID"), "x": Feature("FLOAT_64", "NUMERICAL")}),
    },
    {"ab": EdgeSet("a", "b"), "bb": EdgeSet("b", "b", {"w": Feature("FLOAT_64", "NUMERICAL")})},
)


def test_synthetic_graph_is_valid_and_repeatable(spark):
    g = sy.synthetic_graph(spark, SCHEMA, sy.Sizes({"a": 12}, {"ab": 20}))
    assert [i for s, i in validation.check(g) if s == "error"] == []
    again = sy.synthetic_graph(spark, SCHEMA, sy.Sizes({"a": 12}, {"ab": 20}))
    assert sorted(map(str, g.nodes["a"].collect())) == sorted(map(str, again.nodes["a"].collect()))
    row = g.nodes["a"].first()
    assert row["c"].startswith("CAT_") and sum(x * x for x in row["e"]) == pytest.approx(1)
    assert g.edges["ab"].count() == 20


def test_signals(spark):
    d = spark.range(2000).select(F.col("id").cast("double").alias("t"))
    r = d.select(F.avg(sy.poisson(F.col("t"), rate=3.0)), F.avg(sy.white_noise(F.col("t"))), F.stddev(sy.white_noise(F.col("t"))), F.avg(sy.bernoulli(F.col("t"), p=0.25)), F.sum(sy.impulse(F.col("t"), 7))).first()
    assert r[0] == pytest.approx(3, abs=0.2) and r[1] == pytest.approx(0, abs=0.1) and r[2] == pytest.approx(1, abs=0.1)
    assert r[3] == pytest.approx(0.25, abs=0.05) and r[4] == 1.0


def test_alert_labels_are_means_of_signals(spark):
    g = sy.alert_graph(spark, 5, 8, 30, 6)
    series = {r["id"]: r["signal"] for r in g.nodes["hardware"].collect()}
    ties = {}
    for r in g.edges["hardware_to_alert"].collect():
        ties.setdefault(r["target"], []).append(series[r["source"]])
    for r in g.nodes["alerts"].collect():
        t = r["creation_time"]
        want = [x for s in ties[r["id"]] for x in s[t - 6 : t]]
        assert r["signal_regression"] == pytest.approx(sum(want) / len(want))


def test_synthetic_samples_grow_along_the_plan(spark):
    plan = hop_plan(SCHEMA, "a", 2, 2, reverse=False)
    rows = sy.synthetic_sample(SCHEMA, plan, spark, 3).collect()
    assert len(rows) == 3 * (1 + 2 + 4) and {r["node_set"] for r in rows} == {"a", "b"}


def test_datasets(spark):
    g = sy.synthetic_graph(spark, SCHEMA, sy.Sizes(default_nodes=20, default_edges=40))
    d = datasets.node_dataset(g, "b", "x", 1, 2, 0.25)
    assert d.labels.where("valid").count() == 5 and "x_SOFT_QUANTILE" not in d.features["b"].columns if "b" in d.features else True
    links = datasets.link_dataset(g, "ab", 1, 3)
    left = links.sources.edges.where("edge_set = 'ab'").select(F.split("seed", r"\|")[0].alias("s"), F.split("seed", r"\|")[1].alias("t"), "source", "target")
    assert left.where("s = source AND t = target").count() == 0 and links.links.count() > 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("loomgraph.__main__.local_session", lambda: spark)
    n = spark.createDataFrame([("p", 1.0)], "id string, x double")
    e = spark.createDataFrame([("p", "q")], "source string, target string")
    write_graph(Graph.from_frames({"n": (n, "id")}, {"e": (e, "n", "n")}), str(tmp_path / "g"))
    assert main(["validate", str(tmp_path / "g")]) == 1 and "unknown target" in capsys.readouterr().out
    assert main(["plan", str(tmp_path / "g"), "--hops", "1"]) == 0 and "-> e -> n" in capsys.readouterr().out
    assert main(["schema", str(tmp_path / "g")]) == 0 and "node set n" in capsys.readouterr().out


def test_a_graph_normalizer_fits_applies_and_names_all_sets(spark):
    from loomgraph.functions.normalize import GraphNormalizer
    from loomgraph.graph import Graph

    n = spark.createDataFrame([(i, f"w{i % 3}", float(i), [i, i]) for i in range(20)], "id long, word string, x double, v array<long>")
    m = spark.createDataFrame([(i,) for i in range(4)], "id long")
    e = spark.createDataFrame([(i, i % 4, i / 2) for i in range(20)], "source long, target long, w double")
    g = Graph.from_frames({"n": (n, "id"), "m": (m, "id")}, {"e": (e, "n", "m")})
    z = GraphNormalizer.fit(g, rows={"n": n.where("id < 10")}, quantile_count=5)
    z = GraphNormalizer.from_json(z.to_json())
    out = z.apply(g)
    schema = z.output_schema(g.schema)
    for sets, frames in ((schema.node_sets, out.nodes), (schema.edge_sets, out.edges)):
        for name, s in sets.items():
            kinds = {f.name: f.dataType for f in frames[name].schema}
            assert all(kinds[f].simpleString() == x.spark_type().simpleString() for f, x in s.features.items()), name
            assert set(kinds) == set(s.features) | ({"source", "target"} if name == "e" else set())
    assert schema.node_sets["n"].key() == "id" and out.nodes["m"].columns == ["id"]
    assert z.names("n", "word", g.schema) == ["word_INDEX"] and z.names("e", "w", g.schema) == ["w_SOFT_QUANTILE"]
    top = out.nodes["n"].agg({"x_SOFT_QUANTILE": "max"}).first()[0]
    assert top > 0.5  # rows beyond those it was fitted on
    without = GraphNormalizer.fit(g, skip=[("n", "x")])
    assert "x_SOFT_QUANTILE" not in without.apply(g).nodes["n"].columns


def test_link_batches_agree_on_their_links(spark):
    from loomgraph.graph import Graph

    a, b = spark.range(30).select("id"), spark.range(9).select("id")
    e = spark.range(60).selectExpr("id % 30 AS source", "(id * 7) % 9 AS target")
    g = Graph.from_frames({"a": (a, "id"), "b": (b, "id")}, {"e": (e, "a", "b")})
    d = datasets.link_dataset(g, "e", 1, 2, per_edge=2)
    found = datasets.link_batches(d, g.schema, 8)
    labels = {f"{r['source']}|{r['target']}|{r['k']}": r["batch"] for r in found.labels.collect()}
    n = e.distinct().count() * 2
    assert len(labels) == n // 8 * 8 and all(list(labels.values()).count(i) == 8 for i in range(n // 8))
    for stream in (found.sources, found.targets, found.negatives):
        seen = {(r["seed"], r["batch"]) for r in stream.nodes.where("seed IS NOT NULL").select("seed", "batch").distinct().collect()}
        assert seen == set(labels.items())
        rooms = stream.nodes.groupBy("batch", "node_set").count().select("node_set", "count").distinct()
        assert rooms.count() == 2  # the same room in every batch
