"""Schemas, the graph directory, validation, structure edge cases."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import structure, validation
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet, repaired, schema_of_table
from loomgraph.sources import native, sqltext, tables


@pytest.fixture(scope="module")
def toy(spark):
    n = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 2, [])], "id string, x long, v array<double>")
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 1.5)], "source string, target string, w double")
    return Graph.from_frames({"n": (n, "id")}, {"e": (e, "n", "n")})


def test_schema_text_round_trip(toy):
    assert GraphSchema.from_json(toy.schema.to_json()) == toy.schema


def test_schema_filter_drops_edges_of_dropped_nodes():
    s = GraphSchema({"a": NodeSet(), "b": NodeSet()}, {"ab": EdgeSet("a", "b"), "aa": EdgeSet("a", "a")})
    assert set(s.filtered(node_set=lambda n: n == "a").edge_sets) == {"aa"}


def test_two_keys_are_an_error():
    with pytest.raises(ValueError):
        NodeSet({"a": Feature("BYTES", "PRIMARY_ID"), "b": Feature("BYTES", "PRIMARY_ID")}).key()


def test_repair_guesses_key_and_meaning():
    s = repaired(GraphSchema({"n": NodeSet({"id": Feature("INTEGER_64"), "is_x": Feature("INTEGER_64"), "y": Feature("FLOAT_32")})}))
    f = s.node_sets["n"].features
    assert (f["id"].semantic, f["is_x"].semantic, f["y"].semantic) == ("PRIMARY_ID", "CATEGORICAL", "NUMERICAL")


def test_round_trip(spark, toy, tmp_path):
    native.write_graph(toy, str(tmp_path / "g"))
    back = native.read_graph(spark, str(tmp_path / "g"))
    assert back.schema == toy.schema
    assert sorted(map(str, back.nodes["n"].collect())) == sorted(map(str, toy.nodes["n"].collect()))
    assert sorted(map(str, back.edges["e"].collect())) == sorted(map(str, toy.edges["e"].collect()))


def test_dangling(spark, toy, tmp_path):
    e = toy.edges["e"].unionByName(spark.createDataFrame([("a", "zz", 2.0)], "source string, target string, w double"))
    native.write_graph(Graph(toy.schema, toy.nodes, {"e": e}), str(tmp_path / "g"))
    assert native.read_graph(spark, str(tmp_path / "g"), drop_dangling=True).edges["e"].count() == 2
    with pytest.raises(ValueError, match="zz"):
        native.read_graph(spark, str(tmp_path / "g"), strict=True)


def test_newer_version_is_refused(spark, toy, tmp_path):
    native.write_graph(toy, str(tmp_path / "g"))
    native.Store(spark, str(tmp_path / "g")).write("metadata.json", '{"version": 9}')
    with pytest.raises(ValueError):
        native.read_graph(spark, str(tmp_path / "g"))


def test_snapshots(spark, toy, tmp_path):
    a, b = Graph(toy.schema, toy.nodes, toy.edges, 1), Graph(toy.schema, toy.nodes, toy.edges, 1)
    native.write_snapshots({"s1": a, "s2": b}, str(tmp_path / "s"))
    read = native.read_snapshots(spark, str(tmp_path / "s"))
    assert set(read) == {"s1", "s2"}
    assert any("same timestamp" in t for _, t in validation.snapshot_issues(read))


def test_shard_names():
    assert native.sharded("x@2") == ["x-00000-of-00002", "x-00001-of-00002"]
    assert native.sharded("x@*.parquet") == ["x-?????-of-?????.parquet"] and native.sharded("x") == ["x"]


def test_validation_finds_repeats_and_missing_ends(spark, toy):
    n = toy.nodes["n"].unionByName(toy.nodes["n"].where("id = 'a'")).where("id <> 'b'")
    found = dict((t, s) for s, t in map(tuple, validation.issues(Graph(toy.schema, {"n": n}, toy.edges)).collect()))
    assert "node set n: 1 repeated keys" in found and "edge set e: 1 edges with an unknown source" in found
    with pytest.raises(ValueError):
        validation.check(Graph(toy.schema, {"n": n}, toy.edges))


def test_dense_index_of_text_keys(spark):
    d = spark.createDataFrame([(c,) for c in "hgfedcba"], "k string").repartition(3)
    assert [r["k"] for r in structure.dense_index(d, "k").orderBy("idx").collect()] == list("abcdefgh")


def test_adjacency_round_trip(toy):
    e = toy.edges["e"]
    assert sorted(structure.flat_edges(structure.adjacency_list(e, ["w"])).collect()) == sorted(e.select("source", "target", "w").collect())


def test_padding_needs_a_spare_node(spark):
    n, e = spark.range(3).select(F.col("id").alias("idx")), spark.createDataFrame([(0, 1)], "source_idx long, target_idx long")
    with pytest.raises(ValueError):
        structure.padded(n, e, 3, 5)
    full_n, full_e = structure.padded(n, e, 5, 4)
    assert full_n.count() == 5 and full_e.where("source_idx = 4").count() == 3


def test_timestamps_need_a_side(toy):
    with pytest.raises(ValueError):
        structure.propagate_timestamps(toy.edges["e"], None, None)


def test_mapped_drops_unnamed_sets_only_when_given(toy):
    same = toy.mapped(node_sets={"n": lambda d: d.drop("v")})
    assert "v" not in same.schema.node_sets["n"].features and set(same.edges) == {"e"}
    assert not toy.mapped(edge_sets={}).edges


def test_table_definitions(toy):
    text = "\n".join(sqltext.table_definitions(toy.schema))
    assert "PRIMARY KEY (id)" in text and "FOREIGN KEY (source) REFERENCES n (id)" in text and "ARRAY<FLOAT64>" in text


def test_composite_keys_join_into_one():
    t = tables.NodeTable("t", ("a", "b"))
    assert "concat(CAST(a AS STRING), '|', CAST(b AS STRING)) AS `id`" in tables.node_select(t)


def test_unknown_column_type_is_refused(spark):
    with pytest.raises(TypeError):
        schema_of_table(spark.sql("SELECT map(1, 2) AS m").schema)


def test_toy_statistics(spark, tmp_path):
    """The golden values of a two-node set: scalars, ragged lists, a text category."""
    from loomgraph.operators import statistics as st

    n = spark.createDataFrame([("1", ["blue"], 4, [11, 12], [[11, 12], [13, 14]]), ("2", ["red"], 5, [12, 13, 14], [[15, 16], [17, 18], [19, 20]])], "id string, f1 array<string>, f3 long, f5 array<long>, f6 array<array<long>>")
    got = st.summary(Graph.from_table(n, "n1", "id"), 4)["n1"]
    assert got["f1"]["dictionary"] == {"blue": [0, 1], "red": [1, 1]}
    assert (got["f3"]["min"], got["f3"]["max"]) == (4, 5) and got["f3"]["quantiles"] == pytest.approx([4, 13 / 3, 14 / 3, 5])
    assert (got["f5"]["min"], got["f5"]["max"]) == (11, 14) and got["f5"]["quantiles"] == pytest.approx([11, 12, 38 / 3, 14])
    assert (got["f6"]["min"], got["f6"]["max"]) == (11, 20) and got["f6"]["quantiles"] == pytest.approx([11, 14, 17, 20])
    native.write_statistics(spark, str(tmp_path), got)
    assert native.read_statistics(spark, str(tmp_path)) == got


def test_published_directory_is_read(spark, tmp_path):
    """A directory in the published layout, written by another tool: byte keys, numbered files, ids on edges."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    feature = lambda fmt, semantic, shape=None: {"format": fmt, "semantic": semantic, "shape": shape, "num_categorical_values": None, "is_utf8_string": False, "is_timeseries": False, "is_creation_time": False, "group": None}
    schema = {
        "node_sets": {
            "n1": {"features": {"#id": feature("BYTES", "PRIMARY_ID"), "f1": feature("BYTES", "CATEGORICAL", [1]), "f2": feature("FLOAT_32", "EMBEDDING", [2])}},
            "n2": {"features": {"#id": feature("INTEGER_64", "UNKNOWN"), "f6": feature("INTEGER_64", "NUMERICAL", [None, 2])}},
        },
        "edge_sets": {"e1": {"source": "n1", "target": "n1", "features": {}}, "e2": {"source": "n1", "target": "n2", "features": {"#id": feature("BYTES", "UNKNOWN")}}},
    }
    (tmp_path / "nodesets").mkdir()
    (tmp_path / "edgesets").mkdir()
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    (tmp_path / "metadata.json").write_text('{"version": 0}')
    one = lambda kind, name, data: pq.write_table(pa.table(data), tmp_path / kind / f"{name}-00000-of-00001.parquet")
    one("nodesets", "n1", {"#id": pa.array([b"1", b"2"]), "f1": [[b"blue"], [b"red"]], "f2": pa.array([[0.0, 1.0], [2.0, 3.0]], pa.list_(pa.float32()))})
    one("nodesets", "n2", {"#id": [1, 2], "f6": [[[11, 12], [13, 14]], [[15, 16], [17, 18], [19, 20]]]})
    one("edgesets", "e1", {"#source": pa.array([b"1", b"1"]), "#target": pa.array([b"1", b"2"])})
    one("edgesets", "e2", {"#source": pa.array([b"1", b"missing"]), "#target": [1, 2], "#id": pa.array([b"A", b"B"])})
    g = native.read_graph(spark, str(tmp_path), drop_dangling=True)
    assert g.schema.node_sets["n2"].key() == "#id" and g.schema.edge_sets["e2"].features["#id"].semantic == "PRIMARY_ID"
    assert [(bytes(r["#id"]), list(r["f2"])) for r in g.nodes["n1"].orderBy("#id").collect()] == [(b"1", [0.0, 1.0]), (b"2", [2.0, 3.0])]
    assert [(bytes(r["source"]), r["target"], bytes(r["#id"])) for r in g.edges["e2"].collect()] == [(b"1", 1, b"A")]
    native.write_graph(g, str(tmp_path / "again"))
    assert (tmp_path / "again" / "nodesets" / "n1-00000-of-00001.parquet").exists() or native.Store(spark, str(tmp_path / "again")).names("nodesets")[0].startswith("n1-00000-of-")
    back = native.read_graph(spark, str(tmp_path / "again"))
    assert back.schema == g.schema and back.nodes["n2"].count() == 2
    with pytest.raises(ValueError, match="missing"):
        native.read_graph(spark, str(tmp_path), strict=True)


def test_ambiguous_keys_are_refused():
    with pytest.raises(ValueError, match="look like a key"):
        repaired(GraphSchema({"n": NodeSet({"id": Feature("INTEGER_64"), "#id": Feature("BYTES")})}))
    with pytest.raises(ValueError, match="no primary id"):
        repaired(GraphSchema({"n": NodeSet({"x": Feature("INTEGER_64")})}))


def test_ranks_of_text_keys_are_spread(spark):
    from loomgraph.operators import ranges

    d = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"))
    spread = d.groupBy(ranges.cells(d, "k", ranges=16).of().alias("r")).count().collect()
    assert len(spread) == 16 and max(r["count"] for r in spread) < 1000
    assert ranges.dense_index(d, "k", ranges=16).where("idx <> CAST(substr(k, 2) AS BIGINT)").count() == 0
    empty = ranges.dense_index(d.where("k IS NULL"), "k")
    assert empty.count() == 0
    ran = ranges.running_total(spark.range(300).withColumn("v", F.lit(2)).withColumn("g", F.col("id") % 3), "id", "v", ["g"], ranges=7)
    assert ran.where("ahead <> 2 * floor(id / 3)").count() == 0


@pytest.mark.parametrize("hot", ["7L", "CAST(NULL AS BIGINT)", "CAST(7 AS STRING)"])
def test_ranks_of_a_key_on_half_of_all_rows_are_spread(spark, hot):
    from loomgraph.operators import ranges

    d = spark.range(8000).selectExpr(f"CASE WHEN id % 2 = 0 THEN {hot} ELSE id END AS k", "(id * 7919) % 8000 AS t").withColumn("k", F.col("k").cast("string" if "STRING" in hot else "long"))
    found = ranges.cells(d, "k", ["t"], 16)
    spread = [r["count"] for r in d.groupBy(found.of().alias("c")).count().collect()]
    assert max(spread) < 8000 // 6
    cells = d.select("k", "t", found.of().alias("c")).orderBy("k", "t").collect()
    assert [r["c"] for r in cells] == sorted(r["c"] for r in cells)
    want = [(r["k"], r["t"]) for r in cells]
    assert [(r["k"], r["t"]) for r in ranges.dense_index(d, "k", ranges=16, ties=["t"]).orderBy("idx").collect()] == want
    ranked = ranges.rank_within(d, "k", ["t"], ranges=16)
    place = F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1
    assert ranked.withColumn("p", place).where("p <> place").count() == 0 and ranked.count() == 8000


def test_quantiles_of_few_values(spark):
    from loomgraph.operators.statistics import quantiles

    d = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 1.0D WHEN id < 990 THEN CAST(id AS DOUBLE) WHEN id < 995 THEN NULL ELSE double('NaN') END AS x")
    x = [1.0] * 600 + [float(i) for i in range(600, 990)]
    want = np.quantile(x, np.linspace(0, 1, 11))
    assert np.allclose([r["q"] for r in quantiles(d, "x", 11).orderBy("k").collect()], want)
    assert quantiles(d.where("x IS NULL"), "x", 5).count() == 0


def test_walks_leave_the_seed_out(spark):
    """In a graph of one node set the seed is none of its negatives, not even as a fill."""
    from loomgraph.operators import negatives
    from loomgraph.operators.sampling import hop_plan

    n = spark.range(6).select(F.col("id"))
    e = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "source long, target long")
    g = Graph.from_frames({"n": (n, "id")}, {"e": (e, "n", "n")})
    found = negatives.walk_negatives(g, hop_plan(g.schema, "n", 3, None), "e", n.select(F.col("id").alias("seed")), 8, 6)
    rows = found.collect()
    assert len(rows) == 36 and all(r["seed"] != r["negative"] for r in rows)
    assert all(r["negative"] != (r["seed"] + 1) % 6 for r in rows if r["visits"])
    assert any(r["visits"] for r in rows) and any(not r["visits"] for r in rows)
