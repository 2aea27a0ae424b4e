"""Records, lists, drawings, reports and the linear model."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.learning import baseline
from loomgraph.operators.report import html_report
from loomgraph.sources import external, records
from loomgraph.sources.tables import trade_graph


def test_example_round_trip():
    e = {"i": [1, -2, 1 << 40], "f": [0.5, -1.5], "b": [b"x", b""], "none": []}
    assert records.decode(records.encode(e)) == e


def test_known_checksum():
    assert records.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_record_files(spark, tmp_path):
    rows = [("a", 1, [0.5, 1.0]), ("b", -7, []), ("c", None, [2.0])]
    kind = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))])
    for r in records.files_of_records(spark.createDataFrame(rows, kind), 2).collect():
        (tmp_path / f"part-{r['shard']}").write_bytes(bytes(r["content"]))
    back = records.read_examples(spark, str(tmp_path), kind, verify=True)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    with pytest.raises(ValueError):
        list(records.frames(records.framed(b"abc")[:-5]))


def test_lists_and_drawings(spark):
    g = external.from_lists(spark, {"n": [("a", 1), ("b", 2)]}, {"n": "id string, x long"}, {"e": ([("a", "b")], "n", "n")}, {"n": "id"})
    assert external.edge_lists(g) == {"e": [("a", "b")]}
    assert '"n:a" -> "n:b" [label="e"]' in external.dot_text(g) and '"n" -> "n"' in external.schema_dot(g)
    assert set(external.flat_columns(g)) == {"nodes__n__id", "nodes__n__x", "edges__e__source", "edges__e__target"}
    page = html_report(g)
    assert "node set n" in page and "source degree" in page


def test_split_column(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    out = external.split_column(F.col("k"), ids(1), ids(2), ids(3), spark.createDataFrame([(i,) for i in range(1, 5)], "k long"))
    assert {r["k"]: r["#split"] for r in out.collect()} == {1: "train", 2: "valid", 3: "test", 4: ""}


def test_linear_node_model(spark):
    g = trade_graph(spark, "/root/testdata/sf0.001")
    small = g.project(g.schema.filtered(node_set=lambda n: n in ("customer", "orders"), edge_set=lambda n: n == "placed"))
    m = baseline.train_node_model(small, "customer", "segment")
    assert 0 <= m.metric["accuracy"] <= 1 and "placed_out_degree" in m.columns
    m = baseline.train_node_model(small, "customer", "acctbal", classes=False)
    assert m.metric["rmse"] > 0
