"""Graph directories are replaced whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.sources import native


def graph(spark, n, fail=False):
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 2).alias("x"))
    if fail:
        rows = rows.withColumn("x", F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long"))
    edges = spark.range(n).select(F.col("id").alias("source"), (F.col("id") % 3).alias("target"))
    return Graph.from_frames({"a": (rows, "id"), "a-b": (rows.limit(5), "id")}, {"e": (edges, "a", "a")})


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith(".") and "_SUCCESS" not in f)


def test_a_failed_write_leaves_the_old_graph(spark, tmp_path):
    path = f"{tmp_path}/g"
    native.write_graph(graph(spark, 10), path)
    native.write_statistics(spark, path, {"n": 10})
    before = files(path)
    with pytest.raises(Exception, match="lost"):
        native.write_graph(graph(spark, 30, fail=True), path)
    assert files(path) == before and os.listdir(tmp_path) == ["g"]
    assert native.read_graph(spark, path).nodes["a"].count() == 10
    native.write_graph(graph(spark, 30), path)
    assert native.read_graph(spark, path).nodes["a"].count() == 30 and os.listdir(tmp_path) == ["g"]
    assert native.read_statistics(spark, path) == {"n": 10}


def test_a_write_killed_between_its_renames_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    path, plain = f"{tmp_path}/g", native.Store.rename
    native.write_graph(graph(spark, 10), path)

    def killed(self, old, new):
        if new == "g":
            raise KeyboardInterrupt
        plain(self, old, new)

    monkeypatch.setattr(native.Store, "rename", killed)
    with pytest.raises(KeyboardInterrupt):
        native.write_graph(graph(spark, 30), path)
    monkeypatch.undo()
    assert not os.path.exists(path)
    back = native.read_graph(spark, path)
    assert back.nodes["a"].count() == 10 and native.read_schema(spark, path).node_sets.keys() == {"a", "a-b"}
    native.write_graph(back, path)  # reads what lies aside
    assert native.read_graph(spark, path).edges["e"].count() == 10 and [n for n in os.listdir(tmp_path) if "aside" in n] == []


def test_a_graph_can_be_written_over_itself(spark, tmp_path):
    path = f"{tmp_path}/g"
    native.write_graph(graph(spark, 10), path)
    native.write_graph(native.read_graph(spark, path), path)
    assert native.read_graph(spark, path).nodes["a"].count() == 10


def test_sets_whose_names_begin_alike(spark, tmp_path):
    native.write_graph(graph(spark, 10), f"{tmp_path}/g")
    back = native.read_graph(spark, f"{tmp_path}/g")
    assert (back.nodes["a"].count(), back.nodes["a-b"].count()) == (10, 5)


def test_files_by_rows(spark, tmp_path):
    assert [native.shard_count(n, 10, 4) for n in (0, 1, 10, 11, 1000)] == [1, 1, 1, 2, 4]
    native.write_graph(graph(spark, 100), f"{tmp_path}/g", shard_rows=40, count=True)
    names = [f for f in files(f"{tmp_path}/g") if f.startswith("nodesets/a-0")]
    assert names == [f"nodesets/a-{i:05d}-of-{len(names):05d}.parquet" for i in range(len(names))] and 3 <= len(names) <= 4
    assert len([f for f in files(f"{tmp_path}/g") if f.startswith("nodesets/a-b")]) == 1
