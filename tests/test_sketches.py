"""Mergeable statistics against one pass and exact values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import sketches as K


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).select(
        F.col("id"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan")).otherwise(F.pow(F.col("id") / 1000.0, 2)).alias("x"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("w"), F.col("id") % 700)).alias("word"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.lit(2)).alias("few"),
    )


def test_merged_halves_equal_one_pass(spark, table, tmp_path):
    path, columns = f"{tmp_path}/states", ["x", "word", "few"]
    K.keep(K.state(table.where("id < 5000"), columns, "day1"), path)
    K.keep(K.state(table.where("id >= 5000 AND id < 9000"), columns, "day2"), path)
    K.keep(K.state(table.where("id >= 5000"), columns, F.when(F.col("id") < 12_000, "day2").otherwise("day3")), path)  # replaces day2
    states = K.kept(spark, path)
    assert sorted(r[0] for r in states.select("shard").distinct().collect()) == ["day1", "day2", "day3"]
    total, whole = K.merged(states).cache(), K.merged(K.state(table, columns, "all"))
    a, b = ({r["feature"]: r for r in K.measures(t).collect()} for t in (total, whole))
    for f in columns:
        assert (a[f]["rows"], a[f]["missing"], a[f]["low"], a[f]["high"]) == (b[f]["rows"], b[f]["missing"], b[f]["low"], b[f]["high"])
    x = np.array([r[0] for r in table.where("x IS NOT NULL AND NOT isnan(x)").select("x").collect()])
    assert (a["x"]["rows"], a["x"]["missing"]) == (20_000, 20_000 - len(x))
    assert a["x"]["mean"] == pytest.approx(x.mean()) and a["x"]["deviation"] == pytest.approx(x.std())
    assert a["x"]["distinct"] == pytest.approx(len(x), rel=0.03) and a["few"]["distinct"] == 2
    words = table.where("word IS NOT NULL").select("word").distinct().count()
    assert a["word"]["distinct"] == pytest.approx(words, rel=0.03) and a["word"]["low"] is None and a["word"]["missing"] == 2000
    x.sort()
    for r in K.quantiles(total, [0.01, 0.25, 0.5, 0.9, 0.999]).where("feature = 'x'").collect():
        assert abs(np.searchsorted(x, r["q"]) / len(x) - r["at"]) < 0.01
    assert {r["feature"] for r in K.quantiles(total, [0.5]).collect()} == {"x", "few"}
    for r in K.ranks(total, "x", [4.0, 100.0]).collect():
        assert r["share"] == pytest.approx(np.searchsorted(x, r["value"], "right") / len(x), abs=0.01)


def test_no_rows(table):
    none = K.measures(K.merged(K.state(table.limit(0), ["x", "word"]))).collect()
    assert [(r["feature"], r["rows"], r["low"], r["mean"], r["distinct"]) for r in sorted(none)] == [("word", 0, None, None, 0), ("x", 0, None, None, 0)]


def test_summary_by_sketches_agrees_with_the_exact_one(spark, table):
    from loomgraph.graph import Graph
    from loomgraph.operators.statistics import summary

    g = Graph.from_frames({"n": (table.where("id < 4000"), "id")}, {})
    exact, quick = summary(g, 11)["n"], summary(g, 11, exact=False)["n"]
    assert exact.keys() == quick.keys() and exact["word"] == quick["word"]
    for f in ("x", "few"):
        assert exact[f]["count"] == quick[f]["count"] and len(quick[f]["quantiles"]) == 11
        assert (quick[f]["quantiles"][0], quick[f]["quantiles"][-1]) == (exact[f]["quantiles"][0], exact[f]["quantiles"][-1])
    assert quick["x"]["quantiles"] == pytest.approx(exact["x"]["quantiles"], abs=0.2)
