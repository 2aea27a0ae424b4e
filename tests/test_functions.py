"""Golden values of normalizers, time series, histograms and metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import normalize as nz
from loomgraph.functions import timeseries as ts
from loomgraph.functions import vectors as vec
from loomgraph.operators import evaluation as ev
from loomgraph.operators import negatives, propagate
from loomgraph.operators import statistics as st
from loomgraph.schema import Feature


def test_soft_quantile_golden(spark):
    d = spark.createDataFrame([(float(x),) for x in (-1, 0, 1, 2, 2.25, 2.5, 3, 4)], "x double")
    got = [r[0] for r in nz.normalized(d, {"x": [nz.SoftQuantile([0, 2, 2.5, 3])]}).collect()]
    assert got == pytest.approx([v / 3 - 0.5 for v in (-0.5, 0, 0.5, 1, 1.5, 2, 3, 5)])


def test_dictionary_index_unknown_word(spark):
    d = spark.createDataFrame([("a",), ("zz",), (None,)], "s string")
    assert [r[0] for r in nz.normalized(d, {"s": [nz.DictionaryIndex(["b", "a"])]}).collect()] == [1, 2, 2]


def test_sinusoid_needs_an_even_dimension():
    with pytest.raises(ValueError):
        nz.Sinusoid(3).frequencies()


def test_normalizer_text_round_trip():
    z = nz.SoftQuantile([1.0, 2.0])
    assert nz.from_json(z.to_json()) == z


def test_choice_by_meaning():
    f = {"k": Feature("BYTES", "PRIMARY_ID"), "c": Feature("BYTES", "CATEGORICAL"), "n": Feature("FLOAT_32", "NUMERICAL"), "m": Feature("BOOL", "MASK")}
    chosen = nz.choose(f, {"c": ["x"]}, {"n": [0.0, 1.0]})
    assert {k: type(v[0]).__name__ for k, v in chosen.items()} == {"c": "DictionaryIndex", "n": "SoftQuantile", "m": "Identity"}
    with pytest.raises(KeyError):
        nz.choose(f, {}, {})


def test_calendar_before_the_epoch(spark):
    d = ts.calendar_columns(spark.createDataFrame([(-1,)], "t long"), "t").first()
    assert (d["t_second"], d["t_minute"], d["t_hour"], d["t_day_of_week"], d["t_month"], d["t_year"]) == (59, 59, 23, 2, 12, 1969)


def test_pad_cap_and_mask(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([],)], "v array<long>")
    got = d.select(ts.pad_and_cap(F.col("v"), 2, F.lit(0).cast("long")).alias("p"), ts.step_mask(F.col("v"), 4).alias("m")).collect()
    assert got[0]["p"] == [2, 3] and got[0]["m"] == [False, True, True, True]
    assert got[1]["p"] == [0, 0] and got[1]["m"] == [False] * 4


def test_causal_cut(spark):
    d = spark.createDataFrame([([1, 2, 5], [10, 20, 50])], "t array<long>, v array<long>")
    assert d.select(ts.causal_cut(F.col("t"), F.col("v"), F.lit(2), 1)).first()[0] == [20]


def test_unit_vector_of_zero(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vec.unit(F.col("v"))).first()[0] == [0.0, 0.0]


def test_ranking_golden(spark):
    rows = [(0, 0.5, True), (1, 0.8, True)] + [(q, s, False) for q in (0, 1) for s in (0.2, 0.6, 0.7, 0.9)]
    m = ev.ranking(spark.createDataFrame(rows, "q int, s double, p boolean"), "q", "s", "p").first()
    assert (m["hit_at_5"], m["auc"]) == (1.0, 0.5) and m["hit_at_1"] == 0.0
    ties = [(q, 0.5, True) for q in (0, 1)] + [(q, 0.5, False) for q in (0, 1) for _ in range(8)]
    m = ev.ranking(spark.createDataFrame(ties, "q int, s double, p boolean"), "q", "s", "p").first()
    assert m["mrr"] == pytest.approx(0.2) and m["hit_at_1"] == pytest.approx(1 / 9) and m["hit_at_5"] == pytest.approx(5 / 9)


def test_perfect_auc(spark):
    d = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0), (0.2, 0)], "s double, y int")
    c = ev.binned_curve(d, "s", "y", 100)
    assert ev.roc_auc(c).first()[0] == 1.0 and ev.pr_auc(c).first()[0] == 1.0


def test_histogram_rules(spark):
    assert st.bin_edges(3, 3) == [3, 3]
    assert st.bin_edges(0, 2, 32, integer=True) == [0, 1, 2, 3]
    assert len(st.bin_edges(1, 1000, 3, log=True)) == 4
    empty = st.histogram(spark.createDataFrame([], "x long"), "x")
    assert empty.count() == 0
    one = st.histogram(spark.createDataFrame([(5,), (5,)], "x long"), "x").collect()
    assert [tuple(r) for r in one] == [(0, 5.0, 5.0, 2)]


def test_quantiles_skip_nan(spark):
    d = spark.createDataFrame([(1.0,), (3.0,), (math.nan,), (None,)], "x double")
    assert [r["q"] for r in st.quantiles(d, "x", 3, exact=True).orderBy("k").collect()] == [1.0, 2.0, 3.0]
    assert [r["q"] for r in st.quantiles(d, "x", 2, exact=False).orderBy("k").collect()] == [1.0, 3.0]
    assert st.quantiles(d.where("x > 9"), "x", 3, exact=True).count() == 0


def test_components_of_a_long_chain(spark):
    ids = spark.range(40)
    e = spark.range(30).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = {r["id"]: r["component"] for r in st.components(ids, e).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == i for i in range(31, 40))


def test_components_of_a_long_path_of_random_ids(spark):
    order = list(range(3000))
    random.Random(2).shuffle(order)
    e = spark.createDataFrame(list(zip(order, order[1:])), "source long, target long")
    got = st.components(spark.range(3002), e).collect()
    assert {r["id"]: r["component"] for r in got} == {i: 0 if i < 3000 else i for i in range(3002)} and len(got) == 3002


def test_component_rounds_on_few_edges_shuffle_nothing(spark, monkeypatch):
    """Each shuffle of a round leaves a thread and its memory in the driver for a minute; only the first step, which deals out the edges, has one."""
    from loomgraph.operators import connected

    plans, cut = [], connected.cut
    monkeypatch.setattr(connected, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    rnd = random.Random(5)
    edges = [(rnd.randrange(-150, 150), rnd.randrange(-150, 150)) for _ in range(290)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    got = {}
    for most in (connected.TASK_EDGES, 10):  # in one task, and dealt to several
        monkeypatch.setattr(connected, "TASK_EDGES", most)
        got[most] = {r["node"]: r["root"] for r in connected.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got[most] == want
        if most > 10:
            assert len(plans) > 2 and not any("Exchange" in p for p in plans[1:])


def test_split_sizes(spark):
    d = spark.range(101).select(F.col("id").alias("k"), (F.col("id") % 7).alias("t"))
    assert negatives.split_random(d, "k", 0.2).where("valid").count() == 20
    late = negatives.split_temporal(d, "t", "k", 0.1).where("valid").collect()
    assert len(late) == 10 and {r["t"] for r in late} == {6}


def test_gcn_of_one_edge(spark):
    e = spark.createDataFrame([(0, 1)], "source long, target long")
    x = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "id long, x double")
    assert {r["id"]: round(r["y"], 9) for r in propagate.gcn(e, x).collect()} == {0: 2.0, 1: 2.0, 2: 5.0}
