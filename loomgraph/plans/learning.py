"""Evaluation metrics and message passing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import evaluation as ev
from loomgraph.operators import propagate as pr
from loomgraph.sources.tables import trade_graph


def _scored(spark, sf_dir):
    """Order lines scored by their discount against a returned label."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.least(F.lit(0.9999), F.col("l_discount") * 5 + F.col("l_quantity") / 120)
    return l.select(s.alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), "l_extendedprice", "l_quantity")


def roc_auc(spark, sf_dir):
    return ev.roc_auc(ev.binned_curve(_scored(spark, sf_dir), "score", "label", 1000)).select(F.round("roc_auc", 9).alias("roc_auc"))


def pr_auc(spark, sf_dir):
    return ev.pr_auc(ev.binned_curve(_scored(spark, sf_dir), "score", "label", 1000)).select(F.round("pr_auc", 9).alias("pr_auc"))


def threshold_table(spark, sf_dir):
    t = ev.threshold_table(ev.binned_curve(_scored(spark, sf_dir), "score", "label", 20))
    return t.select(F.col("bin").cast("long").alias("bin"), "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")])


def class_auc(spark, sf_dir):
    """One-vs-rest AUC per return flag, and their mean."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("score", F.col("l_quantity") / 51)
    out = None
    for c in ("A", "N", "R"):
        d = l.select("score", F.when(F.col("l_returnflag") == c, 1).otherwise(0).alias("label"))
        a = ev.roc_auc(ev.binned_curve(d, "score", "label", 500)).select(F.lit(c).alias("class"), F.col("roc_auc").alias("auc"))
        out = a if out is None else out.unionByName(a)
    both = out.unionByName(out.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("class"), "auc"))
    return both.select("class", F.round("auc", 9).alias("auc"))


def ranking_metrics(spark, sf_dir):
    """In each order the first line against the others, by quantity."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    first = l.groupBy("l_orderkey").agg(F.min(key).alias("k"))
    rows = l.join(first, "l_orderkey").select("l_orderkey", "l_quantity", (key == F.col("k")).alias("positive"))
    return ev.ranking(rows, "l_orderkey", "l_quantity", "positive").select(*[F.round(c, 9).alias(c) for c in ("mrr", "hit_at_1", "hit_at_5", "auc")])


def accuracy(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("guess", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return ev.accuracy(s, "label", "guess").select("n", F.round("accuracy", 9).alias("accuracy"))


def rmse_r2(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("guess", F.col("l_quantity") * 1500.0)
    return ev.regression(s, "l_extendedprice", "guess").select("n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


def gcn_propagate(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    e = g.edges["supplied_by"].select("source", (F.col("target") + 10_000_000).alias("target"))
    x = g.nodes["part"].select("id", F.col("retailprice").alias("x")).unionByName(g.nodes["supplier"].select((F.col("id") + 10_000_000).alias("id"), F.col("acctbal").alias("x")))
    return pr.gcn(e, x).select("id", F.round("y", 5).alias("y"))


def gin_propagate(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    e = g.edges["supplied_by"].select("source", (F.col("target") + 10_000_000).alias("target"))
    x = g.nodes["part"].select("id", F.col("retailprice").alias("x")).unionByName(g.nodes["supplier"].select((F.col("id") + 10_000_000).alias("id"), F.col("acctbal").alias("x")))
    return pr.gin(e, x, 0.5).select("id", F.round("y", 4).alias("y"))


def mean_pool(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    out = pr.pool(g.edges["placed"].select(F.col("target").alias("source"), F.col("source").alias("target")), g.nodes["orders"].select("id", F.col("totalprice").alias("x")))
    return out.select("id", F.round("total", 4).alias("total"), F.round("mean", 7).alias("mean"), "high")


def attention_pool(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    e = g.edges["contains"].select("source", "target", (F.col("quantity") / 10).alias("score"))
    return pr.attention_pool(e, g.nodes["orders"].select("id", F.col("totalprice").alias("x")), "score").select("id", F.round("y", 4).alias("y"))


def incidence_pool(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    out = pr.incidence_pool(g.edges["contains"].select("source", (F.col("target") + 1_000_000_000).alias("target"), "quantity"), "quantity")
    return out


def segment_softmax(spark, sf_dir):
    e = trade_graph(spark, sf_dir).edges["contains"].select("target", "ekey", (F.col("quantity") / 10).alias("score"))
    return pr.segment_softmax(e, "score").select("ekey", F.round("weight", 8).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (roc_auc, pr_auc, threshold_table, class_auc, ranking_metrics, accuracy, rmse_r2, gcn_propagate, gin_propagate, mean_pool, attention_pool, incidence_pool, segment_softmax)
}

_SCORED = "s AS (SELECT least(0.9999::DOUBLE, l_discount * 5 + l_quantity / 120) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice, l_quantity FROM lineitem)"
_CURVE = """c AS (SELECT least(CAST(floor(score * {b}) AS BIGINT), {b} - 1) AS bin, sum(label) AS p, sum(1 - label) AS n FROM {s} GROUP BY 1),
k AS (SELECT *, sum(p) OVER (ORDER BY bin DESC) AS tp, sum(n) OVER (ORDER BY bin DESC) AS fp FROM c)"""
_AUC = "(SELECT sum((tp - p / 2.0::DOUBLE) * n) / (sum(p)::DOUBLE * sum(n)) FROM k)"
_X = """e AS (SELECT DISTINCT l_partkey AS s, l_suppkey + 10000000 AS t FROM lineitem), x AS (SELECT p_partkey AS id, p_retailprice AS x FROM part UNION ALL SELECT s_suppkey + 10000000, s_acctbal FROM supplier)"""


def _one_class(c: str) -> str:
    s = f"(SELECT l_quantity / 51 AS score, CASE WHEN l_returnflag = '{c}' THEN 1 ELSE 0 END AS label FROM lineitem)"
    return f"SELECT '{c}' AS class, {_AUC.replace('FROM k', f'FROM (WITH {_CURVE.format(b=500, s=s)} SELECT * FROM k)')} AS auc"


ORACLE = {
    "roc_auc": f"WITH {_SCORED}, {_CURVE.format(b=1000, s='s')} SELECT round({_AUC}, 9) AS roc_auc",
    "pr_auc": f"""WITH {_SCORED}, {_CURVE.format(b=1000, s='s')}, r AS (SELECT bin, tp / (tp + fp)::DOUBLE AS pre, tp / (SELECT sum(p) FROM k)::DOUBLE AS rec FROM k),
d AS (SELECT pre, rec, coalesce(lag(pre) OVER (ORDER BY bin DESC), 1.0) AS pre0, coalesce(lag(rec) OVER (ORDER BY bin DESC), 0.0) AS rec0 FROM r)
SELECT round(sum((rec - rec0) * (pre + pre0) / 2), 9) AS pr_auc FROM d""",
    "threshold_table": f"""WITH {_SCORED}, {_CURVE.format(b=20, s='s')}, t AS (SELECT sum(p) AS tp_all, sum(n) AS n_all FROM k)
SELECT bin, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp_all + 1e-9::DOUBLE), 6) AS tpr, round(fp / (n_all + 1e-9::DOUBLE), 6) AS fpr, round(tp / (tp + fp + 1e-9::DOUBLE), 6) AS precision FROM k, t""",
    "class_auc": f"WITH a AS ({' UNION ALL '.join(_one_class(c) for c in 'ANR')}) SELECT class, round(auc, 9) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 9) FROM a",
    "ranking_metrics": """WITH r AS (SELECT l_orderkey AS q, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
j AS (SELECT p.q, sum(CASE WHEN n.s > p.s THEN 1 ELSE 0 END) AS above, sum(CASE WHEN n.s = p.s THEN 1 ELSE 0 END) AS equal, count(*) AS n FROM r p JOIN r n ON n.q = p.q AND n.i > 1 WHERE p.i = 1 GROUP BY p.q)
SELECT round(avg(1 / (above + 1 + equal / 2.0::DOUBLE)), 9) AS mrr, round(avg(greatest(0, least(1, (1 - above) / (equal + 1)::DOUBLE))), 9) AS hit_at_1,
round(avg(greatest(0, least(1, (5 - above) / (equal + 1)::DOUBLE))), 9) AS hit_at_5, round(avg((n - above - equal + 0.5::DOUBLE * equal) / n), 9) AS auc FROM j""",
    "accuracy": f"WITH {_SCORED} SELECT count(*) AS n, round(avg(CASE WHEN label = CASE WHEN score >= 0.5 THEN 1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM s",
    "rmse_r2": f"""WITH {_SCORED}, e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0::DOUBLE AS d FROM s)
SELECT count(*) AS n, round(sqrt(sum(d * d) / count(*)), 4) AS rmse, round(1 - sum(d * d) / (sum(y * y) - count(*) * avg(y) * avg(y)), 6) AS r2 FROM e""",
    "gcn_propagate": f"""WITH {_X}, a AS (SELECT s AS u, t AS v FROM e UNION ALL SELECT t, s FROM e UNION ALL SELECT id, id FROM x), d AS (SELECT u AS id, count(*) AS d FROM a GROUP BY u)
SELECT a.u AS id, round(sum(x.x / sqrt(dv.d)) / sqrt(any_value(du.d)), 5) AS y FROM a JOIN x ON x.id = a.v JOIN d dv ON dv.id = a.v JOIN d du ON du.id = a.u GROUP BY a.u""",
    "gin_propagate": f"""WITH {_X}, a AS (SELECT s AS u, t AS v FROM e UNION ALL SELECT t, s FROM e), n AS (SELECT u, sum(x) AS s FROM a JOIN x ON id = v GROUP BY u)
SELECT id, round(coalesce(s, 0) + x * 1.5::DOUBLE, 4) AS y FROM x LEFT JOIN n ON u = id""",
    "mean_pool": "SELECT o_custkey AS id, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 7) AS mean, max(o_totalprice) AS high FROM orders GROUP BY 1",
    "attention_pool": "SELECT l_partkey AS id, round(sum(exp(l_quantity / 10) * o_totalprice) / sum(exp(l_quantity / 10)), 4) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "incidence_pool": """SELECT l_orderkey AS id, sum(l_quantity) AS outgoing, 0.0::DOUBLE AS incoming FROM lineitem GROUP BY 1
UNION ALL SELECT l_partkey + 1000000000, 0.0, sum(l_quantity) FROM lineitem GROUP BY 1""",
    "segment_softmax": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ekey, round(exp(l_quantity / 10) / sum(exp(l_quantity / 10)) OVER (PARTITION BY l_partkey), 8) AS weight FROM lineitem",
}
