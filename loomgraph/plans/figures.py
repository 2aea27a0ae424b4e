"""Statistics and topology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import sampling as S
from loomgraph.operators import statistics as st
from loomgraph.plans.samples import _FIRST, _sampler, _seeds
from loomgraph.sources.tables import trade_graph


def degrees(spark, sf_dir):
    """Both degrees of every part and supplier key in the supplied_by set."""
    g = trade_graph(spark, sf_dir)
    e = g.edges["supplied_by"]
    ids = g.ids("part").unionByName(g.ids("supplier")).distinct()
    return st.degrees(ids, e)


def in_degree(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return st.end_degrees(g.ids("part"), g.edges["contains"], "target")


def degree_histogram(spark, sf_dir):
    d = in_degree(spark, sf_dir)
    return st.histogram(d, "degree", bins=16).select(F.col("bin").cast("long").alias("bin"), "lo", "hi", "n")


def price_histogram(spark, sf_dir):
    d = trade_graph(spark, sf_dir).nodes["orders"]
    return st.histogram(d, "totalprice", bins=8).select(F.col("bin").cast("long").alias("bin"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


def degree_distribution(spark, sf_dir):
    return in_degree(spark, sf_dir).groupBy("degree").agg(F.count("*").alias("n"))


def topology(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return st.topology(g.nodes, g.edges)


def density(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return st.density(g.ids("part").unionByName(g.ids("supplier")).distinct(), g.edges["supplied_by"])


def isolated_nodes(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return st.isolated(g.ids("customer"), [(g.edges["placed"], "source")])


def homophily(spark, sf_dir):
    """Share of order lines whose order's customer and supplier live in one nation."""
    g = trade_graph(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("target"))
    e = lines.join(g.edges["placed"].select("source", F.col("target").alias("o")), "o").select("source", "target")
    label = lambda s: g.nodes[s].select("id", F.col("nation").alias("label"))
    return st.homophily(e, label("customer"), label("supplier")).select("edges", F.round("homophily", 9).alias("homophily"))


def feature_minmax(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    parts = [st.feature_statistics(g.nodes[n], c).select(F.lit(n).alias("node_set"), "feature", "n", "low", "high", "missing") for n, c in (("orders", ["totalprice", "ts"]), ("part", ["size", "retailprice"]), ("customer", ["acctbal"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feature_quantiles(spark, sf_dir):
    q = st.quantiles(trade_graph(spark, sf_dir).nodes["orders"], "totalprice", 11, exact=True)
    return q.select(F.col("k").cast("long").alias("k"), F.round("q", 6).alias("q"))


def array_statistics(spark, sf_dir):
    """Flattened extremes of the embedding vectors, and their quartiles."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = st.feature_statistics(v, ["embedding"]).select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    q = st.quantiles(st.flat_values(v, "embedding"), "x", 5, exact=True)
    q = q.agg(*[F.round(F.max(F.when(F.col("k") == k, F.col("q"))), 6).alias(f"q{k}") for k in range(5)])
    return e.crossJoin(F.broadcast(q))


def dictionary(spark, sf_dir):
    d = st.dictionary(trade_graph(spark, sf_dir).nodes["part"], "type", max_items=100, min_count=2)
    return d.select("value", "n", F.col("idx").cast("long").alias("idx"))


def padding(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    out = s.sample(_seeds(s))
    n = st.padding(out.nodes, "seed", "node_set").select(F.lit("nodes").alias("kind"), "name", "size")
    return n.unionByName(st.padding(out.edges, "seed", "edge_set").select(F.lit("edges").alias("kind"), "name", "size"))


def connected_components(spark, sf_dir):
    """Customers, nations and regions as one graph; nations and regions have their own ranges of ids."""
    g = trade_graph(spark, sf_dir)
    e = g.edges["customer_in"].select("source", (F.lit(1_000_000_000) + F.col("target")).alias("target"))
    r = g.edges["in_region"].select((F.lit(1_000_000_000) + F.col("source")).alias("source"), (F.lit(2_000_000_000) + F.col("target")).alias("target"))
    ids = g.ids("customer").unionByName(g.ids("nation").select((F.col("id") + 1_000_000_000).alias("id"))).unionByName(g.ids("region").select((F.lit(2_000_000_000) + F.col("id")).alias("id")))
    return st.components(ids, e.unionByName(r))


QUERIES = {
    f.__name__: f
    for f in (
        degrees, in_degree, degree_histogram, price_histogram, degree_distribution, topology, density, isolated_nodes, homophily,
        feature_minmax, feature_quantiles, array_statistics, dictionary, padding, connected_components,
    )
}

_IN = "SELECT p_partkey AS id, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"
_HIST = """WITH d AS ({values}), r AS (SELECT min(x) AS lo, max(x) AS hi FROM d), {edges},
b AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM s),
k AS (SELECT * FROM b WHERE hi IS NOT NULL)
SELECT bin, {lo} AS lo, {hi} AS hi, (SELECT count(*) FROM d WHERE x >= k.lo AND (x < k.hi OR (k.bin = (SELECT max(bin) FROM k) AND x <= k.hi))) AS n FROM k"""

ORACLE = {
    "degrees": """WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem), i AS (SELECT p_partkey AS id FROM part UNION SELECT s_suppkey FROM supplier)
SELECT id, (SELECT count(*) FROM e WHERE s = id) AS out_degree, (SELECT count(*) FROM e WHERE t = id) AS in_degree FROM i""",
    "in_degree": _IN,
    "degree_histogram": _HIST.format(
        values=f"SELECT CAST(degree AS DOUBLE) AS x FROM ({_IN})",
        edges="s AS (SELECT DISTINCT e FROM (SELECT CASE WHEN hi - lo < 16 THEN lo + i ELSE round_even(lo + (hi - lo) * i / 16, 0) END AS e, lo, hi, i FROM r, range(0, 17) t(i)) WHERE hi - lo >= 16 OR e <= hi + 1)",
        lo="lo", hi="hi",
    ),
    "price_histogram": _HIST.format(values="SELECT o_totalprice AS x FROM orders", edges="s AS (SELECT lo + (hi - lo) * i / 8 AS e FROM r, range(0, 9) t(i))", lo="round(lo, 6)", hi="round(hi, 6)"),
    "degree_distribution": f"SELECT degree, count(*) AS n FROM ({_IN}) GROUP BY degree",
    "topology": """SELECT 'nodes' AS kind, 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nodes', 'orders', count(*) FROM orders UNION ALL SELECT 'nodes', 'part', count(*) FROM part
UNION ALL SELECT 'nodes', 'supplier', count(*) FROM supplier UNION ALL SELECT 'nodes', 'nation', count(*) FROM nation UNION ALL SELECT 'nodes', 'region', count(*) FROM region
UNION ALL SELECT 'edges', 'placed', count(*) FROM orders UNION ALL SELECT 'edges', 'contains', count(*) FROM lineitem UNION ALL SELECT 'edges', 'supplied_by', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'edges', 'customer_in', count(*) FROM customer UNION ALL SELECT 'edges', 'supplier_in', count(*) FROM supplier UNION ALL SELECT 'edges', 'in_region', count(*) FROM nation""",
    "density": """WITH v AS (SELECT count(*) AS v FROM (SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier)), e AS (SELECT count(*) AS e FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
SELECT v AS nodes, e AS edges, 2.0::DOUBLE * e / v AS mean_degree, 2.0::DOUBLE * e / (v::DOUBLE * (v - 1)) AS density FROM v, e""",
    "isolated_nodes": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "homophily": """SELECT count(*) AS edges, round(avg(CASE WHEN c_nationkey = s_nationkey THEN 1.0::DOUBLE ELSE 0 END), 9) AS homophily
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey""",
    "feature_minmax": """SELECT 'orders' AS node_set, 'totalprice' AS feature, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(0 AS BIGINT) AS missing FROM orders
UNION ALL SELECT 'orders', 'ts', count(*), min(epoch(o_orderdate)), max(epoch(o_orderdate)), 0 FROM orders
UNION ALL SELECT 'part', 'size', count(*), min(p_size)::DOUBLE, max(p_size)::DOUBLE, 0 FROM part UNION ALL SELECT 'part', 'retailprice', count(*), min(p_retailprice), max(p_retailprice), 0 FROM part
UNION ALL SELECT 'customer', 'acctbal', count(*), min(c_acctbal), max(c_acctbal), 0 FROM customer""",
    "feature_quantiles": "SELECT k, round((SELECT quantile_cont(o_totalprice, [i / 10.0 for i in range(0, 11)]) FROM orders)[k + 1], 6) AS q FROM range(0, 11) t(k)",
    "array_statistics": """WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]) AS q, round(min(x), 6) AS low, round(max(x), 6) AS high FROM x)
SELECT (SELECT count(*) FROM embeddings) AS n, low, high, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2, round(q[4], 6) AS q3, round(q[5], 6) AS q4 FROM q""",
    "dictionary": """WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx FROM c)
SELECT value, n, idx FROM r WHERE idx < 100""",
    "padding": f"""WITH {_FIRST} n AS (SELECT 'customer' AS name, c_custkey AS seed, 1 AS c FROM customer
UNION ALL SELECT 'orders', seed, count(DISTINCT b) FROM h1 GROUP BY seed UNION ALL SELECT 'part', seed, count(DISTINCT b) FROM h2 GROUP BY seed),
e AS (SELECT 'placed' AS name, seed, count(*) AS c FROM h1 GROUP BY seed UNION ALL SELECT 'contains', seed, count(*) FROM h2 GROUP BY seed)
SELECT 'nodes' AS kind, name, CAST(ceil((max(c) + 1) * 1.1::DOUBLE) AS BIGINT) AS size FROM n GROUP BY name UNION ALL SELECT 'edges', name, CAST(ceil((max(c) + 1) * 1.1::DOUBLE) AS BIGINT) FROM e GROUP BY name""",
    "connected_components": """WITH x AS (SELECT c_custkey AS id, n_regionkey AS r, n_nationkey AS n FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT r, min(id) AS low FROM x GROUP BY r), m AS (SELECT r_regionkey AS r, coalesce(low, (SELECT min(n_nationkey) + 1000000000 FROM nation WHERE n_regionkey = r_regionkey), 2000000000 + r_regionkey) AS low FROM region LEFT JOIN l ON l.r = r_regionkey)
SELECT id, low AS component FROM x JOIN m USING (r) UNION ALL SELECT n_nationkey + 1000000000, low FROM nation JOIN m ON m.r = n_regionkey
UNION ALL SELECT 2000000000 + r_regionkey, low FROM region JOIN m ON m.r = r_regionkey""",
}
