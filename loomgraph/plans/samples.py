"""Sampling queries over the trade graph: every customer is a seed."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.operators import sampling as S
from loomgraph.operators.adjacency import adjacency, store
from loomgraph.session import shared_folder
from loomgraph.sources.tables import trade_graph

CHAIN = ["placed", "contains"]
WIDTHS = [3, 2]


def _sampler(spark, sf_dir, reverse=False, **more) -> S.Sampler:
    g = trade_graph(spark, sf_dir)
    plan = S.hop_plan(g.schema, "customer", hops=2, width=WIDTHS, reverse=reverse, only=CHAIN)
    return S.Sampler(g, plan, edge_key={"contains": "ekey"}, **more)


def _seeds(sampler):
    return sampler.graph.ids("customer").select(F.col("id").alias("seed"))


def khop_first(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return s.sample(_seeds(s)).edges


def khop_both_ways(spark, sf_dir):
    s = _sampler(spark, sf_dir, reverse=True)
    return s.sample(_seeds(s)).edges


def khop_random(spark, sf_dir):
    s = _sampler(spark, sf_dir, order="hash")
    return s.sample(_seeds(s)).edges


def khop_stored(spark, sf_dir):
    """The draws of khop_random from lists stored in buckets: no edge is shuffled after they are written."""
    s = _sampler(spark, sf_dir, order="hash")
    lists, folder = {}, shared_folder(spark)
    for name, key in (("placed", None), ("contains", "ekey")):
        table = f"loom_{name}_{uuid.uuid4().hex}"
        lists[name, False] = store(adjacency(s.graph.edges[name], key=key), table, int(spark.conf.get("spark.sql.shuffle.partitions")), folder)
    return replace(s, stored=lists).sample(_seeds(s)).edges


def khop_random_temporal(spark, sf_dir):
    s = _sampler(spark, sf_dir, order="hash", temporal={"placed": "ts", "contains": "ts"})
    seeds = _seeds(s).select("seed", (F.lit(800_000_000) + F.col("seed") * 86_400).alias("ts"))
    return s.sample(seeds).edges


def khop_random_masked(spark, sf_dir):
    s = _sampler(spark, sf_dir, order="hash", mask_set="placed")
    first = s.graph.edges["placed"].groupBy("source").agg(F.min("target").alias("t"))
    seeds = _seeds(s).join(first, F.col("seed") == F.col("source"), "left")
    return s.sample(seeds.select("seed", F.concat_ws("-", "source", "t").alias("masked"))).edges


def khop_temporal(spark, sf_dir):
    s = _sampler(spark, sf_dir, temporal={"placed": "ts", "contains": "ts"})
    seeds = _seeds(s).select("seed", (F.lit(800_000_000) + F.col("seed") * 86_400).alias("ts"))
    return s.sample(seeds).edges


def khop_masked(spark, sf_dir):
    s = _sampler(spark, sf_dir, mask_set="placed")
    first = s.graph.edges["placed"].groupBy("source").agg(F.min("target").alias("t"))
    seeds = _seeds(s).join(first, F.col("seed") == F.col("source"), "left")
    return s.sample(seeds.select("seed", F.concat_ws("-", "source", "t").alias("masked"))).edges


def khop_replacement(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.sample_tree(s, _seeds(s))


def subgraph(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.subgraph(s, _seeds(s)).edges.select("edge_set", "source", "target")


def multisubgraph(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    seeds = s.graph.nodes["customer"].select(F.col("nation").cast("long").alias("seed"), F.col("id").alias("node"))
    return S.multi_subgraph(s, seeds).edges


def sample_nodes(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.node_order(s.sample(_seeds(s))).select("seed", "node_set", "node", F.col("idx").cast("long").alias("idx"))


def sample_features(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.with_features(s.sample(_seeds(s)), s.graph, "part", ["brand", "retailprice"])


def sample_rows(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.typed_rows(s.sample(_seeds(s)), s.graph, {"part": ["brand", "type"]})


def khop_sql_cte(spark, sf_dir):
    for t in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"loom_{t}")
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    text = S.hop_sql(
        [("loom_orders", "o_custkey", "o_orderkey", "CAST(o_orderkey AS STRING)", 3), ("loom_lineitem", "l_orderkey", "l_partkey", key, 2)],
        "SELECT c_custkey AS seed, c_custkey AS node FROM loom_customer", salt="cte",
    )
    return spark.sql(text).select("seed", F.col("hop").cast("long").alias("hop"), "source", "target")


QUERIES = {f.__name__: f for f in (khop_first, khop_both_ways, khop_random, khop_stored, khop_random_temporal, khop_random_masked, khop_temporal, khop_masked, khop_replacement, subgraph, multisubgraph, sample_nodes, sample_features, sample_rows, khop_sql_cte)}

_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_FIRST = f"""
p AS (SELECT o_custkey AS a, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
c AS (SELECT l_orderkey AS a, l_partkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, {_KEY}) AS n FROM lineitem),
h1 AS (SELECT c_custkey AS seed, c_nationkey AS nation, p.a, p.b FROM customer JOIN p ON p.a = c_custkey WHERE n <= 3),
h2 AS (SELECT DISTINCT h1.seed, h1.nation, c.a, c.b FROM h1 JOIN c ON c.a = h1.b WHERE c.n <= 2),
"""


def _edges(prefix: str, seed: str = "seed") -> str:
    return f"""WITH {prefix} e AS (
SELECT {seed} AS seed, 'placed' AS edge_set, CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target FROM h1
UNION SELECT {seed}, 'contains', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM h2)"""


def _seeded(order1: str, order2: str, where1: str = "true", where2: str = "true", seeds: str = "SELECT c_custkey AS seed, 0 AS ts, NULL AS masked FROM customer") -> str:
    """A chain whose choice depends on the seed."""
    return (
        _edges(f"""s AS ({seeds}),
r1 AS (SELECT s.seed, s.ts, o_custkey AS a, o_orderkey AS b, row_number() OVER (PARTITION BY s.seed ORDER BY {order1}) AS n
  FROM s JOIN orders ON o_custkey = s.seed WHERE {where1}),
h1 AS (SELECT * FROM r1 WHERE n <= 3),
r2 AS (SELECT h1.seed, l_orderkey AS a, l_partkey AS b, row_number() OVER (PARTITION BY h1.seed, h1.b ORDER BY {order2}) AS n
  FROM h1 JOIN lineitem ON l_orderkey = h1.b WHERE {where2}),
h2 AS (SELECT DISTINCT seed, a, b FROM r2 WHERE n <= 2),""")
        + " SELECT seed, edge_set, source, target FROM e"
    )


def _draw(rows: str, path: str, width: int) -> str:
    """The rows ``(seed, a, b, i, d)`` at the drawn places: up to three of d."""
    u = [f"(('0x' || substr(md5(concat_ws('|', 'loom', '{path}', seed, a, {j})), 1, 15))::BIGINT % greatest(d - {j}, 1))" for j in range(width)]
    second = f"{u[1]} + CAST({u[0]} <= {u[1]} AS INT)"
    third = f", {u[2]} AS u2" if width == 3 else ", -1 AS u2"
    places = f"SELECT *, {u[0]} AS x0, {second} AS x1{third} FROM ({rows})"
    places = f"SELECT *, u2 + CAST(least(x0, x1) <= u2 AS INT) AS y FROM ({places})"
    places = f"SELECT *, y + CAST(greatest(x0, x1) <= y AS INT) AS x2 FROM ({places})"
    return f"SELECT * FROM ({places}) WHERE d <= {width} OR i = x0 OR i = x1" + (" OR i = x2" if width == 3 else "")


def _drawn(seeds: str, keep: str = "true", timed: bool = False) -> str:
    """A chain that draws places: lists by time, neighbour and key, cut to what the seed may follow."""
    first, second = ("epoch(o_orderdate)::BIGINT", "epoch(l_shipdate)::BIGINT") if timed else ("0", "0")
    ts = "s.ts" if timed else "0 AS ts"

    def rows(source: str, key: str, neighbor: str, order: str, front: str, where: str) -> str:
        over = f"OVER (PARTITION BY s.seed, {key}"
        return f"SELECT {front}, {key} AS a, {neighbor} AS b, row_number() {over} ORDER BY {order}) - 1 AS i, count(*) {over}) AS d FROM {source} WHERE {where}"

    one = rows("s JOIN orders ON o_custkey = s.seed", "o_custkey", "o_orderkey", f"{first}, o_orderkey", f"s.seed, {ts}", f"{keep} AND ({first} <= {'s.ts' if timed else '0'})")
    two = rows("h1 s JOIN lineitem ON l_orderkey = s.b", "l_orderkey", "l_partkey", f"{second}, l_partkey, {_KEY}", "s.seed", f"({second} <= s.ts)")
    return _edges(f"s AS ({seeds}), h1 AS ({_draw(one, '/0', 3)}), h2 AS ({_draw(two, '/0/0', 2)}),") + " SELECT * FROM e"


ORACLE = {
    "khop_first": _edges(_FIRST) + " SELECT seed, edge_set, source, target FROM e",
    "khop_both_ways": f"""WITH {_FIRST}
back AS (SELECT DISTINCT seed, o_custkey AS a, o_orderkey AS b FROM h1 JOIN orders ON o_orderkey = h1.b)
SELECT seed, 'placed' AS edge_set, CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target FROM h1
UNION SELECT seed, 'placed', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM back
UNION SELECT seed, 'contains', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM h2""",
    "khop_random": _drawn("SELECT c_custkey AS seed FROM customer"),
    "khop_stored": _drawn("SELECT c_custkey AS seed FROM customer"),
    "khop_random_temporal": _drawn("SELECT c_custkey AS seed, 800000000 + c_custkey * 86400 AS ts FROM customer", timed=True),
    "khop_random_masked": _drawn("SELECT c_custkey AS seed, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS masked FROM customer", "o_orderkey IS DISTINCT FROM masked"),
    "khop_temporal": _seeded(
        "epoch(o_orderdate)::BIGINT, o_orderkey",
        f"epoch(l_shipdate)::BIGINT, l_partkey, {_KEY}",
        "epoch(o_orderdate)::BIGINT <= s.ts",
        "epoch(l_shipdate)::BIGINT <= h1.ts",
        "SELECT c_custkey AS seed, 800000000 + c_custkey * 86400 AS ts FROM customer",
    ),
    "khop_masked": _seeded(
        "o_orderkey",
        f"l_partkey, {_KEY}",
        "o_orderkey IS DISTINCT FROM masked",
        seeds="SELECT c_custkey AS seed, 0 AS ts, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS masked FROM customer",
    ),
    "khop_replacement": f"""WITH p AS (SELECT o_custkey AS a, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS d FROM orders),
c AS (SELECT l_orderkey AS a, l_partkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, {_KEY}) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS d FROM lineitem),
h0 AS (SELECT c_custkey AS seed, c_custkey AS node, 'r' AS path FROM customer),
h1 AS (SELECT seed, p.b AS node, path || '/0.' || j AS path, path AS parent FROM h0, (VALUES (0), (1), (2)) v(j), p
  WHERE p.a = h0.node AND p.i = ('0x' || substr(md5(concat_ws('|', 'loom', 0, seed, path, j)), 1, 8))::BIGINT % p.d),
h2 AS (SELECT seed, c.b AS node, path || '/0.' || j AS path, path AS parent FROM h1, (VALUES (0), (1)) v(j), c
  WHERE c.a = h1.node AND c.i = ('0x' || substr(md5(concat_ws('|', 'loom', 0, seed, path, j)), 1, 8))::BIGINT % c.d)
SELECT seed, path, 'customer' AS node_set, CAST(node AS VARCHAR) AS node, NULL AS parent FROM h0
UNION ALL SELECT seed, path, 'orders', CAST(node AS VARCHAR), parent FROM h1
UNION ALL SELECT seed, path, 'part', CAST(node AS VARCHAR), parent FROM h2""",
    "subgraph": _edges(_FIRST) + " SELECT DISTINCT edge_set, source, target FROM e",
    "multisubgraph": _edges(_FIRST, "CAST(nation AS BIGINT)") + " SELECT DISTINCT seed, edge_set, source, target FROM e",
    "sample_nodes": f"""WITH {_FIRST} n AS (
SELECT c_custkey AS seed, 'customer' AS node_set, CAST(c_custkey AS VARCHAR) AS node FROM customer
UNION SELECT seed, 'orders', CAST(b AS VARCHAR) FROM h1 UNION SELECT seed, 'part', CAST(b AS VARCHAR) FROM h2)
SELECT seed, node_set, node, CAST(row_number() OVER (PARTITION BY seed, node_set ORDER BY node) - 1 AS BIGINT) AS idx FROM n""",
    "sample_features": f"""WITH {_FIRST} n AS (SELECT DISTINCT seed, b FROM h2)
SELECT seed, CAST(b AS VARCHAR) AS node, p_brand AS brand, p_retailprice AS retailprice FROM n JOIN part ON p_partkey = b""",
    "sample_rows": _edges(_FIRST) + """, n AS (
SELECT c_custkey AS seed, 'customer' AS s, CAST(c_custkey AS VARCHAR) AS node FROM customer
UNION SELECT seed, 'orders', CAST(b AS VARCHAR) FROM h1 UNION SELECT seed, 'part', CAST(b AS VARCHAR) FROM h2)
SELECT seed, 'edge' AS element, edge_set AS set_name, NULL AS node, source, target, '{}' AS properties FROM e
UNION ALL SELECT seed, 'node', s, node, NULL, NULL, coalesce('{"brand":"' || p_brand || '","type":"' || p_type || '"}', '{}') FROM n LEFT JOIN part ON s = 'part' AND CAST(p_partkey AS VARCHAR) = node""",
    "khop_sql_cte": f"""WITH p AS (SELECT o_custkey AS a, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('cte|1|' || CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR), o_orderkey) AS n FROM orders),
c AS (SELECT l_orderkey AS a, l_partkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('cte|2|' || {_KEY}), {_KEY}, l_partkey) AS n FROM lineitem),
h1 AS (SELECT DISTINCT c_custkey AS seed, p.a, p.b FROM customer JOIN p ON p.a = c_custkey WHERE n <= 3),
h2 AS (SELECT DISTINCT h1.seed, c.a, c.b FROM h1 JOIN c ON c.a = h1.b WHERE c.n <= 2)
SELECT seed, CAST(1 AS BIGINT) AS hop, a AS source, b AS target FROM h1 UNION ALL SELECT seed, 2, a, b FROM h2""",
}
