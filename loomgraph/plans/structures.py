"""Queries that reshape, filter and validate the trade graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import filters, negatives, structure, validation
from loomgraph.operators import sampling as S
from loomgraph.plans.samples import _FIRST, _sampler, _seeds
from loomgraph.schema import GraphSchema
from loomgraph.sources.tables import trade_graph


def reverse_edges(spark, sf_dir):
    return structure.reverse_edges(trade_graph(spark, sf_dir)).edges["contains"].select("source", "target", "ekey", "quantity")


def adjacency_list(spark, sf_dir):
    a = structure.adjacency_list(trade_graph(spark, sf_dir).edges["contains"], ["ekey"])
    return a.select("source", F.size("neighbors").cast("long").alias("n"), F.array_join(F.transform("neighbors", lambda x: F.concat_ws(":", x["target"], x["ekey"])), ",").alias("neighbors"))


def flat_edges(spark, sf_dir):
    return structure.flat_edges(structure.adjacency_list(trade_graph(spark, sf_dir).edges["contains"], ["ekey"]))


def dense_ids(spark, sf_dir):
    return structure.dense_index(trade_graph(spark, sf_dir).nodes["orders"].select("id"), "id")


def indexed_edges(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    s, t = structure.dense_index(g.ids("orders"), "id"), structure.dense_index(g.ids("part"), "id")
    return structure.indexed_edges(g.edges["contains"].select("source", "target", "ekey"), s, t).select("ekey", "source_idx", "target_idx")


def dangling_edges(spark, sf_dir):
    """Ends that are missing when the part set holds the larger parts only."""
    g = trade_graph(spark, sf_dir)
    known = g.nodes["part"].where("size > 25").select("id")
    return structure.dangling(g.edges["contains"], g.ids("orders"), known).select("side", "id")


def kept_edges(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    known = g.nodes["part"].where("size > 25").select("id")
    return structure.without_dangling(g.edges["contains"], g.ids("orders"), known).select("ekey", "source", "target")


def undirected_simple(spark, sf_dir):
    return structure.undirected_simple(trade_graph(spark, sf_dir).edges["supplied_by"])


def _keys_only(spark, sf_dir):
    """Sets are merged if their features agree; here only the keys do."""
    g = trade_graph(spark, sf_dir)
    return g.project(g.schema.filtered(node_feature=lambda n, f: f == "id"))


def homogenize(spark, sf_dir):
    g = _keys_only(spark, sf_dir)
    n, _ = structure.homogenize(g, ["customer", "nation", "supplier"], ["customer_in", "supplier_in"], {k: "id" for k in ("customer", "nation", "supplier")})
    return n.select("idx", "node_set", "id")


def homogenized_edges(spark, sf_dir):
    g = _keys_only(spark, sf_dir)
    _, e = structure.homogenize(g, ["customer", "nation", "supplier"], ["customer_in", "supplier_in"], {k: "id" for k in ("customer", "nation", "supplier")})
    return e


def _merged(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    out = s.sample(_seeds(s))
    ends = {n: (e.source, e.target) for n, e in s.graph.schema.edge_sets.items()}
    pick = lambda i: F.when(F.col("edge_set") == "placed", ends["placed"][i]).otherwise(ends["contains"][i])
    return structure.merge_samples(out.nodes, out.edges.withColumn("source_set", pick(0)).withColumn("target_set", pick(1)))


def merge_graphs(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("node_set", F.col("idx").cast("long").alias("idx"), "seed", "node")


def merged_edges(spark, sf_dir):
    e = _merged(spark, sf_dir)[1]
    return e.select("edge_set", "seed", F.col("source_idx").cast("long").alias("source_idx"), F.col("target_idx").cast("long").alias("target_idx"))


def unpad(spark, sf_dir):
    """The part nodes padded, then stripped of their sentinels again."""
    g = trade_graph(spark, sf_dir)
    nodes = structure.dense_index(g.ids("part"), "id").select("idx", "id")
    edges = g.edges["supplied_by"].join(nodes.select(F.col("id").alias("source"), F.col("idx").alias("source_idx")), "source").select("source_idx", F.col("source_idx").alias("target_idx"))
    n, e = nodes.count(), edges.count()
    full_n, full_e = structure.padded(nodes, edges, n + 10, e + 7)
    real_n, real_e = structure.unpadded(full_n, full_e, n)
    return real_n.select(F.lit("node").alias("kind"), F.col("idx").alias("a"), F.col("id").alias("b")).unionByName(real_e.select(F.lit("edge").alias("kind"), F.col("source_idx").alias("a"), F.col("target_idx").alias("b")))


def filter_samples(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    out = s.sample(_seeds(s)).nodes
    brands = s.graph.nodes["part"].select(F.col("id").cast("string").alias("node"), F.lit("part").alias("node_set"), "brand")
    rows = out.join(brands, ["node", "node_set"], "left")
    return filters.filter_samples(
        rows,
        {
            "few_parts": filters.NodeCount(1, 4, "part"),
            "large": filters.NodeCount(lower=8),
            "any_brand": filters.HasLabel("part", "brand", "Brand#11"),
            "all_brand": filters.HasLabel("part", "brand", "Brand#11", every=True),
        },
    )


def filter_schema(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    small: GraphSchema = g.schema.filtered(node_set=lambda n: n != "nation", node_feature=lambda n, f: f in ("id", "acctbal"))
    g = g.project(small)
    rows = [(n, "node", f) for n, s in g.schema.node_sets.items() for f in s.features] + [(n, "edge", f) for n, s in g.schema.edge_sets.items() for f in ("source", "target", *s.features)]
    text = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t(name, kind, feature)")


def drop_edge_features(spark, sf_dir):
    return trade_graph(spark, sf_dir).without_edge_features().edges["contains"]


def propagate_ts(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    placed = g.edges["placed"].groupBy(F.col("source").alias("id")).agg(F.min("ts").alias("ts"))
    e = g.edges["placed"].select("source", "target")
    return structure.propagate_timestamps(e, placed, g.nodes["orders"].select("id", "ts"))


def edge_lookup(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    placed = g.edges["placed"].select("source", "target", F.col("target").alias("edge"))
    asks = placed.select("source", "target").unionByName(placed.select("source", (F.col("target") + 1).alias("target"))).distinct()
    return structure.edge_lookup(placed, asks, "edge")


def as_of(spark, sf_dir):
    """What each user's last event was worth at the end of each event's day."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    asks = ev.select("user_id", ((F.floor(F.col("t") / 86_400_000_000) + 1) * 86_400_000_000 - 1).alias("t"), F.col("event_id").alias("ask"))
    return structure.as_of(ev, asks, "user_id", "t", "value").select("ask", "user_id", "t", "value")


def random_negatives(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    pairs = g.edges["contains"].select("source", "target").distinct()
    return negatives.random_negatives(pairs, structure.dense_index(g.ids("part"), "id"), 2).select("source", "target", F.col("k").cast("long").alias("k"), "negative")


def walk_negatives(spark, sf_dir):
    """Orders that walks from a customer reach over its nation, or back over its own orders."""
    g = trade_graph(spark, sf_dir)
    plan = S.hop_plan(g.schema, "customer", hops=3, width=None, only=["customer_in", "placed"])
    found = negatives.walk_negatives(g, plan, "placed", g.ids("customer").select(F.col("id").alias("seed")), 6, 3)
    return found.select("seed", "negative", "visits", F.col("rank").cast("long").alias("rank"))


def split_random(spark, sf_dir):
    return negatives.split_random(trade_graph(spark, sf_dir).ids("orders"), "id", 0.2)


def split_temporal(spark, sf_dir):
    return negatives.split_temporal(trade_graph(spark, sf_dir).nodes["orders"].select("id", "ts"), "ts", "id", 0.2)


def batches(spark, sf_dir):
    return negatives.batches(trade_graph(spark, sf_dir).ids("orders"), "id", 64)


def validate_issues(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    broken = g.nodes["part"].where("size > 25")
    g.nodes["part"] = broken.unionByName(broken.where("size = 30"))
    return validation.issues(g)


def packed_samples(spark, sf_dir):
    """Samples with a label, one row a seed: what a trainer reads."""
    s = _sampler(spark, sf_dir)
    p = S.packed(s.sample(_seeds(s)))
    return p.select("seed", F.size("nodes").cast("long").alias("n_nodes"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("n_edges"))


QUERIES = {
    f.__name__: f
    for f in (
        reverse_edges, adjacency_list, flat_edges, dense_ids, indexed_edges, dangling_edges, kept_edges, undirected_simple, homogenize, homogenized_edges,
        merge_graphs, merged_edges, unpad, filter_samples, filter_schema, drop_edge_features, propagate_ts, edge_lookup, as_of,
        random_negatives, walk_negatives, split_random, split_temporal, batches, validate_issues, packed_samples,
    )
}

_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_TURN = _HEX.format("concat_ws('|', 'walk', 'hop', {}, seed, w)")
_DRAW = _HEX.format("concat_ws('|', 'walk', 'node', '{}', seed, w)")
_NODES = """n AS (SELECT c_custkey AS seed, 'customer' AS node_set, CAST(c_custkey AS VARCHAR) AS node FROM customer
UNION SELECT seed, 'orders', CAST(b AS VARCHAR) FROM h1 UNION SELECT seed, 'part', CAST(b AS VARCHAR) FROM h2)"""
_MERGED = f"""WITH {_FIRST} {_NODES},
l AS (SELECT *, row_number() OVER (PARTITION BY node_set ORDER BY seed, node) - 1 AS idx FROM n)"""
_HOMO = """WITH n AS (
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, 'customer' AS node_set, CAST(c_custkey AS VARCHAR) AS id FROM customer
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) - 1 + (SELECT count(*) FROM customer), 'nation', CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1 + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation), 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier)"""

ORACLE = {
    "reverse_edges": f"SELECT l_partkey AS source, l_orderkey AS target, {_KEY} AS ekey, l_quantity AS quantity FROM lineitem",
    "adjacency_list": f"SELECT l_orderkey AS source, count(*) AS n, string_agg(l_partkey || ':' || {_KEY}, ',' ORDER BY l_partkey, {_KEY}) AS neighbors FROM lineitem GROUP BY 1",
    "flat_edges": f"SELECT l_orderkey AS source, l_partkey AS target, {_KEY} AS ekey FROM lineitem",
    "dense_ids": "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders",
    "indexed_edges": f"""WITH o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)
SELECT {_KEY} AS ekey, o.idx AS source_idx, p.idx AS target_idx FROM lineitem JOIN o ON o.id = l_orderkey JOIN p ON p.id = l_partkey""",
    "dangling_edges": "SELECT DISTINCT 'target' AS side, l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)",
    "kept_edges": f"SELECT {_KEY} AS ekey, l_orderkey AS source, l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25",
    "undirected_simple": "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem",
    "homogenize": _HOMO + " SELECT idx, node_set, id FROM n",
    "homogenized_edges": _HOMO + """ SELECT 'customer_in' AS edge_set, a.idx AS source, b.idx AS target FROM customer JOIN n a ON a.node_set = 'customer' AND a.id = CAST(c_custkey AS VARCHAR)
JOIN n b ON b.node_set = 'nation' AND b.id = CAST(c_nationkey AS VARCHAR)
UNION ALL SELECT 'supplier_in', a.idx, b.idx FROM supplier JOIN n a ON a.node_set = 'supplier' AND a.id = CAST(s_suppkey AS VARCHAR)
JOIN n b ON b.node_set = 'nation' AND b.id = CAST(s_nationkey AS VARCHAR)""",
    "merge_graphs": _MERGED + " SELECT node_set, idx, seed, node FROM l",
    "merged_edges": _MERGED + """ SELECT 'placed' AS edge_set, h1.seed, s.idx AS source_idx, t.idx AS target_idx FROM h1
JOIN l s ON s.seed = h1.seed AND s.node_set = 'customer' AND s.node = CAST(h1.a AS VARCHAR) JOIN l t ON t.seed = h1.seed AND t.node_set = 'orders' AND t.node = CAST(h1.b AS VARCHAR)
UNION ALL SELECT 'contains', h2.seed, s.idx, t.idx FROM h2
JOIN l s ON s.seed = h2.seed AND s.node_set = 'orders' AND s.node = CAST(h2.a AS VARCHAR) JOIN l t ON t.seed = h2.seed AND t.node_set = 'part' AND t.node = CAST(h2.b AS VARCHAR)""",
    "unpad": """WITH p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)
SELECT 'node' AS kind, idx AS a, id AS b FROM p UNION ALL
SELECT 'edge', idx, idx FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN p ON p.id = l_partkey""",
    "filter_samples": f"""WITH {_FIRST} {_NODES},
k AS (SELECT seed, count(*) AS n, count(*) FILTER (WHERE node_set = 'part') AS parts, coalesce(bool_or(p_brand = 'Brand#11'), false) AS has_any, coalesce(bool_and(p_brand = 'Brand#11'), true) AS has_all
  FROM n LEFT JOIN part ON node_set = 'part' AND node = CAST(p_partkey AS VARCHAR) GROUP BY seed)
SELECT seed, 'few_parts' AS name FROM k WHERE parts >= 1 AND parts < 4 UNION ALL SELECT seed, 'large' FROM k WHERE n >= 8
UNION ALL SELECT seed, 'any_brand' FROM k WHERE has_any UNION ALL SELECT seed, 'all_brand' FROM k WHERE has_all""",
    "filter_schema": """SELECT * FROM (VALUES ('customer', 'node', 'id'), ('customer', 'node', 'acctbal'), ('orders', 'node', 'id'), ('part', 'node', 'id'), ('supplier', 'node', 'id'), ('supplier', 'node', 'acctbal'), ('region', 'node', 'id'),
('placed', 'edge', 'source'), ('placed', 'edge', 'target'), ('placed', 'edge', 'ts'), ('contains', 'edge', 'source'), ('contains', 'edge', 'target'), ('contains', 'edge', 'ekey'), ('contains', 'edge', 'ts'), ('contains', 'edge', 'quantity'), ('contains', 'edge', 'price'), ('contains', 'edge', 'discount'),
('supplied_by', 'edge', 'source'), ('supplied_by', 'edge', 'target')) t(name, kind, feature)""",
    "drop_edge_features": "SELECT l_orderkey AS source, l_partkey AS target FROM lineitem",
    "propagate_ts": """WITH f AS (SELECT o_custkey, min(epoch(o_orderdate)::BIGINT) AS t FROM orders GROUP BY 1)
SELECT orders.o_custkey AS source, o_orderkey AS target, greatest(f.t, epoch(o_orderdate)::BIGINT) AS ts FROM orders JOIN f USING (o_custkey)""",
    "edge_lookup": """WITH q AS (SELECT o_custkey AS source, o_orderkey AS target FROM orders UNION SELECT o_custkey, o_orderkey + 1 FROM orders)
SELECT source, target, coalesce(o_orderkey, -1) AS edge FROM q LEFT JOIN orders ON o_custkey = source AND o_orderkey = target""",
    "as_of": """WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS t FROM events), q AS (SELECT event_id AS ask, user_id, (t // 86400000000 + 1) * 86400000000 - 1 AS t FROM e)
SELECT ask, q.user_id, q.t, (SELECT value FROM e WHERE e.user_id = q.user_id AND e.t <= q.t ORDER BY e.t DESC LIMIT 1) AS value FROM q""",
    "random_negatives": f"""WITH e AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem), p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)
SELECT source, target, CAST(k AS BIGINT) AS k, p.id AS negative FROM e, (VALUES (0), (1)) v(k) JOIN p ON p.idx = {_HEX.format("concat_ws('|', 'neg', source, target, k)")} % (SELECT count(*) FROM part)""",
    "walk_negatives": f"""WITH ci AS (SELECT c_custkey AS a, n AS b, 0 AS i, 1 AS d FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS n FROM customer)),
ic AS (SELECT c_nationkey AS a, c_custkey AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS d FROM customer),
po AS (SELECT o_custkey AS a, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS d FROM orders),
op AS (SELECT o_orderkey AS a, o_custkey AS b, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderkey) AS d FROM orders),
s AS (SELECT c_custkey AS seed, w, c_custkey AS node FROM customer, range(6) t(w)),
n1 AS (SELECT seed, w, b AS node FROM s JOIN ci ON a = node AND {_TURN.format("''")} % 2 = 0 AND i = {_DRAW.format("/0")} % d),
o1 AS (SELECT seed, w, b AS node FROM s JOIN po ON a = node AND {_TURN.format("''")} % 2 = 1 AND i = {_DRAW.format("/1")} % d),
c2 AS (SELECT seed, w, b AS node, '/0/0' AS path FROM n1 JOIN ic ON a = node AND i = {_DRAW.format("/0/0")} % d
  UNION ALL SELECT seed, w, b, '/1/0' FROM o1 JOIN op ON a = node AND i = {_DRAW.format("/1/0")} % d),
o3 AS (SELECT seed, w, b AS node FROM c2 JOIN po ON a = node AND {_TURN.format("path")} % 2 = 1 AND i = {_HEX.format("concat_ws('|', 'walk', 'node', path || '/1', seed, w)")} % d),
c AS (SELECT seed, node AS negative, count(*) AS visits FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o3) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = seed AND o_orderkey = node) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY visits DESC, negative) AS rank FROM c),
x AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
m AS (SELECT c_custkey AS seed, r AS rank FROM customer, range(1, 4) t(r) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.seed = c_custkey AND k.rank = r))
SELECT seed, negative, visits, rank FROM k WHERE rank <= 3
UNION ALL SELECT seed, x.id, 0, rank FROM m JOIN x ON x.idx = {_HEX.format("concat_ws('|', 'walk', 'fill', seed, rank)")} % (SELECT count(*) FROM orders)""",
    "split_random": f"""SELECT o_orderkey AS id, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'split', o_orderkey)")}, o_orderkey) <= CAST(floor((SELECT count(*) FROM orders) * 0.2) AS BIGINT) AS valid FROM orders""",
    "split_temporal": """SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS ts, row_number() OVER (ORDER BY epoch(o_orderdate)::BIGINT DESC, o_orderkey DESC) <= CAST(floor((SELECT count(*) FROM orders) * 0.2) AS BIGINT) AS valid FROM orders""",
    "batches": f"""WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'batch', o_orderkey)")}, o_orderkey) - 1 AS n FROM orders)
SELECT id, n // 64 AS batch, n % 64 AS slot FROM r WHERE n // 64 < (SELECT count(*) FROM orders) // 64""",
    "validate_issues": """WITH b AS (SELECT p_partkey FROM part WHERE p_size > 25), d AS (SELECT count(*) AS n FROM part WHERE p_size = 30)
SELECT 'error' AS severity, 'node set part: ' || d.n || ' repeated keys' AS issue FROM d WHERE d.n > 0
UNION ALL SELECT 'error', 'edge set contains: ' || count(*) || ' edges with an unknown target' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM b)
UNION ALL SELECT 'error', 'edge set supplied_by: ' || count(*) || ' edges with an unknown source' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM b)""",
    "packed_samples": f"""WITH {_FIRST} {_NODES},
e AS (SELECT seed, count(*) AS n FROM (SELECT seed, 'p', a, b FROM h1 UNION ALL SELECT seed, 'c', a, b FROM h2) GROUP BY seed)
SELECT n.seed, count(*) AS n_nodes, coalesce(max(e.n), 0) AS n_edges FROM n LEFT JOIN e ON e.seed = n.seed GROUP BY n.seed""",
}
