"""Queries about training data: samples with labels, links, batches; statistics over samples; shapes of whole graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import timeseries as ts
from loomgraph.generate import synthetic
from loomgraph.graph import Graph
from loomgraph.operators import datasets, negatives, statistics, structure
from loomgraph.operators import sampling as S
from loomgraph.plans.samples import _FIRST, _edges, _sampler, _seeds
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet
from loomgraph.sources.tables import trade_graph


def _small(spark, sf_dir) -> Graph:
    """Customers, nations and regions."""
    g = trade_graph(spark, sf_dir)
    return g.project(g.schema.filtered(node_set=lambda n: n in ("customer", "nation", "region"), edge_set=lambda n: n in ("customer_in", "in_region")))


def node_labels(spark, sf_dir):
    """Seeds of a node dataset: the label and which of them validate."""
    return datasets.node_dataset(_small(spark, sf_dir), "customer", "segment", share=0.2).labels.select("seed", "label", "valid")


def node_labels_by_time(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n in ("orders", "customer"), edge_set=lambda n: n == "placed"))
    return datasets.node_dataset(g, "orders", "status", hops=1, share=0.2, time="ts").labels.select("seed", "label", "valid")


def node_dataset_sizes(spark, sf_dir):
    """What a node dataset's samples hold, and how many rows and columns of features there are."""
    d = datasets.node_dataset(_small(spark, sf_dir), "customer", "segment", hops=2, width=2)
    n = d.sample.nodes.groupBy(F.col("node_set").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"))
    wide = [f.agg(F.count("*").alias("n")).select(F.lit(f"features {name}").alias("name"), "n", F.lit(len(f.columns) - 1).cast("long").alias("seeds")) for name, f in d.features.items()]
    for w in wide:
        n = n.unionByName(w)
    return n


def node_batches(spark, sf_dir):
    """Padded batches of 16 seeds: real and sentinel rows of each set in each batch."""
    g = _small(spark, sf_dir)
    sampler = S.Sampler(g, S.hop_plan(g.schema, "customer", 2, 2, reverse=False))
    b = datasets.batched(sampler.sample(_seeds(sampler)), g.schema, 16)
    spare = F.count_if(F.col("node").isNull())
    n = b.nodes.groupBy("batch", F.col("node_set").alias("name")).agg(F.count("*").alias("room"), spare.alias("spare"), F.max("idx").cast("long").alias("last"))
    return n.unionByName(b.edges.groupBy("batch", F.col("edge_set").alias("name")).agg(F.count("*").alias("room"), F.lit(0).cast("long").alias("spare"), F.max("slot").cast("long").alias("last")))


def batch_edges(spark, sf_dir):
    """The edges of padded batches with the nodes that their numbers stand for; sentinels have none."""
    g = _small(spark, sf_dir)
    sampler = S.Sampler(g, S.hop_plan(g.schema, "customer", 2, 2, reverse=False))
    b = datasets.batched(sampler.sample(_seeds(sampler)), g.schema, 16)
    at = lambda c, sets: b.nodes.where(F.col("node_set").isin(*sets)).select("batch", F.col("node_set").alias(f"{c}s"), F.col("idx").alias(f"{c}_idx"), F.col("node").alias(c), F.col("seed").alias(f"{c}_seed"))
    e = b.edges.withColumn("sources", F.when(F.col("edge_set") == "customer_in", "customer").otherwise("nation")).withColumn("targets", F.when(F.col("edge_set") == "customer_in", "nation").otherwise("region"))
    j = e.join(at("source", ["customer", "nation"]), ["batch", "sources", "source_idx"]).join(at("target", ["nation", "region"]), ["batch", "targets", "target_idx"])
    return j.where("source IS NOT NULL AND source_seed = target_seed").select(F.col("source_seed").alias("seed"), "edge_set", "source", "target")


def edge_seeds(spark, sf_dir):
    """Link seeds: the fifth of the pairs that came last validates."""
    return datasets.split_edges(trade_graph(spark, sf_dir), "contains", 0.2, "ts").select("source", "target", "valid")


def link_samples(spark, sf_dir):
    """A link dataset: how many samples each end has, and how large they are."""
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n in ("part", "supplier"), edge_set=lambda n: n == "supplied_by"))
    d = datasets.link_dataset(g, "supplied_by", hops=1, width=2, per_edge=1)
    count = lambda s, n: s.nodes.agg(F.countDistinct("seed").alias("seeds"), F.count("*").alias("nodes")).select(F.lit(n).alias("end"), "seeds", "nodes")
    return count(d.sources, "source").unionByName(count(d.targets, "target"))


def link_batches(spark, sf_dir):
    """Links in batches of 32: each one's place, and how many nodes its samples have in the padded batches of both ends."""
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n in ("part", "supplier"), edge_set=lambda n: n == "supplied_by"))
    b = datasets.link_batches(datasets.link_dataset(g, "supplied_by", hops=1, width=2, per_edge=1, once=False), g.schema, 32)
    held = lambda s, n: s.nodes.where(F.col("slot").isNotNull()).groupBy("batch", "slot").agg(F.count("*").alias(n))
    both = b.labels.join(held(b.sources, "source_nodes"), ["batch", "slot"]).join(held(b.targets, "target_nodes"), ["batch", "slot"])
    return both.select("batch", "slot", "source", "target", "source_nodes", "target_nodes")


def training_scale(spark, sf_dir):
    """Account balances scaled by quantiles of the customers that don't validate."""
    d = datasets.node_dataset(_small(spark, sf_dir), "customer", "segment", hops=1, width=1, share=0.2)
    n = d.features["customer"]
    low, high = F.min("acctbal_SOFT_QUANTILE"), F.max("acctbal_SOFT_QUANTILE")
    mine = n.join(d.labels.where("NOT valid").select(F.col("seed").alias("id")), "id").agg(F.count("*").alias("n"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
    return mine.withColumn("beyond", F.lit(n.where(F.abs("acctbal_SOFT_QUANTILE") > 0.5).count()).cast("long"))


def interleaved_links(spark, sf_dir):
    """Each pair's own target, then its negatives, as one table of candidates."""
    g = trade_graph(spark, sf_dir)
    pairs = g.edges["supplied_by"].select("source", "target")
    return negatives.interleaved(negatives.edge_neighbors(g, "supplied_by", pairs, 2)).select("source", "target", "place", "candidate", F.col("label").cast("long").alias("label"))


def separated_scores(spark, sf_dir):
    """Scores of interleaved links, put back to each pair."""
    g = trade_graph(spark, sf_dir)
    links = negatives.interleaved(negatives.edge_neighbors(g, "supplied_by", g.edges["supplied_by"].select("source", "target"), 2))
    out = negatives.separated(links.withColumn("score", F.col("candidate") * 2))
    return out.select("source", "target", "positive", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


def seed_labels(spark, sf_dir):
    s = _sampler(spark, sf_dir)
    return S.seed_labels(s.sample(_seeds(s)), _seeds(s), "customer").select("seed", "node_set", "node", F.col("is_seed").cast("long").alias("is_seed"))


def visit_order(spark, sf_dir):
    """Numbers of a sample's nodes as hops reach them."""
    s = _sampler(spark, sf_dir, reverse=True)
    return S.node_order(s.sample(_seeds(s)), visits=True).select("seed", "node_set", "node", F.col("hop").cast("long").alias("hop"), F.col("idx").cast("long").alias("idx"))


def sample_statistics(spark, sf_dir):
    """Statistics over the nodes that samples hold, each as often as they hold it."""
    s = _sampler(spark, sf_dir)
    return statistics.sample_statistics(s.sample(_seeds(s)), s.graph, {"part": ["size", "retailprice"], "orders": ["totalprice"]})


def limited_statistics(spark, sf_dir):
    """Statistics of a bounded sample of nodes: those with the smallest key digests."""
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n == "part", node_feature=lambda n, f: f in ("id", "size", "brand")))
    found = statistics.summary(g, 3, limit=50)["part"]
    rows = [("size", "count", float(found["size"]["count"])), ("size", "min", found["size"]["min"]), ("size", "max", found["size"]["max"])]
    rows += [("brand", w, float(n)) for w, (_, n) in found["brand"]["dictionary"].items()]
    return spark.createDataFrame(rows, "feature string, what string, n double")


def metric_means(spark, sf_dir):
    """Metrics averaged over steps, here orders by priority; steps without a metric don't count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("closed"))
    return statistics.mean_metrics(o, ["o_totalprice", "closed"], "o_orderpriority").select("o_orderpriority", "metric", F.round("mean", 4).alias("mean"))


def block_starts(spark, sf_dir):
    """Where each part's edges begin in a list sorted by part."""
    g = trade_graph(spark, sf_dir)
    return structure.block_starts(g.ids("part"), g.edges["supplied_by"])


def sorted_edges(spark, sf_dir):
    return structure.sorted_edges(trade_graph(spark, sf_dir).edges["contains"].select("source", "target", "ekey"), ["ekey"])


def _nations(spark, sf_dir):
    """Nations with ties between neighbouring keys of one region: a few chains."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("r"))
    a, b = n.select(F.col("id").alias("source"), F.col("r").alias("ra")), n.select(F.col("id").alias("target"), F.col("r").alias("rb"))
    near = a.join(b, (F.col("target") > F.col("source")) & (F.col("target") <= F.col("source") + 3) & (F.col("ra") == F.col("rb")))
    return n.select("id"), near.select("source", "target")


def component_sizes(spark, sf_dir):
    return statistics.component_sizes(statistics.components(*_nations(spark, sf_dir)))


def largest_component(spark, sf_dir):
    return statistics.largest_component(statistics.components(*_nations(spark, sf_dir)))


def eccentricities(spark, sf_dir):
    """Distance to each node's farthest node; the largest is the diameter."""
    return statistics.eccentricity_bounds(*_nations(spark, sf_dir)).where("lower = upper").select("id", F.col("lower").alias("distance"))


def diameters(spark, sf_dir):
    return statistics.diameters(*_nations(spark, sf_dir))


def reach(spark, sf_dir):
    """How far and how many nodes each node reaches, from sketches that tell so few nodes apart exactly."""
    return statistics.reach(*_nations(spark, sf_dir))


def padded_graph(spark, sf_dir):
    """Suppliers and their nations filled up with sentinels."""
    g = trade_graph(spark, sf_dir)
    nodes = structure.dense_index(g.ids("supplier"), "id").select("idx", "id")
    edges = nodes.select(F.col("idx").alias("source_idx"), F.col("idx").alias("target_idx"))
    n = nodes.count()
    full_n, full_e = structure.padded(nodes, edges, n + 5, n + 3)
    return full_n.select(F.lit("node").alias("kind"), F.col("idx").alias("a"), F.col("id").alias("b")).unionByName(full_e.select(F.lit("edge").alias("kind"), F.col("source_idx").alias("a"), F.col("target_idx").alias("b")))


def creation_times(spark, sf_dir):
    """Edges dated by the schema: the later of their ends' creation times."""
    g = trade_graph(spark, sf_dir)
    since = g.edges["placed"].groupBy(F.col("source").alias("id")).agg(F.min("ts").alias("since"))
    born = Feature("INTEGER_64", "TIMESTAMP", is_creation_time=True)
    key = Feature("INTEGER_64", "PRIMARY_ID")
    schema = GraphSchema({"customer": NodeSet({"id": key, "since": born}), "orders": NodeSet({"id": key, "ts": born})}, {"placed": EdgeSet("customer", "orders")})
    small = Graph(schema, {"customer": since, "orders": g.nodes["orders"].select("id", "ts")}, {"placed": g.edges["placed"].select("source", "target")})
    return structure.with_creation_times(small, "placed")


def parsed_times(spark, sf_dir):
    """Written times as microseconds: with and without an offset, dates, and what is none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    written = F.element_at(F.array(F.col("d"), F.concat("d", F.lit("T01:02:03.5Z")), F.concat("d", F.lit(" 01:02:03")), F.concat("d", F.lit("T01:02:03+02:00")), F.lit("no time")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", ts.parse_micros(written).alias("micros"))


def durations(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 7).alias("s"))
    return o.select("o_orderkey", ts.duration_text(F.col("s")).alias("took"), ts.indented(F.concat(F.lit(" a\n"), F.col("s").cast("string"), F.lit("\n")), 2).alias("text"))


def synthetic_counts(spark, sf_dir):
    """A made-up graph as large as the parts, suppliers, order lines and customers: sizes, distinct keys, edges with known ends, features within range."""
    key = lambda: Feature("INTEGER_64", "PRIMARY_ID")
    schema = GraphSchema({"a": NodeSet({"id": key(), "v": Feature("FLOAT_32", "EMBEDDING", (4,))}), "b": NodeSet({"id": key(), "c": Feature("BYTES", "CATEGORICAL")})}, {"ab": EdgeSet("a", "b"), "bb": EdgeSet("b", "b")})
    rows = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    g = synthetic.synthetic_graph(spark, schema, synthetic.Sizes(nodes={"a": rows("part"), "b": rows("supplier")}, edges={"ab": rows("lineitem"), "bb": rows("customer")}))
    out = g.nodes["a"].agg(F.countDistinct("id").alias("n")).select(F.lit("a").alias("name"), "n").unionByName(g.nodes["b"].agg(F.countDistinct("id").alias("n")).select(F.lit("b").alias("name"), "n"))
    out = out.unionByName(g.nodes["a"].where(F.size("v") == 4).agg(F.count("*").alias("n")).select(F.lit("vectors").alias("name"), "n"))
    for n, e in schema.edge_sets.items():
        out = out.unionByName(structure.without_dangling(g.edges[n], g.ids(e.source), g.ids(e.target)).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n"))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        node_labels, node_labels_by_time, node_dataset_sizes, node_batches, batch_edges, edge_seeds, link_samples, link_batches, training_scale, interleaved_links, separated_scores, seed_labels, visit_order,
        sample_statistics, limited_statistics, metric_means, block_starts, sorted_edges, component_sizes, largest_component, eccentricities, diameters, reach, padded_graph, creation_times,
        parsed_times, durations, synthetic_counts,
    )
}

_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_SUP = "(SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"
_NODES = """n AS (SELECT c_custkey AS seed, 'customer' AS node_set, CAST(c_custkey AS VARCHAR) AS node FROM customer
UNION SELECT seed, 'orders', CAST(b AS VARCHAR) FROM h1 UNION SELECT seed, 'part', CAST(b AS VARCHAR) FROM h2)"""
_DEALT = f"""r AS (SELECT c_custkey AS seed, c_nationkey AS n, n_regionkey AS g, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'batch', c_custkey)")}, c_custkey) - 1 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
d AS (SELECT *, k // 16 AS batch FROM r WHERE k // 16 < (SELECT count(*) FROM customer) // 16)"""
_DRAWN = f"""x AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier),
l AS (SELECT p AS source, s AS target, k, x.id AS negative FROM {_SUP} e, (VALUES (0), (1)) v(k) JOIN x ON x.idx = {_HEX.format("concat_ws('|', 'neg', p, s, k)")} % (SELECT count(*) FROM supplier)),
i AS (SELECT DISTINCT source, target, CAST(0 AS BIGINT) AS place, target AS candidate, CAST(1 AS BIGINT) AS label FROM l UNION ALL SELECT source, target, k + 1, negative, 0 FROM l)"""
_CHAIN = """e AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3 AND a.n_regionkey = b.n_regionkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(s, t, d) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation UNION SELECT s, u.b, d + 1 FROM w JOIN u ON u.a = t WHERE d < 25),
m AS (SELECT s, t, min(d) AS d FROM w GROUP BY ALL), c AS (SELECT s AS id, min(t) AS component FROM m GROUP BY s)"""

ORACLE = {
    "node_labels": f"""SELECT c_custkey AS seed, c_mktsegment AS label, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'split', c_custkey)")}, c_custkey) <= CAST(floor((SELECT count(*) FROM customer) * 0.2) AS BIGINT) AS valid FROM customer""",
    "node_labels_by_time": "SELECT o_orderkey AS seed, o_orderstatus AS label, row_number() OVER (ORDER BY epoch(o_orderdate)::BIGINT DESC, o_orderkey DESC) <= CAST(floor((SELECT count(*) FROM orders) * 0.2) AS BIGINT) AS valid FROM orders",
    "node_dataset_sizes": """WITH f AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
n AS (SELECT c_custkey AS seed, c_custkey AS node FROM customer UNION SELECT s.c_custkey, f.c_custkey FROM customer s JOIN f ON f.c_nationkey = s.c_nationkey WHERE f.k <= 2)
SELECT 'customer' AS name, count(*) AS n, count(DISTINCT seed) AS seeds FROM n UNION ALL SELECT 'nation', count(*), count(*) FROM customer UNION ALL SELECT 'region', count(*), count(*) FROM customer
UNION ALL SELECT 'features customer', count(*), CAST(2 AS BIGINT) FROM customer UNION ALL SELECT 'features nation', count(*), 1 FROM nation UNION ALL SELECT 'features region', count(*), 1 FROM region""",
    "node_batches": f"""WITH {_DEALT}, b AS (SELECT DISTINCT batch FROM d),
s AS (SELECT *, CAST(ceil((16 + 1) * 1.1) AS BIGINT) AS room FROM b, (VALUES ('customer'), ('nation'), ('region'), ('customer_in'), ('in_region')) v(name))
SELECT batch, name, room, CAST(CASE WHEN name IN ('customer', 'nation', 'region') THEN room - 16 ELSE 0 END AS BIGINT) AS spare, room - 1 AS last FROM s""",
    "batch_edges": f"""WITH {_DEALT} SELECT seed, 'customer_in' AS edge_set, CAST(seed AS VARCHAR) AS source, CAST(n AS VARCHAR) AS target FROM d UNION ALL SELECT seed, 'in_region', CAST(n AS VARCHAR), CAST(g AS VARCHAR) FROM d""",
    "edge_seeds": """WITH e AS (SELECT l_orderkey AS source, l_partkey AS target, min(epoch(l_shipdate)::BIGINT) AS t FROM lineitem GROUP BY 1, 2)
SELECT source, target, row_number() OVER (ORDER BY t DESC, concat_ws('-', source, target) DESC) <= CAST(floor((SELECT count(*) FROM e) * 0.2) AS BIGINT) AS valid FROM e""",
    "link_samples": f"""WITH p AS (SELECT p, count(*) AS d FROM {_SUP} GROUP BY 1), s AS (SELECT s, count(*) AS d FROM {_SUP} GROUP BY 1)
SELECT 'source' AS "end", count(*) AS seeds, CAST(sum(1 + least(2, p.d - 1)) AS BIGINT) AS nodes FROM {_SUP} e JOIN p ON p.p = e.p
UNION ALL SELECT 'target', count(*), CAST(sum(1 + least(2, s.d - 1)) AS BIGINT) FROM {_SUP} e JOIN s ON s.s = e.s""",
    "link_batches": f"""WITH e AS (SELECT p AS source, s AS target, count(*) OVER (PARTITION BY p) AS dp, count(*) OVER (PARTITION BY s) AS ds, concat_ws('|', p, s, 0) AS seed FROM {_SUP}),
r AS (SELECT *, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'batch', seed)")}, seed) - 1 AS r FROM e)
SELECT r // 32 AS batch, r % 32 AS slot, source, target, 1 + least(2, dp - 1) AS source_nodes, 1 + least(2, ds - 1) AS target_nodes FROM r WHERE r // 32 < (SELECT count(*) FROM e) // 32""",
    "training_scale": f"""WITH v AS (SELECT c_acctbal, row_number() OVER (ORDER BY {_HEX.format("concat_ws('|', 'split', c_custkey)")}, c_custkey) <= CAST(floor((SELECT count(*) FROM customer) * 0.2) AS BIGINT) AS valid FROM customer),
t AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM v WHERE NOT valid)
SELECT n, -0.5::DOUBLE AS low, 0.5::DOUBLE AS high, (SELECT count(*) FROM v WHERE c_acctbal < lo OR c_acctbal > hi) AS beyond FROM t""",
    "interleaved_links": f"WITH {_DRAWN} SELECT source, target, place, candidate, label FROM i",
    "separated_scores": f"WITH {_DRAWN} SELECT source, target, max(candidate * 2) FILTER (WHERE place = 0) AS positive, string_agg(CAST(candidate * 2 AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place > 0) AS negatives FROM i GROUP BY 1, 2",
    "seed_labels": f"WITH {_FIRST} {_NODES} SELECT seed, node_set, node, CAST(node_set = 'customer' AND node = CAST(seed AS VARCHAR) AS BIGINT) AS is_seed FROM n",
    "visit_order": f"""WITH {_FIRST} {_NODES}, k AS (SELECT *, CAST(CASE node_set WHEN 'customer' THEN 0 WHEN 'orders' THEN 1 ELSE 2 END AS BIGINT) AS hop FROM n)
SELECT seed, node_set, node, hop, row_number() OVER (PARTITION BY seed, node_set ORDER BY hop, node) - 1 AS idx FROM k""",
    "sample_statistics": f"""WITH {_FIRST} {_NODES},
pt AS (SELECT part.* FROM n JOIN part ON node_set = 'part' AND node = CAST(p_partkey AS VARCHAR)), o AS (SELECT orders.* FROM n JOIN orders ON node_set = 'orders' AND node = CAST(o_orderkey AS VARCHAR))
SELECT 'part' AS node_set, 'size' AS feature, count(*) AS n, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, CAST(0 AS BIGINT) AS missing FROM pt
UNION ALL SELECT 'part', 'retailprice', count(*), min(p_retailprice), max(p_retailprice), 0 FROM pt UNION ALL SELECT 'orders', 'totalprice', count(*), min(o_totalprice), max(o_totalprice), 0 FROM o""",
    "limited_statistics": """WITH p AS (SELECT * FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50)
SELECT 'size' AS feature, 'count' AS what, CAST(count(*) AS DOUBLE) AS n FROM p UNION ALL SELECT 'size', 'min', min(p_size) FROM p UNION ALL SELECT 'size', 'max', max(p_size) FROM p
UNION ALL SELECT 'brand', p_brand, count(*) FROM p GROUP BY p_brand""",
    "metric_means": """SELECT o_orderpriority, 'o_totalprice' AS metric, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, 'closed', round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) FROM orders GROUP BY 1""",
    "block_starts": f"""WITH d AS (SELECT p_partkey AS id, (SELECT count(*) FROM {_SUP} e WHERE e.p = p_partkey) AS degree FROM part)
SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d""",
    "sorted_edges": f"SELECT l_orderkey AS source, l_partkey AS target, {_KEY} AS ekey, row_number() OVER (ORDER BY l_orderkey, l_partkey, {_KEY}) - 1 AS place FROM lineitem",
    "component_sizes": f"WITH RECURSIVE {_CHAIN} SELECT component, count(*) AS n FROM c GROUP BY 1",
    "largest_component": f"WITH RECURSIVE {_CHAIN} SELECT component, count(*) AS n, count(*) / (SELECT count(*) FROM c)::DOUBLE AS share FROM c GROUP BY 1 ORDER BY n DESC, component LIMIT 1",
    "diameters": f"WITH RECURSIVE {_CHAIN}, x AS (SELECT s, max(d) AS d, min(t) AS component FROM m GROUP BY s) SELECT component, count(*) AS n, CAST(max(d) AS BIGINT) AS diameter FROM x GROUP BY component",
    "reach": f"WITH RECURSIVE {_CHAIN} SELECT s AS id, CAST(max(d) AS BIGINT) AS distance, count(*) AS reached FROM m GROUP BY 1",
    "eccentricities": f"WITH RECURSIVE {_CHAIN} SELECT s AS id, CAST(max(d) AS BIGINT) AS distance FROM m GROUP BY 1",
    "padded_graph": """WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier), c AS (SELECT count(*) AS n FROM supplier)
SELECT 'node' AS kind, idx AS a, id AS b FROM s UNION ALL SELECT 'node', n + i, NULL FROM c, range(5) t(i) UNION ALL SELECT 'edge', idx, idx FROM s UNION ALL SELECT 'edge', n + 4, n + 4 FROM c, range(3) t(i)""",
    "creation_times": """WITH f AS (SELECT o_custkey, min(epoch(o_orderdate)::BIGINT) AS t FROM orders GROUP BY 1)
SELECT orders.o_custkey AS source, o_orderkey AS target, greatest(f.t, epoch(o_orderdate)::BIGINT) AS ts FROM orders JOIN f USING (o_custkey)""",
    "parsed_times": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(CAST(o_orderdate AS DATE)) WHEN 1 THEN epoch_us(CAST(o_orderdate AS DATE)) + 3723500000 WHEN 2 THEN epoch_us(CAST(o_orderdate AS DATE)) + 3723000000
WHEN 3 THEN epoch_us(CAST(o_orderdate AS DATE)) + 3723000000 - 7200000000 END AS micros FROM orders""",
    "durations": """WITH d AS (SELECT o_orderkey, o_orderkey * 7 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm ' || s % 60 || 's' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || '.00s' END AS took, 'a' || chr(10) || '  ' || s AS text FROM d""",
    "synthetic_counts": "SELECT 'a' AS name, count(*) AS n FROM part UNION ALL SELECT 'vectors', count(*) FROM part UNION ALL SELECT 'b', count(*) FROM supplier UNION ALL SELECT 'ab', count(*) FROM lineitem UNION ALL SELECT 'bb', count(*) FROM customer",
}
