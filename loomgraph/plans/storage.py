"""Queries that write and read graphs, samples and sidecars, and those about schemas and their text forms."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import normalize as nz
from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators import filters, statistics, validation
from loomgraph.operators import sampling as S
from loomgraph.plans.samples import _FIRST, _sampler, _seeds
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet, repaired, schema_of_table, timeseries_groups
from loomgraph.session import shared_folder
from loomgraph.sources import external, native, sqltext, tables
from loomgraph.sources.tables import trade_graph


def _place(spark) -> str:
    return f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"


def _counted(g: Graph) -> DataFrame:
    """Rows and key sums of every set."""
    parts = [d.agg(F.count("*").alias("n"), F.sum(F.col(g.key(n)).cast("long")).alias("keys")).select(F.lit("node").alias("kind"), F.lit(n).alias("name"), "n", "keys") for n, d in g.nodes.items()]
    ends = F.sum(F.col(SOURCE).cast("long") + F.col(TARGET).cast("long"))
    parts += [d.agg(F.count("*").alias("n"), ends.alias("keys")).select(F.lit("edge").alias("kind"), F.lit(n).alias("name"), "n", "keys") for n, d in g.edges.items()]
    return reduce(DataFrame.unionByName, parts)


def graph_round_trip(spark, sf_dir):
    """The trade graph written as a directory of shards and read again."""
    path = _place(spark)
    native.write_graph(trade_graph(spark, sf_dir), path)
    return _counted(native.read_graph(spark, path))


def graph_shards(spark, sf_dir):
    """The files of a set when one is asked for, and the rows of each."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    native.write_graph(g.project(g.schema.filtered(node_set=lambda n: n == "part")), path, max_shards=1)
    rows = spark.read.parquet(f"{path}/{native.NODE_DIR}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return rows.agg(F.count("*").alias("n"))


def graph_pruned_read(spark, sf_dir):
    """Two features of one set, read under a narrower schema."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    native.write_graph(g, path)
    small = native.read_schema(spark, path).filtered(node_set=lambda n: n == "customer", node_feature=lambda n, f: f in ("id", "acctbal"))
    return native.read_graph(spark, path, small).nodes["customer"].select("id", "acctbal")


def graph_without_dangling(spark, sf_dir):
    """A graph whose part set is too small, read without the edges that then hang."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    g.nodes["part"] = g.nodes["part"].where("size > 25")
    native.write_graph(g, path)
    return native.read_graph(spark, path, drop_dangling=True).edges["contains"].select("ekey", SOURCE, TARGET)


def project_graph(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return _counted(g.project(g.schema.filtered(node_set=lambda n: n in ("customer", "nation"))))


def mapped_sets(spark, sf_dir):
    """A function on one node set; node sets that are not named go, and edges with them."""
    g = trade_graph(spark, sf_dir).mapped(node_sets={"orders": lambda d: d.where("totalprice > 100000"), "customer": lambda d: d})
    return _counted(g)


def one_table_graph(spark, sf_dir):
    g = Graph.from_table(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "supplier", "s_suppkey")
    return g.ids("supplier").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))


def literal_graph(spark, sf_dir):
    """The nations and regions as literal rows, and the pairs back from the driver."""
    taken = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
    nodes = {"nation": taken("nation", "n_nationkey", "n_name"), "region": taken("region", "r_regionkey", "r_name")}
    pairs = taken("nation", "n_nationkey", "n_regionkey")
    g = external.from_lists(spark, nodes, {n: "id long, name string" for n in nodes}, {"in_region": (pairs, "nation", "region")}, {n: "id" for n in nodes})
    return spark.createDataFrame(external.edge_lists(g)["in_region"], "source long, target long")


def samples_round_trip(spark, sf_dir):
    """Samples written in long form and read again: nodes and edges of each set."""
    path = _place(spark)
    s = _sampler(spark, sf_dir)
    native.write_sample(s.sample(_seeds(s)), path)
    back = native.read_sample(spark, path)
    n = back.nodes.groupBy(F.col("node_set").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(back.edges.groupBy(F.col("edge_set").alias("name")).agg(F.count("*").alias("n")))


def statistics_round_trip(spark, sf_dir):
    """Feature statistics as a sidecar, read again."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    found = {r["feature"]: [r["n"], r["low"], r["high"]] for r in statistics.feature_statistics(g.nodes["part"], ["size", "retailprice"]).collect()}
    native.write_statistics(spark, path, found)
    rows = [(f, int(n), float(lo), float(hi)) for f, (n, lo, hi) in native.read_statistics(spark, path).items()]
    return spark.createDataFrame(rows, "feature string, n long, low double, high double")


def topology_round_trip(spark, sf_dir):
    """Sizes of all sets as a sidecar, read again."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    found = [[r["kind"], r["name"], r["n"]] for r in statistics.topology(g.nodes, g.edges).collect()]
    native.write_statistics(spark, path, {"sets": found}, "topology.json")
    return spark.createDataFrame([tuple(r) for r in native.read_statistics(spark, path, "topology.json")["sets"]], "kind string, name string, n long")


def cached_frame(spark, sf_dir):
    """Made and written the first time, read the second."""
    path, calls = _place(spark), []

    def make():
        calls.append(1)
        return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")

    native.cached(spark, path, make)
    return native.cached(spark, path, make).withColumn("made", F.lit(len(calls)).cast("long"))


def snapshot_counts(spark, sf_dir):
    """Two dated graphs in one directory, read again."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n in ("customer", "orders")))
    early = {"orders": g.nodes["orders"].where("ts < 800000000")}
    old = replace(g, nodes=g.nodes | early, edges={"placed": g.edges["placed"].where("ts < 800000000")}, timestamp=1)
    native.write_snapshots({"a": old, "b": replace(g, timestamp=2)}, path)
    found = native.read_snapshots(spark, path)
    return reduce(DataFrame.unionByName, [_counted(s).select(F.lit(n).alias("snapshot"), F.lit(s.timestamp).cast("long").alias("at"), "kind", "name", "n") for n, s in found.items()])


def snapshot_faults(spark, sf_dir):
    """What a directory with a snapshot for each region lacks: some have no time, some that of the one before, one no metadata."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    g = g.project(g.schema.filtered(node_set=lambda n: n == "region", node_feature=lambda n, f: True))
    keys = [r["id"] for r in g.nodes["region"].select("id").orderBy("id").collect()]
    own = {f"r{k}": replace(g, nodes={"region": g.nodes["region"].where(F.col("id") == k)}, timestamp=None if k % 5 == 4 else k // 2) for k in keys}
    native.write_snapshots(own, path)
    native.Store(spark, path).write("snapshots/x/note.txt", "empty")
    native.Store(spark, path).write("metadata.json", json.dumps({"version": 0}))
    return spark.createDataFrame(validation.snapshot_directory_issues(spark, path), "severity string, issue string")


def split_column(spark, sf_dir):
    """A published split as a column: lists of ids for training, validation and test."""
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    some = lambda k: ids.where(F.col("id") % 5 == k)
    return external.split_column(F.col("id"), some(0), some(1), some(2), ids, "split").select("id", "split")


def selected_sets(spark, sf_dir):
    """Node and edge sets by the SELECT texts that a warehouse would run."""
    for t in ("customer", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"loom_{t}")
    n = spark.sql(tables.node_select(tables.NodeTable("loom_customer", ("c_custkey",), {"segment": "c_mktsegment"})))
    e = spark.sql(tables.edge_select(tables.EdgeTable("loom_lineitem", ("l_orderkey", "l_linenumber"), ("l_partkey",), "line", "part")))
    return n.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("a"), F.col("segment").alias("b")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col(SOURCE).alias("a"), F.col(TARGET).cast("string").alias("b"))
    )


def database_texts(spark, sf_dir):
    """The texts that a property-graph database gets for the orders: a query of each set, table definitions, names, and key ranges of the keys there are."""
    g = trade_graph(spark, sf_dir)
    schema = GraphSchema({"orders 1": NodeSet({"id": g.schema.node_sets["orders"].features["id"], "x": Feature("FLOAT_32", "EMBEDDING", (2,))})}, {"e": EdgeSet("orders 1", "orders 1", {"w": Feature("FLOAT_64", "NUMERICAL")})})
    low, high = g.nodes["orders"].agg(F.min("id"), F.max("id")).first()
    rows = [("node", sqltext.node_query("G", "O", ["status"])), ("edge", sqltext.edge_query("G", "E", ["w"])), ("table", sqltext.table_query("t", ["a", "b"]))]
    rows += [("definition", t) for t in sqltext.table_definitions(schema)]
    rows += [("range", t) for t in sqltext.partition_bounds(low, high, 3)]
    rows += [("name", sqltext.clean_name("2#a-b")), ("name", sqltext.flat_name("nodes", "a", "#id")), ("export", tables.export_statement("SELECT 1", "/x"))]
    return spark.createDataFrame(rows, "kind string, text string")


def inferred_schema(spark, sf_dir):
    """Features found from a table's column types, and how many rows know each."""
    out = []
    for t, key in (("orders", "o_orderkey"), ("embeddings", "vec_id")):
        d = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        found = schema_of_table(d.schema, key).features
        known = d.agg(*[F.count(n).alias(n) for n in found])
        rows = [F.struct(F.lit(n).alias("name"), F.lit(f.format).alias("format"), F.lit(f.semantic).alias("semantic"), F.lit(len(f.shape or ())).cast("long").alias("dims"), F.col(n).alias("known")) for n, f in found.items()]
        out.append(known.select(F.inline(F.array(*rows))))
    return out[0].unionByName(out[1])


def repaired_schema(spark, sf_dir):
    """Keys, meanings, shapes and formats that a broken schema of the customers lacks, and how many rows the repaired one reads."""
    broken = GraphSchema(
        {"a": NodeSet({"id": Feature("INTEGER_32", shape=(None, 1)), "v": Feature("FLOAT_64", shape=(None, 3))}), "b": NodeSet({"is_x": Feature("INTEGER_64"), "t": Feature("BYTES")})},
        {"e": EdgeSet("a", "b", {"id": Feature("BYTES"), "w": Feature("BOOL")}), "f": EdgeSet("a", "a", {"w": Feature("FLOAT_32")})},
    )
    s = repaired(broken, fallback_key=True, narrow=True)
    rows = [(f"{kind} {n}", f, x.format, x.semantic, json.dumps(x.shape)) for kind, sets in (("node", s.node_sets), ("edge", s.edge_sets)) for n, c in sets.items() for f, x in c.features.items()]
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.array("c_acctbal", "c_acctbal", "c_acctbal").alias("v"))
    kinds = {n: x.spark_type() for n, x in s.node_sets["a"].features.items()}
    read = d.select(*[F.col(n).cast(k).alias(n) for n, k in kinds.items()]).where("id IS NOT NULL AND v IS NOT NULL")
    fixed = spark.createDataFrame([*rows, ("graph", "is_homogeneous", str(s.is_homogeneous()).lower(), "", "")], "owner string, name string, format string, semantic string, shape string")
    n = read.agg(F.count("*").cast("string").alias("format"), F.countDistinct("id").cast("string").alias("semantic"))
    return fixed.unionByName(n.select(F.lit("rows").alias("owner"), F.lit("a").alias("name"), "format", "semantic", F.lit("").alias("shape")))


def schema_text(spark, sf_dir):
    """A written graph's schema in its published text form, with a field of a later version: read again, and the rows it then reads."""
    path = _place(spark)
    g = trade_graph(spark, sf_dir)
    native.write_graph(g.project(g.schema.filtered(node_set=lambda n: n in ("nation", "region"))), path)
    store = native.Store(spark, path)
    text = json.loads(store.text("schema.json"))
    text["node_sets"]["nation"]["features"]["name"] |= {"newer": 1, "num_categorical_values": 25, "shape": None}
    store.write("schema.json", json.dumps(text))
    back = native.read_graph(spark, path)
    kept = json.loads(back.schema.to_json())
    rows = [(k, json.dumps(v)) for k, v in kept["node_sets"]["nation"]["features"]["name"].items()]
    rows = [*rows, ("edge", json.dumps(kept["edge_sets"]["in_region"]))]
    counts = back.nodes["nation"].agg(F.count("name").cast("string").alias("value")).select(F.lit("names").alias("field"), "value")
    return spark.createDataFrame(rows, "field string, value string").unionByName(counts)


def series_groups(spark, sf_dir):
    """Which series of the users' events share a clock and a mask, and how many steps each group's clock has."""
    stamp = lambda **k: Feature("INTEGER_64", "TIMESTAMP", (None,), is_timeseries=True, is_creation_time=True, **k)
    f = {"time": stamp(group="g"), "x": Feature("FLOAT_32", "NUMERICAL", (None,), is_timeseries=True, group="g"), "seen": Feature("BOOL", "MASK", (None,), is_timeseries=True, group="g"), "alone": stamp(), "plain": Feature("FLOAT_32", "NUMERICAL")}
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.col("value").alias("x"), F.col("value").isNotNull().alias("seen"))
    users = e.groupBy("user_id").agg(*[F.collect_list(c).alias(c) for c in ("time", "x", "seen")], F.array(F.max("time")).alias("alone"))
    held = [users.agg(F.sum(F.size(d["clock"])).alias("steps")).select(*[F.lit(v).cast("string").alias(k) for k, v in (("name", g), ("clock", d["clock"]), ("mask", d["mask"]), ("members", ",".join(d["members"])))], "steps") for g, d in timeseries_groups(f).items()]
    return reduce(DataFrame.unionByName, held)


def described_plan(spark, sf_dir):
    """The readable listing of a sampling plan and of a schema's first set, with the set's rows."""
    g = trade_graph(spark, sf_dir)
    plan = S.hop_plan(g.schema, "customer", 2, 3, only=["placed", "contains"]).described().split("\n")
    text = g.schema.filtered(node_set=lambda n: n == "region").described().split("\n")
    lines = spark.createDataFrame([(i, t) for i, t in enumerate([*plan, *text])], "line long, text string")
    rows = g.nodes["region"].agg(F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("text"))
    return lines.unionByName(rows.select(F.lit(len(plan) + len(text)).cast("long").alias("line"), "text"))


def planted_faults(spark, sf_dir):
    """The customers and their orders with a fault of each kind planted in some of them, and what the validator says."""
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = c.selectExpr(
        "CAST(CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN c_custkey + 1 ELSE c_custkey END AS INT) AS id", "CAST(c_acctbal AS FLOAT) AS x", "IF(c_custkey % 10 = 3, array(1L, 2L), array(3L)) AS clock",
        "array(1.0F) AS series", "IF(c_custkey % 10 = 4, array(true), array(true, false)) AS seen", "5L AS born",
    )
    e = o.selectExpr("CAST(IF(o_orderkey % 50 = 0, -o_custkey, o_custkey) AS INT) AS source", "CAST(o_custkey AS INT) AS target")
    series = {"is_timeseries": True, "group": "g"}
    nodes = {
        "id": Feature("INTEGER_32", "PRIMARY_ID"), "x": Feature("FLOAT_64", "NUMERICAL"), "clock": Feature("INTEGER_64", "TIMESTAMP", (None,), is_creation_time=True, **series), "series": Feature("FLOAT_32", "NUMERICAL", (None,), **series),
        "seen": Feature("BOOL", "MASK", (2,)), "born": Feature("INTEGER_64", "NUMERICAL", is_creation_time=True), "gone": Feature("FLOAT_32", "UNKNOWN", group="h"),
    }
    schema = GraphSchema({"n": NodeSet(nodes), "m": NodeSet({"a": Feature("BYTES", "CATEGORICAL")}), "k": NodeSet({"a": Feature("INTEGER_32", "PRIMARY_ID"), "b": Feature("INTEGER_32", "PRIMARY_ID")})}, {"e": EdgeSet("n", "n"), "z": EdgeSet("n", "nowhere")})
    k = c.selectExpr("CAST(c_custkey AS INT) AS a", "CAST(c_nationkey AS INT) AS b")
    return validation.issues(Graph(schema, {"n": n, "k": k}, {"e": e}))


def restored_normalizers(spark, sf_dir):
    """Normalizers written as text, read again and applied."""
    chain = [nz.from_json(z.to_json()) for z in (nz.HashBucket(10), nz.Identity())]
    d = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return nz.normalized(d, {"n_name": chain}, ["n_nationkey"])


def own_normalizer(spark, sf_dir):
    """A user's own normalizer in a plan."""

    class Length(nz.Normalizer):
        def columns(self, name, value):
            return {f"{name}_LENGTH": F.char_length(value).cast("long")}

    d = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return nz.normalized(d, {"p_name": [Length()]}, ["p_partkey"])


def own_predicate(spark, sf_dir):
    """Samples by a user's own predicate: more order than part nodes."""

    class OrdersLead:
        def aggregate(self):
            n = lambda kind: F.count(F.when(F.col("node_set") == kind, 1))
            return n("orders") > n("part")

    s = _sampler(spark, sf_dir)
    return filters.filter_samples(s.sample(_seeds(s)).nodes, {"orders_lead": OrdersLead()})


QUERIES = {
    f.__name__: f
    for f in (
        graph_round_trip, graph_shards, graph_pruned_read, graph_without_dangling, project_graph, mapped_sets, one_table_graph, literal_graph, samples_round_trip, statistics_round_trip,
        topology_round_trip, cached_frame, snapshot_counts, snapshot_faults, split_column, selected_sets, database_texts, inferred_schema, repaired_schema, schema_text, series_groups,
        described_plan, planted_faults, restored_normalizers, own_normalizer, own_predicate,
    )
}

_SUP = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
_COUNTS = {
    "customer": "SELECT 'node' AS kind, 'customer' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer",
    "orders": "SELECT 'node', 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders",
    "part": "SELECT 'node', 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part",
    "supplier": "SELECT 'node', 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier",
    "nation": "SELECT 'node', 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation",
    "region": "SELECT 'node', 'region', count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region",
    "placed": "SELECT 'edge', 'placed', count(*), CAST(sum(o_custkey + o_orderkey) AS BIGINT) FROM orders",
    "contains": "SELECT 'edge', 'contains', count(*), CAST(sum(l_orderkey + l_partkey) AS BIGINT) FROM lineitem",
    "supplied_by": f"SELECT 'edge', 'supplied_by', count(*), CAST(sum(l_partkey + l_suppkey) AS BIGINT) FROM {_SUP}",
    "customer_in": "SELECT 'edge', 'customer_in', count(*), CAST(sum(c_custkey + c_nationkey) AS BIGINT) FROM customer",
    "supplier_in": "SELECT 'edge', 'supplier_in', count(*), CAST(sum(s_suppkey + s_nationkey) AS BIGINT) FROM supplier",
    "in_region": "SELECT 'edge', 'in_region', count(*), CAST(sum(n_nationkey + n_regionkey) AS BIGINT) FROM nation",
}
_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_NODES = """n AS (SELECT c_custkey AS seed, 'customer' AS node_set, CAST(c_custkey AS VARCHAR) AS node FROM customer
UNION SELECT seed, 'orders', CAST(b AS VARCHAR) FROM h1 UNION SELECT seed, 'part', CAST(b AS VARCHAR) FROM h2)"""


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


ORACLE = {
    "graph_round_trip": " UNION ALL ".join(_COUNTS.values()),
    "graph_shards": "SELECT 'part-00000-of-00001.parquet' AS file, count(*) AS n FROM part",
    "graph_pruned_read": "SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer",
    "graph_without_dangling": f"SELECT {_KEY} AS ekey, l_orderkey AS source, l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25",
    "project_graph": " UNION ALL ".join(_COUNTS[k] for k in ("customer", "nation", "customer_in")),
    "mapped_sets": " UNION ALL ".join([_COUNTS["customer"], _COUNTS["orders"] + " WHERE o_totalprice > 100000", _COUNTS["placed"]]),
    "one_table_graph": "SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier",
    "literal_graph": "SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_regionkey AS BIGINT) AS target FROM nation",
    "samples_round_trip": f"""WITH {_FIRST} {_NODES} SELECT node_set AS name, count(*) AS n FROM n GROUP BY 1
UNION ALL SELECT 'placed', count(*) FROM (SELECT DISTINCT seed, a, b FROM h1) UNION ALL SELECT 'contains', count(*) FROM h2""",
    "statistics_round_trip": """SELECT 'size' AS feature, count(*) AS n, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high FROM part
UNION ALL SELECT 'retailprice', count(*), min(p_retailprice), max(p_retailprice) FROM part""",
    "topology_round_trip": "SELECT kind || 's' AS kind, name, n FROM (" + " UNION ALL ".join(_COUNTS.values()) + ")",
    "cached_frame": "SELECT n_nationkey, n_name, CAST(1 AS BIGINT) AS made FROM nation",
    "snapshot_counts": """WITH e AS (SELECT count(*) AS n FROM orders WHERE epoch(o_orderdate)::BIGINT < 800000000), o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer)
SELECT 'a' AS snapshot, CAST(1 AS BIGINT) AS at, 'node' AS kind, 'customer' AS name, n FROM c UNION ALL SELECT 'a', 1, 'node', 'orders', n FROM e UNION ALL SELECT 'a', 1, 'edge', 'placed', n FROM e
UNION ALL SELECT 'b', 2, 'node', 'customer', n FROM c UNION ALL SELECT 'b', 2, 'node', 'orders', n FROM o UNION ALL SELECT 'b', 2, 'edge', 'placed', n FROM o""",
    "snapshot_faults": """WITH s AS (SELECT r_regionkey AS k, CASE WHEN r_regionkey % 5 = 4 THEN NULL ELSE r_regionkey // 2 END AS t FROM region),
f AS (SELECT k, t, min(k) OVER (PARTITION BY t) AS f FROM s)
SELECT 'error' AS severity, 'metadata.json: the format is not graph_snapshots' AS issue UNION ALL SELECT 'error', 'snapshot x: no metadata.json'
UNION ALL SELECT 'error', 'snapshot r' || k || ': no timestamp' FROM f WHERE t IS NULL UNION ALL SELECT 'error', 'snapshot r' || k || ': same timestamp as r' || f FROM f WHERE t IS NOT NULL AND f <> k""",
    "split_column": "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' ELSE '' END AS split FROM part",
    "selected_sets": "SELECT 'node' AS kind, CAST(c_custkey AS VARCHAR) AS a, c_mktsegment AS b FROM customer UNION ALL SELECT 'edge', l_orderkey || '|' || l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem",
    "database_texts": _values(
        "kind, text",
        "('node', 'GRAPH G MATCH (n:O) RETURN n.id AS id, JSON_OBJECT(''status'', n.status) AS properties')",
        "('edge', 'GRAPH G MATCH (a)-[e:E]->(b) RETURN a.id AS source, b.id AS target, JSON_OBJECT(''w'', e.w) AS properties')",
        "('table', 'SELECT a, b FROM t')",
        "('definition', 'CREATE TABLE orders_1 (' || chr(10) || '  id INT64,' || chr(10) || '  x ARRAY<FLOAT64>' || chr(10) || ') PRIMARY KEY (id)')",
        "('definition', 'CREATE TABLE e (' || chr(10) || '  source INT64,' || chr(10) || '  target INT64,' || chr(10) || '  w FLOAT64,' || chr(10) || '  CONSTRAINT fk_e_source FOREIGN KEY (source) REFERENCES orders_1 (id),' || chr(10) || '  CONSTRAINT fk_e_target FOREIGN KEY (target) REFERENCES orders_1 (id)' || chr(10) || ') PRIMARY KEY (source, target)')",
        "('name', '_2hash_a_b')", "('name', 'nodes__a___hash_id')", "('export', 'INSERT OVERWRITE DIRECTORY ''/x'' USING parquet SELECT 1')",
    ) + """ UNION ALL SELECT 'range', 'key >= ' || (lo + i * step) || ' AND key < ' || least(lo + (i + 1) * step, hi + 1)
FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, (max(o_orderkey) - min(o_orderkey) + 3) // 3 AS step FROM orders), range(3) r(i) WHERE lo + i * step <= hi""",
    "inferred_schema": "SELECT v.*, known FROM (" + _values(
        "name, format, semantic, dims", "('o_orderkey', 'INTEGER_64', 'PRIMARY_ID', CAST(0 AS BIGINT))", "('o_custkey', 'INTEGER_64', 'NUMERICAL', 0)", "('o_orderstatus', 'BYTES', 'CATEGORICAL', 0)", "('o_totalprice', 'FLOAT_64', 'NUMERICAL', 0)",
        "('o_orderdate', 'INTEGER_64', 'TIMESTAMP', 0)", "('o_orderpriority', 'BYTES', 'CATEGORICAL', 0)", "('vec_id', 'INTEGER_64', 'PRIMARY_ID', 0)", "('embedding', 'FLOAT_32', 'NUMERICAL', 1)", "('label', 'INTEGER_32', 'NUMERICAL', 0)",
    ) + ") v JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS known FROM {t}" for t, cs in (("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"), ("embeddings", "vec_id embedding label")) for c in cs.split()) + ") k USING (name)",
    "repaired_schema": _values(
        "owner, name, format, semantic, shape", "('node a', 'id', 'INTEGER_64', 'PRIMARY_ID', '[]')", "('node a', 'v', 'FLOAT_32', 'NUMERICAL', '[3]')", "('node b', 'is_x', 'INTEGER_64', 'CATEGORICAL', 'null')", "('node b', 't', 'BYTES', 'CATEGORICAL', 'null')",
        "('node b', '#id', 'BYTES', 'PRIMARY_ID', 'null')", "('edge e', 'id', 'BYTES', 'PRIMARY_ID', 'null')", "('edge e', 'w', 'INTEGER_64', 'NUMERICAL', 'null')", "('edge f', 'w', 'FLOAT_32', 'NUMERICAL', 'null')", "('graph', 'is_homogeneous', 'false', '', '')",
    ) + " UNION ALL SELECT 'rows', 'a', CAST(count(*) AS VARCHAR), CAST(count(DISTINCT c_custkey) AS VARCHAR), '' FROM customer",
    "schema_text": _values(
        "field, value", "('format', '\"BYTES\"')", "('semantic', '\"CATEGORICAL\"')", "('shape', 'null')", "('num_categorical_values', '25')", "('is_utf8_string', 'true')", "('is_timeseries', 'false')", "('is_creation_time', 'false')", "('group', 'null')",
        "('edge', '{\"source\": \"nation\", \"target\": \"region\", \"features\": {}}')",
    ) + " UNION ALL SELECT 'names', CAST(count(n_name) AS VARCHAR) FROM nation",
    "series_groups": "SELECT 'alone' AS name, 'alone' AS clock, NULL AS mask, '' AS members, count(DISTINCT user_id) AS steps FROM events UNION ALL SELECT 'g', 'time', 'seen', 'x', count(*) FROM events",
    "described_plan": _values(
        "line, text", "(CAST(0 AS BIGINT), 'customer')", "(1, '  -> placed -> orders (width 3)')", "(2, '    -> contains -> part (width 3)')", "(3, '    <- placed -> customer (width 3)')", "(4, 'node set region')", "(5, '  id: INTEGER_32 PRIMARY_ID')", "(6, '  name: BYTES CATEGORICAL')",
    ) + " UNION ALL SELECT 7, count(*) || ' rows' FROM region",
    "planted_faults": "WITH c AS (SELECT *, CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN c_custkey + 1 ELSE c_custkey END AS id FROM customer), x AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS s, o_custkey AS t FROM orders), f AS (" + _values(
        "severity, issue", "('warning', 'node set m: 0 primary keys')", "('error', 'node set m: no frame')", "('error', 'node set k: 2 primary keys')", "('error', 'edge set z: unknown node set nowhere')", "('error', 'edge set z: no frame')",
        "('error', 'node set n: mask seen has no group')", "('error', 'node set n: creation time born is not a TIMESTAMP')", "('warning', 'node set n: gone has no meaning')", "('error', 'node set n: gone has a group but is no time series')",
        "('error', 'node set n: x is float, not double')", "('error', 'node set n: no column gone')",
    ) + """ UNION ALL SELECT 'error', 'node set n: ' || count(*) || ' rows whose seen has not 2 entries' FROM c WHERE c_custkey % 10 = 4 HAVING count(*) > 0
UNION ALL SELECT 'error', 'node set n: ' || count(*) || ' rows whose series is not as long as clock' FROM c WHERE c_custkey % 10 = 3 HAVING count(*) > 0
UNION ALL SELECT 'error', 'node set n: ' || count(*) || ' repeated keys' FROM (SELECT id FROM c WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'error', 'node set n: ' || count(*) || ' null keys' FROM c WHERE id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'error', 'edge set e: ' || count(*) || ' edges with an unknown source' FROM x WHERE s NOT IN (SELECT id FROM c WHERE id IS NOT NULL) HAVING count(*) > 0
UNION ALL SELECT 'error', 'edge set e: ' || count(*) || ' edges with an unknown target' FROM x WHERE t NOT IN (SELECT id FROM c WHERE id IS NOT NULL) HAVING count(*) > 0) SELECT * FROM f""",
    "restored_normalizers": "SELECT n_nationkey, ('0x' || substr(md5(n_name), 1, 8))::BIGINT % 10 AS \"n_name_HASH\", n_name FROM nation",
    "own_normalizer": "SELECT p_partkey, length(p_name) AS \"p_name_LENGTH\" FROM part",
    "own_predicate": f"""WITH {_FIRST} {_NODES} SELECT seed, 'orders_lead' AS name FROM n GROUP BY seed HAVING count(*) FILTER (WHERE node_set = 'orders') > count(*) FILTER (WHERE node_set = 'part')""",
}
