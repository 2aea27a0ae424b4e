"""Relational tables as a property graph: which table and key makes which set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph

SEPARATOR = "|"


@dataclass(frozen=True)
class NodeTable:
    """A node set from a table: key columns, and features as {name: SQL expression}."""

    table: str
    keys: tuple[str, ...]
    features: dict[str, str] = field(default_factory=dict)
    key_name: str = "id"


@dataclass(frozen=True)
class EdgeTable:
    table: str
    source_keys: tuple[str, ...]
    target_keys: tuple[str, ...]
    source_set: str
    target_set: str
    features: dict[str, str] = field(default_factory=dict)


def key_expression(keys: tuple[str, ...]) -> str:
    """One key column as it is; several are joined into a string."""
    if len(keys) == 1:
        return keys[0]
    return "concat(" + f", '{SEPARATOR}', ".join(f"CAST({k} AS STRING)" for k in keys) + ")"


def node_select(t: NodeTable) -> str:
    """The SELECT that makes the node set; also the text for a database that runs it itself."""
    columns = [f"{key_expression(t.keys)} AS `{t.key_name}`", *[f"{e} AS `{n}`" for n, e in t.features.items()]]
    return f"SELECT {', '.join(columns)} FROM {t.table}"


def edge_select(t: EdgeTable) -> str:
    columns = [f"{key_expression(t.source_keys)} AS `{SOURCE}`", f"{key_expression(t.target_keys)} AS `{TARGET}`", *[f"{e} AS `{n}`" for n, e in t.features.items()]]
    return f"SELECT {', '.join(columns)} FROM {t.table}"


def export_statement(select: str, folder: str) -> str:
    """Write a SELECT's rows as Parquet."""
    return f"INSERT OVERWRITE DIRECTORY '{folder}' USING parquet {select}"


def build(spark: SparkSession, tables: dict[str, DataFrame], nodes: dict[str, NodeTable], edges: dict[str, EdgeTable]) -> Graph:
    """The graph that the mappings describe, as lazy selections."""

    def rows(table: str, columns: list[str]) -> DataFrame:
        return tables[table].selectExpr(*columns)

    ns = {n: (rows(t.table, [f"{key_expression(t.keys)} AS `{t.key_name}`", *[f"{e} AS `{f}`" for f, e in t.features.items()]]), t.key_name) for n, t in nodes.items()}
    es = {
        n: (
            rows(t.table, [f"{key_expression(t.source_keys)} AS {SOURCE}", f"{key_expression(t.target_keys)} AS {TARGET}", *[f"{e} AS `{f}`" for f, e in t.features.items()]]),
            t.source_set,
            t.target_set,
        )
        for n, t in edges.items()
    }
    return Graph.from_frames(ns, es)


NODES = {
    "customer": NodeTable("customer", ("c_custkey",), {"nation": "c_nationkey", "acctbal": "c_acctbal", "segment": "c_mktsegment"}),
    "orders": NodeTable("orders", ("o_orderkey",), {"status": "o_orderstatus", "totalprice": "o_totalprice", "priority": "o_orderpriority", "ts": "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"}),
    "part": NodeTable("part", ("p_partkey",), {"brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "supplier": NodeTable("supplier", ("s_suppkey",), {"nation": "s_nationkey", "acctbal": "s_acctbal"}),
    "nation": NodeTable("nation", ("n_nationkey",), {"name": "n_name"}),
    "region": NodeTable("region", ("r_regionkey",), {"name": "r_name"}),
}
EDGES = {
    "placed": EdgeTable("orders", ("o_custkey",), ("o_orderkey",), "customer", "orders", {"ts": "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"}),
    "contains": EdgeTable(
        "lineitem", ("l_orderkey",), ("l_partkey",), "orders", "part",
        {"ekey": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "ts": "unix_seconds(CAST(l_shipdate AS TIMESTAMP))", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"},
    ),
    "supplied_by": EdgeTable("lineitem", ("l_partkey",), ("l_suppkey",), "part", "supplier"),
    "customer_in": EdgeTable("customer", ("c_custkey",), ("c_nationkey",), "customer", "nation"),
    "supplier_in": EdgeTable("supplier", ("s_suppkey",), ("s_nationkey",), "supplier", "nation"),
    "in_region": EdgeTable("nation", ("n_nationkey",), ("n_regionkey",), "nation", "region"),
}


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The driver tables as a graph; parts and suppliers are joined once each pair."""
    names = {t.table for t in (*NODES.values(), *EDGES.values())}
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    g = build(spark, tables, NODES, EDGES)
    g.edges["supplied_by"] = g.edges["supplied_by"].distinct()
    return g


def rows_from_json(df: DataFrame, column: str, ddl: str, defaults: dict | None = None) -> DataFrame:
    """Property bags in a JSON column as features.

    The graph model has no nulls: a missing property becomes 0, false, an empty string
    or an empty list, by its type, unless ``defaults`` names another value.
    """
    parsed = df.select("*", F.from_json(column, ddl).alias("__bag"))
    fields = parsed.schema["__bag"].dataType.fields
    empty = {"string": "''", "boolean": "false"}
    out = []
    for f in fields:
        kind = f.dataType.simpleString()
        blank = f"CAST(array() AS {kind})" if kind.startswith("array") else f"CAST({empty.get(kind, '0')} AS {kind})"
        value = F.lit(defaults[f.name]).cast(f.dataType) if defaults and f.name in defaults else F.expr(blank)
        out.append(F.coalesce(F.col("__bag")[f.name], value).alias(f.name))
    return parsed.select(*[c for c in df.columns if c != column], *out)
