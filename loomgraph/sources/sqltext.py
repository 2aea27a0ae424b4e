"""SQL and GQL text for property-graph databases: reads, and table definitions."""

from __future__ import annotations

import re

from loomgraph.graph import SOURCE, TARGET
from loomgraph.schema import Feature, GraphSchema

#: Column types of a relational store (fixed values).
COLUMN_TYPES = {"INTEGER_32": "INT64", "INTEGER_64": "INT64", "FLOAT_32": "FLOAT64", "FLOAT_64": "FLOAT64", "BYTES": "BYTES(MAX)", "BOOL": "BOOL"}


def clean_name(name: str) -> str:
    """A name that a table or column may have."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", name.replace("#", "hash_"))
    return out if re.match(r"[A-Za-z_]", out) else f"_{out}"


def node_query(graph: str, label: str, properties: list[str]) -> str:
    """GQL that returns each node's id and a JSON bag of properties."""
    bag = ", ".join(f"'{p}', n.{p}" for p in properties)
    return f"GRAPH {graph} MATCH (n:{label}) RETURN n.id AS id, JSON_OBJECT({bag}) AS properties"


def edge_query(graph: str, label: str, properties: list[str]) -> str:
    bag = ", ".join(f"'{p}', e.{p}" for p in properties)
    return f"GRAPH {graph} MATCH (a)-[e:{label}]->(b) RETURN a.id AS {SOURCE}, b.id AS {TARGET}, JSON_OBJECT({bag}) AS properties"


def table_query(table: str, columns: list[str]) -> str:
    """The same rows from the base table."""
    return f"SELECT {', '.join(columns)} FROM {table}"


def _column(name: str, f: Feature) -> str:
    kind = "STRING(MAX)" if f.format == "BYTES" and f.is_text else COLUMN_TYPES[f.format]
    return f"{clean_name(name)} {f'ARRAY<{kind}>' if f.shape else kind}"


def table_definitions(schema: GraphSchema) -> list[str]:
    """CREATE TABLE statements with primary keys, and foreign keys from edges to nodes."""
    out = []
    for n, s in sorted(schema.node_sets.items()):
        columns = ",\n  ".join(_column(f, x) for f, x in s.features.items())
        out.append(f"CREATE TABLE {clean_name(n)} (\n  {columns}\n) PRIMARY KEY ({clean_name(s.key())})")
    for n, s in sorted(schema.edge_sets.items()):
        ends = [(SOURCE, s.source), (TARGET, s.target)]
        columns = [_column(c, schema.node_sets[o].features[schema.node_sets[o].key()]) for c, o in ends]
        columns += [_column(f, x) for f, x in s.features.items()]
        columns += [f"CONSTRAINT fk_{clean_name(n)}_{c} FOREIGN KEY ({c}) REFERENCES {clean_name(o)} ({clean_name(schema.node_sets[o].key())})" for c, o in ends]
        body = ",\n  ".join(columns)
        out.append(f"CREATE TABLE {clean_name(n)} (\n  {body}\n) PRIMARY KEY ({SOURCE}, {TARGET})")
    return out


def flat_name(kind: str, set_name: str, feature: str) -> str:
    """The name of a feature in a flat dictionary of columns."""
    return f"{kind}__{set_name}__{feature}".replace("#", "_hash_")


def partition_bounds(low: int, high: int, parts: int) -> list[str]:
    """Predicates that cut a key range for a parallel read."""
    step = max(1, -(-(high - low + 1) // parts))
    return [f"key >= {a} AND key < {min(a + step, high + 1)}" for a in range(low, high + 1, step)]
