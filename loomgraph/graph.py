"""The graph: a schema, and one DataFrame for each node set and edge set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EdgeSet, GraphSchema, NodeSet, schema_of_table

SOURCE, TARGET = "source", "target"


@dataclass(frozen=True)
class Graph:
    """Node frames have their primary key; edge frames have ``source`` and ``target`` keys."""

    schema: GraphSchema
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    timestamp: int | None = None

    @staticmethod
    def from_table(df: DataFrame, name: str = "nodes", key: str | None = None, detect: bool = True) -> Graph:
        """A table as a graph of one node set and no edges."""
        return Graph(GraphSchema({name: schema_of_table(df.schema, key, detect)}), {name: df})

    @staticmethod
    def from_frames(nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[DataFrame, str, str]]) -> Graph:
        """From ``{set: (frame, key)}`` and ``{set: (frame, source set, target set)}``."""
        ns = {n: schema_of_table(df.schema, key) for n, (df, key) in nodes.items()}
        es = {n: EdgeSet(s, t, schema_of_table(df.drop(SOURCE, TARGET).schema).features) for n, (df, s, t) in edges.items()}
        return Graph(GraphSchema(ns, es), {n: d for n, (d, _) in nodes.items()}, {n: d for n, (d, _, _) in edges.items()})

    def key(self, node_set: str) -> str:
        return self.schema.node_sets[node_set].key()

    def ids(self, node_set: str) -> DataFrame:
        """The set's keys as ``id``."""
        return self.nodes[node_set].select(F.col(self.key(node_set)).alias("id"))

    def project(self, schema: GraphSchema) -> Graph:
        """Only the sets and features of ``schema``; rows are not filtered."""
        nodes = {n: self.nodes[n].select(*s.features) for n, s in schema.node_sets.items()}
        edges = {n: self.edges[n].select(SOURCE, TARGET, *s.features) for n, s in schema.edge_sets.items()}
        return replace(self, schema=schema, nodes=nodes, edges=edges)

    def without_edge_features(self) -> Graph:
        return self.project(self.schema.without_edge_features())

    def mapped(
        self,
        node_sets: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
        edge_sets: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    ) -> Graph:
        """Apply a function to each named set.

        If a dict is given, the sets of its kind that it does not name go; if it is
        None they all stay as they are.
        """
        nodes = self.nodes if node_sets is None else {n: f(self.nodes[n]) for n, f in node_sets.items()}
        edges = self.edges if edge_sets is None else {n: f(self.edges[n]) for n, f in edge_sets.items()}
        ns = {n: self.schema.node_sets[n] if node_sets is None else schema_of_table(d.schema, self.key(n) if self.schema.node_sets[n].key_or_none() in d.columns else None) for n, d in nodes.items()}
        es = {}
        for n, d in edges.items():
            old = self.schema.edge_sets[n]
            if old.source in ns and old.target in ns:
                es[n] = old if edge_sets is None else replace(old, features=schema_of_table(d.drop(SOURCE, TARGET).schema).features)
        return Graph(GraphSchema(ns, es), nodes, {n: d for n, d in edges.items() if n in es}, self.timestamp)


def node_schema(**features) -> NodeSet:
    return NodeSet(features)
