"""Filters of samples by what they contain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeCount:
    """lower <= number of nodes < upper; without a node set, of all sets together."""

    lower: int | None = None
    upper: int | None = None
    node_set: str | None = None

    def aggregate(self) -> Column:
        mine = F.lit(True) if self.node_set is None else F.col("node_set") == self.node_set
        n = F.count(F.when(mine, 1))
        ok = F.lit(True)
        if self.lower is not None:
            ok = ok & (n >= self.lower)
        if self.upper is not None:
            ok = ok & (n < self.upper)
        return ok


@dataclass(frozen=True)
class HasLabel:
    """Any or all of a set's nodes have the label; all holds for no nodes, any does not."""

    node_set: str
    column: str
    label: object
    every: bool = False

    def aggregate(self) -> Column:
        hit = F.when(F.col("node_set") == self.node_set, F.col(self.column) == F.lit(self.label))
        return F.coalesce(F.bool_and(hit), F.lit(True)) if self.every else F.coalesce(F.bool_or(hit), F.lit(False))


def filter_samples(nodes: DataFrame, predicates: dict[str, object]) -> DataFrame:
    """``(seed, name)``: for each predicate the samples that meet it, all in one aggregate."""
    checks = nodes.groupBy("seed").agg(*[p.aggregate().alias(n) for n, p in predicates.items()])
    hits = F.array(*[F.when(F.col(n), F.lit(n)) for n in predicates])
    return checks.select("seed", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("name"))
