"""Feature normalizers: column expressions made from a schema and statistics."""

from __future__ import annotations

import json
import math
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet


class Normalizer(ABC):
    """Turns one feature into one or more named columns."""

    @abstractmethod
    def columns(self, name: str, value: Column) -> dict[str, Column]: ...

    def features(self, name: str, feature: Feature) -> dict[str, Feature]:
        """The schema of ``columns``; by default of each name the feature's own format without a meaning."""
        return {n: Feature(feature.format, "UNKNOWN", feature.shape) for n in self.columns(name, F.lit(None))}

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, **asdict(self)})


KINDS: dict[str, type] = {}


def registered(cls):
    """Make a normalizer readable from its JSON form; user classes may register too."""
    KINDS[cls.__name__] = cls
    return cls


def from_json(text: str) -> Normalizer:
    raw = json.loads(text)
    return KINDS[raw.pop("kind")](**raw)


def over(value: Column, f, is_array: bool) -> Column:
    return F.transform(value, f) if is_array else f(value)


@registered
@dataclass(frozen=True)
class Identity(Normalizer):
    def columns(self, name, value):
        return {name: value}

    def features(self, name, feature):
        return {name: feature}


@registered
@dataclass(frozen=True)
class DictionaryIndex(Normalizer):
    """Text to its dictionary place; unknown text gets the dictionary's size."""

    words: list
    is_array: bool = False

    def columns(self, name, value):
        table = F.create_map(*[F.lit(x) for i, w in enumerate(self.words) for x in (w, i)]) if self.words else None

        def one(v: Column) -> Column:
            return F.coalesce(F.try_element_at(table, v), F.lit(len(self.words))) if self.words else F.lit(0)

        return {f"{name}_INDEX": over(value, one, self.is_array)}

    def features(self, name, feature):
        return {f"{name}_INDEX": Feature("INTEGER_32", "CATEGORICAL", feature.shape, num_categories=len(self.words) + 1)}


@registered
@dataclass(frozen=True)
class SoftQuantile(Normalizer):
    """Place among quantiles with linear steps between them, from -0.5 to 0.5; beyond the ends it goes on straight."""

    points: list
    is_array: bool = False

    def columns(self, name, value):
        q = sorted(set(self.points)) or [0.0, 1.0]
        q = [q[0], q[0] + 1.0] if len(q) == 1 else q
        n = len(q)
        table = F.array(*[F.lit(float(x)) for x in q])

        def one(v: Column) -> Column:
            x = v.cast("double")
            k = F.least(F.lit(n - 2), F.greatest(F.lit(0), F.size(F.filter(table, lambda p: p <= x)) - 1))
            lo, hi = F.element_at(table, k + 1), F.element_at(table, k + 2)
            return (k + (x - lo) / (hi - lo)) / (n - 1) - 0.5

        return {f"{name}_SOFT_QUANTILE": over(value, one, self.is_array)}

    def features(self, name, feature):
        return {f"{name}_SOFT_QUANTILE": Feature("FLOAT_64", "NUMERICAL", feature.shape)}


@registered
@dataclass(frozen=True)
class HashBucket(Normalizer):
    """Text to one of ``buckets`` by its MD5, the same in other engines."""

    buckets: int
    is_array: bool = False

    def columns(self, name, value):
        def one(v: Column) -> Column:
            return F.conv(F.substring(F.md5(v), 1, 8), 16, 10).cast("long") % self.buckets

        return {f"{name}_HASH": over(value, one, self.is_array)}

    def features(self, name, feature):
        return {f"{name}_HASH": Feature("INTEGER_64", "CATEGORICAL", feature.shape, num_categories=self.buckets)}


@registered
@dataclass(frozen=True)
class Sinusoid(Normalizer):
    """Sines, then cosines, of a time difference at log-spaced periods."""

    dim: int = 8
    shortest: float = 1.0
    longest: float = 1_000_000.0
    is_array: bool = False

    def frequencies(self) -> list[float]:
        if self.dim <= 0 or self.dim % 2:
            raise ValueError("the dimension must be even and positive")
        k = self.dim // 2
        lo, hi = math.log10(self.shortest), math.log10(self.longest)
        return [2 * math.pi / 10 ** (lo + (hi - lo) * (i / (k - 1) if k > 1 else 0)) for i in range(k)]

    def columns(self, name, value):
        f = self.frequencies()

        def one(v: Column) -> Column:
            return F.array(*[F.sin(v * F.lit(x)) for x in f], *[F.cos(v * F.lit(x)) for x in f])

        return {f"{name}_SINUSOID": over(value, one, self.is_array)}

    def features(self, name, feature):
        return {f"{name}_SINUSOID": Feature("FLOAT_64", "EMBEDDING", (*(feature.shape or ()), self.dim))}


def choose(features: dict[str, Feature], dictionaries: dict[str, list], points: dict[str, list], keep_raw: bool = False, hash_keys: int = 0, lenient: bool = False) -> dict[str, list[Normalizer]]:
    """The normalizers that fit each feature's meaning.

    Keys hash if asked; text categories index; integer categories, embeddings and
    masks stay; numbers take quantiles; time differences take sinusoids.  A missing
    statistic raises KeyError unless ``lenient``.
    """
    out: dict[str, list[Normalizer]] = {}
    for n, f in features.items():
        array = bool(f.shape)
        found: list[Normalizer] = [Identity()] if keep_raw or f.semantic == "MASK" else []
        if f.semantic == "PRIMARY_ID":
            found += [HashBucket(hash_keys, array)] if hash_keys else []
        elif f.semantic == "CATEGORICAL" and f.format == "BYTES":
            if n in dictionaries:
                found.append(DictionaryIndex(dictionaries[n], array))
            elif not lenient:
                raise KeyError(f"no dictionary for {n}")
        elif f.semantic == "NUMERICAL":
            if n in points:
                found.append(SoftQuantile(points[n], array))
            elif not lenient:
                raise KeyError(f"no quantiles for {n}")
        elif f.semantic == "TIMEDELTA":
            found.append(Sinusoid(is_array=array))
        elif f.semantic in ("EMBEDDING", "CATEGORICAL") and not keep_raw:
            found.append(Identity())
        if found:
            out[n] = found
    return out


def normalized(df: DataFrame, plan: dict[str, list[Normalizer]], keep: list[str] = ()) -> DataFrame:
    """One projection with all normalized columns."""
    out = {}
    for n, chain in plan.items():
        for z in chain:
            out.update(z.columns(n, F.col(n)))
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def auto(df: DataFrame, node_set: NodeSet | EdgeSet, quantile_count: int = 100, max_items: int = 10_000, exact: bool = True) -> dict[str, list[Normalizer]]:
    """Statistics of a node set, then the normalizers chosen for it; dictionaries are bounded."""
    from loomgraph.operators.statistics import dictionary, quantiles

    words, points = {}, {}
    for n, f in node_set.features.items():
        if f.semantic == "CATEGORICAL" and f.format == "BYTES" and not f.shape:
            words[n] = [r["value"] for r in dictionary(df, n, max_items).orderBy("idx").collect()]
        elif f.semantic == "NUMERICAL" and not f.shape:
            points[n] = [r["q"] for r in quantiles(df, n, quantile_count, exact).orderBy("k").collect()]
    return choose(node_set.features, words, points, lenient=True)


Plan = dict[str, list[Normalizer]]


@dataclass(frozen=True)
class GraphNormalizer:
    """Normalizers of the features of all node sets and edge sets at once; sets without any keep their keys only."""

    nodes: dict[str, Plan]
    edges: dict[str, Plan]

    @staticmethod
    def fit(g: Graph, skip: Iterable[tuple[str, str]] = (), rows: dict[str, DataFrame] | None = None, **options) -> GraphNormalizer:
        """Chosen from each set's own statistics.  ``skip`` names (set, feature) pairs to leave out, such as
        the label; ``rows`` are frames to take a set's statistics from instead of all of it, such as its training rows."""
        rows, skip = rows or {}, set(skip)

        def plan(name: str, d: DataFrame, s: NodeSet | EdgeSet) -> Plan:
            return auto(rows.get(name, d), replace(s, features={f: x for f, x in s.features.items() if (name, f) not in skip}), **options)

        sets = g.schema.node_sets, g.schema.edge_sets
        return GraphNormalizer(*[{n: plan(n, frames[n], s) for n, s in found.items()} for found, frames in zip(sets, (g.nodes, g.edges))])

    def output_schema(self, schema: GraphSchema) -> GraphSchema:
        """What ``apply`` makes of a graph of this schema."""

        def made(features: dict[str, Feature], plan: Plan) -> dict[str, Feature]:
            return {n: x for f, chain in plan.items() for z in chain for n, x in z.features(f, features[f]).items()}

        ns = {}
        for n, s in schema.node_sets.items():
            key = s.key_or_none()
            ns[n] = NodeSet(({key: s.features[key]} if key else {}) | made(s.features, self.nodes.get(n, {})))
        return GraphSchema(ns, {n: EdgeSet(s.source, s.target, made(s.features, self.edges.get(n, {}))) for n, s in schema.edge_sets.items()})

    def apply(self, g: Graph) -> Graph:
        """The graph with its keys and the normalized features; rows stay, one projection a set."""
        keys = {n: [k] if (k := s.key_or_none()) else [] for n, s in g.schema.node_sets.items()}
        plain = lambda plan, kept: {f: z for f, z in plan.items() if f not in kept}  # noqa: E731  keys are kept as they are
        ns = {n: normalized(d, plain(self.nodes.get(n, {}), keys[n]), keys[n]) for n, d in g.nodes.items()}
        es = {n: normalized(d, self.edges.get(n, {}), [SOURCE, TARGET]) for n, d in g.edges.items()}
        return replace(g, schema=self.output_schema(g.schema), nodes=ns, edges=es)

    def names(self, set_name: str, feature: str, schema: GraphSchema) -> list[str]:
        """What a set's feature is called after ``apply``."""
        s = schema.node_sets.get(set_name) or schema.edge_sets[set_name]
        chain = (self.nodes | self.edges).get(set_name, {}).get(feature, [])
        return [n for z in chain for n in z.features(feature, s.features[feature])]

    def to_json(self) -> str:
        written = lambda sets: {n: {f: [z.to_json() for z in chain] for f, chain in plan.items()} for n, plan in sets.items()}
        return json.dumps({"nodes": written(self.nodes), "edges": written(self.edges)})

    @staticmethod
    def from_json(text: str) -> GraphNormalizer:
        read = lambda sets: {n: {f: [from_json(z) for z in chain] for f, chain in plan.items()} for n, plan in sets.items()}
        raw = json.loads(text)
        return GraphNormalizer(read(raw["nodes"]), read(raw["edges"]))
