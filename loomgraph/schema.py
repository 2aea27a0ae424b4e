"""Graph schemas: what each node and edge set holds, and what its features mean."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import types as T

#: Feature formats and their Spark types (fixed values).
FORMATS = {
    "INTEGER_32": T.IntegerType(),
    "INTEGER_64": T.LongType(),
    "FLOAT_32": T.FloatType(),
    "FLOAT_64": T.DoubleType(),
    "BYTES": T.BinaryType(),
    "BOOL": T.BooleanType(),
}
#: Feature semantics (fixed values).
SEMANTICS = ("UNKNOWN", "NUMERICAL", "CATEGORICAL", "EMBEDDING", "TIMESTAMP", "TIMEDELTA", "TIMESERIES", "PRIMARY_ID", "MASK")
#: Column names that mark a primary key, in order of preference (fixed values).
KEY_NAMES = ("#id", "#ID", "id", "ID")


#: What fields are called in a schema's text form where it isn't their name here (fixed values).
FILE_NAMES = {"num_categories": "num_categorical_values", "is_text": "is_utf8_string"}


@dataclass(frozen=True)
class Feature:
    """One feature: format, meaning and shape.

    ``shape`` None or () is a scalar, (k,) a fixed vector, (None,) a ragged one,
    (None, k) a ragged list of vectors.  ``group`` ties time series that share a
    length and a clock.
    """

    format: str
    semantic: str = "UNKNOWN"
    shape: tuple | None = None
    num_categories: int | None = None
    is_text: bool = False
    is_timeseries: bool = False
    is_creation_time: bool = False
    group: str | None = None

    def spark_type(self) -> T.DataType:
        kind = T.StringType() if self.format == "BYTES" and self.is_text else FORMATS[self.format]
        for _ in self.shape or ():
            kind = T.ArrayType(kind)
        return kind


@dataclass(frozen=True)
class NodeSet:
    features: dict[str, Feature] = field(default_factory=dict)

    def key(self) -> str:
        """The only PRIMARY_ID feature; several or none raise ValueError."""
        found = [n for n, f in self.features.items() if f.semantic == "PRIMARY_ID"]
        if len(found) != 1:
            raise ValueError(f"a node set needs one primary id, found {found}")
        return found[0]

    def key_or_none(self) -> str | None:
        return self.key() if any(f.semantic == "PRIMARY_ID" for f in self.features.values()) else None


@dataclass(frozen=True)
class EdgeSet:
    source: str
    target: str
    features: dict[str, Feature] = field(default_factory=dict)


@dataclass(frozen=True)
class GraphSchema:
    node_sets: dict[str, NodeSet] = field(default_factory=dict)
    edge_sets: dict[str, EdgeSet] = field(default_factory=dict)

    # -- text form -------------------------------------------------------------

    def to_json(self) -> str:
        def written(features: dict[str, Feature]) -> dict:
            return {n: {FILE_NAMES.get(k, k): v for k, v in asdict(f).items()} for n, f in features.items()}

        nodes = {n: {"features": written(s.features)} for n, s in self.node_sets.items()}
        edges = {n: {"source": s.source, "target": s.target, "features": written(s.features)} for n, s in self.edge_sets.items()}
        return json.dumps({"node_sets": nodes, "edge_sets": edges}, indent=2)

    @staticmethod
    def from_json(text: str) -> GraphSchema:
        """Read the text form; fields that are not known here are ignored, missing ones have their defaults."""
        raw = json.loads(text)
        names = {f.name: FILE_NAMES.get(f.name, f.name) for f in fields(Feature)}

        def features(d: dict | None) -> dict[str, Feature]:
            out = {}
            for n, f in (d or {}).items():
                held = {k: f[w] for k, w in names.items() if f.get(w) is not None}
                out[n] = Feature(**held | ({"shape": tuple(held["shape"])} if "shape" in held else {}))
            return out

        return GraphSchema(
            {n: NodeSet(features(s.get("features"))) for n, s in raw.get("node_sets", {}).items()},
            {n: EdgeSet(s["source"], s["target"], features(s.get("features"))) for n, s in raw.get("edge_sets", {}).items()},
        )

    # -- projections ------------------------------------------------------------

    def filtered(
        self,
        node_set: Callable[[str], bool] = lambda n: True,
        edge_set: Callable[[str], bool] = lambda n: True,
        node_feature: Callable[[str, str], bool] = lambda n, f: True,
        edge_feature: Callable[[str, str], bool] = lambda n, f: True,
    ) -> GraphSchema:
        """Keep what the predicates accept; an edge set goes with either of its node sets."""
        nodes = {n: NodeSet({f: x for f, x in s.features.items() if node_feature(n, f)}) for n, s in self.node_sets.items() if node_set(n)}
        edges = {
            n: replace(s, features={f: x for f, x in s.features.items() if edge_feature(n, f)})
            for n, s in self.edge_sets.items()
            if edge_set(n) and s.source in nodes and s.target in nodes
        }
        return GraphSchema(nodes, edges)

    def without_edge_features(self) -> GraphSchema:
        return self.filtered(edge_feature=lambda n, f: False)

    def is_homogeneous(self) -> bool:
        """One node set, and one edge set that joins it with itself."""
        return len(self.node_sets) == 1 and len(self.edge_sets) == 1 and all(s.source in self.node_sets and s.source == s.target for s in self.edge_sets.values())

    def described(self) -> str:
        """Readable listing of all sets and features."""
        lines = []
        for n, s in sorted(self.node_sets.items()):
            lines.append(f"node set {n}")
            lines += [f"  {f}: {x.format} {x.semantic}{'' if not x.shape else ' ' + str(list(x.shape))}" for f, x in sorted(s.features.items())]
        for n, s in sorted(self.edge_sets.items()):
            lines.append(f"edge set {n}: {s.source} -> {s.target}")
            lines += [f"  {f}: {x.format} {x.semantic}{'' if not x.shape else ' ' + str(list(x.shape))}" for f, x in sorted(s.features.items())]
        return "\n".join(lines)


def likely_key(columns: list[str]) -> str | None:
    """The usual key name among ``columns``; several of them raise ValueError."""
    found = [k for k in KEY_NAMES if k in columns]
    if len(found) > 1:
        raise ValueError(f"several columns look like a key: {found}")
    return found[0] if found else None


def infer_semantics(name: str, feature: Feature) -> Feature:
    """Fill in an unknown meaning: text and booleans are categories, ``is_*`` integers too, other numbers numerical."""
    if feature.semantic != "UNKNOWN" or name.startswith("#"):
        return feature
    if feature.format in ("BYTES", "BOOL") or (feature.format.startswith("INTEGER") and name.startswith("is_")):
        return replace(feature, semantic="CATEGORICAL")
    return replace(feature, semantic="NUMERICAL")


def repaired(schema: GraphSchema, semantics: bool = True, fallback_key: bool = False, shapes: bool = True, narrow: bool = False) -> GraphSchema:
    """Guess what a schema leaves out, set by set.

    A node set without a primary id gets the column with a usual key name; if it has
    none, ``fallback_key`` adds ``#id`` and else ValueError is raised.  An edge set may
    stay without.  ``semantics`` fills in unknown meanings.  ``shapes``: where all
    features of a set have a ragged outer dimension around a fixed one, it goes.
    ``narrow`` widens or narrows formats to those of records that hold int64, float32 and bytes only.
    """
    slim = {"INTEGER_32": "INTEGER_64", "BOOL": "INTEGER_64", "FLOAT_64": "FLOAT_32"}

    def fix(name: str, features: dict[str, Feature], needed: bool) -> dict[str, Feature]:
        f = {n: replace(x, format=slim.get(x.format, x.format)) for n, x in features.items()} if narrow else dict(features)
        odd = lambda x: x.shape is not None and len(x.shape) == 2 and x.shape[0] is None and x.shape[1] is not None
        if shapes and f and all(map(odd, f.values())):
            f = {n: replace(x, shape=() if x.shape[1] == 1 else x.shape[1:]) for n, x in f.items()}
        if semantics:
            f = {n: infer_semantics(n, x) for n, x in f.items()}
        if not any(x.semantic == "PRIMARY_ID" for x in f.values()):
            guess = likely_key(list(f))
            if guess is None and needed and fallback_key:
                guess, f["#id"] = "#id", Feature("BYTES")
            if guess is None and needed:
                raise ValueError(f"node set {name}: no primary id, and no column looks like one: {list(f)}")
            if guess is not None:
                f[guess] = replace(f[guess], semantic="PRIMARY_ID")
        return f

    edges = {n: replace(s, features=fix(n, s.features, False)) for n, s in schema.edge_sets.items()}
    return GraphSchema({n: NodeSet(fix(n, s.features, True)) for n, s in schema.node_sets.items()}, edges)


def timeseries_groups(features: dict[str, Feature]) -> dict[str, dict]:
    """For each group of time series: its clock (creation time), its mask and its other members, by name.

    A series without a group of its own clock is a group by itself.  Several clocks
    or masks in one group raise ValueError.
    """
    out: dict[str, dict] = {}
    for n, f in sorted(features.items()):
        group = f.group or (n if f.is_timeseries and f.is_creation_time else None)
        if group is None:
            continue
        g = out.setdefault(group, {"clock": None, "mask": None, "members": []})
        role = "mask" if f.semantic == "MASK" else "clock" if f.is_creation_time else None
        if role and g[role]:
            raise ValueError(f"group {group} has two {role}s: {g[role]} and {n}")
        if role:
            g[role] = n
        else:
            g["members"].append(n)
    return out


def creation_time(features: dict[str, Feature]) -> str | None:
    """The one feature that says when a node or edge came to be; several raise ValueError."""
    found = [n for n, f in features.items() if f.is_creation_time and not f.is_timeseries]
    if len(found) > 1:
        raise ValueError(f"several creation times: {found}")
    return found[0] if found else None


def feature_of(kind: T.DataType) -> Feature:
    """The feature that stands for a Spark column type; structs and maps raise TypeError."""
    shape: tuple = ()
    while isinstance(kind, T.ArrayType):
        shape, kind = (*shape, None), kind.elementType
    table = {
        T.StringType: ("BYTES", True),
        T.BinaryType: ("BYTES", False),
        T.ByteType: ("INTEGER_32", False),
        T.ShortType: ("INTEGER_32", False),
        T.IntegerType: ("INTEGER_32", False),
        T.LongType: ("INTEGER_64", False),
        T.FloatType: ("FLOAT_32", False),
        T.DoubleType: ("FLOAT_64", False),
        T.DecimalType: ("FLOAT_64", False),
        T.BooleanType: ("BOOL", False),
        T.DateType: ("BYTES", True),
        T.TimestampType: ("INTEGER_64", False),
        T.TimestampNTZType: ("INTEGER_64", False),
    }
    if type(kind) not in table:
        raise TypeError(f"no feature format for {kind}")
    fmt, text = table[type(kind)]
    stamp = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    return Feature(fmt, "TIMESTAMP" if stamp else "UNKNOWN", shape or None, is_text=text)


def schema_of_table(columns: T.StructType, key: str | None = None, detect: bool = True) -> NodeSet:
    """Features for a table's columns; ``key`` or a usual key name becomes the primary id."""
    out = {c.name: feature_of(c.dataType) for c in columns}
    if detect:
        out = {n: infer_semantics(n, f) for n, f in out.items()}
    key = key or likely_key(list(out))
    if key:
        out[key] = replace(out[key], semantic="PRIMARY_ID")
    return NodeSet(out)
