"""Consistency checks of a graph as rows of (severity, issue)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.schema import Feature

LEVELS = ("warning", "error")


def feature_issues(features: dict[str, Feature], where: str) -> list[tuple[str, str]]:
    """What is wrong with the features of one set by their declarations alone."""
    out, groups = [], {}
    for n, f in features.items():
        if f.semantic == "UNKNOWN" and n != "#id":
            out.append(("warning", f"{where}: {n} has no meaning"))
        if n == "#id" and f.semantic != "PRIMARY_ID":
            out.append(("warning", f"{where}: #id is not the primary id"))
        if f.semantic == "MASK" and f.format != "BOOL":
            out.append(("error", f"{where}: mask {n} is not BOOL"))
        if f.semantic == "MASK" and f.group is None:
            out.append(("error", f"{where}: mask {n} has no group"))
        if f.is_creation_time and f.semantic != "TIMESTAMP":
            out.append(("error", f"{where}: creation time {n} is not a TIMESTAMP"))
        if f.semantic == "TIMESTAMP" and f.format != "INTEGER_64":
            out.append(("error", f"{where}: timestamp {n} is not INTEGER_64"))
        if f.group is not None and not f.is_timeseries:
            out.append(("error", f"{where}: {n} has a group but is no time series"))
        group = f.group or (n if f.is_timeseries and f.is_creation_time else None)
        if group is not None:
            groups.setdefault(group, []).append(n)
    born = [n for n, f in features.items() if f.is_creation_time and not f.is_timeseries]
    if len(born) > 1:
        out.append(("error", f"{where}: several creation times {sorted(born)}"))
    for g, members in sorted(groups.items()):
        clocks = [n for n in members if features[n].is_creation_time and features[n].is_timeseries]
        if len(clocks) > 1:
            out.append(("error", f"{where}: group {g} has several clocks {sorted(clocks)}"))
        if len(clocks) == 1:
            length = features[clocks[0]].shape or ()
            if len(length) != 1:
                out.append(("error", f"{where}: clock {clocks[0]} needs one dimension"))
            for n in members:
                shape = features[n].shape or ()
                if n != clocks[0] and features[n].is_timeseries and (not shape or (len(length) == 1 and shape[0] != length[0])):
                    out.append(("error", f"{where}: {n} is not as long as its clock {clocks[0]}"))
    return out


def schema_issues(g: Graph) -> list[tuple[str, str]]:
    """What is wrong with the schema, or between it and the frames' columns and types."""
    out = []

    def columns(d: DataFrame, features: dict[str, Feature], where: str) -> None:
        kinds = {c.name: c.dataType for c in d.schema}
        for n, f in features.items():
            if n not in kinds:
                out.append(("error", f"{where}: no column {n}"))
            elif not _same(kinds[n], f.spark_type()):
                out.append(("error", f"{where}: {n} is {kinds[n].simpleString()}, not {f.spark_type().simpleString()}"))

    for n, s in g.schema.node_sets.items():
        where = f"node set {n}"
        keys = [f for f, x in s.features.items() if x.semantic == "PRIMARY_ID"]
        if len(keys) != 1:
            out.append(("error" if keys else "warning", f"{where}: {len(keys)} primary keys"))
        out += feature_issues(s.features, where)
        if n not in g.nodes:
            out.append(("error", f"{where}: no frame"))
            continue
        columns(g.nodes[n], s.features, where)
    for n, s in g.schema.edge_sets.items():
        where = f"edge set {n}"
        out += [("error", f"{where}: unknown node set {e}") for e in (s.source, s.target) if e not in g.schema.node_sets]
        out += feature_issues(s.features, where)
        if n not in g.edges:
            out.append(("error", f"{where}: no frame"))
            continue
        out += [("error", f"{where}: no column {c}") for c in (SOURCE, TARGET) if c not in g.edges[n].columns]
        columns(g.edges[n], s.features, where)
    return out


def _same(found: T.DataType, declared: T.DataType) -> bool:
    """Types agree; text and bytes do, and times may be stored as such."""
    while isinstance(found, T.ArrayType) and isinstance(declared, T.ArrayType):
        found, declared = found.elementType, declared.elementType
    text = (T.StringType, T.BinaryType, T.DateType)
    if isinstance(found, text) and isinstance(declared, text):
        return True
    loose = {T.LongType: (T.TimestampType, T.TimestampNTZType), T.IntegerType: (T.ByteType, T.ShortType), T.DoubleType: (T.DecimalType,)}
    return type(found) is type(declared) or isinstance(found, loose.get(type(declared), ()))


def _value_checks(d: DataFrame, features: dict[str, Feature]) -> list[tuple[str, Column]]:
    """(text with %, condition of a bad row) for shapes and lengths that only values show."""
    out = []
    for n, f in features.items():
        if n not in d.columns or not isinstance(d.schema[n].dataType, T.ArrayType):
            continue
        shape = f.shape or ()
        if shape and shape[0] is not None:
            out.append((f"% rows whose {n} has not {shape[0]} entries", F.size(n) != shape[0]))
        if len(shape) > 1 and shape[1] is not None and isinstance(d.schema[n].dataType.elementType, T.ArrayType):
            out.append((f"% rows whose {n} has entries of another length than {shape[1]}", F.exists(n, lambda x: F.size(x) != shape[1])))
    clocks = {f.group or n: n for n, f in features.items() if f.is_timeseries and f.is_creation_time}
    for n, f in features.items():
        clock = clocks.get(f.group)
        if f.is_timeseries and clock and clock != n and {n, clock} <= set(d.columns) and isinstance(d.schema[n].dataType, T.ArrayType):
            out.append((f"% rows whose {n} is not as long as {clock}", F.size(n) != F.size(clock)))
    return out


def issues(g: Graph) -> DataFrame:
    """``(severity, issue)``: schema problems, bad shapes, repeated and null keys, edges with unknown ends.

    Each check is an aggregate or an anti-join; nothing but counts leaves the executors.
    A set that the schema already shows to be broken is left out of the checks that need what it lacks.
    """
    spark = next(iter([*g.nodes.values(), *g.edges.values()])).sparkSession
    rows: list[DataFrame] = [spark.createDataFrame(schema_issues(g), "severity string, issue string")]

    def counted(df: DataFrame, text: str) -> DataFrame:
        n = df.agg(F.count("*").alias("n")).where("n > 0")
        return n.select(F.lit("error").alias("severity"), F.concat(F.lit(text[: text.index("%")]), F.col("n").cast("string"), F.lit(text[text.index("%") + 1 :])).alias("issue"))

    def values(d: DataFrame, features: dict[str, Feature], where: str) -> None:
        checks = _value_checks(d, features)
        if checks:  # one pass for all of a set's checks
            found = d.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(checks)])
            told = [F.struct(F.col(f"c{i}").alias("n"), F.concat(F.lit(f"{where}: "), F.col(f"c{i}").cast("string"), F.lit(t[1:])).alias("issue")) for i, (t, _) in enumerate(checks)]
            rows.append(found.select(F.inline(F.array(*told))).where("n > 0").select(F.lit("error").alias("severity"), "issue"))

    ids = {}
    for n, s in g.schema.node_sets.items():
        if n not in g.nodes:
            continue
        values(g.nodes[n], s.features, f"node set {n}")
        keys = [f for f, x in s.features.items() if x.semantic == "PRIMARY_ID"]
        if len(keys) != 1 or keys[0] not in g.nodes[n].columns:
            continue
        ids[n] = g.nodes[n].select(F.col(keys[0]).alias("id"))
        rows.append(counted(ids[n].where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c")).where("c > 1"), f"node set {n}: % repeated keys"))
        rows.append(counted(ids[n].where("id IS NULL"), f"node set {n}: % null keys"))
    for n, s in g.schema.edge_sets.items():
        if n not in g.edges:
            continue
        values(g.edges[n], s.features, f"edge set {n}")
        for end, of in ((SOURCE, s.source), (TARGET, s.target)):
            if of in ids and end in g.edges[n].columns:
                known = ids[of].select(F.col("id").alias("__id"))
                e = g.edges[n].select(end)
                rows.append(counted(e.join(known, e[end] == known["__id"], "left_anti"), f"edge set {n}: % edges with an unknown {end}"))
    return reduce(DataFrame.unionByName, rows)


def check(g: Graph, fail_at: str = "error") -> list[tuple[str, str]]:
    """All issues; raises ValueError if one is at least as severe as ``fail_at``."""
    found = [tuple(r) for r in issues(g).collect()]
    bad = [i for s, i in found if LEVELS.index(s) >= LEVELS.index(fail_at)]
    if bad:
        raise ValueError("; ".join(bad))
    return found


def snapshot_issues(snapshots: dict[str, Graph], reference: Graph | None = None) -> list[tuple[str, str]]:
    """Issues of a set of snapshots: missing or repeated timestamps, differing schemas, and each one's own."""
    out, seen = [], {}
    for name, g in sorted(snapshots.items()):
        if g.timestamp is None:
            out.append(("error", f"snapshot {name}: no timestamp"))
        elif g.timestamp in seen:
            out.append(("error", f"snapshot {name}: same timestamp as {seen[g.timestamp]}"))
        else:
            seen[g.timestamp] = name
        if reference is not None and g.schema != reference.schema:
            out.append(("error", f"snapshot {name}: another schema"))
        out += [(s, f"snapshot {name}: {t}") for s, t in (tuple(r) for r in issues(g).collect())]
    return out


def snapshot_directory_issues(spark: SparkSession, path: str, contents: bool = True) -> list[tuple[str, str]]:
    """Issues of a directory of snapshots: root metadata and schema, each snapshot's metadata, and its contents if asked."""
    from loomgraph.sources.native import Store, read_graph, read_schema

    store, out, seen = Store(spark, path), [], {}
    if not store.exists("metadata.json"):
        out.append(("error", "no metadata.json"))
    elif json.loads(store.text("metadata.json")).get("format") != "graph_snapshots":
        out.append(("error", "metadata.json: the format is not graph_snapshots"))
    schema = read_schema(spark, path) if store.exists("schema.json") else None
    if schema is None:
        out.append(("error", "no schema.json"))
    if not store.exists("snapshots"):
        return [*out, ("error", "no folder of snapshots")]
    names = store.names("snapshots")
    if not names:
        out.append(("warning", "no snapshots"))
    for n in names:
        if not store.exists(f"snapshots/{n}/metadata.json"):
            out.append(("error", f"snapshot {n}: no metadata.json"))
            continue
        stamp = json.loads(store.text(f"snapshots/{n}/metadata.json")).get("timestamp")
        if stamp is None:
            out.append(("error", f"snapshot {n}: no timestamp"))
            continue
        if stamp in seen:
            out.append(("error", f"snapshot {n}: same timestamp as {seen[stamp]}"))
        seen.setdefault(stamp, n)
        if contents and schema is not None:
            g = read_graph(spark, f"{path}/snapshots/{n}", schema)
            out += [(s, f"snapshot {n}: {t}") for s, t in (tuple(r) for r in issues(g).collect())]
    return out
