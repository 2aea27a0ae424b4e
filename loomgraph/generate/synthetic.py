"""Synthetic graphs: every value is a digest of its key, so any part can be made anywhere."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.negatives import hash_int
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet


@dataclass(frozen=True)
class Sizes:
    """Rows per set, categories per categorical feature, vector and ragged lengths."""

    nodes: dict[str, int] = field(default_factory=dict)
    edges: dict[str, int] = field(default_factory=dict)
    default_nodes: int = 100
    default_edges: int = 300
    categories: int = 10
    ragged: int = 4
    salt: str = "synthetic"


def _uniform(*parts: Column, salt: str) -> Column:
    """A number in [0, 1) from keys."""
    return hash_int(*parts, salt=salt) / F.lit(2.0**32)


def _scalar(name: str, f: Feature, parts: list[Column], sizes: Sizes) -> Column:
    u = _uniform(F.lit(name), *parts, salt=sizes.salt)
    if f.semantic == "PRIMARY_ID":
        return F.concat(F.lit("ID_"), parts[0].cast("string")) if f.format == "BYTES" else parts[0].cast(f.spark_type())
    if f.semantic == "CATEGORICAL":
        k = F.floor(u * (f.num_categories or sizes.categories))
        return F.concat(F.lit("CAT_"), k.cast("string")) if f.format == "BYTES" else k.cast(f.format.startswith("FLOAT") and "double" or ("boolean" if f.format == "BOOL" else "bigint"))
    if f.format == "BOOL":
        return u < 0.5
    if f.format.startswith("INTEGER"):
        return F.floor(u * 1000).cast("bigint")
    if f.format == "BYTES":
        return F.md5(F.concat_ws("|", F.lit(sizes.salt), F.lit(name), *[p.cast("string") for p in parts]))
    return u


def feature_values(name: str, f: Feature, key: Column, sizes: Sizes) -> Column:
    """A feature's value for a key: scalars, fixed vectors, ragged lists; embeddings have length one."""
    shape = f.shape or ()

    def level(dims: tuple, parts: list[Column]) -> Column:
        if not dims:
            return _scalar(name, f, parts, sizes)
        n = F.lit(dims[0]) if dims[0] is not None else (hash_int(F.lit(f"{name}#"), *parts, salt=sizes.salt) % (sizes.ragged + 1)).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: level(dims[1:], [*parts, i]))

    value = level(tuple(shape), [key])
    kind = f.spark_type()
    if f.semantic == "EMBEDDING" and len(shape) == 1:
        from loomgraph.functions.vectors import unit

        value = unit(value)
    text = f.format == "BYTES"
    return value if text else value.cast(kind)


def synthetic_graph(spark: SparkSession, schema: GraphSchema, sizes: Sizes = Sizes()) -> Graph:
    """A graph of the schema with uniform edges and digest-made features."""
    nodes, counts = {}, {}
    for n, s in schema.node_sets.items():
        counts[n] = sizes.nodes.get(n, sizes.default_nodes)
        base = spark.range(counts[n])
        nodes[n] = base.select(*[feature_values(f, x, F.col("id"), sizes).alias(f) for f, x in s.features.items()])
    edges = {}
    for n, s in schema.edge_sets.items():
        base = spark.range(sizes.edges.get(n, sizes.default_edges))

        def end(of: str, side: str, name: str = n) -> Column:
            pick = hash_int(F.lit(name), F.lit(side), F.col("id"), salt=sizes.salt) % counts[of]
            key = schema.node_sets[of].key_or_none()
            f = schema.node_sets[of].features[key] if key else Feature("INTEGER_64", "PRIMARY_ID")
            return _scalar(key or "id", f, [pick], sizes)

        edges[n] = base.select(end(s.source, "s").alias(SOURCE), end(s.target, "t").alias(TARGET), *[feature_values(f, x, F.col("id"), sizes).alias(f) for f, x in s.features.items()])
    return Graph(schema, nodes, edges)


# -- signals: value of a time column -------------------------------------------


def sinusoid(t: Column, amplitude: float = 1.0, period: float = 24.0, phase: float = 0.0) -> Column:
    return F.lit(amplitude) * F.sin(2 * math.pi * t / period + phase)


def linear(t: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return t * slope + intercept


def rectangle(t: Column, start: float, stop: float, height: float = 1.0) -> Column:
    return F.when((t >= start) & (t < stop), F.lit(height)).otherwise(F.lit(0.0))


def impulse(t: Column, at: float, height: float = 1.0, width: float = 1.0) -> Column:
    return rectangle(t, at, at + width, height)


def white_noise(t: Column, *keys: Column, scale: float = 1.0, salt: str = "noise") -> Column:
    """Normal noise by the Box-Muller transform of two digests."""
    a = F.greatest(_uniform(F.lit("a"), t, *keys, salt=salt), F.lit(1e-12))
    b = _uniform(F.lit("b"), t, *keys, salt=salt)
    return F.lit(scale) * F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def bernoulli(t: Column, *keys: Column, p: float = 0.5, salt: str = "coin") -> Column:
    return F.when(_uniform(t, *keys, salt=salt) < p, 1.0).otherwise(0.0)


def poisson(t: Column, *keys: Column, rate: float = 1.0, most: int = 64, salt: str = "poisson") -> Column:
    """Counts by inverting the distribution, whose table is a literal."""
    total, term, table = 0.0, math.exp(-rate), []
    for k in range(most):
        total += term
        table.append(total)
        term *= rate / (k + 1)
    u = _uniform(t, *keys, salt=salt)
    return F.size(F.filter(F.array(*[F.lit(x) for x in table]), lambda c: c <= u)).cast("double")


def composite(*signals: Column) -> Column:
    out = signals[0]
    for s in signals[1:]:
        out = out + s
    return out


SIGNALS = {f.__name__: f for f in (sinusoid, linear, rectangle, impulse, white_noise, bernoulli, poisson)}


# -- temporal alert graph ------------------------------------------------------

ALERT_SCHEMA = GraphSchema(
    {
        "hardware": NodeSet(
            {
                "id": Feature("BYTES", "PRIMARY_ID", is_text=True),
                "creation_time": Feature("INTEGER_64", "TIMESTAMP", is_creation_time=True),
                "time": Feature("INTEGER_64", "TIMESTAMP", (None,), is_timeseries=True, group="time"),
                "signal": Feature("FLOAT_64", "NUMERICAL", (None,), is_timeseries=True, group="time"),
            }
        ),
        "alerts": NodeSet(
            {
                "id": Feature("BYTES", "PRIMARY_ID", is_text=True),
                "creation_time": Feature("INTEGER_64", "TIMESTAMP", is_creation_time=True),
                "signal_regression": Feature("FLOAT_64", "NUMERICAL"),
            }
        ),
    },
    {"hardware_to_alert": EdgeSet("hardware", "alerts", {"creation_time": Feature("INTEGER_64", "TIMESTAMP")})},
)


def alert_graph(spark: SparkSession, hardware: int = 20, alerts: int = 50, steps: int = 48, lookback: int = 10, stop: float = 0.5, salt: str = "alert") -> Graph:
    """Machines with signals, and alerts whose label is their machines' mean signal over a lookback window.

    An alert is tied to a geometric number of machines (each further one with
    probability 1 - ``stop``).  The signal is a step function: its mean over the window is the
    sum of values times the time each one holds, divided by the window.
    """
    t = F.col("time").cast("double")
    rows = spark.range(hardware).select(F.col("id").alias("h")).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("time", F.col("time").cast("long"))
    phase = _uniform(F.col("h"), salt=salt) * 2 * math.pi
    signal = F.sin(2 * math.pi * t / 24 + phase) + white_noise(F.col("time"), F.col("h"), scale=0.1, salt=salt)
    rows = rows.withColumn("signal", signal)
    series = rows.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("time", "signal"))).alias("s"))
    machines = series.select(F.concat(F.lit("H_"), F.col("h").cast("string")).alias("id"), F.lit(0).cast("long").alias("creation_time"), F.col("s.time").alias("time"), F.col("s.signal").alias("signal"))

    base = spark.range(alerts).select(F.col("id").alias("a"), (F.lit(lookback) + hash_int(F.lit("at"), F.col("id"), salt=salt) % (steps - lookback)).alias("at"))
    most = 16
    count = F.least(F.lit(most), F.ceil(F.log(F.greatest(_uniform(F.lit("n"), F.col("a"), salt=salt), F.lit(1e-9))) / math.log(1 - stop)).cast("int"))
    picks = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), count))))
    ties = picks.select("a", "at", (hash_int(F.lit("h"), F.col("a"), F.col("k"), salt=salt) % hardware).alias("h")).distinct()
    steps_of = rows.withColumn("next", F.lead("time", 1, steps).over(Window.partitionBy("h").orderBy("time")))
    held = ties.join(steps_of, "h").where((F.col("next") > F.col("at") - lookback) & (F.col("time") < F.col("at")))
    span = F.least("next", "at") - F.greatest("time", F.col("at") - lookback)
    label = held.groupBy("a").agg((F.sum(F.col("signal") * span) / F.sum(span)).alias("signal_regression"))
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    alert = base.join(label, "a", "left").select(name("a", "A_").alias("id"), F.col("at").alias("creation_time"), F.coalesce("signal_regression", F.lit(0.0)).alias("signal_regression"))
    edges = ties.select(name("h", "H_").alias(SOURCE), name("a", "A_").alias(TARGET), F.col("at").alias("creation_time"))
    return Graph(ALERT_SCHEMA, {"hardware": machines, "alerts": alert}, {"hardware_to_alert": edges})


def synthetic_sample(schema: GraphSchema, plan, spark: SparkSession, seeds: int, reuse: float = 0.1, salt: str = "sample") -> DataFrame:
    """``(seed, path, node_set, node, parent)``: trees grown along a plan; a visit reuses its parent's sibling number with probability ``reuse``."""
    start = spark.range(seeds).select(F.col("id").alias("seed"), F.lit("r").alias("path"))
    out = [start.select("seed", "path", F.lit(plan.seed_set).alias("node_set"), F.lit("r").alias("node"), F.lit(None).cast("string").alias("parent"))]

    def grow(steps, front: DataFrame):
        for n, s in enumerate(steps):
            k = F.explode(F.sequence(F.lit(0), F.lit((s.width or 1) - 1))).alias("k")
            more = front.select("seed", F.col("path").alias("parent"), k)
            more = more.withColumn("path", F.concat("parent", F.lit(f"/{n}."), F.col("k").cast("string")))
            again = _uniform(F.col("seed"), F.col("path"), salt=salt) < reuse
            node = F.when(again & (F.col("k") > 0), F.concat("parent", F.lit(f"/{n}.0"))).otherwise(F.col("path"))
            out.append(more.select("seed", "path", F.lit(s.node_set).alias("node_set"), node.alias("node"), "parent"))
            grow(s.then, more.select("seed", "path"))

    grow(plan.steps, start)
    from functools import reduce

    return reduce(DataFrame.unionByName, out)
