"""Message passing as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET


def symmetric(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """A + A^T + I as ``(u, v)`` rows, parallel edges kept."""
    forward = edges.select(F.col(SOURCE).alias("u"), F.col(TARGET).alias("v"))
    back = forward.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return forward.unionByName(back).unionByName(ids.select(F.col("id").alias("u"), F.col("id").alias("v")))


def gcn(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(id, y)``: D^-1/2 (A + A^T + I) D^-1/2 x for ``values(id, x)``."""
    a = symmetric(edges, values.select("id"))
    d = a.groupBy(F.col("u").alias("id")).agg(F.count("*").cast("double").alias("d"))
    scaled = values.join(d, "id").select("id", "d", (F.col("x") / F.sqrt("d")).alias("z"))
    y = a.join(scaled.select(F.col("id").alias("v"), "z"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("z").alias("s"))
    return y.join(scaled, "id").select("id", (F.col("s") / F.sqrt("d")).alias("y"))


def gin(edges: DataFrame, values: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """``(id, y)``: (A + A^T + (1 + epsilon) I) x."""
    e = edges.select(F.col(SOURCE).alias("u"), F.col(TARGET).alias("v"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    s = both.join(values.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("x").alias("s"))
    return values.join(s, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) + F.col("x") * (1 + epsilon)).alias("y"))


def incidence_pool(edges: DataFrame, message: str) -> DataFrame:
    """``(id, outgoing, incoming)``: a message per edge summed at both of its ends."""
    o = edges.groupBy(F.col(SOURCE).alias("id")).agg(F.sum(message).alias("outgoing"))
    i = edges.groupBy(F.col(TARGET).alias("id")).agg(F.sum(message).alias("incoming"))
    return o.join(i, "id", "full").select("id", F.coalesce("outgoing", F.lit(0.0)).alias("outgoing"), F.coalesce("incoming", F.lit(0.0)).alias("incoming"))


def pool(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(id, total, mean, high)`` of the sources' values at each target."""
    j = edges.join(values.select(F.col("id").alias(SOURCE), "x"), SOURCE)
    return j.groupBy(F.col(TARGET).alias("id")).agg(F.sum("x").alias("total"), F.avg("x").alias("mean"), F.max("x").alias("high"))


def attention_pool(edges: DataFrame, values: DataFrame, score: str) -> DataFrame:
    """``(id, y)``: source values weighted by the softmax of edge scores at each target.

    The softmax is two aggregates, so a hub's edges are combined map-side.
    """
    top = edges.groupBy(TARGET).agg(F.max(score).alias("__m"))
    j = edges.join(top, TARGET).withColumn("__w", F.exp(F.col(score) - F.col("__m"))).join(values.select(F.col("id").alias(SOURCE), "x"), SOURCE)
    return j.groupBy(F.col(TARGET).alias("id")).agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("y"))


def segment_softmax(edges: DataFrame, score: str) -> DataFrame:
    """Edges with ``weight``: the softmax of their score among their target's edges; maxima and sums are partial aggregates."""
    top = edges.groupBy(TARGET).agg(F.max(score).alias("__m"))
    e = edges.join(top, TARGET).withColumn("__e", F.exp(F.col(score) - F.col("__m")))
    total = e.groupBy(TARGET).agg(F.sum("__e").alias("__t"))
    return e.join(total, TARGET).withColumn("weight", F.col("__e") / F.col("__t")).select(*edges.columns, "weight")
