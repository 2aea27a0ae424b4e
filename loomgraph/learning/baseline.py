"""A node model without a neural network: own and pooled neighbour features, then a linear model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.negatives import split_random

NUMBERS = ("int", "bigint", "float", "double")


def pooled_features(g: Graph, node_set: str, label: str) -> DataFrame:
    """``(id, label, own numbers, degree and mean of each neighbour set's numbers)``, one row a node."""
    key = g.key(node_set)
    own = [c for c, t in g.nodes[node_set].dtypes if t in NUMBERS and c not in (key, label)]
    out = g.nodes[node_set].select(F.col(key).alias("id"), F.col(label).alias("label"), *[F.col(c).cast("double").alias(f"own_{c}") for c in own])
    for n, s in sorted(g.schema.edge_sets.items()):
        for here, there, other in ((SOURCE, TARGET, s.target), (TARGET, SOURCE, s.source)):
            if (s.source if here == SOURCE else s.target) != node_set:
                continue
            far = [c for c, t in g.nodes[other].dtypes if t in NUMBERS and c != g.key(other) and not (other == node_set and c == label)]
            rows = g.nodes[other].select(F.col(g.key(other)).alias(there), *[F.col(c).cast("double") for c in far])
            e = g.edges[n].select(F.col(here).alias("id"), F.col(there)).join(rows, there)
            tag = f"{n}_{'out' if here == SOURCE else 'in'}"
            pooled = e.groupBy("id").agg(F.count("*").cast("double").alias(f"{tag}_degree"), *[F.avg(c).alias(f"{tag}_{c}") for c in far])
            out = out.join(pooled, "id", "left")
    return out.fillna(0.0, [c for c in out.columns if c not in ("id", "label")])


@dataclass(frozen=True)
class NodeModel:
    model: PipelineModel
    columns: list[str]
    metric: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).select("id", "prediction")


def train_node_model(g: Graph, node_set: str, label: str, share: float = 0.2, classes: bool = True) -> NodeModel:
    """Fit on the training split, measure on the rest: accuracy, or RMSE for a number."""
    rows = split_random(pooled_features(g, node_set, label).where(F.col("label").isNotNull()), "id", share)
    columns = [c for c in rows.columns if c not in ("id", "label", "valid")]
    stages = [VectorAssembler(inputCols=columns, outputCol="features")]
    if classes:
        stages += [StringIndexer(inputCol="label", outputCol="target", handleInvalid="keep"), LogisticRegression(labelCol="target", standardization=True, maxIter=30)]
    else:
        rows = rows.withColumn("target", F.col("label").cast("double"))
        stages.append(LinearRegression(labelCol="target", maxIter=30))
    model = Pipeline(stages=stages).fit(rows.where("NOT valid"))
    tested = model.transform(rows.where("valid"))
    right = F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("m")
    error = F.sqrt(F.avg((F.col("prediction") - F.col("target")) ** 2)).alias("m")
    return NodeModel(model, columns, {"accuracy" if classes else "rmse": tested.agg(right if classes else error).first()["m"]})


def link_scores(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target, score)``: sigmoid of the dot product of two embeddings ``(id, v)``."""
    from loomgraph.functions.vectors import dot, sigmoid

    a, b = sources.select(F.col("id").alias(SOURCE), F.col("v").alias("va")), targets.select(F.col("id").alias(TARGET), F.col("v").alias("vb"))
    return reduce(lambda d, x: d.join(x[0], x[1]), ((a, SOURCE), (b, TARGET)), pairs).select(SOURCE, TARGET, sigmoid(dot(F.col("va"), F.col("vb"))).alias("score"))
