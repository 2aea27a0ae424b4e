"""Evaluation of predictions: binned AUCs, ranking metrics, accuracy, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binned_curve(df: DataFrame, score: str, label: str, bins: int = 10_000) -> DataFrame:
    """``(bin, p, n, tp, fp)``: positives and negatives per score bin, and cumulated from the top.

    Scores in [0, 1] fall into ``bins`` bins, so the window runs over at most that
    many rows whatever the input's size.
    """
    b = F.least((F.col(score) * bins).cast("int"), F.lit(bins - 1)).alias("bin")
    c = df.groupBy(b).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    top = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return c.select("bin", "p", "n", F.sum("p").over(top).alias("tp"), F.sum("n").over(top).alias("fp"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the ROC curve; null without both classes."""
    steps = curve.agg(F.sum((F.col("tp") - F.col("p") / 2) * F.col("n")).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return steps.select(F.try_divide(F.col("area"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """Area under the precision-recall curve, trapezoids from (recall 0, precision 1)."""
    w = Window.orderBy(F.desc("bin"))
    total = curve.agg(F.sum("p").alias("total"))
    x = curve.crossJoin(F.broadcast(total)).withColumn("prec", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("rec", F.try_divide(F.col("tp").cast("double"), F.col("total")))
    x = x.withColumn("prec0", F.coalesce(F.lag("prec").over(w), F.lit(1.0))).withColumn("rec0", F.coalesce(F.lag("rec").over(w), F.lit(0.0)))
    return x.agg(F.sum((F.col("rec") - F.col("rec0")) * (F.col("prec") + F.col("prec0")) / 2).alias("pr_auc"))


def threshold_table(curve: DataFrame) -> DataFrame:
    """Per bin: true and false positive rates, precision."""
    total = curve.agg(F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n"))
    x = curve.crossJoin(F.broadcast(total))
    tiny = 1e-9
    return x.select("bin", "tp", "fp", (F.col("tp") / (F.col("tot_p") + tiny)).alias("tpr"), (F.col("fp") / (F.col("tot_n") + tiny)).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp") + tiny)).alias("precision"))


def ranking(df: DataFrame, query: str, score: str, positive: str) -> DataFrame:
    """MRR, hit@1, hit@5 and AUC of one positive against its query's negatives.

    Ties take the middle rank; hits among ties count in part.
    """
    pos = df.where(F.col(positive)).select(query, F.col(score).alias("__s"))
    neg = df.where(~F.col(positive)).select(F.col(query).alias("__q"), F.col(score).alias("__x"))
    j = pos.join(neg, pos[query] == neg["__q"]).groupBy(query, "__s").agg(
        F.sum(F.when(F.col("__x") > F.col("__s"), 1).otherwise(0)).alias("above"), F.sum(F.when(F.col("__x") == F.col("__s"), 1).otherwise(0)).alias("equal"), F.count("*").alias("n")
    )
    hit = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(k) - F.col("above")) / (F.col("equal") + 1)))
    auc = (F.col("n") - F.col("above") - F.col("equal") + 0.5 * F.col("equal")) / F.col("n")
    rank = F.col("above") + 1 + F.col("equal") / 2
    return j.agg(F.avg(1 / rank).alias("mrr"), F.avg(hit(1)).alias("hit_at_1"), F.avg(hit(5)).alias("hit_at_5"), F.avg(auc).alias("auc"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.when(F.col(label) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"))


def regression(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """RMSE and R2 in one pass."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(predicted)
    a = df.agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum(y * y).alias("yy"), F.avg(y).alias("m"))
    total = F.col("yy") - F.col("n") * F.col("m") * F.col("m")
    return a.select("n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (1 - F.try_divide(F.col("sse"), total)).alias("r2"))
