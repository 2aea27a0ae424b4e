"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut


#: Edges of a task.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(u long, v long)``.

    Alternates large-star and small-star steps (each an aggregate and an equi
    join; on few edges a window in one task, so that the many rounds shuffle nothing)
    until the edge set stops changing, and returns ``(node, root)`` for
    each node that has an edge; ``root`` is the smallest node reachable.  Each
    round is cut to the shared folder; only a count and a checksum reach the
    driver.  The number of rounds grows with the logarithm of the component size.
    """

    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def few(d: DataFrame, n: int) -> DataFrame:
        """Rounds on few edges run in few tasks, whatever the number of shuffle partitions."""
        tasks = 1 + n // TASK_EDGES
        return d.coalesce(tasks) if tasks < most or tasks == 1 else d

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = few(e, n).select(F.inline(F.array(F.struct("u", "v"), back)))  # no union: what lies in one task stays there
        if not large:
            both = both.where("v < u")
        if n < TASK_EDGES:  # all in one task: no shuffle
            linked = both.select("u", "v", F.least(F.min("v").over(Window.partitionBy("u")), "u").alias("m"))
        else:
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            linked = both.join(low.hint("merge"), "u")  # rounds are many: a broadcast each would fill the driver
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        return few(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = sign(now)
    while before[0]:
        now = cut(few(star(star(now, True, before[0]), False, before[0]), before[0]))
        after = sign(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
