"""Negative targets, random walks, splits and batches; all randomness is a digest of keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.adjacency import adjacency
from loomgraph.operators.ranges import dense_index
from loomgraph.operators.sampling import SamplingPlan, Step, hash_order, hop_plan


def hash_int(*parts: Column, salt: str = "loom") -> Column:
    """The first 32 bits of the digest of salt and keys as a long."""
    return F.conv(F.substring(hash_order(*parts, salt=salt), 1, 8), 16, 10).cast("long")


def random_negatives(positives: DataFrame, targets: DataFrame, per_edge: int, salt: str = "neg", keep: Sequence[str] = ()) -> DataFrame:
    """``(source, target, k, negative)``: uniform targets with replacement; they may be true neighbours.

    ``targets(idx, id)`` are densely numbered; only their count is needed to draw.  ``keep`` names columns of the positives that stay.
    """
    n = targets.agg(F.count("*").alias("n"))
    drawn = positives.select(SOURCE, TARGET, *keep).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1)))).crossJoin(F.broadcast(n))
    drawn = drawn.withColumn("idx", hash_int(F.col(SOURCE), F.col(TARGET), F.col("k"), salt=salt) % F.col("n"))
    return drawn.join(targets.select("idx", F.col("id").alias("negative")), "idx").select(SOURCE, TARGET, "k", "negative", *keep)


def walk_negatives(g: Graph, plan: SamplingPlan, edge_set: str, seeds: DataFrame, walks: int, top: int, edge_key: dict[str, str] | None = None, salt: str = "walk") -> DataFrame:
    """``(seed, negative, visits, rank)``: targets that random walks along a plan reach most, without the seed's own edges.

    At each plan node a walk takes one of the hops uniformly, then a uniform neighbour, parallel
    edges counting each, and ends where there is none.  Every step into the edge set's
    target set counts as a visit; where the edge set joins a node set with itself,
    the seed is none of its negatives.  Most visited targets come first, ties by key.  Places left up to
    ``top`` get uniform targets with 0 visits, unchecked but for the seed.  All choices are digests of (seed, walk, path).
    """
    e, edge_key = g.schema.edge_sets[edge_set], edge_key or {}
    same = e.source == e.target
    visits: list[DataFrame] = []

    def walk(steps: Sequence[Step], front: DataFrame, path: str) -> None:
        turn = hash_int(F.lit("hop"), F.lit(path), F.col("seed"), F.col("w"), salt=salt) % len(steps)
        front = front.withColumn("turn", turn)
        for n, step in enumerate(steps):
            lists = adjacency(g.edges[step.edge_set], step.reverse, edge_key.get(step.edge_set))
            ranked = lists.edges.select(F.col("node").alias("a"), F.col("neighbor").alias("b"), F.col("place").alias("i"))
            degree = lists.degrees.select(F.col("node").alias("a"), F.col("degree").alias("d"))
            draw = hash_int(F.lit("node"), F.lit(f"{path}/{n}"), F.col("seed"), F.col("w"), salt=salt) % F.col("d")
            drawn = front.where(F.col("turn") == n).join(degree, front["node"] == degree["a"]).select("seed", "w", "a", draw.alias("i"))
            reached = drawn.join(ranked, ["a", "i"]).select("seed", "w", F.col("b").alias("node"))
            if step.node_set == e.target:
                hit = reached.where(F.col("node") != F.col("seed")) if same else reached
                visits.append(hit.select("seed", F.col("node").alias("negative")))
            if step.then:
                walk(step.then, reached, f"{path}/{n}")

    start = seeds.select("seed", F.col("seed").alias("node")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    walk(plan.steps, start, "")
    if not visits:
        raise ValueError(f"the plan never reaches {e.target}")
    counted = reduce(DataFrame.unionByName, visits).groupBy("seed", "negative").agg(F.count("*").alias("visits"))
    known = g.edges[edge_set].select(F.col(SOURCE).alias("seed"), F.col(TARGET).alias("negative"))
    fresh = counted.join(known, ["seed", "negative"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("visits"), "negative"))
    found = fresh.withColumn("rank", rank).where(F.col("rank") <= top)
    targets = dense_index(g.ids(e.target), "id")
    places = seeds.select("seed", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("rank"))
    empty = places.join(found.select("seed", "rank"), ["seed", "rank"], "left_anti")
    n = g.ids(e.target).count()
    if same:  # uniform among the others: numbers from the seed's own on are one further
        own = targets.select(F.col("id").alias("seed"), F.col("idx").alias("own"))
        drawn = empty.join(own, "seed", "left").withColumn("r", hash_int(F.lit("fill"), F.col("seed"), F.col("rank"), salt=salt) % max(1, n - 1))
        drawn = drawn.withColumn("idx", F.col("r") + F.when(F.col("r") >= F.col("own"), 1).otherwise(0))
    else:
        drawn = empty.withColumn("idx", hash_int(F.lit("fill"), F.col("seed"), F.col("rank"), salt=salt) % max(1, n))
    filled = drawn.join(targets.select("idx", F.col("id").alias("negative")), "idx").select("seed", "negative", F.lit(0).cast("long").alias("visits"), "rank")
    return found.unionByName(filled)


#: Negative samplers by name: (graph, edge set, positives, per edge or top) -> rows; users may add their own.
SAMPLERS: dict[str, Callable[..., DataFrame]] = {}


def sampler(name: str):
    """Register a negative sampler under a name that a configuration may use."""

    def keep(f):
        SAMPLERS[name] = f
        return f

    return keep


@sampler("random")
def _random(g: Graph, edge_set: str, positives: DataFrame, per_edge: int, keep: Sequence[str] = ()) -> DataFrame:
    return random_negatives(positives, dense_index(g.ids(g.schema.edge_sets[edge_set].target), "id"), per_edge, keep=keep)


@sampler("walk")
def _walk(g: Graph, edge_set: str, positives: DataFrame, per_edge: int, walks: int = 20, hops: int = 3) -> DataFrame:
    """Each positive edge gets its source's walk negatives, the k-th for k."""
    e = g.schema.edge_sets[edge_set]
    seeds = positives.select(F.col(SOURCE).alias("seed")).distinct()
    found = walk_negatives(g, hop_plan(g.schema, e.source, hops, None), edge_set, seeds, walks, per_edge)
    return positives.select(SOURCE, TARGET).join(found, positives[SOURCE] == found["seed"]).select(SOURCE, TARGET, (F.col("rank") - 1).alias("k"), "negative")


def edge_neighbors(g: Graph, edge_set: str, positives: DataFrame, per_edge: int, kind: str = "random", **options) -> DataFrame:
    """``(source, target, k, negative)`` of the seed edges by the named sampler."""
    return SAMPLERS[kind](g, edge_set, positives, per_edge, **options)


def interleaved(links: DataFrame) -> DataFrame:
    """``(source, target, place, candidate, label)`` from ``links(source, target, k, negative)``: each edge's own target first, then its negatives."""
    own = links.select(SOURCE, TARGET, F.lit(0).cast("long").alias("place"), F.col(TARGET).alias("candidate"), F.lit(1).alias("label")).distinct()
    others = links.select(SOURCE, TARGET, (F.col("k") + 1).cast("long").alias("place"), F.col("negative").alias("candidate"), F.lit(0).alias("label"))
    return own.unionByName(others)


def separated(scored: DataFrame, score: str = "score") -> DataFrame:
    """``(source, target, positive, negatives)``: scores of interleaved links, an edge's own and the array of the others in order."""
    others = F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", F.col(score).alias("s")))))
    g = scored.groupBy(SOURCE, TARGET).agg(F.max(F.when(F.col("place") == 0, F.col(score))).alias("positive"), others.alias("o"))
    return g.select(SOURCE, TARGET, "positive", F.transform("o", lambda x: x["s"]).alias("negatives"))


#: Upper bits of a digest by which rows are counted to find a limit, or dealt to be numbered.
COUNTED_BITS, DEALT_BITS = 16, 10


def split_random(df: DataFrame, key: str, share: float, salt: str = "split") -> DataFrame:
    """Adds ``valid``: the ``int(n * share)`` rows with the smallest key digests.

    Rows are counted by the upper bits of their digests; only those of the part in which the limit lies are ranked.
    """
    dealt = df.withColumn("__h", hash_int(F.col(key), salt=salt)).withColumn("__p", F.shiftright("__h", 32 - COUNTED_BITS))
    counts = sorted(map(tuple, dealt.groupBy("__p").agg(F.count("*")).collect()))  # as many as the bits have values, at most
    left, part = int(sum(n for _, n in counts) * share), 1 << COUNTED_BITS
    for p, n in counts:
        if n > left:
            part = p
            break
        left -= n
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key))
    some = dealt.where(F.col("__p") == part).withColumn("valid", rank <= left)
    return dealt.where(F.col("__p") != part).withColumn("valid", F.col("__p") < part).unionByName(some).drop("__h", "__p")


def split_temporal(df: DataFrame, time: str, key: str, share: float) -> DataFrame:
    """Adds ``valid``: the ``int(n * share)`` latest rows by time, then key."""
    n = df.count()
    return dense_index(df, time, "__r", ties=[key]).withColumn("valid", F.col("__r") >= n - int(n * share)).drop("__r")


def batches(df: DataFrame, key: str, size: int, drop_remainder: bool = True, salt: str = "batch", keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds ``batch`` and ``slot``: shuffled by digest and dealt into batches of ``size``.

    Digests are uniform, so equal ranges of them are about equally full: rows are ranked in each and shifted by the rows of those before.
    ``keep`` is given the rows ranked in their ranges, to compute them once.
    """
    dealt = df.withColumn("__h", hash_int(F.col(key), salt=salt)).withColumn("__p", F.shiftright("__h", 32 - DEALT_BITS))
    line = Window.partitionBy("__p").orderBy("__h", key)
    ranked = keep(dealt.withColumn("__r", F.row_number().over(line) - 1).drop("__h"))
    sizes = ranked.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    place = F.col("__r") + F.col("__ahead")
    out = ranked.join(F.broadcast(ahead), "__p").withColumn("batch", F.floor(place / size).cast("long")).withColumn("slot", (place % size).cast("long"))
    if drop_remainder:
        out = out.where(F.col("batch") < F.floor(F.col("__all") / size))
    return out.drop("__p", "__r", "__ahead", "__all")
