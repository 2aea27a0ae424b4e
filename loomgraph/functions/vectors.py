"""Embedding arithmetic and text sketches as column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


#: 2**31 - 1, the modulus of the sketch's permutations (fixed value).
PRIME = 2147483647


def permutations(count: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of the sketch's permutations, from a seeded generator."""
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(count)]


def minhash(df: DataFrame, group: str, item: str, count: int = 128, seed: int = 1) -> DataFrame:
    """``(group, sketch)``: for each permutation the smallest value over the group's items.

    Minima are taken map-side, so sketches merge like any partial aggregate.
    """
    h = F.conv(F.substring(F.md5(F.col(item)), 1, 7), 16, 10).cast("long")
    mins = [F.min((F.lit(a) * F.col("__h") + F.lit(b)) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(count, seed))]
    low = df.select(group, h.alias("__h")).groupBy(group).agg(*mins)
    return low.select(group, F.array(*[f"m{i}" for i in range(count)]).alias("sketch"))


def merged_sketch(df: DataFrame, sketch: str, count: int) -> DataFrame:
    """One sketch for all rows."""
    return df.agg(F.array(*[F.min(F.col(sketch)[i]) for i in range(count)]).alias(sketch))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated from two sketches: the share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
