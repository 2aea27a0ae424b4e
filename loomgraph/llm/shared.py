"""What several corpus operators share: texts, cut lineage, row picking, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.connected import components  # noqa: F401
from loomgraph.session import cut  # noqa: F401
from loomgraph.sources.native import Store

#: ASCII white space, as a character class and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def one_row_each(docs: DataFrame, winners: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose keys stand in ``winners``, one row for each key.

    ``keys`` maps a column of ``winners`` to its expression over ``docs``; nulls
    match nulls.  Of several rows with one key the smallest text stays.  The
    columns of ``docs`` come back unchanged.
    """
    *names, nth = free_names(docs, *[f"{c}_{part}" for c in keys for part in ("value", "void")], "nth")
    blank = {c: F.lit("" if kind == "string" else 0).cast(kind) for c, kind in winners.dtypes}
    plain = lambda c, e: (F.coalesce(e, blank[c]), e.isNull())  # noqa: E731  nulls match as a value and a mark
    held = docs.withColumns(dict(zip(names, [x for c, e in keys.items() for x in plain(c, e)])))
    won = winners.select(*[x.alias(f"w{i}") for i, x in enumerate(x for c in keys for x in plain(c, F.col(c)))])
    semi = held.join(won, [held[n] == won[f"w{i}"] for i, n in enumerate(names)], "left_semi")
    order = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(text)))  # on the partitioning of the join
    return semi.withColumn(nth, order).where(F.col(nth) == 1).drop(*names, nth)


def rows_without(docs: DataFrame, marked: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """``docs`` without the rows whose keys ``marked(*keys, stays boolean)`` says don't stay, and with those that stay once each.

    ``marked`` has a row for each row of ``docs``.  Most rows stay and stand alone,
    so only keys that go, or that several rows have, meet the texts; rows that no such key has and
    those to pick from are told apart on one shuffle of the texts.
    """
    *names, nth = free_names(docs, *[f"{c}_{part}" for c in keys for part in ("value", "void")], "nth")
    counted = marked.groupBy(*keys).agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n"))
    blank = {c: F.lit("" if kind == "string" else 0).cast(kind) for c, kind in counted.dtypes if c in keys}
    plain = lambda c, e: (F.coalesce(e, blank[c]), e.isNull())  # noqa: E731  nulls match as a value and a mark
    keyed = docs.withColumns(dict(zip(names, [x for c, e in keys.items() for x in plain(c, e)])))
    known = counted.where("n > 1 OR NOT stays").select("n", "stays", *[x.alias(f"w{i}") for i, x in enumerate(x for c in keys for x in plain(c, F.col(c)))])
    match = lambda d: [keyed[n] == d[f"w{i}"] for i, n in enumerate(names)]
    several = known.where("n > 1 AND stays")
    order = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(text)))  # on the partitioning of the join
    some = keyed.join(several, match(several), "left_semi").withColumn(nth, order).where(F.col(nth) == 1).drop(nth)
    return keyed.join(known, match(known), "left_anti").unionByName(some).drop(*names)


def words_in(col: Column) -> Column:
    """Number of runs of non-white-space; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({WORD})"))).cast("long")


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, on whatever file system it is."""
    Store(spark, folder).delete("")


def depth_bound(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n)))) + 1
