"""Exact deduplication with skew-safe combining; DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import SPACE, documents, one_row_each

#: Salt winners that a digest has at most after the second stage.
SALTS = 16

#: Copies of one row that are written out at once.
_STEP = 1 << 16

#: A winner is one decimal: code points times this, plus a place for the id.
_RANGE = Decimal(2**65)
_TOP = Decimal(2**63)


def _normalised(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    norm = raw.select("id", F.char_length("raw").alias("n"), F.regexp_replace("raw", SPACE, "").alias("norm"))
    return norm.select("*", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("check"))


def _groups(base: DataFrame, salts: int) -> DataFrame:
    """One row for each distinct content: its winner as (id, n) and its size.

    Local: Spark's partial aggregate merges equal contents inside each task.
    Salted: what a task has left is merged by digest, salt and content; the salt
    is the task's number, so a hot content reaches a reducer once per task.
    Global: at most ``salts`` rows of a content are merged.  The grouping key
    holds the whole content at each stage, so equality never rests on the digest.
    The order "most code points, then smallest id, null ids last" is one decimal,
    which keeps the aggregates in hash maps.
    """
    order = F.col("n").cast("decimal(12,0)") * F.lit(_RANGE) + F.when(
        F.col("id").isNotNull(), F.lit(_TOP) - F.col("id")
    ).otherwise(0).cast("decimal(21,0)")
    keyed = base.select("digest", "check", "norm", order.cast("decimal(38,0)").alias("win"), (F.spark_partition_id() % salts).alias("salt"))
    salted = keyed.groupBy("digest", "salt", "norm", "check").agg(F.max("win").alias("win"), F.count("*").alias("size"))
    merged = salted.groupBy("digest", "norm", "check").agg(F.max("win").alias("win"), F.sum("size").alias("size"))
    back = F.col("win") % F.lit(_RANGE)
    return merged.select(
        "digest",
        "check",
        F.length("norm").alias("len"),
        F.when(back > 0, (F.lit(_TOP) - back).cast("long")).alias("keep_id"),
        ((F.col("win") - back) / F.lit(_RANGE)).cast("int").alias("keep_n"),
        F.col("size").alias("group_size"),
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Decide for every row which row of its content stays.

    Null texts count as empty, all empty texts are equal, a null key sorts after
    every other.  Fully repeated rows (same key, same length, equal content) count
    in ``group_size`` and only the first is kept.  An empty table gives no row.
    Other columns are not read.
    """
    base = _normalised(docs, key, text)
    groups = _groups(base, salts)
    rows = base.groupBy("id", "n", "digest", "check", F.length("norm").alias("len")).agg(F.count("*").alias("copies"))
    linked = rows.join(groups, ["digest", "check", "len"])
    # in two steps, so no row holds an array of all of its copies
    some = linked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(_STEP).cast("long"))).alias("first"))
    nth = some.select("*", F.explode(F.sequence("first", F.least(F.col("first") + (_STEP - 1), F.col("copies")))).alias("nth"))
    return nth.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, all columns unchanged.

    Null and empty texts are equal; long texts are compared whole; of ties the smallest key stays (null last), of rows
    that repeat key and text one; an empty table gives an empty table.
    """
    winners = _groups(_normalised(docs, key, text), salts).select("keep_id", "keep_n", "digest")
    raw = F.coalesce(F.col(text), F.lit(""))
    keys = {"keep_id": F.col(key).cast("long"), "keep_n": F.char_length(raw), "digest": F.sha2(F.regexp_replace(raw, SPACE, ""), 256)}
    return one_row_each(docs, winners, keys, text)


def op4_exact_dedup(spark, sf_dir):
    """Columns: doc_id, keep_id, group_size, kept, text_sha256, one row for each row of ``documents``.

    Null and empty texts are equal; long texts are compared whole; of ties the smallest
    id stays, of fully repeated rows one; an empty table gives no row; other columns are not read.
    """
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
