"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import SPACE, WORD, cut, documents, free_names, one_row_each, words_in

WEIGHTS = (5, 2, 1)
#: A source is taken at most this many times over.
REPEATS = 3
#: A document of more than one in so many of its source's target words queues in pieces of that size.
PIECES = 4096
#: Rows of a hash range of a source's queue and of a slot of the virtual clock, and the fewest and most of either.
SPAN_ROWS, SPANS = 1 << 16, (1 << 12, 1 << 18)


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn.  The whole
    budget is shared by weight; a target stops at ``repeats`` times its source and
    the excess is reshared.  That fixed point is ``least(cap, level * weight)``:
    with sources sorted by cap / weight, the level is the first one at which the
    next source would not overflow.  The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * repeats
    order = Window.orderBy(F.col("ratio"), F.col("place"))
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select("source", "source_size", place.alias("place"), weight.cast("long").alias("weight"))
    ranked = ranked.select("*", cap.alias("cap"), (cap.cast("double") / F.col("weight")).alias("ratio"))
    ranked = ranked.select("*", F.sum("source_size").over(everything).alias("budget"))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0))).cast("double") / F.sum("weight").over(above)
    ranked = ranked.select("*", level.alias("level"))
    chosen = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), chosen["level"] * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _shuffle_key(key: Column, text: Column) -> Column:
    """60 bits of a digest of the key, or of the text where there is no key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(key.cast("string"), text, F.lit("")))), 1, 15), 16, 10).cast("long")


def _spans(rows: int) -> int:
    """A power of two: how many ranges or slots so many rows are dealt to."""
    return min(SPANS[1], max(SPANS[0], 1 << (rows // SPAN_ROWS).bit_length()))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix as a queue: one row for each piece of each copy of each document near the budget or before it.

    Each source's documents stand in a hash-shuffled queue that is gone through up
    to ``repeats`` times.  A copy has the virtual finish time (words before + its size) /
    target: all sources reach time 1 together.  A document longer than a ``PIECES``-th of its
    source's target queues in pieces, each with a finish time of its own, so that no long document keeps its
    source far from the target.  All pieces are range-sorted by finish time, whatever source they are of;
    ``position`` is the number of words before a piece in that order, and the order is truncated at
    the total budget, the words of the corpus: a piece gets what its position leaves of it.

    With pieces of at most target / PIECES + 1 words, a source has at time T no fewer than T * target - piece
    words before it, or has run out of copies; so the budget ends by the time at which any source's queue has
    ``_reach`` words, and pieces that start later never enter the sort.

    Columns: id, mark, source, size, source_size, target, row (source, range, nth), copy,
    start, offered, words, finish, position.  A row that is never served has one row with words 0.
    Null and blank texts have size 0.  Running sums are taken within hash ranges of
    a source and slots of the clock, with the totals of earlier ranges added, so no
    task needs a whole source.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("id"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"),
        _shuffle_key(F.col(key).cast("long"), F.col(text)).alias("h"),
    )
    rows = cut(rows)
    spans = _spans(rows.count())
    rows = rows.select("*", F.shiftright("h", 61 - spans.bit_length()).cast("int").alias("range"))  # h has 60 bits
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, repeats)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "range", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("ahead"))
    plan = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    plan = cut(plan.select("p.source", "range", "ahead", "source_size", "target"))

    line = Window.partitionBy("source", "range").orderBy("h", "id", "size", "mark")
    queued = rows.select(
        "*",
        F.row_number().over(line).alias("nth"),
        (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
    )
    match = queued["source"].eqNullSafe(plan["source"]) & (queued["range"] == plan["range"])
    queued = queued.join(plan, match).select(queued["*"], "ahead", "source_size", "target")
    turns = queued.select("*", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("copy"))
    turns = turns.withColumn("start", F.col("ahead") + F.col("before") + F.col("copy") * F.col("source_size"))
    sources = plan.select("source", "source_size").distinct().agg(F.count("*").alias("n"), F.sum("source_size").alias("budget")).first()
    turns = turns.where((F.col("copy") == 0) | (F.col("start") < _reach(sources["n"])))
    piece, most = F.greatest(F.lit(1), F.ceil(F.col("target") / PIECES)), F.ceil(_reach(sources["n"]) - F.col("start"))
    last = F.greatest(F.lit(0), F.least(F.col("size") - 1, most)).cast("long")
    turns = turns.withColumn("piece", piece).withColumn("within", F.explode(F.sequence(F.lit(0).cast("long"), last, F.col("piece"))))
    turns = turns.withColumn("start", F.col("start") + F.col("within"))
    due = (F.col("size") > 0) & (F.col("start") < _reach(sources["n"]))
    turns = turns.withColumn("offered", F.when(due, F.least("piece", F.col("size") - F.col("within"))).otherwise(0).cast("long"))
    turns = turns.where("offered > 0 OR copy = 0 AND within = 0")
    turns = turns.withColumn("finish", F.when(F.col("offered") > 0, (F.col("start") + F.col("offered")) / F.col("target")))
    slot = F.when(F.col("offered") > 0, F.least(F.floor(F.col("finish") * spans), F.lit(spans * 2))).otherwise(F.col("h") % spans)
    turns = turns.withColumn("slot", slot.cast("int"))
    held = turns.groupBy("slot").agg(F.sum("offered").alias("held"))
    held = held.select("slot", F.coalesce(F.sum("held").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_slot"))
    clock = Window.partitionBy("slot").orderBy("finish", "source", "start")
    inside = F.sum("offered").over(clock.rowsBetween(Window.unboundedPreceding, 0)) - F.col("offered")
    placed = turns.withColumn("inside", inside).join(held, "slot")
    position = F.col("before_slot") + F.col("inside")
    placed = placed.withColumn("words", _truncated(position, F.col("offered"), sources["budget"] or 0))
    return placed.select("id", "mark", "source", "size", "source_size", "target", "range", "nth", "copy", "start", "offered", "words", "finish", F.when(F.col("words") > 0, position).alias("position"))


def _reach(sources: int) -> Column:
    """Words of a source's queue beyond which the budget is surely used up."""
    return F.col("target") * 1.01 + (sources + 1)


def _truncated(position: Column, offered: Column, budget: int) -> Column:
    """What the budget leaves of a piece at its position in the sorted queue."""
    return F.greatest(F.lit(0), F.least(offered, F.lit(budget) - position)).cast("long")


def mix(docs: DataFrame, **columns) -> DataFrame:
    """One row for each row of ``docs``: how many of its words the mix takes, repeats counted.

    ``first_position`` is null for rows that are not taken.  An empty table gives no row.
    """
    served = schedule(docs, **columns)
    row = ["source", "range", "nth", "id", "mark", "size", "source_size", "target"]
    return served.groupBy(*row).agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as mixed: whole repeats, then the words of a last one that fit; columns unchanged.

    A document taken 2.5 times over gives two whole rows and one with the first half
    of its words.  Rows that repeat a key and a text are mixed as one document.
    """
    plain = docs.where(words_in(F.col(text)) > 0)
    takes = mix(docs, key=key, text=text, source=source).where("taken > 0")
    takes = takes.groupBy("id", "mark").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    k, m, copy, taken, size = free_names(docs, "id", "mark", "copy", "taken", "size")
    takes = takes.select(F.col("id").alias(k), F.col("mark").alias(m), F.col("taken").alias(taken), F.col("size").alias(size))
    once = one_row_each(plain, takes, {k: F.col(key).cast("long"), m: F.xxhash64(F.col(text))}, text)
    joined = once.join(takes, F.col(key).cast("long").eqNullSafe(takes[k]) & (F.xxhash64(F.col(text)) == takes[m]))
    whole, rest = F.floor(F.col(taken) / F.col(size)), F.col(taken) % F.col(size)
    copies = F.sequence(F.lit(0), (whole + F.when(rest > 0, 1).otherwise(0) - 1).cast("int"))
    rows = joined.withColumn(copy, F.explode(copies))
    shown = F.when(F.col(copy) < whole, F.col(text)).otherwise(_first_words(F.col(text), rest))
    return rows.withColumn(text, shown).select(*docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    words = F.regexp_extract_all(text, F.lit(f"({SPACE}*{WORD})"))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), n).cast("int")), "")


def op3_mixing(spark, sf_dir):
    """Columns: doc_id, size, source_size, target, taken, first_position in the served queue (null if not taken).

    Null, empty and blank texts have size 0 and are never taken; long ones are counted
    whole; ties stand by hash, then id, size and text, repeated rows count each; a null
    source comes last; an empty table gives no row; other columns are not read.
    """
    return mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_position")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM s
), r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w
), l AS (
  SELECT *, CAST(budget - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r
), f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, place LIMIT 1
), t AS (SELECT source, place, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target FROM l
), q AS (
  SELECT d.*, t.place, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (SELECT count(*) AS sources, CAST(sum(source_size) AS BIGINT) AS budget FROM s
), c AS (
  SELECT q.*, ahead + copy * source_size AS begins, greatest(1, CAST(ceil(target / 4096) AS BIGINT)) AS piece
  FROM q, (VALUES (0), (1), (2)) v(copy) WHERE size > 0
), x AS (
  SELECT doc_id, source, target, begins + within AS start, least(piece, size - within) AS offered
  FROM (SELECT *, unnest(range(0, size, piece)) AS within FROM c)
), o AS (
  SELECT *, CAST(sum(offered) OVER (ORDER BY (start + offered) / target, source NULLS FIRST, start ROWS UNBOUNDED PRECEDING) - offered AS BIGINT) AS position
  FROM x
), p AS (
  SELECT doc_id, position, least(offered, budget - position) AS words FROM o, n WHERE position < budget
), g AS (SELECT doc_id, sum(words) AS taken, CAST(min(position) AS BIGINT) AS first_position FROM p GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, g.first_position
FROM q LEFT JOIN g USING (doc_id)
"""
