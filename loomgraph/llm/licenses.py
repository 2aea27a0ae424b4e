"""License scans by an exact set-similarity join; DataFrame functions only."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.notices import NOTICES, Notice
from loomgraph.llm.shared import documents

#: Whole phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

THRESHOLD = 0.8
#: Copies of each found text's labels that rows of that text are dealt to.
SALTS = 16

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case.

    ``lower`` differs for letters beyond ASCII, which no phrase has, except the two
    that it turns into ASCII letters; texts with those are translated letter by letter.
    """
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(odd, plain).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Start positions of the phrase; looked for only where its last word occurs."""
    last = F.size(words) - len(phrase)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        found = words[i] == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            found = found & (words[i + k] == w)
        return found

    has = F.lit(True)
    for w in phrase:
        has = has & F.array_contains(words, w)
    return F.when(has, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


class _Template:
    """A notice as a set of words in the global order, rarest first, with its filters and blocks.

    A block starts at every ``step``-th word, a quarter of the notice, and is two steps less a
    word longer than the notice, so each span of the notice's length and a step more lies whole in one.
    """

    def __init__(self, notice: Notice, threshold: float, order: dict[str, int] | None = None):
        self.label = notice.label
        words = words_of(notice.text)
        self.step = max(1, len(words) // 4)
        self.width = len(words) + 2 * self.step - 1
        self.words = sorted(set(words), key=order.__getitem__ if order else None)
        self.need = max(1, math.ceil(threshold * len(self.words) - 1e-9))
        self.prefix = self.words[: len(self.words) - self.need + 1]
        self.must, self.never = words_of(notice.must), words_of(notice.never)


def word_order(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Place of each notice word by the number of documents that have it, rarest first.

    Counted over all documents; at most one row a notice word reaches the driver.
    """
    counted = tokens.select(F.explode(F.array_intersect(_lits(vocabulary), "words")).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counted}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def _prefix_table(spark, known: list[_Template]) -> DataFrame:
    """One row for each notice and word of its prefix, with what the filters need; its size is that of the fixed list."""
    rows = [
        {"token": w, "label": t.label, "words": t.words, "prefix": t.prefix, "rank": k + 1, "need": t.need, "step": t.step, "width": t.width, "must": t.must, "never": t.never}
        for t in known
        for k, w in enumerate(t.prefix)
    ]
    kind = "array<struct<token: string, label: string, words: array<string>, prefix: array<string>, rank: int, need: int, step: int, width: int, must: array<string>, never: array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def notice_matches(tokens: DataFrame, known: list[_Template], ranked: list[str]) -> DataFrame:
    """``(digest, labels, part)`` of the texts ``tokens(digest, words)`` that have a block with a notice.

    The words that stand in some notice's prefix meet the notices in an equi-join on the
    word; each meeting stands for the blocks around its place.  A block and a notice
    are looked at only where they meet first: at the rarest word that both have, in its first place.
    Length: a block of fewer words than needed can't match.  Prefix: that
    word must be among the first of the block, too.  Position: the words from it on
    must suffice on both sides.  What is left is counted exactly.
    """
    prefixes = sorted({w for t in known for w in t.prefix})
    reach = max(t.width for t in known)
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.col("words")[i].isin(prefixes))

    def around(i: Column) -> Column:
        begin = F.greatest(i - reach + 1, F.lit(0))
        return F.struct(i.alias("at"), F.col("words")[i].alias("token"), begin.alias("begin"), F.slice("words", begin + 1, F.lit(2 * reach - 1)).alias("near"))

    hits = tokens.where(F.arrays_overlap("words", _lits(prefixes))).select("digest", F.explode(F.transform(spots, around)).alias("hit")).select("digest", "hit.*")
    met = hits.join(F.broadcast(_prefix_table(tokens.sparkSession, known)), "token")
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("width") + 1) / F.col("step")).cast("int"))
    starts = F.transform(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int")), lambda k: k * F.col("step"))

    def block(i: Column) -> Column:
        held = F.slice("near", i - F.col("begin") + 1, F.col("width"))
        return F.struct((F.array_position(held, F.col("token")) - 1 + i == F.col("at")).alias("here"), F.array_distinct(held).alias("held"))

    blocks = met.select("*", F.explode(F.filter(F.transform(starts, block), lambda b: b["here"] & (F.size(b["held"]) >= F.col("need")))).alias("block"))
    least = blocks.where(F.array_intersect("prefix", "block.held")[0] == F.col("token"))
    ordered = least.select("*", F.array_intersect(_lits(ranked), "block.held").alias("b"))
    place = F.array_position("b", F.col("token"))
    room = F.least(F.size("b") - place, F.size("words") - F.col("rank")) + 1 >= F.col("need")
    few = ordered.where((place <= F.size("b") - F.col("need") + 1) & room)
    both = few.select("*", F.size(F.array_intersect("words", "b")).alias("both")).where(F.col("both") >= F.col("need"))
    sure = both.where((F.size(F.array_except("must", "block.held")) == 0) & ~F.arrays_overlap("never", "block.held"))
    return sure.groupBy("digest").agg(F.collect_set("label").alias("labels"), F.max(F.col("both") / F.size("words")).alias("part"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=None, threshold: float = THRESHOLD) -> DataFrame:
    """Find license phrases and notices in every whole text.

    A notice is present where a block of words holds at least ``threshold`` of its
    set of words, all of its ``must`` words and none of its ``never`` words; see
    ``_Template`` for the blocks and ``notice_matches`` for the join.  Found texts, one row each, meet
    the rows of that text by digest, dealt to SALTS copies.

    Null and wordless texts have n_words 0, no places and empty labels.  A phrase
    gives score 1, otherwise the score is the largest containment found.  Repeated
    rows come back repeated; very long texts are read whole; an empty table gives no row.
    """
    notices = NOTICES if notices is None else notices
    vocabulary = sorted({w for n in notices for w in words_of(n.text)})
    tokens = docs.select(F.col(key).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), _words(F.col(text)).alias("words"))
    order = word_order(tokens, vocabulary)
    known = [_Template(n, threshold, order) for n in notices]
    matches = notice_matches(tokens, known, sorted(vocabulary, key=order.__getitem__))

    found = tokens.select("doc_id", "digest", "words", *[_places(F.col("words"), p.split()).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    found = found.select(
        "doc_id",
        "digest",
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"),
        F.size("words").cast("long").alias("n_words"),
        sum((F.size(p) for p in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.array_min(p) for p in places]).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(p) for p in places]).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(l)) for p, l in zip(places, PHRASES.values())]), lambda x: x.isNotNull()).alias("base"),
    )
    dealt = matches.select("digest", "labels", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    both = found.join(dealt, ["digest", "salt"], "left")
    every = F.array_union("base", F.coalesce("labels", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def words_of(text: str | None) -> list[str]:
    """The words of one text, for notices and tests."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(_BREAK, low) if w]


def op6_license_scan(spark, sf_dir):
    """Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see ``license_scan``.

    Null and empty texts have n_words 0, null places and empty labels; ties and
    repeated rows come back repeated; an empty table gives no row; other columns are not read.
    """
    return license_scan(documents(spark, sf_dir))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL: phrases by position, notices by counting words in every block."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    places, parts = [], []
    for i, p in enumerate(PHRASES):
        q = p.split()
        places.append(f"list_filter(range(0, len(w) - {len(q) - 1}), lambda i: w[i + 1:i + {len(q)}] = {quoted(q)}) AS p{i}")
    known = [_Template(n, threshold) for n in NOTICES]
    for i, t in enumerate(known):
        blocks = f"list_transform(range(0, len(w), {t.step}), lambda i: w[i + 1:i + {t.width}])"
        fits = f"list_has_all(b, {quoted(t.must)}) AND NOT list_has_any(b, {quoted(t.never)})"
        held = f"list_max(list_transform(list_filter({blocks}, lambda b: {fits}), lambda b: len(list_intersect(b, {quoted(t.words)}))))"
        parts.append(f"(SELECT CASE WHEN m >= {t.need} THEN m / {len(t.words)}::DOUBLE ELSE 0 END FROM (SELECT CASE WHEN list_has_all(w, {quoted(t.must)}) THEN coalesce({held}, 0) ELSE 0 END AS m)) AS t{i}")
    n, k = len(PHRASES), len(known)
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    method = "list_filter([" + ", ".join(f"CASE WHEN t{i} > 0 THEN '{t.label}' END" for i, t in enumerate(known)) + "], lambda x: x IS NOT NULL)"
    every = "list_concat(" + ", ".join(f"p{i}" for i in range(n)) + ")"
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BREAK}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {', '.join(places)}, {', '.join(parts)} FROM d),
l AS (SELECT *, {every} AS every, {base} AS base, {method} AS method FROM p)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, method))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE greatest({', '.join(f't{i}' for i in range(k))}) END AS score
FROM l"""
