"""How quality filters interact: what each removes in every order, from one scan of the texts.

The scan runs over Arrow's own offset and byte buffers: a table gives each byte its
classes, prefix sums count words, capitals, symbols and code points of a text, and the
hashes of its words, sorted within the text and verified byte by byte where
they are equal, give its distinct words.  A text's failures are then one mask, and all
orders of all filters follow from the number of documents of each mask.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import documents

#: A: fewer words; B: fewer distinct words in a hundred; C: more capitals in a hundred code points; D: any of these; E: copies.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Bytes that are classed at a time; texts are scanned together up to as many.
BLOCK = 1 << 20
#: Parts that the rows of one key are dealt to before they are joined.
SALTS = 64
_SPACE, _CAPITAL, _SYMBOL, _LEAD = 1, 2, 4, 8
#: Base of the words' hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _classes(symbols: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    table[ord("A") : ord("Z") + 1] |= _CAPITAL
    table[[ord(c) for c in symbols]] |= _SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= _LEAD
    return table


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts of texts whose UTF-8 bytes lie one after the other in a buffer."""

    def __init__(self, symbols: str = SYMBOLS):
        self.table = _classes(symbols)
        self.up, self.down = _powers(_BASE), _powers(_BACK)
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """``words``, ``distinct``, ``capitals``, ``symbols``, ``chars`` of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        out = {k: np.zeros(len(offsets) - 1, np.int64) for k in ("words", "distinct", "capitals", "symbols", "chars")}
        low = 0
        while low < len(offsets) - 1:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1)
            first = int(offsets[low])
            found = self._some(data[first : int(offsets[high])], offsets[low : high + 1] - first)
            for k, v in found.items():
                out[k][low:high] = v
            low = high
        return out

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        size = len(data)
        at = np.zeros((3, len(offsets)), np.int64)  # capitals, symbols, code points before each offset
        base = np.zeros(3, np.int64)
        hash_before, in_word = np.zeros(1, np.uint64), False
        power, back = np.ones(1, np.uint64), np.ones(1, np.uint64)
        starts, ends, heads, tails, undo = [], [], [], [], []
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        for low in range(0, size, BLOCK):
            part = data[low : low + BLOCK]
            n = len(part)
            kind = self.table[part]
            mine = slice(np.searchsorted(offsets, low, "right"), np.searchsorted(offsets, low + n, "right"))
            for k, bit in enumerate((_CAPITAL, _SYMBOL, _LEAD)):
                sums = np.cumsum(kind & bit != 0, dtype=np.int64)
                at[k, mine] = base[k] + sums[offsets[mine] - low - 1]
                base[k] += sums[-1]
            solid = kind & _SPACE == 0
            before = np.empty(n, bool)
            before[0], before[1:] = in_word, solid[:-1]
            new_text = np.zeros(n, bool)
            new_text[firsts[np.searchsorted(firsts, low) : np.searchsorted(firsts, low + n)] - low] = True
            begin = np.flatnonzero(solid & (~before | new_text))
            end = np.flatnonzero(before & (~solid | new_text))
            sums = np.empty(n + 1, np.uint64)
            sums[0] = hash_before[0]
            np.cumsum(self.values[part] * (self.up[:n] * power), out=sums[1:])
            sums[1:] += hash_before
            starts.append(begin + low)
            ends.append(end + low)
            heads.append(sums[begin])
            tails.append(sums[end])
            undo.append(self.down[begin] * back)
            hash_before, in_word = sums[-1:].copy(), bool(solid[-1])
            power, back = power * self.up[n], back * self.down[n]
        if in_word:
            ends.append(np.array([size]))
            tails.append(hash_before)
        counts = dict(zip(("capitals", "symbols", "chars"), np.diff(at)))
        if not starts:
            return counts | {"words": np.zeros(len(offsets) - 1, np.int64), "distinct": np.zeros(len(offsets) - 1, np.int64)}
        start, end = np.concatenate(starts), np.concatenate(ends)
        text = np.searchsorted(offsets, start, "right") - 1
        words = np.bincount(text, minlength=len(offsets) - 1)
        marks = (np.concatenate(tails) - np.concatenate(heads)) * np.concatenate(undo)
        return counts | {"words": words, "distinct": words - self._repeats(data, start, end, text, marks, len(words))}

    def _repeats(self, data, start, end, text, marks, texts: int) -> np.ndarray:
        """Words of each text that stand earlier in the text's sorted hashes, verified; exact where hashes collide."""
        order = np.lexsort((marks, text))
        a, b = order[:-1], order[1:]
        twin = (text[a] == text[b]) & (marks[a] == marks[b])
        a, b = a[twin], b[twin]
        same = self._equal(data, start[a], end[a] - start[a], start[b], end[b] - start[b])
        out = np.bincount(text[b], minlength=texts)
        for t in np.unique(text[b[~same]]):
            mine = np.flatnonzero(text == t)
            out[t] = len(mine) - len({data[s:e].tobytes() for s, e in zip(start[mine].tolist(), end[mine].tolist())})
        return out

    def _equal(self, data, a, n_a, b, n_b) -> np.ndarray:
        same = n_a == n_b
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), np.uint64, wide, strides=(1,))
        live, done = np.flatnonzero(same), 0
        while len(live) > 64 or (len(live) and done < 256):
            left = np.minimum(n_a[live] - done, 8)
            differ = (eight[a[live] + done] ^ eight[b[live] + done]) & _LOW[left]
            same[live[differ != 0]] = False
            done += 8
            live = live[(differ == 0) & (n_a[live] > done)]
        for i in live:
            n = int(n_a[i])
            same[i] = np.array_equal(data[a[i] : a[i] + n], data[b[i] : b[i] + n])
        return same


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", min_words: int = MIN_WORDS,
                   min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS, symbols: str = SYMBOLS) -> DataFrame:
    """``(id, part, digest, mask)`` of each row: bit i of the mask says that filter i of A to D fails it.

    Null texts and parts count as empty.  The digest is the text's SHA-256.
    """

    def run(batches):
        scanner = Scanner(symbols)
        for batch in batches:
            column = batch.column(3).cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            c = scanner.scan(data, offsets)
            mask = (c["words"] < min_words).astype(np.int32)
            mask |= (100 * c["distinct"] < min_distinct * c["words"]).astype(np.int32) << 1
            mask |= (100 * c["capitals"] > max_capitals * c["chars"]).astype(np.int32) << 2
            mask |= (c["symbols"] > 0).astype(np.int32) << 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask)], ["id", "part", "digest", "mask"])

    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(whole, 256))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), whole.alias("text"))
    return rows.mapInArrow(run, "id long, part string, digest binary, mask int")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents of each part by the filters that fail them, E among them.

    ``failed(id, part, digest, mask)`` as of ``failed_filters``; ``labels(id, good, toxic)``
    has one row for each id at most.  Filter E fails a row whose text some row with a smaller id
    has; a null id is larger than all others, and rows of one id are no copies
    of each other.  Equal rows are counted together before they are joined, and a text's
    copies are combined in every task before they meet, so neither a hot id nor a
    hot text is one group of rows; what meets is one row for each part and label of a text.
    """
    rows = failed.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), salt).otherwise(F.lit(0)))
    tagged = rows.join(labels.select("id", "good", "toxic", F.lit(0).cast("long").alias("salt")), ["id", "salt"], "left")
    tagged = tagged.select("id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", F.col("n").alias("here")))
    copies = tagged.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), first.alias("first"))
    place = F.struct(F.col("first.void"), F.col("first.id"))
    copies = copies.withColumn("least", F.min(place).over(Window.partitionBy("digest")))
    kept = F.when(place == F.col("least"), F.col("first.here")).otherwise(F.lit(0))
    kept = F.when(F.col("least.void"), F.col("n")).otherwise(kept)  # ids that are all null: none is smaller
    split = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - kept).alias("n")))
    flat = copies.select("part", "good", "toxic", F.explode(split).alias("m")).select("part", "good", "toxic", "m.mask", "m.n")
    return flat.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each step of each order of all filters, from ``mask_counts``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Each part has a row for every order and step; without documents there is no part and no row.
    """
    orders = ["".join(p) for p in permutations(letters)]
    rows = counts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = {c: F.lit(1 << i) for i, c in enumerate(letters)}
    earlier = [F.when(F.instr(before, c) > 0, bit).otherwise(0) for c, bit in bits.items()]
    bit = F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{letters}') - 1)")
    rows = rows.withColumns({"bit": bit, "earlier": reduce(add, earlier)})
    hit = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0)).alias
    removed = hit("bit") & ~hit("earlier")
    n_orders = F.lit(len(orders))
    share = F.floor(n_orders / F.bit_count("mask")).cast("long")  # orders in which the filter comes first among those that fail
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~hit("bit") & ~hit("earlier"))("kept"),
        count(removed)("removed"),
        count(hit("bit") & hit("earlier"))("redundant"),
        count(F.col("mask") == F.col("bit"))("unique_fails"),
        count(removed & F.col("good"))("good_lost"),
        count(removed & F.col("toxic"))("toxic_lost"),
        F.sum(F.when(hit("bit"), F.col("n") * share).otherwise(0)).alias("shapley"),
    )


def label_flags(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(id, good, toxic)``, one row for each id: whether any of its rows says so; nulls say nothing."""
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col(key).isNotNull())
    return known.groupBy(F.col(key).cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def op11_filter_interactions(spark, sf_dir):
    """Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts have no words and fail A, and E after the first; long ones are
    scanned whole; a null language is part '' with the empty one; null ids have no label and
    count as larger than all others; rows of one id count each and are no copies of
    each other; labels of one id count together; an empty table gives no row; other columns are not read.
    """
    labels = label_flags(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(mask_counts(failed_filters(documents(spark, sf_dir)), labels))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN least < coalesce(doc_id, 9223372036854775807) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS x, left(filter_order, i - 1) AS earlier FROM o, range(1, 6) r(i)
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL
), t AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS hit,
         earlier <> '' AND fails <> '' AND translate(fails, earlier, '') <> fails AS gone
  FROM g, s
), r AS (
  SELECT part, filter_order, step, x,
         CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY ALL
)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
