"""Order MinHash fingerprints of documents; DataFrame functions only.

A k-mer with its occurrence number is one element of a text.  Each sketch has an order of all
elements of its own: that of their hashes with the sketch's number flipped into the upper bits, so every
order is as random as the hash.  The ``TUPLE`` smallest elements of the whole text in
that order are put back in text order and hashed as a tuple.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import SPACE, documents

#: Words in a k-mer, sketches in a fingerprint, and minimal k-mers in a sketch.
K = 3
SKETCHES = 64
TUPLE = 2
#: Ranges of neighbouring documents for each shuffle partition, and rows of a range among null ids.
BUCKETS = 4
VOID_ROWS = 1 << 12
#: Upper bits of a k-mer's hash that are looked at; what is below has room for a place.
_HASH_BITS = 40
_LOW = (1 << 64 - _HASH_BITS) - 1
_EMPTY = "0000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Words between ASCII white space; the plain split where only blanks and new lines occur is the faster one."""
    rare = F.lit(False)
    for c in "\t\x0b\x0c\r":
        rare = rare | F.contains(text, F.lit(c))
    return F.array_remove(F.when(rare, F.split(text, f"{SPACE}+")).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def _hashes(text: Column, k: int) -> Column:
    """Hashes of a text's k-mers of words, in order; a text of fewer words is one k-mer, a blank one none."""

    def of(w: Column) -> Column:
        last = F.size(w) - k
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(last >= 0, many).otherwise(one)

    return _let(_words(text), of)


class _Packed:
    """An element as one long: the hash's upper bits, the place below.  For texts whose places fit."""

    make = staticmethod(lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
    hash = staticmethod(lambda x: x.bitwiseAND(F.lit(~_LOW)))
    turned = staticmethod(lambda x, key: x.bitwiseXOR(key))
    placed = staticmethod(lambda x: F.shiftleft(x, _HASH_BITS).bitwiseOR(F.shiftrightunsigned(x, 64 - _HASH_BITS)))
    value = staticmethod(lambda y: y.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))

    @staticmethod
    def again(x: Column, nth: Column) -> Column:
        return F.xxhash64(x.bitwiseAND(F.lit(~_LOW)), nth).bitwiseAND(F.lit(~_LOW)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))


class _Wide:
    """The same element as a struct, for texts of any size."""

    make = staticmethod(lambda h, i: F.struct(h.bitwiseAND(F.lit(~_LOW)).alias("h"), i.cast("int").alias("p")))
    hash = staticmethod(lambda x: x["h"])
    turned = staticmethod(lambda x, key: F.struct(x["h"].bitwiseXOR(key).alias("h"), x["p"].alias("p")))
    placed = staticmethod(lambda x: F.struct(x["p"].alias("p"), F.shiftrightunsigned(x["h"], 64 - _HASH_BITS).alias("v")))
    value = staticmethod(lambda y: y["v"])
    again = staticmethod(lambda x, nth: F.struct(F.xxhash64(x["h"], nth).bitwiseAND(F.lit(~_LOW)).alias("h"), x["p"].alias("p")))


def _numbered(hashes: Column, kind=_Packed) -> Column:
    """The elements of a text, sorted: a k-mer's first occurrence by its hash, a later one by a hash of it and the number.

    Sorting (hash, place) brings occurrences together in text order, and most texts
    have few k-mers twice, so only the later occurrences are hashed and sorted again.
    """
    packed = F.sort_array(F.transform(hashes, kind.make))

    def number(s: Column) -> Column:
        same = lambda i: (i > 0) & (kind.hash(s[i]) == kind.hash(s[F.greatest(i - 1, F.lit(0))]))
        more = F.filter(F.sequence(F.lit(0), F.size(s) - 1), same)

        def renumber(d: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda t: (t == 0) | (d[F.greatest(t - 1, F.lit(0))] != d[t] - 1))

            def runs(h: Column) -> Column:
                def run(t: Column, r: Column) -> Column:
                    stop = F.coalesce(F.get(h, r + 1), F.size(d))
                    return F.transform(F.sequence(t, stop - 1), lambda u: kind.again(s[d[u]], u - t + 1))

                return F.flatten(F.transform(h, run))

            first = F.filter(s, lambda x, i: ~same(i))
            return F.sort_array(F.concat(first, _let(starts, runs)))

        return _let(more, lambda d: F.when(F.size(d) == 0, s).otherwise(renumber(d)))

    return _let(packed, number)


def _signature(elements: Column, sketches: int, width: int, kind=_Packed) -> Column:
    """Four hex digits a sketch, from the sorted elements of a text that has some.

    In the order of sketch j come first the elements whose upper bits are j, by their
    hashes, then those of the other upper bits, the nearest by exclusive or first; so
    the ``width`` smallest of each upper-bits value hold those of every order.
    """
    shift = 64 - (sketches.bit_length() - 1)
    upper = lambda x: F.shiftright(kind.hash(x), shift)

    def pick(s: Column) -> Column:
        chosen = F.filter(s, lambda x, i: (i < width) | (upper(s[F.greatest(i - width, F.lit(0))]) != upper(x)))

        def sign(c: Column, bins: Column) -> Column:
            def one(j: Column) -> Column:
                at = F.array_position(bins, j).cast("int")
                full = (at > 0) & F.coalesce(F.get(bins, at + width - 2) == j, F.lit(False))
                key = F.shiftleft(j, shift).bitwiseXOR(F.lit(-(1 << 63)))
                near = F.transform(F.slice(F.sort_array(F.transform(c, lambda x: kind.turned(x, key))), F.lit(1), F.lit(width)), lambda x: kind.turned(x, key))
                ordered = F.sort_array(F.transform(F.when(full, F.slice(c, at, F.lit(width))).otherwise(near), kind.placed))
                digits = F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(F.transform(ordered, kind.value)), 48)), len(_EMPTY), "0"))
                return F.when(digits == _EMPTY, F.lit("0001")).otherwise(digits)

            numbers = F.array(*[F.lit(j - sketches // 2).cast("long") for j in range(sketches)])
            return F.array_join(F.transform(numbers, one), "")

        return _let(chosen, lambda c: _let(F.transform(c, upper), lambda bins: sign(c, bins)))

    return _let(elements, pick)


def fingerprint(text: Column, k: int = K, sketches: int = SKETCHES, width: int = TUPLE, packed: int = _LOW) -> Column:
    """The Order MinHash fingerprint of ``text`` as a hex string (null: empty; without a word: zeros).

    Elements of texts of up to ``packed`` k-mers are held as longs, those of longer
    ones as structs; the fingerprint is the same.
    """

    def of(h: Column) -> Column:
        by = lambda kind: _signature(_numbered(h, kind), sketches, width, kind)
        return F.when(F.size(h) == 0, F.lit(_EMPTY * sketches)).when(F.size(h) <= packed, by(_Packed)).otherwise(by(_Wide))

    return _let(_hashes(F.coalesce(text, F.lit("")), k), of)


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """Share of the sketches that agree; 1 for equal fingerprints, 0 beside a text without a word."""
    n = len(_EMPTY)
    same = F.filter(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda i: F.substring(a, i * n + 1, F.lit(n)) == F.substring(b, i * n + 1, F.lit(n)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.lit(sketches))


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below the value, looked up in two steps of about sqrt(n).

    The cuts stand in the plan as two literals, however many they are.
    """
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    text = lambda xs: ",".join(map(str, xs))
    lasts = F.split(F.lit(text(g[-1] for g in groups)), ",").cast("array<bigint>")
    inner = F.transform(F.split(F.lit(";".join(map(text, groups))), ";"), lambda g: F.split(g, ",").cast("array<bigint>"))
    whole = F.size(F.filter(lasts, lambda c: c < value))

    def within(k: Column) -> Column:
        return k * step + F.size(F.filter(F.element_at(inner, k + 1), lambda c: c < value))

    return F.when(whole == len(groups), F.lit(len(cuts))).otherwise(_let(whole, within))


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(bucket, nth, ghost, id, text, next_text)``: each document beside the next by id, the last beside the first.

    Ids are cut into buckets of about equally many rows, a few for each shuffle
    partition, at quantiles (a list of that length on the driver), so one exchange
    puts neighbours together.  The first document of a bucket is also sent to the
    bucket before it, marked ``ghost``, as what follows there; the first of all
    follows the last.  Null ids come after all others, by a hash of their text, and
    their buckets are ranges of it; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    n = BUCKETS * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("id", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("turn"), "text")
    seen = base.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("q"), F.count_if(F.col("id").isNull()).alias("void")).first()
    cuts = sorted(set(seen["q"] or [0]))
    bits = min(20, (seen["void"] // VOID_ROWS).bit_length())
    void = F.shiftright("turn", 64 - bits) + (1 << bits - 1) if bits else F.lit(0)
    base = base.withColumn("bucket", F.when(F.col("id").isNull(), len(cuts) + 1 + void).otherwise(_place(F.col("id"), cuts)).cast("int"))
    least = F.min(F.struct(F.coalesce("id", "turn").alias("at")))
    firsts = sorted((r["bucket"], r["f"]["at"]) for r in base.groupBy("bucket").agg(least.alias("f")).collect()) or [(0, 0)]
    rows = json.dumps([{"b": b, "i": i, "p": firsts[k - 1][0]} for k, (b, i) in enumerate(firsts)])
    lead = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<b: int, i: bigint, p: int>>"))))  # a row a bucket
    placed = base.join(lead, (base["bucket"] == lead["b"]) & (F.coalesce(base["id"], base["turn"]) == lead["i"]), "left")
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("ghost"))
    also = F.struct(F.col("p").alias("at"), F.lit(1).alias("ghost"))
    spread = placed.select("id", "turn", "text", F.explode(F.when(F.col("p").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("to"))
    spread = spread.select(F.col("to.at").alias("bucket"), F.col("to.ghost").alias("ghost"), "id", "turn", "text")
    line = Window.partitionBy("bucket").orderBy("ghost", "id", "turn", "text")
    return spread.select("bucket", "ghost", "id", "text", F.row_number().over(line).alias("nth"), F.lead("text").over(line).alias("next_text"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edit; see ``op7_order_minhash`` for the columns.

    The edit replaces the last floor(n / 2) code points by the first as many (or
    all) of the next document.  Null texts count as empty; an empty text's
    fingerprint is all zeros.  A single document is its own next one.  Repeated rows
    come back repeated, ordered by text; an empty table gives no row.
    """
    pairs = beside_next(docs, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    real = F.col("ghost") == 0
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    texts = pairs.select("bucket", "nth", "ghost", "id", "text", F.when(real, changed).alias("edited"))
    prints = texts.select(
        "bucket", "nth", "ghost", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        F.when(real, fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("nth"))
    both = prints.select("*", following.alias("next_fingerprint")).where(real)
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7_order_minhash(spark, sf_dir):
    """Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty and have fingerprint zeros; texts of any length are
    fingerprinted whole; equal ids are ordered by text and null ids come last by a hash
    of theirs; repeated rows come back repeated; an empty table gives no row; other
    columns are not read.
    """
    return edited_fingerprints(documents(spark, sf_dir))
