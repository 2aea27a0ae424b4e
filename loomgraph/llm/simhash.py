"""SimHash fingerprints and their exact Hamming join by pivot distance tables."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import components, cut, documents, rows_without
from loomgraph.session import shuffles_freed

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Reference fingerprints: zero, and one mask for each pair of neighbouring bits.
PIVOTS = [0, *[3 << (2 * j) for j in range(32)]]
#: Coordinates are dealt into this many groups; all but DISTANCE of them agree in a linked pair.
GROUPS = 5
#: A larger bucket is resolved by shared midpoints instead of pairs.
BUCKET = 48
_BLOCK = 1 << 16
#: Near copies: words in a shingle, least similarity of the shingle sets, and the share of pairs at that similarity that tables are drawn for.
NEAR_SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.98
#: Bits of a wide fingerprint, most that two near copies differ in (2.1 standard deviations over what SIMILARITY makes expect),
#: and references that every bucket's neighbours are compared by.
WIDE, WIDE_DISTANCE = 128, 28
WIDE_PIVOTS = [0, (1 << 128) // 3, (1 << 128) // 15 * 3, (1 << 64) - 1]
#: Neighbours in a bucket's order that a member meets.
NEIGHBOURS = 24
#: Coordinates that the tables of each further level have more than their number of classes asks for: classes of full buckets are split by them.
LEVELS = (6, 12)
#: Pairs for each of the first pairs up to which all are verified at once.
SPARSE = 4
#: Exact way for what buckets leave out: texts whose shingles are counted for their order (which changes no result), most shingles in that
#: order's list, classes that may share a leading shingle and be paired one by one, and classes and shingles in a block of a larger family.
COUNTED, LISTED, FEW = 1 << 13, 1 << 18, 48
FAMILY_ROWS, FAMILY_SHINGLES = 1 << 10, 1 << 20
#: Most classes whose keys are sent to the texts rather than the texts dealt to them.
SENT = 1 << 18
#: The table of repeated shingles: text bytes for each of its bits, the power of two that has the most bits (128 MB), parts that it is made in, and shingles that a task sorts at once.
TABLE_BYTES, MOST_BITS, TABLE_PARTS, SORTED = 8, 30, 1 << 7, 1 << 21
#: Share of its shingles that a text sends beyond the leading ones where the table would be too full: near copies then share as many more.
BEYOND = 1 / 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The 64-bit SimHash of a whole text, big-endian; null and wordless texts give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    pairs = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(pairs), _BLOCK):
        part = b"".join([digest(joined[s:e], seed) for s, e in pairs[at : at + _BLOCK]])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(pairs)).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, mark, fingerprint, fp)``: the hex digits, the same bits as a long, and a hash of the raw text."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([p.hex() for p in prints]), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))],
                names=["id", "mark", "fingerprint", "fp"],
            )

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id long, mark long, fingerprint string, fp long")


def distance_row(fp: Column) -> Column:
    """Hamming distances of ``fp`` to every reference fingerprint."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in _signed(PIVOTS)])


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _bucket_rows(prints: DataFrame) -> DataFrame:
    """``(key, fp)``: one key for each choice of GROUPS - DISTANCE coordinate groups.

    ``(d(x, 0) - d(x, mask) + 2) / 2`` is the number of bits set under the mask, so
    a changed bit moves one coordinate, and two changed bits leave at least
    GROUPS - DISTANCE groups as they were.
    """
    masks = np.array(PIVOTS, np.uint64)
    choices = list(combinations(range(GROUPS), GROUPS - DISTANCE))

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64)
            if not len(fp):
                continue
            table = np.bitwise_count(fp.view(np.uint64)[:, None] ^ masks[None, :]).astype(np.int64)
            coords = (table[:, :1] - table[:, 1:] + 2) // 2
            parts, sizes = [], []
            for g in range(GROUPS):
                member = coords[:, g::GROUPS]
                parts.append(member @ 3 ** np.arange(member.shape[1]))
                sizes.append(3 ** member.shape[1])
            for n, chosen in enumerate(choices):
                key = np.full(len(fp), n, np.int64)
                for g in chosen:
                    key = key * sizes[g] + parts[g]
                yield pa.record_batch([pa.array(key), pa.array(fp)], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of "differ in at most two bits".

    ``prints(fp)`` are distinct.  Buckets of up to ``bucket`` fingerprints are
    paired: pairs whose pivot distances differ by more than two in some coordinate
    are discarded, the rest verified bit by bit.  Members of a larger bucket are
    tied through every value within one bit of them, since two fingerprints differ
    in at most two bits exactly if they share such a midpoint: work stays in
    proportion to the members and no link is lost.
    """
    keyed = _bucket_rows(prints)
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(crowd, "key"))
    few = shared.where(F.col("n") <= bucket).select("key", "fp", distance_row(F.col("fp")).alias("d"))
    a, b = few.alias("a"), few.alias("b")
    near = F.forall(F.zip_with("a.d", "b.d", lambda x, y: F.abs(x - y)), lambda x: x <= DISTANCE)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(near).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE)
    found = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x) for x in _signed([1 << i for i in range(64)])])
    mids = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    lead = mids.groupBy("mid").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    tied = mids.join(lead, "mid").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return found.union(tied).distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, mark, fingerprint, component_id)`` for every row of ``docs``.

    Rows with equal fingerprints form one class before any join, so copies cost
    one row.  ``component_id`` is the smallest non-null key reachable (null if a
    component has null keys only).  Null and empty texts share the zero
    fingerprint.  Repeated rows come back repeated; an empty table gives no row.
    """
    rows = cut(fingerprints(docs, key, text))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(classes.select("fp")))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    member = placed.join(least, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("id", "mark", "fingerprint", "component_id")


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted 64-bit digests of the different word shingles of a whole text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    each = (digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.unique(np.fromiter(each, np.uint64, len(words) - k + 1))


def _set_mark(held: np.ndarray) -> int:
    """One signed number for a set of shingles; the empty set has zero."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).astype(np.int64)) if len(held) else 0


def wide_fingerprint(held: np.ndarray) -> bytes:
    """The SimHash of a set of shingle digests over WIDE bits; each digest's bits and those of a mix of it vote."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(held), _BLOCK):
        part = held[at : at + _BLOCK]
        mixed = part * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.unpackbits(np.stack((part, mixed ^ (mixed >> np.uint64(32))), axis=1).astype(">u8").view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(held)).tobytes()


def _slices(batches, rows: int = 500):
    """The batches in pieces of so many rows, so that a worker turns few texts and sets into objects at once; what Arrow has left goes back at the end."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))
    pa.default_memory_pool().release_unused()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def coordinate_tables(rows: int, least: float = SIMILARITY, recall: float = RECALL, further: int = 0) -> list[np.ndarray]:
    """The reference bits of each table for a corpus of so many different texts.

    A coordinate is a text's distance to a single-bit reference less that to zero, which
    is one of its bits.  Sets of similarity ``least`` have vectors at an angle whose
    share of a half turn is the share of bits that differ.  A table takes so many
    coordinates that few texts agree in all by chance, and there are so many tables
    that pairs of that similarity agree in one with probability ``recall``.  ``further``
    coordinates make smaller buckets, in other and more tables.
    """
    agree = 1 - math.acos(2 * least / (1 + least)) / math.pi
    width = min(40, max(10, math.ceil(math.log2(max(2, rows))) - 3) + further)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    rng = np.random.default_rng(SEED + further)
    return [np.sort(rng.permutation(WIDE)[:width]) for _ in range(tables)]


def near_pairs(classes: DataFrame, tables: list[np.ndarray], distance: int = WIDE_DISTANCE, neighbours: int = NEIGHBOURS, marks: bool = False) -> DataFrame:
    """``(u, v, bits)``: pairs, u < v, of ``classes(fp, high, low, root)`` at most ``distance`` bits apart that agree in a table, of different roots.

    Within a bucket, classes stand in the order of their bits, and each meets those
    just before it: all pairs of a usual bucket.  In the bucket of a large family of copies,
    each keeps the closest of the ``neighbours`` before it and the bucket's first: a chain and a star in
    each table, and work proportional to the members.  Pairs whose distances to some reference differ by
    more than ``distance`` are discarded, and the bits of the others are compared.  With ``marks``, a class that
    stood in a bucket too large for all its pairs comes with itself, as a pair with u = v.
    """
    halves = [(p >> 64, p & (1 << 64) - 1) for p in WIDE_PIVOTS]

    def run(batches):
        spots = [(t // 8, (7 - t % 8).astype(np.uint8)) for t in tables]
        for b in batches:
            fp, high, low, root = (np.asarray(c).astype(np.int64) for c in b.columns)
            if not len(fp):
                continue
            raw = np.stack((high, low), axis=1).astype(">i8").view(np.uint8).reshape(-1, WIDE // 8)
            h, w = high.view(np.uint64), low.view(np.uint64)
            d = np.zeros(len(fp), np.int64)
            for x, y in halves:
                d = d << 8 | (np.bitwise_count(h ^ np.uint64(x)).astype(np.int64) + np.bitwise_count(w ^ np.uint64(y)))
            for n, (byte, shift) in enumerate(spots):
                key = np.zeros(len(fp), np.uint64)
                for c, t in zip(byte, shift):
                    key = key << np.uint64(1) | (raw[:, c] >> t & 1).astype(np.uint64)
                key = (key | np.uint64(n) << np.uint64(40)).view(np.int64)
                yield pa.record_batch([pa.array(x) for x in (key, fp, high, low, root, d)], names=["key", "fp", "high", "low", "root", "d"])

    keyed = classes.select("fp", "high", "low", "root").mapInArrow(run, "key long, fp long, high long, low long, root long, d long")
    line = Window.partitionBy("key").orderBy("high", "low", "fp")
    own = F.struct("fp", "high", "low", "root", "d")
    crowded = F.count("*").over(line.rowsBetween(-neighbours - 1, neighbours + 1)) > neighbours + 1 if marks else F.lit(False)
    met = keyed.select("fp", "high", "low", "root", "d", crowded.alias("crowded"), F.collect_list(own).over(line.rowsBetween(-neighbours, -1)).alias("met"), F.first(own).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("head"))

    def bits(x: Column) -> Column:
        return F.bit_count(x["high"].bitwiseXOR(F.col("high"))) + F.bit_count(x["low"].bitwiseXOR(F.col("low")))

    def close(x: Column) -> Column:
        near = bits(x) <= distance
        for k in range(len(halves)):
            at = lambda d: F.shiftright(d, 8 * k).bitwiseAND(F.lit(255))  # noqa: B023, E731
            near = (F.abs(at(x["d"]) - at(F.col("d"))) <= distance) & near
        return near & (x["root"] != F.col("root"))

    linked = lambda xs: F.transform(F.filter(xs, close), lambda x: F.struct(bits(x).alias("bits"), x["fp"].alias("fp")))
    full = F.size("met") == neighbours
    some = met.where("size(met) > 0 OR crowded").select("fp", "crowded", full.alias("full"), linked(F.col("met")).alias("linked"), F.when(full, linked(F.array("head"))).alias("first"))
    found = some.where((F.size("linked") > 0) | F.coalesce(F.size("first") > 0, F.lit(False)) | F.col("crowded"))
    some = F.when(F.col("full"), F.array_union(F.slice(F.array_sort("linked"), 1, 1), F.col("first"))).otherwise(F.col("linked"))
    itself = F.array(F.struct(F.lit(0).alias("bits"), F.col("fp").alias("fp")))
    pairs = found.select("fp", F.explode(F.when(F.col("crowded"), F.array_union(some, itself)).otherwise(some)).alias("x"))
    return pairs.select(F.least("fp", "x.fp").alias("u"), F.greatest("fp", "x.fp").alias("v"), F.col("x.bits").alias("bits")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float, share: int = 32) -> DataFrame:
    """The pairs whose shingle sets, ``sets(fp, held)``, have at least the similarity; a set that very many pairs need is dealt out in copies."""

    def run(batches):
        for b in _slices(batches):
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    for end in ("u", "v"):
        copies = pairs.groupBy(end).agg(F.ceil(F.count("*") / share).cast("int").alias("copies"))
        some = copies.join(sets, F.col(end) == sets.fp).select(F.col(end), "copies", F.col("held").alias(f"{end}_held"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        other = "v" if end == "u" else "u"
        wanted = pairs.join(copies, end).withColumn("copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
        pairs = wanted.join(some.drop("copies"), [end, "copy"]).drop("copy")
    return pairs.select("u", "v", "u_held", "v_held").mapInArrow(run, "u long, v long")


def first_pairs(pairs: DataFrame) -> DataFrame:
    """``(u, v)``: each class's closest of ``pairs(u, v, bits)`` and the one with the smallest class, two for a class at most."""
    ends = pairs.select(F.col("u").alias("c"), F.col("v").alias("o"), "bits", "u", "v").union(pairs.select("v", "u", "bits", "u", "v"))
    best = ends.groupBy("c").agg(F.min(F.struct("bits", "o", "u", "v")).alias("x"), F.min(F.struct("o", "bits", "u", "v")).alias("y"))
    return cut(best.select(F.explode(F.array(F.struct("x.u", "x.v"), F.struct("y.u", "y.v"))).alias("b")).select("b.u", "b.v").distinct())


def joined(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY, sparse: int = SPARSE) -> DataFrame:
    """Verified pairs that have the components of all of ``pairs(u, v, bits)`` with at least the similarity.

    Pairs inside a component add nothing, so a large family of copies needs few of its
    many pairs: each class's closest pair and the one with the smallest class are verified first,
    then all pairs that are still between components.  With at most ``sparse`` pairs for each of the
    first ones, all are verified at once.
    """
    best = first_pairs(pairs)
    if pairs.count() <= sparse * best.count():
        return _verified(pairs.select("u", "v"), sets, least)
    found = cut(_verified(best, sets, least))
    roots = components(found)
    a, b = roots.select(F.col("node").alias("u"), F.col("root").alias("a")), roots.select(F.col("node").alias("v"), F.col("root").alias("b"))
    apart = pairs.select("u", "v").join(best, ["u", "v"], "left_anti").join(a, "u", "left").join(b, "v", "left")
    apart = cut(apart.where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v"))
    return found.unionByName(_verified(apart, sets, least))


def _packed(spots: np.ndarray) -> bytes:
    """Ascending numbers as their steps, a byte each; 255 goes on in the byte that follows."""
    steps = np.diff(spots, prepend=0)
    out = np.full(len(steps) + int((steps // 255).sum()), 255, np.uint8)
    out[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def repeated_shingles(texts: DataFrame, bits: int, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """A table of 2 ** ``bits`` bits: set where the upper bits of shingles of ``texts(text)`` meet more than once, in two texts or by chance.

    A task sends the spots of its shingles in order, about a byte each; each part of the table is made in one group.
    """
    wide = (1 << bits) // TABLE_PARTS

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        flat, rows = np.concatenate(held), []
        flat.sort()
        ends = np.searchsorted(flat, np.arange(TABLE_PARTS) * wide).tolist()
        for k, (a, b) in enumerate(zip(ends, [*ends[1:], len(flat)])):
            if b > a:
                every, n = np.unique(flat[a:b].astype(np.int64) - k * wide, return_counts=True)
                rows += [(k, False, _packed(every)), (k, True, _packed(every[n > 1]))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "often", "spots"])

    def spots(batches):
        held, n = [], 0
        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                held.append((shingles(t, shingle) >> np.uint64(64 - bits)).astype(np.uint32))
                n += len(held[-1])
                if n >= SORTED:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def merged(table):
        seen, twice = np.zeros(wide, bool), np.zeros(wide, bool)
        for often, raw in zip(table["often"].to_pylist(), table["spots"].to_pylist()):
            at = _unpacked(raw)
            twice[at] |= often | seen[at]
            seen[at] = True
        return pa.table({"part": table["part"].slice(0, 1), "twice": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    out = np.zeros((TABLE_PARTS, wide // 8), np.uint8)
    made = texts.select("text").mapInArrow(spots, "part int, often boolean, spots binary").groupBy("part").applyInArrow(merged, "part int, twice binary").toArrow()
    for part, twice in zip(made["part"].to_pylist(), made["twice"]):
        out[part] = np.frombuffer(twice.as_buffer(), np.uint8)
    return out.ravel()


def stand_alone(held: list[np.ndarray], table: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For each set, whether so few of its shingles are repeated, by the ``repeated_shingles``, that no other set has the similarity."""
    size = np.array([len(h) for h in held], np.int64)
    spot = (np.concatenate([np.empty(0, np.uint64), *held]) >> np.uint64(64 - (8 * len(table) - 1).bit_length())).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(table[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1, dtype=np.int64)))
    last = np.cumsum(size)
    return ends[last] - ends[last - size] < np.ceil(least * size - 1e-9)


def meeting_classes(texts: DataFrame, shingle: int = NEAR_SHINGLE, least: float = SIMILARITY, beyond: float = BEYOND) -> DataFrame:
    """``(fp)``: the classes of ``texts(text)``, by the mark of their set, that share so many leading shingles with others that one may have the similarity.

    For texts of any size: shingles are dealt to tasks and no table of them is held.  With ``beyond`` * n more shingles a set of n
    sends, the common part has as many more of its first ones in what both sets send.  A set that lies in several tasks
    counts in each, so that more classes than needed may come, but none is left out.
    """

    def each(batches):
        for b in _slices(batches):
            yield pa.record_batch([pa.array([shingles(t, shingle).tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["held"])

    def lead(batches):
        (common, count), seen = listed.value, set()
        for b in _slices(batches):
            new = {_set_mark(h): h for h in (shingles(t, shingle) for t in b.column(0).to_pylist())}
            new = {fp: h for fp, h in new.items() if fp not in seen}
            seen.update(new)
            first = [np.empty(0, np.uint64), *(leading_shingles(h, common, count, least, beyond) for h in new.values())]
            spread = np.array([len(f) for f in first[1:]], np.int64)
            fp, size = np.array([*new], np.int64), np.array([len(h) for h in new.values()], np.int32)
            yield pa.record_batch([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(fp, spread)), pa.array(np.repeat(size, spread))], names=["shingle", "fp", "size"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 + texts.count() // COUNTED)) == 0)
    listed = texts.sparkSession.sparkContext.broadcast(_common_shingles(some.select("text").mapInArrow(each, "held binary")))
    line = Window.partitionBy("shingle")
    sent = texts.select("text").mapInArrow(lead, "shingle long, fp long, size int")
    shared = sent.withColumn("low", F.min("fp").over(line)).withColumn("high", F.max("fp").over(line)).where("low < high")
    wanted = 1 + F.floor(F.ceil(F.col("size") * F.lit(least) - 1e-9) * F.lit(beyond))
    return shared.groupBy("fp").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(F.col("n") >= wanted).select("fp")


def wide_fingerprints(sets: DataFrame) -> DataFrame:
    """``(fp, high, low)``: the two halves of the wide fingerprint of each of ``sets(fp, held)``."""

    def run(batches):
        for b in _slices(batches):
            bits = np.frombuffer(b"".join(wide_fingerprint(np.frombuffer(h, np.uint64)) for h in b.column(1).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["fp", "high", "low"])

    return sets.select("fp", "held").mapInArrow(run, "fp long, high long, low long")


def _common_shingles(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many of ``some(held)`` have, and their counts; they only say in which order a set's shingles stand, so a share of a corpus will do."""

    def each(batches):
        for b in _slices(batches):
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], names=["shingle"])

    often = some.select("held").mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 4").orderBy(F.desc("n"), "shingle").limit(LISTED).toArrow()
    shingle, n = (np.asarray(often[c]).astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], n[order]


def leading_shingles(held: np.ndarray, common: np.ndarray, count: np.ndarray, least: float = SIMILARITY, beyond: float = 0) -> np.ndarray:
    """The first shingles of a sorted set, rare ones first: two sets of at least the similarity share one of them.

    The common part has at least ``least`` times the shingles of either set, so it can't lie in what follows them.  With
    ``beyond`` times its shingles more from each, they share one and ``beyond`` times the smaller set's more.
    """
    keep = len(held) - math.ceil(least * len(held) - 1e-9) + 1 + math.floor(beyond * len(held)) if len(held) else 0
    heat = np.zeros(len(held), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        heat[common[at] == held] = count[at][common[at] == held]
    return held[np.argsort(heat, kind="stable")[:keep]]


def family_links(fps: list[int], roots: list[int], sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of at least the similarity that have the components of all such pairs of different roots; one less than the sets at most.

    Shared shingles are counted by an index of the sets' shingles; sets of the most frequent root are not compared with each other.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, spot, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(spot, kind="stable")]
    first, ends = np.cumsum(often) - often, np.cumsum(sizes)
    names, group = np.unique(np.array(roots, np.int64), return_inverse=True)
    main, found = np.bincount(group).argmax(), []
    for i in np.flatnonzero(group != main).tolist():
        mine = spot[ends[i] - sizes[i] : ends[i]]
        n = often[mine]
        both = np.bincount(owner[np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero((both >= least * (sizes + sizes[i] - both) - 1e-9) & (group != group[i]))
        for j in near.tolist():
            if group[j] != group[i] and both[j] / (sizes[i] + sizes[j] - both[j]) >= least:
                found.append((fps[i], fps[j]))
                group[group == group[j]] = group[i]
    return found


def _family_edges(members: DataFrame, held: DataFrame, least: float, rows: int = FAMILY_ROWS, weight: int = FAMILY_SHINGLES) -> DataFrame:
    """Links within the families of ``members(fp, root, size, family)``: each is cut into blocks, and every two blocks meet in a group."""

    def compare(table):
        held = [np.frombuffer(h, np.uint64) for h in table["held"].to_pylist()]
        found = family_links(table["fp"].to_pylist(), table["root"].to_pylist(), held, least)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("size") / weight)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "family").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") > 1, F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("b"))).otherwise(F.array(F.lit(0)))
    filled = dealt.join(held, "fp").select("fp", "root", "held", "family", "b", F.explode(others).alias("o"))
    return filled.groupBy("family", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).applyInArrow(compare, "u long, v long")


def missing_links(sets: DataFrame, roots: DataFrame, least: float = SIMILARITY, few: int = FEW) -> DataFrame:
    """``(u, v)``: links that join the classes of ``sets(fp, held)`` into the components of all pairs of at least the similarity.

    ``roots(node, root)`` tells what is linked so far; every link between two of its components is
    found, whatever the fingerprints say.  Two such classes share one of their leading shingles.  Classes that share one
    with at most ``few`` are paired, and verified if they share enough of them; those of larger groups make families, in which blocks meet blocks, and
    only merges leave a task.  The shingles of a share of the sets are counted to put frequent ones last.
    """
    some = sets.where(F.pmod(F.xxhash64("fp"), F.lit(1 + sets.count() // COUNTED)) == 0)
    listed = sets.sparkSession.sparkContext.broadcast(_common_shingles(some))

    def lead(batches):
        common, count = listed.value
        for b in _slices(batches):
            held = [np.frombuffer(h, np.uint64) for h in b.column(1).to_pylist()]
            first = [leading_shingles(h, common, count, least) for h in held]
            spread = np.array([len(f) for f in first], np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)
            fp, size = np.asarray(b.column(0)).astype(np.int64), np.array([len(h) for h in held], np.int32)
            yield pa.record_batch([pa.array(flat), pa.array(np.repeat(fp, spread)), pa.array(np.repeat(size, spread))], names=["shingle", "fp", "size"])

    leading = sets.select("fp", "held").mapInArrow(lead, "shingle long, fp long, size int")
    shared = leading.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).where("n > 1")
    shared = cut(shared.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    apart = shared.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("fp").alias("v")).where("low < high").select("shingle", "v")
    apart = cut(shared.join(apart, "shingle"))
    crowd = apart.where(F.col("n") > few)
    families = components(crowd.select(F.col("fp").alias("u"), "v")).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    families = cut(families)
    members = crowd.select("fp", "root", "size").distinct().join(families, "fp")
    within = _family_edges(members, sets, least)
    one = apart.where(F.col("n") <= few).join(families, "fp", "left").select("shingle", "fp", "root", "size", "family")
    a, b = one.alias("a"), one.alias("b")
    unlike = (F.col("a.fp") < F.col("b.fp")) & (F.col("a.root") != F.col("b.root")) & ~F.coalesce(F.col("a.family") == F.col("b.family"), F.lit(False))
    sized = F.least("a.size", "b.size") >= least * F.greatest("a.size", "b.size") - 1e-9
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & unlike & sized).groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    met = met.agg(F.count("*").alias("both"), F.max("a.size").alias("x"), F.max("b.size").alias("y"))
    behind = F.ceil(F.greatest("x", "y") * F.lit(least) - 1e-9) - 1  # shingles of the longer one that do not lead, the most that the leading ones leave out
    pairs = cut(met.where(F.col("both") + behind >= least / (1 + least) * (F.col("x") + F.col("y")) - 1e-6).select("u", "v"))
    return within.unionByName(_verified(pairs, sets, least))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, least: float = SIMILARITY, neighbours: int = NEIGHBOURS,
                    distance: int = WIDE_DISTANCE, recall: float = RECALL, levels=(), whole: bool = False) -> DataFrame:
    """``(id, mark, component_id)`` for every row; rows whose shingle sets have at least the similarity ``least`` are linked.

    Rows with equal sets form one class before any join.  Wide SimHash fingerprints find candidates
    by their coordinates, exact similarity decides; texts are read again only for classes that are in a
    candidate pair.  A pair of just the similarity ``least`` meets in a table with probability ``recall``, and is a
    candidate if at most ``distance`` bits differ: larger values of both lose fewer links, for more
    tables and pairs.  Classes of buckets with more than ``neighbours`` members meet again in tables of
    further coordinates, at each of ``levels`` if any are given (``LEVELS`` are made for it), where only pairs that nothing has linked so far count.  With ``whole`` no link is lost: classes
    that ``stand_alone`` for their shingles, or where that table would be too full are not among the ``meeting_classes``, are out, of the candidates among the others only each class's first pairs are verified, and ``missing_links`` finds all links between the components that they leave,
    by shared shingles, whatever buckets, bits and tables left out.  ``component_id`` is the smallest non-null key reachable.  Texts
    without a word are equal.  Repeated rows come back repeated; an empty table gives no row.
    """

    plain, table, meeting = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), None, None
    if whole:
        n_bytes = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        bits = max(20, (n_bytes // TABLE_BYTES).bit_length())
        if bits <= MOST_BITS:
            table = docs.sparkSession.sparkContext.broadcast(repeated_shingles(plain, bits, shingle))
        else:
            meeting = cut(meeting_classes(plain, shingle, least))
    later = meeting is not None  # fingerprints are made of the sets, when those that meet are known

    def alone(held: list[np.ndarray]) -> np.ndarray:
        return stand_alone(held, table.value, least) if table else np.zeros(len(held), bool)

    def sign(batches):
        for b in _slices(batches):
            held = [shingles(t, shingle) for t in b.column(2).to_pylist()]
            single = alone(held) | later
            bits = np.frombuffer(b"".join(bytes(WIDE // 8) if x else wide_fingerprint(h) for h, x in zip(held, single)), ">i8").astype(np.int64).reshape(-1, 2)
            marks = pa.array([_set_mark(h) for h in held], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), marks, pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(single)], names=["id", "mark", "fp", "high", "low", "alone"])

    def measure(batches):
        for b in _slices(batches):
            held = [shingles(t, shingle) for t in b.column(0).to_pylist()]
            held = [h for h, x in zip(held, alone(held)) if not x]
            yield pa.record_batch([pa.array([_set_mark(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], names=["fp", "held"])

    def held_by(needed: DataFrame) -> DataFrame:
        """``(fp, held)`` once for each of the classes ``needed(fp)``, whose texts are read again."""
        first = cut(classes.join(needed, "fp", "left_semi").select(F.col("w.id").alias("i"), F.col("w.mark").alias("m")))
        few = first.count() <= SENT
        same = F.col("id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("m"))
        texts = plain if table and not few else plain.join(F.broadcast(first) if few else first, same, "left_semi")  # of all texts, those that stand alone have no set
        return cut(texts.select("text").mapInArrow(measure, "fp long, held binary").dropDuplicates(["fp"]))

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    rows = cut(narrow.mapInArrow(sign, "id long, mark long, fp long, high long, low long, alone boolean"))
    first = [F.first(c).alias(c) for c in ("high", "low", "alone")]
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("lowest"), F.min(F.struct("id", "mark")).alias("w"), *first))
    if later:
        sets = held_by(meeting)
        some = cut(wide_fingerprints(sets))
    else:
        some = classes.where("NOT alone")
    pairs = cut(near_pairs(some.withColumn("root", F.col("fp")), coordinate_tables(some.count(), least, recall), distance, neighbours, bool(levels)))
    if whole:
        sets = sets if later else held_by(some.select("fp"))
        linked = cut(_verified(first_pairs(pairs.where("u < v")), sets, least))
    else:
        sets = held_by(ends_of(pairs))  # members of full buckets among them
        linked = cut(joined(pairs.where("u < v"), sets, least))
    for further in () if whole else levels:
        crowded = pairs.where("u = v").select(F.col("u").alias("fp"))
        n = crowded.count()
        if not n:
            break
        roots = components(linked).select(F.col("node").alias("fp"), F.col("root").alias("found"))
        members = classes.join(crowded, "fp", "left_semi").join(roots, "fp", "left")
        members = cut(members.select("fp", "high", "low", F.coalesce("found", "fp").alias("root")))
        pairs = cut(near_pairs(members, coordinate_tables(n, least, recall, further), distance, neighbours, True))
        linked = cut(linked.unionByName(joined(pairs.where("u < v"), sets, least)))
    roots = components(linked)
    if whole:
        more = cut(missing_links(sets, roots, least))
        if not more.isEmpty():  # each class is tied to its root: few rounds are left
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("lowest").alias("component_id"))
    member = placed.join(low, "root").select("fp", "component_id")
    return rows.select("id", "mark", "fp").join(member, "fp").select("id", "mark", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, least: float = SIMILARITY, **options) -> DataFrame:
    """One row of each component of near copies, the one with the smallest key (null last); columns unchanged.

    Null and empty texts have no word and are equal; long texts are read whole; of equal keys the smallest hash of the
    text stays, of repeated rows one; an empty table gives an empty table.  Every link counts; ``options`` are those of ``near_components``.
    """
    with shuffles_freed(docs.sparkSession):
        found = cut(near_components(docs, key, text, shingle, least, **{"whole": True} | options))
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min(F.struct("id", "mark")).alias("w"))
    f, w = found.alias("f"), first.alias("w")
    marked = f.join(w, F.col("f.component_id").eqNullSafe(F.col("w.component_id"))).select("f.id", "f.mark", F.struct("f.id", "f.mark").eqNullSafe(F.col("w.w")).alias("stays"))
    return rows_without(docs, marked, {"id": F.col(key).cast("long"), "mark": F.xxhash64(F.col(text))}, text)


def op5_simhash_components(spark, sf_dir):
    """Columns: doc_id, fingerprint, component_id, one row for each row of ``documents``.

    Null and empty texts have fingerprint zero and are linked like any other; very
    long texts are read whole; ties and repeated rows come back each; an empty table
    gives no row; other columns are not read.
    """
    found = simhash_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
