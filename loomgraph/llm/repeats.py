"""Removal of passages that repeat across documents, by suffix sorting.

Every 50-byte string has one anchor: its 12-byte word with the smallest hash.  Equal strings have equal anchors, so only strings whose
anchor occurs in two documents can repeat.  Those are gathered by anchor and their
suffixes sorted, which puts equal strings side by side.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import documents

LENGTH = 50
ANCHOR = 12
#: Half of what an anchor leaves of a string: a string has this many bytes to the left or to the right of it.
CONTEXT = (LENGTH - ANCHOR) // 2
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 16
#: Most bits of the table of anchors that occur twice (256 MB); it has one for every ten text bytes up to that.
#: A collision only costs work.
MOST_BITS = 31
#: Text bytes for each part that anchors and strings are gathered in.
PART_BYTES = 6 << 20
_CHUNK = 24 << 20
#: Bytes of short texts that are looked at together.
_BLOCK = 1 << 17
_OTHER = (1 << 63) - 1
#: Marks the size of a content that one flush has seen more than once.
_SHARED = 1 << 31
_LONGEST = 60_000


# ---------------------------------------------------------------- suffix sorting


def multikey_quicksort(eight: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` by their first ``depth`` bytes, and group numbers of ties.

    Eight bytes are one character.  All groups of suffixes that agree so far are
    split at once, and only they are looked at again.  A group is split by a library sort of that
    character in place of three-way partitions around pivots; equal characters stay a group just the same.
    """
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for d in range(0, depth, 8):
        if len(live) < 2:
            break
        key = eight[at[order[live]] + d]
        if d + 8 > depth:
            key >>= np.uint64(8 * (d + 8 - depth))
        within = np.lexsort((key, group[live])) if d else np.argsort(key)
        order[live] = order[live[within]]
        mine = group[live]
        key = key[within]
        cutoff = np.zeros(len(order), bool)
        cutoff[live[1:]] = (key[1:] != key[:-1]) & (mine[1:] == mine[:-1])
        first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else cutoff
        group = np.cumsum(first | cutoff) - 1
        sizes = np.bincount(group)
        live = np.nonzero(sizes[group] > 1)[0]
    return order, group


def blind_tries(data: np.ndarray, eight: np.ndarray, at: np.ndarray, order: np.ndarray, group: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes that agree in ``known`` bytes by their first ``depth`` bytes.

    One blind trie per group, all grown level by level: a node skips to the first
    byte at which its members differ, looking at nothing between, and branches there.
    Nodes whose members agree up to ``depth`` are leaves.
    """
    order, group = order.copy(), group.copy()
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    live = np.nonzero(sizes[group] > 1)[0] if len(group) else np.zeros(0, np.int64)
    skip = np.full(len(order), known, np.int64)
    while len(live):
        g = group[live]
        head = np.concatenate(([True], g[1:] != g[:-1]))
        node = np.cumsum(head) - 1
        leader = order[live[head]][node]
        where, lead = at[order[live]], at[leader]
        branch = np.full(len(live), depth, np.int64)
        open_ = np.arange(len(live))
        for d in range(int(skip[live].min()) // 8 * 8, depth, 8):  # first differing byte of each member from its leader
            a, b = eight[where[open_] + d], eight[lead[open_] + d]
            differ = np.nonzero(a != b)[0]
            if len(differ):
                x = a[differ] ^ b[differ]
                byte = np.zeros(len(x), np.int64)
                done = np.zeros(len(x), bool)
                for k in range(8):
                    hit = ~done & (((x >> np.uint64(56 - 8 * k)) & np.uint64(255)) != 0)
                    byte[hit] = k
                    done |= hit
                branch[open_[differ]] = np.minimum(d + byte, depth)
                open_ = np.delete(open_, differ)
            if not len(open_):
                break
        at_node = np.full(node[-1] + 1, depth, np.int64)
        np.minimum.at(at_node, node, branch)
        split = at_node[node]
        inner = split < depth
        live, node, split, where = live[inner], node[inner], split[inner], where[inner]
        if not len(live):
            break
        byte = data[where + split]
        within = np.lexsort((byte, node))
        order[live] = order[live[within]]
        node, byte, split = node[within], byte[within], split[within]
        skip[live] = split + 1
        fresh = np.zeros(len(order), bool)
        fresh[live[1:]] = (byte[1:] != byte[:-1]) & (node[1:] == node[:-1])
        first = np.concatenate(([True], group[1:] != group[:-1]))
        group = np.cumsum(first | fresh) - 1
        sizes = np.bincount(group)
        live = live[sizes[group[live]] > 1]
    return order, group


def sort_suffixes(data: np.ndarray, at: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting of the suffixes ``at`` of ``data`` by their first ``depth`` bytes.

    Multikey quicksort to the shallow depth, then blind tries for the groups that
    still agree.  Returns the order, and for each place in it the number of its
    group of suffixes equal in all ``depth`` bytes.
    """
    padded = np.concatenate((data, np.zeros(depth + 16, np.uint8)))
    eight = _eights(padded)
    order, group = multikey_quicksort(eight, at, min(shallow, depth))
    if depth > shallow:
        order, group = blind_tries(padded, eight, at, order, group, shallow, depth)
    return order, group


# ---------------------------------------------------------------- anchors


@dataclass
class Strings:
    """Runs of string starts of one text chunk that share an anchor.

    ``first`` and ``last`` start, the anchor's hash, and hashes of the anchor with the
    CONTEXT bytes to its left and to its right (0 where the chunk ends before).  A string
    that holds the anchor has that much on one side of it, so two equal strings have
    an equal left or right hash.  ``unsure`` marks runs in whose reach the anchor
    occurs again; ``text`` is the number of the text.
    """

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    left: np.ndarray
    right: np.ndarray
    unsure: np.ndarray
    text: np.ndarray


def _mix(h: np.ndarray, times: int) -> np.ndarray:
    h = h * np.uint64(times)
    h ^= h >> np.uint64(32)
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    w = data.astype(np.uint64)
    two = (w[:-1] << np.uint64(8)) | w[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def _smallest(keys: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbours."""
    n, best, width = len(keys) - span + 1, keys, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[:n], best[span - width : span - width + n])


_PLACE = np.uint64((1 << 25) - 1)  # more places than a chunk has


def strings(data: np.ndarray, ends: np.ndarray | None = None) -> Strings:
    """All LENGTH-byte strings of ``data`` as runs of starts with a common anchor.

    ``ends`` are the ends of the texts that ``data`` is made of, if several; no
    string crosses one.
    The upper bits of a word's hash choose it; the lower ones hold its place, once
    from the left and once from the right, so the smallest key also tells where the
    leftmost and the rightmost anchor of a string are.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        e, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Strings(e, e, u, u, u, np.zeros(0, bool), e)
    eight = _eights(data)
    words = len(data) - ANCHOR + 1
    h = _mix(eight[:words], 0x9E3779B97F4A7C15)
    h += eight[ANCHOR - 8 : ANCHOR - 8 + words]
    h = _mix(_mix(h, 0xBF58476D1CE4E5B9), 0x94D049BB133111EB) & ~_PLACE
    spot = np.arange(words, dtype=np.uint64)
    span = LENGTH - ANCHOR + 1
    left_most, right_most = _smallest(h | spot, span), _smallest(h | (_PLACE - spot), span)
    value = left_most >> np.uint64(25)
    ends = np.array([len(data)]) if ends is None else ends
    begins = np.concatenate(([0], ends[:-1]))
    change = np.zeros(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = value[1:] != value[:-1]
    stops = np.maximum(ends - LENGTH + 1, begins)  # a text's starts are those before its stop
    change[begins[begins < n]] = True
    change[stops[stops < n]] = True
    first = np.nonzero(change[:n])[0]
    last = np.concatenate((first[1:] - 1, [n - 1]))
    text = np.searchsorted(ends, first, "right")
    inside = first < stops[text]
    first, last, text = first[inside], last[inside], text[inside]
    value = value[first]
    place = (left_most[first] & _PLACE).astype(np.int64)
    unsure = place != (_PLACE - (right_most[last] & _PLACE)).astype(np.int64)
    m = len(eight) - 1

    def side(offsets: tuple[int, ...], whole: np.ndarray, times: int) -> np.ndarray:
        out = value
        for o in offsets:
            out = _mix(out ^ eight[np.clip(place + o, 0, m)], times)
        return np.where(whole, _mix(out, 0xC4CEB9FE1A85EC53), 0)

    left = side((-CONTEXT, 8 - CONTEXT, -8), place - CONTEXT >= begins[text], 0xFF51AFD7ED558CCD)
    right = side((ANCHOR, ANCHOR + 8, ANCHOR + CONTEXT - 8), place + ANCHOR + CONTEXT <= ends[text], 0xC2B2AE3D27D4EB4F)
    return Strings(first, last, _mix(_mix(value, 0xFF51AFD7ED558CCD), 0xC4CEB9FE1A85EC53), left, right, unsure, text)


def _texts(column: pa.Array):
    """(row, bytes of the text) for each row, as numpy arrays without copies."""
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    for i in range(len(whole)):
        yield i, data[ends[i] : ends[i + 1]]


def _blocks(column: pa.Array):
    """(rows, offset, bytes, ends): neighbouring texts in blocks; a long one in overlapping pieces, so that each string lies whole in one."""
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(whole):
        return
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(whole):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _BLOCK, "right")) - 1)
        part = data[ends[row] : ends[stop]]
        if stop == row + 1:
            for at, piece in _chunks(part):
                yield row, at, piece, np.array([len(piece)])
        else:
            yield row, 0, part, ends[row + 1 : stop + 1] - ends[row]
        row = stop


def _chunks(data: np.ndarray):
    """(offset, bytes): a long text in pieces that overlap so that each string lies whole in one."""
    for at in range(0, max(1, len(data) - LENGTH + 1), _CHUNK):
        yield at, data[at : at + _CHUNK + LENGTH - 1]


# ---------------------------------------------------------------- distributed steps


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed planes of their differences' bytes."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that owns each hash and the place inside it: the upper and lower half of hash * parts / 2**32."""
    low = np.uint64(0xFFFFFFFF)
    scaled = (h >> np.uint64(32)) * np.uint64(parts) + (((h & low) * np.uint64(parts)) >> np.uint64(32))
    return scaled >> np.uint64(32), (scaled & low).astype(np.uint32)


def _table(docs: DataFrame, parts: int, bits: int) -> bytes:
    """A bit for each range of anchor hashes, with left or right context, that occurs in two documents.

    Tasks send the distinct hashes of what they have read to the part that owns the
    hash range, as 32-bit numbers inside it, those seen in two documents already
    twice.  A passage that very many documents share comes twice from each flush, not
    once per document.  A part answers with its slice of the table, so what reaches the driver has the
    table's size whatever the corpus holds.
    """

    def gather(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate(held)
            h.sort()
            again = np.concatenate(([False], h[1:] == h[:-1]))
            third = again & np.concatenate(([False], again[:-1]))
            h = h[~third]
            part, inside = _dealt(h, parts)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            some = np.nonzero(cuts[1:] > cuts[:-1])[0]
            blobs = [_packed(inside[cuts[p] : cuts[p + 1]]) for p in some]
            return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "anchors"])

        for b in batches:
            for _, _, piece, ends in _blocks(b.column(0)):
                runs = strings(piece, ends)
                h, text = np.concatenate((runs.left, runs.right)), np.concatenate((runs.text, runs.text))
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = h > 0  # once a text; the pieces of a long text may send one twice, which only costs work
                new[1:] &= (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                held.append(h[new])
                size += len(held[-1]) * 8
                if size > 16 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_unpacked(a) for a in frame["anchors"]])
        h.sort()
        often = h[1:][h[1:] == h[:-1]].astype(np.uint64) + (np.uint64(frame["part"].iloc[0]) << np.uint64(32))
        spots = np.unique((often // np.uint64(parts)) >> np.uint64(32 - bits))  # often // parts: a hash's upper 32 bits
        return pd.DataFrame({"spots": [spots.astype(np.uint32).tobytes()]})

    sent = docs.select("text").mapInArrow(gather, "part int, anchors binary")
    table = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for r in sent.groupBy("part").applyInPandas(decide, "spots binary").toLocalIterator():
        spots = np.minimum(np.frombuffer(r["spots"], np.uint32), (1 << bits) - 1).astype(np.int64)
        if len(spots):
            first = spots[0] >> 3
            some = np.zeros(spots[-1] - (first << 3) + 1, bool)
            some[spots - (first << 3)] = True
            some = np.packbits(some, bitorder="little")
            table[first : first + len(some)] |= some
    return table.tobytes()


def _hits(batch, bitmap: np.ndarray, bits: int):
    """(id, mark, place, anchor, bytes) of each run whose anchor may occur in two documents; null ids come last."""
    ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for row, at, piece, ends in _blocks(batch.column(2)):
        runs = strings(piece, ends)
        again = runs.unsure.copy()
        for h in (runs.left, runs.right):
            spot = h >> np.uint64(64 - bits)
            again |= ((bitmap[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & (h > 0)
        hit = np.nonzero(again)[0]
        if not len(hit):
            continue
        whole, text = piece.tobytes(), runs.text[hit]
        begins = np.concatenate(([0], ends[:-1]))[text]
        for first, last, anchor, begin, k in zip(runs.first[hit].tolist(), runs.last[hit].tolist(), runs.anchor[hit].tolist(), begins.tolist(), (text + row).tolist()):
            i = ids[k]
            yield _OTHER if i is None else i, marks[k], at + first - begin, anchor, whole[first : last + LENGTH]


def _content(raw: bytes) -> tuple[int, int]:
    """A 128-bit digest of a run's bytes as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(raw))


def _covered(docs: DataFrame, parts: int, bits: int) -> DataFrame:
    """``(id, mark, spans)``: for each text with repeats, the runs of starts of strings that an earlier document has.

    Texts are read again and the runs whose anchor is in the table are looked at.
    Each flush sends a run's bytes once, with the smallest id that has them, to the
    part that owns the anchor.  The part sorts all strings it got and answers, for
    each content, the smallest id of each of its strings.  Who has which content goes
    as narrow rows that meet the answers in an equi-join, so a passage in very many
    documents is never gathered in one task.
    """
    table = docs.sparkSession.sparkContext.broadcast(_table(docs, parts, bits))

    def send(batches):
        bitmap = np.frombuffer(table.value, np.uint8)
        seen: dict[bytes, tuple[int, int, int]] = {}
        size = 0

        def flush():
            by: dict[int, list[tuple[int, int, bytes]]] = {}
            for raw, (i, p, shared) in seen.items():
                by.setdefault(p, []).append((i, len(raw) | shared, raw))
            blobs = []
            for rows in by.values():
                ids = np.array([i for i, _, _ in rows], np.int64).tobytes()
                sizes = np.array([n for _, n, _ in rows], np.uint32).tobytes()
                body = struct.pack("<q", len(rows)) + ids + sizes + b"".join([raw for _, _, raw in rows])
                blobs.append(zstandard.ZstdCompressor(level=7).compress(body))
            return pa.record_batch([pa.array(list(by), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "runs"])

        for b in batches:
            for i, _, _, anchor, raw in _hits(b, bitmap, bits):
                known = seen.get(raw)
                if known is None:
                    seen[raw] = (i, (anchor >> 32) * parts >> 32, 0)
                    size += len(raw) + 200
                else:
                    seen[raw] = (min(i, known[0]), known[1], _SHARED)
                if size > 56 << 20:
                    yield flush()
                    seen.clear()
                    size = 0
        if seen:
            yield flush()

    def members(batches):
        bitmap = np.frombuffer(table.value, np.uint8)
        names = ["c1", "c2", "id", "mark", "first"]
        for b in batches:
            out = []
            for i, mark, place, _, raw in _hits(b, bitmap, bits):
                out.append((*_content(raw), i, mark, place))
                if len(out) >= 50_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    def smallest(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        alone: dict[bytes, bool] = {}
        for blob in frame["runs"]:
            body = zstandard.ZstdDecompressor().decompress(blob)
            (n,) = struct.unpack_from("<q", body)
            ids = np.frombuffer(body, np.int64, n, 8).tolist()
            sizes = np.frombuffer(body, np.uint32, n, 8 + 8 * n)
            ends = 8 + 12 * n + np.cumsum((sizes & (_SHARED - 1)).astype(np.int64))
            at = 8 + 12 * n
            for i, e, several in zip(ids, ends.tolist(), (sizes >= _SHARED).tolist()):
                raw = body[at:e]
                at = e
                low = known.get(raw)
                alone[raw] = low is None and not several
                known[raw] = i if low is None else min(i, low)
        raws = list(known)
        sizes = np.array([len(r) for r in raws])
        data = np.frombuffer(b"".join(raws), np.uint8)
        starts = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(raws)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
        order, group = sort_suffixes(data, at, LENGTH)
        ids = np.array([known[r] for r in raws], np.int64)
        low = np.full(int(group[-1]) + 1, _OTHER, np.int64)
        np.minimum.at(low, group, ids[owner[order]])
        answer = np.empty(len(at), np.int64)
        answer[order] = low[group]
        cuts = np.cumsum(counts)
        single = np.array([alone[r] for r in raws])
        least = np.minimum.reduceat(answer, cuts - counts)
        told = np.nonzero(~(single & (least >= ids)))[0].tolist()
        keys = np.array([_content(raws[k]) for k in told], np.int64).reshape(-1, 2)
        even = (least == np.maximum.reduceat(answer, cuts - counts))[told]
        heads = np.empty(len(told), [("n", "<i4"), ("low", "<i8")])
        heads["n"], heads["low"] = counts[told], least[told]
        short = heads.tobytes()
        packed = [short[12 * j : 12 * j + 12] if even[j] else short[12 * j : 12 * j + 4] + answer[cuts[k] - counts[k] : cuts[k]].tobytes() for j, k in enumerate(told)]
        return pd.DataFrame({"c1": keys[:, 0], "c2": keys[:, 1], "low": packed})

    answers = docs.mapInArrow(send, "part int, runs binary").groupBy("part").applyInPandas(smallest, "c1 long, c2 long, low binary")
    mine = docs.mapInArrow(members, "c1 long, c2 long, id long, mark long, first long")

    def earlier(batches):
        names = ["id", "mark", "span"]
        for b in batches:
            low = b.column(3)
            low = low.cast(pa.large_binary())  # whichever offsets Spark sends
            ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
            data = np.frombuffer(low.buffers()[2], np.uint8) if len(low) else np.empty(0, np.uint8)
            even = np.diff(ends) == 12  # one smallest id for all strings of the run
            heads = data[ends[:-1][even][:, None] + np.arange(12)].copy().view([("n", "<i4"), ("low", "<i8")]).ravel()
            ids, marks, firsts = (np.asarray(b.column(k)) for k in range(3))
            length = heads["n"].astype(np.int64) - 1 + LENGTH
            quick = (heads["low"] < ids[even]) & (length <= _LONGEST)
            span = (firsts[even] << 16 | length)[quick]
            yield pa.record_batch([pa.array(ids[even][quick]), pa.array(marks[even][quick]), pa.array(span)], names=names)
            slow = ~even
            slow[np.nonzero(even)[0][length > _LONGEST]] = True
            rows = []
            for k in np.nonzero(slow)[0].tolist():
                raw = data[ends[k] : ends[k + 1]].tobytes()
                lows = np.frombuffer(raw, np.int64, -1, 4)
                (n,) = struct.unpack_from("<i", raw)
                old = np.nonzero(np.broadcast_to(lows, n) < ids[k])[0]
                if len(old):
                    edges = np.nonzero(np.diff(old) > 1)[0]
                    starts = np.concatenate((old[:1], old[edges + 1])).tolist()
                    stops = np.concatenate((old[edges], old[-1:])).tolist()
                    first = int(firsts[k])
                    rows += [(ids[k], marks[k], x << 16 | y - x) for a, z in zip(starts, stops) for x, y in _cut(first + a, first + z + LENGTH)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    spans = mine.join(answers, ["c1", "c2"]).select("id", "mark", "first", "low").mapInArrow(earlier, "id long, mark long, span long")
    return spans.groupBy("id", "mark").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _cut(start: int, stop: int):
    """A span in pieces whose length fits 16 bits."""
    for at in range(start, stop, _LONGEST):
        yield at, min(stop, at + _LONGEST)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id, n_bytes, kept binary, n_removed, n_spans)`` for every row of ``docs``.

    A byte is removed if it is covered by a 50-byte string that also starts in a
    document with a smaller id; all strings are judged on the input.  Null texts
    count as empty; null ids come after all others, and rows with equal ids do not
    remove each other's text.  Repeated rows come back repeated; an empty table
    gives no row.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // part_bytes))
    bits = bits or min(MOST_BITS, max(20, (total // 10).bit_length()))
    spans = _covered(base, parts, bits)
    spans = spans.select(F.when(F.col("id") != _OTHER, F.col("id")).alias("sid"), F.col("mark").alias("smark"), "spans")
    joined = base.join(spans, base["id"].eqNullSafe(spans["sid"]) & (base["mark"] == spans["smark"]), "left")

    def take(batches):
        for b in batches:
            out = []
            for (_, data), spans in zip(_texts(b.column(1)), b.column(2).to_pylist()):
                runs: list[list[int]] = []
                for s in spans or ():
                    start, stop = s >> 16, (s >> 16) + (s & 0xFFFF)
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                raw = data.tobytes()
                edges = [0, *[e for r in runs for e in r], len(raw)]
                kept = b"".join([raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)])
                out.append((len(raw), kept, len(raw) - len(kept), len(runs)))
            n, kept, gone, runs = zip(*out) if out else ([], [], [], [])
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())],
                names=["id", "n_bytes", "kept", "n_removed", "n_spans"],
            )

    return joined.select("id", "text", "spans").mapInArrow(take, "id long, n_bytes long, kept binary, n_removed long, n_spans long")


def op9_suffix_dedup(spark, sf_dir):
    """Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row for each row of ``documents``.

    Null and empty texts have no bytes; texts of any length are treated whole; rows of
    equal ids don't remove each other's text, null ids come last; repeated rows come back
    repeated; an empty table gives no row; other columns are not read.
    """
    out = remove_repeats(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
