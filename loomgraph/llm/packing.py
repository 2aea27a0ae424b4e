"""Packing token sequences into windows by non-negative least squares over length patterns."""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import cut, documents

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Rests of one length are ranked in salted parts of about this many.
ROWS = 1 << 11
#: Most such parts besides one for each length; their counts are held on the driver.
PARTS = 1 << 18
#: Words, and parts of words, whose ids a Python worker keeps.
_CACHE = 500_000
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) if b in shown else chr(256 + n) for n, b in enumerate([*[x for x in range(256) if x not in shown], *shown])}


class _Memo(dict):
    """Results of a function; the first ``room`` of them are kept, later ones are made anew."""

    def __init__(self, make, room: int):
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts by the tokenizer, word by word.

    The vocabulary splits at white space before anything else, so the ids of a text
    are its words' ids joined.  Ids of the first words met, which the frequent ones are among, are
    kept.  Other words made of Latin letters and punctuation are cut as the
    tokenizer's own rules cut them and go straight to its BPE model; all others pass
    through the whole tokenizer.
    """

    _plain = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)+")
    _parts = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
    _other_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str, cache: int = _CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.raw = [np.array([i], self.kind).tobytes() for i in range(size)]
        self.end = self.raw[END_ID]
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.table = str.maketrans(self.letters)
        self.words = _Memo(self._word, cache)
        self.pieces = _Memo(self._piece, cache)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if self._plain.fullmatch(word) and "<|" not in word:
            parts = self._parts.findall(word.lower())
            return self._piece(parts[0]) if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))  # the word itself is kept
        return b"".join([self.raw[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, then END_ID."""
        words = text.translate(_SPACES).split(" ") if self._other_space.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)) + self.end, self.kind)


def kept_encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary; what it has kept serves all tasks of a worker."""
    home = sys.modules.setdefault("_loomgraph_kept", types.ModuleType("_loomgraph_kept"))
    if path not in vars(home):
        vars(home)[path] = Encoder(path)
    return vars(home)[path]


@dataclass
class Plan:
    """Where the k-th rest of each length goes.

    ``runs[n]`` lists, by first rank, how the rests of length n from there on are
    placed: ``(first rank, sequence, rests to a sequence, offset)`` for rests that lie
    whole in their window, ``(first rank, sequence, 0, offset)`` for rests that stand
    one after the other in a stream of windows from that place on and are cut where a
    window ends.  The number of runs depends on the lengths, not on their counts.
    """

    runs: dict[int, list[tuple[int, int, int, int]]]
    sequences: int
    window: int = WINDOW

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        return placed(self.runs[length], length, rank, self.window)


def placed(runs: list[tuple[int, int, int, int]], length: int, rank: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of the rest with this rank among its length's runs."""
    first, seq, per, offset = runs[bisect_right(runs, rank, key=lambda r: r[0]) - 1]
    k = rank - first
    if per:
        return [(0, length, seq + k // per, offset + (k % per) * length)]
    ahead, at = divmod(offset + k * length, window)
    head = min(length, window - at)
    tail = [(head, length - head, seq + ahead + 1, 0)] if head < length else []
    return [(0, head, seq + ahead, at), *tail]


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[dict[int, int]]:
    """Shallow combinations of present lengths that fill a window exactly.

    m pieces of one length and the one length that completes them, for every m: at
    most window * ln(window) patterns of at most two lengths; where the completing
    length is missing, it is split into the two present lengths closest to its half.
    """
    present = sorted(n for n, c in histogram.items() if c > 0 and 0 < n < window)
    there, found = set(present), {}
    for n in present:
        for m in range(1, min(window // n, histogram[n]) + 1):
            rest = window - m * n
            if rest == 0:
                found[((n, m),)] = {n: m}
            elif rest in there:
                p = {n: m}
                p[rest] = p.get(rest, 0) + 1
                found[tuple(sorted(p.items()))] = p
            else:
                at = bisect_right(present, rest // 2)
                for a in present[max(0, at - 4) : at + 4]:
                    if rest - a in there:
                        p = {n: m}
                        p[a] = p.get(a, 0) + 1
                        p[rest - a] = p.get(rest - a, 0) + 1
                        found[tuple(sorted(p.items()))] = p
                        break
    return list(found.values())


def solve(histogram: dict[int, int], columns: list[dict[int, int]], sweeps: int = 30) -> np.ndarray:
    """x >= 0 that minimises ||A x - histogram||, by cyclic coordinate descent over sparse columns."""
    left = {n: float(c) for n, c in histogram.items()}
    x = [0.0] * len(columns)
    norms = [sum(m * m for m in p.values()) for p in columns]
    items = [list(p.items()) for p in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(items):
            step = sum(m * left[n] for n, m in p) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in p:
                    left[n] -= m * step
        if moved < 0.5:
            break
    return np.array(x)


def plan(histogram: dict[int, int], window: int = WINDOW, first_sequence: int = 0) -> Plan:
    """Pack ``histogram[length]`` rests of each length below ``window``.

    Patterns are repeated as often as the rounded-down solution and the lengths left
    allow.  The residual is packed greedily, longest first, as many equal windows at
    once as the counts allow, wherever that fills a window exactly; the lengths that
    fill none stand one after the other in a stream that is cut at each window's end,
    so only the very last window can have padding and a window cuts one rest at most.
    All work is on counts of lengths: its cost and the number of runs depend on the
    number of different lengths, not on how many documents have them.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    seq = first_sequence

    def repeat(combo: list[tuple[int, int]], k: int) -> None:
        nonlocal seq
        offset = 0
        for n, m in combo:
            runs[n].append((used[n], seq, m, offset))
            used[n] += k * m
            left[n] -= k * m
            offset += n * m
        seq += k

    columns = patterns(left, window)
    times = np.floor(solve(left, columns) + 1e-6).astype(np.int64)
    for j in np.argsort(-times, kind="stable").tolist():
        k = min([int(times[j]), *(left[n] // m for n, m in columns[j].items())])
        if k > 0:
            repeat(sorted(columns[j].items(), reverse=True), k)
    lengths = sorted(n for n, c in left.items() if c)
    stream = []
    while lengths:
        combo, room, at = [], window, len(lengths)
        while room and at:
            at = min(at, bisect_right(lengths, room)) - 1
            if at >= 0:
                n = lengths[at]
                m = min(room // n, left[n])
                combo.append((n, m))
                room -= n * m
            at = max(at, 0)
        if room:
            stream.append(lengths.pop())
        else:
            repeat(combo, min(left[n] // m for n, m in combo))
            lengths = [n for n in lengths if left[n]]
    at = 0
    for n in stream:
        runs[n].append((used[n], seq + at // window, 0, at % window))
        at += n * left[n]
    return Plan(runs, seq - (-at // window), window)


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, rows: int = ROWS) -> DataFrame:
    """One row per piece of each document's ids; see ``op8_packing`` for the columns.

    A document's whole windows are sequences of their own.  Rests are ranked within
    their length; a length of more than ``rows`` rests is salted into parts of about
    that many, so none that very many documents have is a hot key.  The driver sees
    counts by length, then by (length, salt), at most window + PARTS of
    them (parts grow beyond that), and the plan made of them.  Ids are kept once, in the shared folder, and
    dealt once.  Null texts count as empty and have the closing id only.  Repeated
    rows are packed each by itself; an empty table gives no row.
    """
    path = path or tokenizer_path()
    kind = kept_encoder(path).kind
    schema = "id long, ids binary, rest int, full int"

    def encode(batches):
        encoder = kept_encoder(path)
        for b in batches:
            keys = b.column(0)
            for at in range(0, b.num_rows, 500):
                ids = [encoder.ids(t or "") for t in b.column(1).slice(at, 500).to_pylist()]
                sizes = np.array([len(i) for i in ids])
                yield pa.record_batch(
                    [keys.slice(at, 500), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array((sizes % window).astype(np.int32)), pa.array((sizes // window).astype(np.int32))],
                    names=["id", "ids", "rest", "full"],
                )
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    coded = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(encode, schema)
    coded = cut(coded.withColumn("spin", F.xxhash64("id", "rest", F.spark_partition_id())))  # repeated rows spread by task
    held = {r["rest"]: r["n"] for r in coded.groupBy("rest").agg(F.count("*").alias("n")).collect()}
    rows = max(rows, sum(held.values()) // PARTS)
    shared = {rest: 1 + n // rows for rest, n in held.items() if n >= rows}
    share = F.coalesce(F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[F.col("rest")], F.lit(1)) if shared else F.lit(1)
    coded = coded.withColumn("salt", F.pmod("spin", share).cast("int"))
    counts = coded.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], tuple[int, int]] = {}
    full = 0
    for r in sorted(counts, key=lambda r: (r["rest"], r["salt"])):
        base[r["rest"], r["salt"]] = (histogram.get(r["rest"], 0), full)
        histogram[r["rest"]] = histogram.get(r["rest"], 0) + r["n"]
        full += r["full"]
    histogram.pop(0, None)
    layout = docs.sparkSession.sparkContext.broadcast((base, plan(histogram, window, full).runs))

    line = Window.partitionBy("rest", "salt").orderBy("id", F.xxhash64("ids"))
    ranked = coded.select(
        "id", "ids", "rest", "salt", (F.row_number().over(line) - 1).alias("rank"),
        (F.sum("full").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("ahead"),
    )

    def place(batches):
        base, runs = layout.value
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = []
            for doc, raw, rest, salt, rank, ahead in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.frombuffer(raw, kind).astype("<u4")
                first_rank, first_full = base[rest, salt]
                pieces = [(w * window, window, first_full + ahead + w, 0) for w in range(len(ids) // window)]
                if rest:
                    at = len(ids) - rest
                    pieces += [(at + s, n, q, o) for s, n, q, o in placed(runs[rest], rest, first_rank + rank, window)]
                out += [(doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), q, o) for s, n, q, o in pieces]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)
        pa.default_memory_pool().release_unused()

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark, sf_dir):
    """Pieces of all ``documents``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have one piece, the closing id; very long ones are whole
    windows and a rest; ties and repeated rows are packed each by itself; an empty
    table gives no row; other columns are not read.
    """
    return pack(documents(spark, sf_dir))
