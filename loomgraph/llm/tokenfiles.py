"""Token ids in binary files: independent zstandard frames, a seek table at the end, a checksum for each frame.

A file is, from its start:

* frames of little-endian ids, two bytes each where the vocabulary allows, else four;
  a frame ends with a document once it holds FRAME_IDS ids, and only a longer document
  is spread over several;
* a skippable frame with the index: the file's place among all files, and key and
  first id of each document;
* the seek table of the public seekable zstandard layout: a skippable frame with
  compressed size, content size and XXH64 checksum of every frame before it, their
  number, a descriptor and a closing magic number.

Any zstandard tool decompresses such a file whole; a reader that wants some documents
reads the table and the index and decompresses only their frames.
"""

from __future__ import annotations

import io
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.packing import _byte_letters, _Memo, tokenizer_path
from loomgraph.llm.shared import cut, documents, removed
from loomgraph.session import shared_folder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a frame ends; compressed bytes after which a file ends.
FRAME_IDS, FILE_BYTES = 1 << 15, 8 << 20
LEVEL = 3
#: Fixed values of the public layout: skippable frames, the seek table's frame, its closing number.
INDEX_MAGIC, TABLE_MAGIC, CLOSING = 0x184D2A50, 0x184D2A5E, b"\xb1\xea\x92\x8f"
#: Stands before a text's first word, which no space precedes.
FIRST = "\0"
#: Texts that are encoded at a time; their words and places take several times their bytes.
ROWS = 1024
#: Words, and parts of words, whose ids a Python worker keeps.
_CACHE = 400_000


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer that adds no prefix space, word by word.

    Its rules never join what stands on both sides of the start of a run of white
    space, so the ids of a text are those of its words, each with the space before it, joined.
    Ids of the first words met, which the frequent ones are among, are kept.
    Words of Latin letters, digits and ASCII marks are cut as the tokenizer's own
    pattern cuts them and go straight to its BPE model; all others, and texts with
    special tokens or with characters that engines may class apart, pass through the
    whole tokenizer.
    """

    _space = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
    _latin = f"A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}"
    _chunk = re.compile(f" ?[^{_space}]+|[{_space}]+(?![^{_space}])|[{_space}]+")
    _runs = ("  ", " \n", "\n ", "\n\n")
    _other_space = re.compile(f"[\t\x0b-\r{_space[6:]}]")
    _plain = re.compile(f" ?[!-~{_latin}]+")
    _parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_latin}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+")
    _one = re.compile(f" ?[{_latin}]+")
    _doubtful = re.compile(r"[\x00-\x08\x0e-\x1f\x7f" + "".join(map(chr, (0x180E, 0x200B, 0x2060, 0xFEFF))) + "]")

    def __init__(self, path: str, end: int = END_ID, cache: int = _CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.raw = [np.array([i], self.kind).tobytes() for i in range(size)]
        self.end = self.raw[end]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.line = self._whole("\n")
        self.words = _Memo(self._after_space, cache)
        self.pieces = _Memo(self._piece, cache)

    def _piece(self, piece: str) -> bytes:
        shown = piece.replace(" ", self.table[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if self._plain.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, self._parts.findall(word)))
        return self._whole(word)

    def _kept_word(self, word: str) -> bytes:
        """Ids of a word that is kept whole: not kept again as its only part."""
        return self._piece(word) if self._one.fullmatch(word) else self._word(word)

    def _after_space(self, word: str) -> bytes:
        """Ids of a word after a space; of a new line and the first word of a line; of FIRST and a text's first word."""
        if word[0] == "\n":
            return self.line + self._kept_word(word[1:])
        return self._kept_word(word[1:]) if word[0] == FIRST else self._kept_word(f" {word}")

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, then the end id."""
        if self._doubtful.search(text) or self.special.search(text):
            found = self._whole(text)
        else:
            found = b"".join(map(self._word, self._chunk.findall(text)))
        return np.frombuffer(found + self.end, self.kind)

    def _even(self, text: str) -> bool:
        """Whether single spaces and new lines, between words, are its only white space, and no character is doubtful or special."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(r in text for r in self._runs):
            return False
        return not (self._doubtful.search(text) or self.special.search(text) or self._other_space.search(text))

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``ids`` of each text in turn, nulls as empty: equal words of the texts are looked up once."""
        known = texts.to_pylist()
        even = np.array([self._even(t or "") for t in known], bool)
        plain = texts.filter(pa.array(even)).cast(pa.large_string())
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), plain, pa.scalar("", pa.large_string())), "\n", " \n")
        words = pc.split_pattern(lines, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        raw = [self.words[w] for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(r) for r in raw], np.int64) // np.dtype(self.kind).itemsize
        firsts, store = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), self.kind)
        spots = coded.indices.to_numpy()
        end, nth = np.frombuffer(self.end, self.kind), -1
        for text, is_even in zip(known, even.tolist()):
            if not is_even:
                yield self.ids(text or "")
                continue
            nth += 1
            mine = spots[bounds[nth] - bounds[0] : bounds[nth + 1] - bounds[0]]
            n = sizes[mine]
            shift = firsts[mine] - (np.cumsum(n) - n)
            yield np.concatenate([store[np.repeat(shift, n) + np.arange(n.sum())], end])


def kept_encoder(path: str, end: int = END_ID) -> ByteEncoder:
    """This process's encoder; what it has kept serves all tasks of a worker."""
    home = vars(sys.modules.setdefault("_loomgraph_kept", types.ModuleType("_loomgraph_kept")))
    name = f"bytes|{path}|{end}"
    if name not in home:
        home[name] = ByteEncoder(path, end)
    return home[name]


class FileMaker:
    """Builds one file after the other from documents that come in order."""

    def __init__(self, part: int, kind: str, frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES, level: int = LEVEL):
        self.part, self.kind, self.frame_ids, self.file_bytes = part, np.dtype(kind), frame_ids, file_bytes
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.nth = self.before = 0
        self._open()

    def _open(self) -> None:
        self.frames, self.entries, self.keys, self.starts = [], [], [], [0]
        self.held, self.n_held, self.bytes = [], 0, 0

    def _frame(self) -> None:
        raw = b"".join(self.held)
        if raw:
            packed = self.squeeze.compress(raw)
            self.frames.append(packed)
            self.entries.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(packed)
        self.held, self.n_held = [], 0

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Takes a document in; gives a whole file when one is full."""
        if self.n_held and self.n_held + len(ids) > self.frame_ids:
            self._frame()
        for at in range(0, len(ids), self.frame_ids):
            piece = ids[at : at + self.frame_ids]
            self.held.append(piece.tobytes())
            self.n_held += len(piece)
            if self.n_held >= self.frame_ids:
                self._frame()
        self.keys.append(key)
        self.starts.append(self.starts[-1] + len(ids))
        if self.bytes >= self.file_bytes:
            yield from self.close()

    def close(self) -> Iterator[bytes]:
        """The file that is open, but for its closing number; nothing if it has no document."""
        if not self.keys:
            return
        self._frame()
        head = struct.pack("<qqqqq", self.part, self.nth, self.before, len(self.keys), self.kind.itemsize)
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        void = np.array([k is None for k in self.keys], "u1").tobytes()
        index = zstandard.ZstdCompressor(write_checksum=True).compress(head + keys + void + np.array(self.starts, "<i8").tobytes())
        self.frames.append(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append(struct.pack("<III", len(self.frames[-1]), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.entries)
        tail = struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IB", len(self.entries), 0x80)
        yield b"".join([*self.frames, tail])
        self.nth += 1
        self.before += self.starts[-1]
        self._open()


class TokenFile:
    """Reads documents of one file; ``file`` can be sought in, and only the frames asked for are decompressed."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        count, flags, closing = struct.unpack("<IB4s", self._at(size - 9, 9))
        if closing != CLOSING or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        width = 12 * count
        magic, length = struct.unpack("<II", self._at(size - 17 - width, 8))
        if magic != TABLE_MAGIC or length != width + 9:
            raise ValueError("damaged seek table")
        table = np.frombuffer(self._at(size - 9 - width, width), "<u4").reshape(count, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        index = self._at(int(self.places[-2]), int(table[-1, 0]))
        if struct.unpack("<I", index[:4])[0] != INDEX_MAGIC:
            raise ValueError("no index before the seek table")
        index = zstandard.ZstdDecompressor().decompress(index[8:])
        self.part, self.nth, self.before, self.count, wide = struct.unpack_from("<qqqqq", index)
        self.kind = np.dtype(f"<u{wide}")
        self.sums = table[:-1, 2]
        self.firsts = np.concatenate([[0], np.cumsum(table[:-1, 1])]) // wide
        keys = np.frombuffer(index, "<i8", self.count, 40)
        void = np.frombuffer(index, "u1", self.count, 40 + 8 * self.count)
        self.keys = [None if v else k for k, v in zip(keys.tolist(), void.tolist())]
        self.starts = np.frombuffer(index, "<i8", self.count + 1, 40 + 9 * self.count)
        self.decompressed = 0
        self._kept = (-1, None)

    def _at(self, place: int, length: int) -> bytes:
        if place < 0:
            raise ValueError("damaged token file")
        self.file.seek(place)
        return self.file.read(length)

    def frame(self, n: int) -> np.ndarray:
        if self._kept[0] != n:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[n]), int(self.places[n + 1] - self.places[n])))
            self.decompressed += 1
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[n]:
                raise ValueError(f"frame {n} does not match its checksum")
            self._kept = (n, np.frombuffer(raw, self.kind))
        return self._kept[1]

    def pieces(self, nth: int) -> Iterator[np.ndarray]:
        """The ids of the file's nth document, frame by frame."""
        low, high = int(self.starts[nth]), int(self.starts[nth + 1])
        n = int(np.searchsorted(self.firsts, low, "right")) - 1
        while low < high:
            first, last = int(self.firsts[n]), int(self.firsts[n + 1])
            yield self.frame(n)[low - first : min(high, last) - first]
            low, n = min(high, last), n + 1

    def ids(self, nth: int) -> np.ndarray:
        return np.concatenate(list(self.pieces(nth)))


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END_ID, **sizes) -> None:
    """Encodes ``docs`` and writes their ids to ``folder`` in ascending order of the key, nulls first.

    Null texts count as empty: a document has its end id at least.  Rows of one key
    stand by the hash of their text.  Rows are dealt by ranges of key, hash and row
    number, so a key that many rows have is spread over tasks.  Each task makes whole files of
    about ``file_bytes``, and Spark's text writer puts each into a file of its own, with the
    closing number as its line end: a file is there after its task's commit or not at all,
    on any file system that Spark writes to.  An empty table leaves a folder without documents.
    """
    path = path or tokenizer_path(TOKENIZER)

    def write(batches):
        coder = kept_encoder(path, end)
        maker = FileMaker(TaskContext.get().partitionId(), coder.kind, **sizes)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                for k, ids in zip(part.column(0).to_pylist(), coder.many(part.column(1))):
                    for made in maker.add(k, ids):
                        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["value"])
        for made in maker.close():
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["value"])
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    order = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", order[1].alias("mark"), order[2].alias("row")).repartitionByRange("id", "mark", "row")
    files = keyed.sortWithinPartitions("id", "mark", "row").select("id", "text").mapInArrow(write, "value binary")
    out = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    out.option("encoding", "ISO-8859-1").option("lineSep", CLOSING.decode("latin-1")).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content")


def read_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document of the folder, from its files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` runs over the ids
    as little-endian four-byte integers.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(io.BytesIO(content.as_buffer()))
                sums = []
                for nth in range(f.count):
                    crc = 0
                    for ids in f.pieces(nth):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                columns = [
                    pa.array(f.keys, pa.int64()),
                    pa.array([f.part] * f.count, pa.int64()),
                    pa.array(f.before + f.starts[:-1]),
                    pa.array(np.diff(f.starts)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "inside", "n_tokens", "ids_crc32"])

    rows = cut(_files(spark, folder).mapInArrow(read, "id long, part long, inside long, n_tokens long, ids_crc32 long"))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # one row for each task that wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    return rows.join(parts, "part").select("id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, folder: str, keys: Sequence[int | None]) -> DataFrame:
    """``(id, ids array<int>)`` of the documents with one of the caller's ``keys``; other frames stay compressed."""
    wanted = frozenset(keys)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(io.BytesIO(content.as_buffer()))
                for nth in [n for n, k in enumerate(f.keys) if k in wanted]:
                    ids = pa.array([f.ids(nth).tolist()], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([f.keys[nth]], pa.int64()), ids], ["id", "ids"])

    return _files(spark, folder).mapInArrow(read, "id long, ids array<int>")


def op13_token_files(spark, sf_dir):
    """Columns: doc_id, start, n_tokens, ids_crc32, read back from the files.

    Null and empty texts have the end id only; long texts are encoded whole and spread
    over frames; rows of one doc_id stand by the hash of their text, repeated rows count
    each, null ids come first; an empty table gives no row; other columns are not read.
    The files are removed once they are read.
    """
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder)
    counts = read_token_counts(spark, folder)
    removed(spark, folder)
    return counts.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
