"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import documents

#: Most labelled texts per language that the centroids are fitted on.
SAMPLE = 600
#: Most languages that are learned, those with most rows, and most texts of all together; their counts are held on the driver.
LANGUAGES, TEXTS = 1000, 24_000
#: Centroids per language, hashed n-gram dimensions.
CENTROIDS = 4
DIMENSIONS = 4096
#: A text is rejected if its cosine distance to the best centroid exceeds the centroid's own limit for texts of
#: its size: this share of the distances of its fitting texts, widened by SLACK of what is left up to 1.
QUANTILE, SLACK = 0.995, 0.1
#: Sizes in grams, each with a limit; the fitting texts are thinned to them.
SIZES = tuple(4 << k for k in range(10))
#: Centroids with a smaller share of a language's texts are merged into the others.
SHARE = 0.02
UNDETERMINED = "und"
_ROWS, _BYTES = 256, 4 << 20


def _held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' lower-case bytes in one array, and where each begins and ends."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    if not len(low):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = low.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), ends


def _counts(data: np.ndarray, ends: np.ndarray, dimensions: int) -> np.ndarray:
    """Hashed counts of the 2- and 3-byte grams of each text, a row a text.

    Everything but letters counts as a space; grams that hold two spaces are left out.
    Texts are read in slices, so a long one needs no more memory than a short one.
    """
    rows = len(ends) - 1
    out = np.zeros(rows * dimensions, np.float32)
    for first in range(0, rows):
        lo, hi = int(ends[first]), int(ends[first + 1])
        for at in range(lo - 1, hi, _BYTES):  # the text stands between two spaces
            b = _FOLD[data[max(lo, at) : min(hi, at + _BYTES + 2)]].astype(np.uint32)
            b = np.pad(b, (int(at < lo), int(at + _BYTES + 2 > hi)), constant_values=32)
            space = b == 32
            pair = b[:-1] * np.uint32(257) + b[1:]
            fine = ~(space[:-1] & space[1:])
            fine[_BYTES:] = False
            bins = ((pair[fine] * np.uint32(2654435761)) >> np.uint32(17)) % dimensions
            three = pair[:-1] * np.uint32(8191) + b[2:]
            fine = (fine[:-1] & ~space[1:-1])[: len(three)]
            more = ((three[fine] * np.uint32(2246822519)) >> np.uint32(15)) % dimensions
            row = out[first * dimensions : (first + 1) * dimensions]
            row += np.bincount(bins, minlength=dimensions)
            row += np.bincount(more, minlength=dimensions)
    return out.reshape(rows, dimensions)


@dataclass
class Centroids:
    languages: list[str]
    weights: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    limit: np.ndarray

    def cosine(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.weights
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.maximum(norm, 1e-12)) @ self.vectors.T

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection for each row of counts."""
        near = self.cosine(counts)
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(near)), best], 0.0, 1.0)
        size = np.maximum(np.searchsorted(SIZES, counts.sum(axis=1), "right") - 1, 0)
        return self.owner[best], cosine, 1 - cosine > self.limit[best, size]


def _thinned(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows of more than ``size`` grams as so many drawn from them by a fixed seed; others as they are."""
    out, rng = counts.copy(), np.random.default_rng(size)
    for i in np.nonzero(counts.sum(axis=1) > size)[0]:
        ends = np.cumsum(counts[i])
        out[i] = np.bincount(np.searchsorted(ends, rng.random(size) * ends[-1], "right"), minlength=counts.shape[1])
    return out


def _dense(texts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The counts of texts whose bins and counts are given."""
    counts = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, (spots, n) in zip(counts, texts):
        row[np.frombuffer(spots, np.uint16)] = np.frombuffer(n, np.float32)
    return counts


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Counts as normalised TF-IDF vectors, in their place."""
    v = np.log1p(counts, out=counts)
    v *= weights
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


def fit(texts: dict[str, list[tuple[bytes, bytes]]], centroids: int = CENTROIDS, rounds: int = 10, slack: float = SLACK) -> Centroids:
    """Spherical k-means inside each language over normalised TF-IDF vectors.

    ``texts`` has each language's texts as their bins and counts; the counts of one language are spread out at a time.
    Short texts are farther from every centroid than long ones of the same language,
    so each centroid has a limit for each of SIZES, from its texts thinned to that size.
    """
    seen = np.zeros(DIMENSIONS, np.int64)
    for own in texts.values():
        for spots, _ in own:
            seen[np.frombuffer(spots, np.uint16)] += 1
    total = sum(map(len, texts.values()))
    weights = np.where(seen > 0, np.log((1 + total) / (1 + seen)) + 1, 0).astype(np.float32)
    names, vectors, owner, limit = sorted(texts), [], [], []
    for n, name in enumerate(names):
        counts = _dense(texts[name])
        mine = _weighted(counts.copy(), weights)
        mean = mine.mean(axis=0)
        chosen = [int((mine @ mean).argmax())]
        while len(chosen) < min(centroids, len(mine)):  # each next start is far from those so far, but no odd single text
            chosen.append(int(np.argsort((mine @ mine[chosen].T).max(axis=1), kind="stable")[len(mine) // 10]))
        c = mine[chosen]
        for _ in range(rounds):
            near = (mine @ c.T).argmax(axis=1)
            sums = np.stack([mine[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        members = np.bincount((mine @ c.T).argmax(axis=1), minlength=len(c))
        c = c[members >= min(members.max(), max(2, SHARE * len(mine)))]
        del mine
        vectors.append(c)
        owner += [n] * len(c)
        cells = np.ones((len(c), len(SIZES)))
        for at, size in enumerate(SIZES):
            counts = counts[counts.sum(axis=1) >= size]
            if not len(counts):  # larger than any fitting text: as the size before
                cells[:, at] = cells[:, at - 1] if at else 1.0
                continue
            cos = _weighted(_thinned(counts, size), weights) @ c.T
            near = cos.argmax(axis=1)
            for k in range(len(c)):
                own = cos[near == k, k] if (near == k).any() else cos.max(axis=1)
                far = float(1 - np.quantile(own, 1 - QUANTILE))
                cells[k, at] = far + slack * (1 - far)
        limit.append(cells)
    return Centroids(names, weights, np.concatenate(vectors).astype(np.float32), np.array(owner), np.concatenate(limit))


def training_sample(docs: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts per language, those with the smallest key digests; fewer if there are very many languages.

    Rows whose key's CRC-32 modulo 3 is 1 are never drawn.  A first pass counts each
    language without its texts, so that about twice the sample is read in the second
    and no language, however large, is gathered in one task.
    """
    spread = F.conv(F.substring(F.md5(F.concat(F.lit("sample|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~_held_out(F.col(key)))
    rows = rows.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), spread.alias("place"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return rows.select("lang", "text")
    sample = max(1, min(sample, TEXTS // len(sizes)))
    upto = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 2.0**33 * sample / r["count"] + 2.0**26)])
    close = rows.where(F.col("place") < F.element_at(upto, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    return close.withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "text")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Centroids | None:
    """Fit on the bounded sample; None if no row is labelled.

    The sample's texts are counted where they are; the driver gets at most
    ``DIMENSIONS`` counts for each, however long they are.
    """

    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                counts = _counts(*_utf8(pa.concat_arrays([part.column(1)])), DIMENSIONS)
                spots = [np.nonzero(c)[0] for c in counts]
                yield pa.record_batch(
                    [part.column(0), pa.array([x.astype(np.uint16).tobytes() for x in spots], pa.binary()), pa.array([c[x].tobytes() for c, x in zip(counts, spots)], pa.binary())],
                    names=["lang", "spots", "counts"],
                )

    rows = training_sample(docs, key, text, lang, sample).mapInArrow(count, "lang string, spots binary, counts binary").collect()
    texts: dict[str, list[tuple[bytes, bytes]]] = {}
    for label, spots, n in sorted((r["lang"], bytes(r["spots"]), bytes(r["counts"])) for r in rows):
        texts.setdefault(label, []).append((spots, n))
    return fit(texts) if texts else None


def _judged(column: pa.Array, model: Centroids | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a batch."""
    texts = pa.concat_arrays([column])
    data, ends = _utf8(texts)
    lettered = np.array(pc.match_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"\p{L}"))
    if model is None:
        return [UNDETERMINED] * len(lettered), np.zeros(len(lettered)), np.ones(len(lettered), bool)
    which, cosine, far = model.predict(_counts(data, ends, DIMENSIONS))
    names = [model.languages[w] if ok else UNDETERMINED for w, ok in zip(which, lettered)]
    return names, np.where(lettered, cosine, 0.0).astype(float), far | ~lettered


def predict(docs: DataFrame, model: Centroids | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, mark, lang_pred, score, rejected)`` for every row, from the whole text alone.

    Texts that are null or hold no letter are ``und`` with score 0 and rejected; so is
    every text if there is no model.  ``score`` is the cosine to the nearest centroid.
    A text farther from it than the centroid's limit is rejected, but still gets the
    nearest language.  Repeated rows come back repeated.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                names, score, rejected = _judged(part.column(2), model)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "mark", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id long, mark long, lang_pred string, score double, rejected boolean")


def accepted_documents(docs: DataFrame, model: Centroids | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, columns and repeats unchanged.

    Whole rows pass through the tasks that judge their texts; nothing is shuffled.
    """
    at_text = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                yield part.filter(pa.array(~_judged(part.column(at_text), model)[2]))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark, sf_dir):
    """Columns: doc_id, held_out, lang_pred, score, rejected, one row for each row of ``documents``.

    Null, empty and letterless texts are ``und`` with score 0; long texts are read
    whole; of equal cosines the first label's centroid wins; repeated rows come back
    repeated; an empty table gives no row; other columns are not read.
    """
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), _held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")
