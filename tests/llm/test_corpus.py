"""Each corpus operator against a brute-force version, on small tables with awkward rows."""

import calendar
import collections
import datetime
import hashlib
import math
import os
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import chat, exact, langid, licenses, mixing, ordermin, packing, pii, repeats, shared, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]")


def table(spark, rows, extra=""):
    """Rows of (doc_id, text) or (doc_id, text, source); with clashing extra columns on demand."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for name in extra.split():
        df = df.withColumn(name, F.lit("x"))
    return df


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = words(rng, 40)
    for i in range(40, 60):
        a, b = words(rng, 20), words(rng, 15)
        rows.append((i, f"{a} {passage} {b}"))
    rows += [(60 + k, base[k].upper() if k % 2 else base[k].replace(" ", "  ")) for k in range(6)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (None, base[1]), (73, base[2]), (73, base[2]), (74, "é" * 80), (75, "x" * 30_000), (76, "x" * 30_000 + "y")]
    return rows


EMPTY = []
CLASH = "key id mark kept won m digest fp words taken copy rest salt bucket nth w0 __key __nth"


# -- exact ---------------------------------------------------------------------


def test_exact(spark, corpus):
    got = exact.exact_groups(table(spark, corpus, CLASH)).collect()
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[SPACES.sub("", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        seen = False
        for m in members:
            kept = m == best and not seen
            seen = seen or kept
            want.append((m[2], best[2], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_rows_that_stay(spark, corpus):
    docs = table(spark, corpus, CLASH)
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns
    texts = [SPACES.sub("", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({SPACES.sub("", t or "") for _, t in corpus})
    assert exact.exact_groups(table(spark, EMPTY)).count() == 0 and exact.drop_exact_copies(table(spark, EMPTY)).count() == 0


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(exact, "_STEP", 4)
    got = exact.exact_groups(table(spark, [(1, "a b")] * 11 + [(2, "ab")])).collect()
    assert len(got) == 12 and all(r["group_size"] == 12 and r["keep_id"] == 1 for r in got) and sum(r["kept"] for r in got) == 1


def test_equal_digest_is_not_enough(spark):
    """Contents that differ stay apart in every stage even under one salt."""
    docs = table(spark, [(1, "a b"), (2, "ab"), (3, "abc")])
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(docs, salts=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# -- simhash -------------------------------------------------------------------


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def slow_components(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                group[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(prints):
        low[find(k)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in low.items()}
    return [(i, f"{p:016x}", least[find(k)]) for k, (i, p) in enumerate(prints)]


def test_simhash(spark, corpus):
    got = [(r["id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(table(spark, corpus, CLASH)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow_components(corpus)))
    assert simhash.simhash_components(table(spark, EMPTY)).count() == 0


def test_xxhash_matches(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket", [0, 3, 48])
def test_links_join_what_two_bits_join(spark, bucket):
    rng = random.Random(3)
    marks = {rng.getrandbits(64) for _ in range(60)}
    for x in list(marks)[:25]:
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            marks.add(x ^ (1 << rng.randrange(64)))
    marks = sorted(marks)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in shared.components(simhash.links(df, bucket)).collect()}
    group = {m: m for m in marks}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in marks:
        for b in marks:
            if a < b and bin(a ^ b).count("1") <= 2:
                group[find(a)] = find(b)
    for a in marks:
        for b in marks:
            together = a == b or (a in roots and b in roots and roots[a] == roots[b])
            assert together == (find(a) == find(b))


def slow_near(rows):
    """Component of each row by similarity of all pairs of five-word shingle sets."""
    sets = [slow_sets(t or "") for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[find(k)].append(i)
    return [(i, min((x for x in low[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_near_copies_leave_one_each(spark, corpus):
    docs = table(spark, corpus, CLASH)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    want = collections.Counter(c for _, c in slow_near(corpus))
    assert out.count() == len(want) and {r["doc_id"] for r in out.collect()} == set(want)
    assert simhash.drop_near_copies(table(spark, EMPTY)).count() == 0


def slow_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("neighbours", [2, 24])
def test_planted_near_copies_go(spark, neighbours):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(60, 200), 5000)) for i in range(40)]
    for i in range(25):  # one or two words changed, and a family of copies of one text
        for c in range(1 if i else 12):
            w = rows[i][1].split()
            for _ in range(1 + c % 2):
                w[rng.randrange(len(w))] = f"new{i}x{c}"
            rows.append((100 + 20 * i + c, " ".join(w)))
    sets = {i: slow_sets(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = {r["id"]: r["component_id"] for r in simhash.near_components(table(spark, rows, CLASH), neighbours=neighbours).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(rows) - 15


def test_a_large_family_needs_few_pairs(spark, monkeypatch):
    """The closest pairs first, then those between components: the components of all pairs."""
    rng = random.Random(21)
    base, rows = words(rng, 120, 9000).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, words(rng, 80, 9000)) for i in range(10)]
    asked, plain = [], simhash._verified
    full = simhash.joined
    monkeypatch.setattr(simhash, "joined", lambda *a: full(*a, sparse=1))
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: asked.append(pairs.count()) or plain(pairs, *a))
    got = {r["id"]: r["component_id"] for r in simhash.near_components(table(spark, rows)).collect()}
    few = sum(asked)
    want = dict(slow_near(rows))
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    monkeypatch.setattr(simhash, "joined", lambda *a: full(*a, sparse=1 << 20))  # all pairs at once
    assert got == {r["id"]: r["component_id"] for r in simhash.near_components(table(spark, rows)).collect()} and few < 0.6 * (sum(asked) - few)


# -- language ------------------------------------------------------------------


def test_language_learns_and_holds_out(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ka", "ko", "ki", "ta"], "bb": ["sch", "und", "ein", "ger"], "cc": ["eau", "oui", "ère", "que"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(rng.randrange(5, 60))), k) for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (None, "kakoki tako", None)]
    df = spark.createDataFrame([(a, b, c, "s", 0) for a, b, c in rows], SCHEMA)
    out = {r["id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    tested = [(out[i]["lang_pred"], k) for i, t, k in rows if i is not None and i < 900 and langid.held_out(i)]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (900, 901, 902))
    assert out[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in out.values())
    flipped = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    same = {r["id"]: r["lang_pred"] for r in langid.predict(df, langid.train(flipped)).collect()}
    assert same == {i: r["lang_pred"] for i, r in out.items()}
    assert langid.accepted_documents(df, langid.train(df)).columns == df.columns


def slow_language(model, text):
    """Label, cosine and rejection by dictionaries of grams and sums over one centroid at a time."""
    low = (text or "").lower().encode()
    low = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low) + b" "
    n, d = collections.Counter(), langid.DIMENSIONS
    for k in range(len(low) - 1):
        if low[k : k + 2] != b"  ":
            n[((low[k] * 257 + low[k + 1]) * 2654435761 % (1 << 32) >> 17) % d] += 1
            if k + 2 < len(low) and low[k + 1] != 32:
                n[((low[k] * 257 + low[k + 1]) * 8191 + low[k + 2]) * 2246822519 % (1 << 32) // (1 << 15) % d] += 1
    v = {g: math.log1p(c) * float(model.weights[g]) for g, c in n.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    near = [sum(x * float(row[g]) for g, x in v.items()) / norm for row in model.vectors]
    best = max(range(len(near)), key=near.__getitem__)
    size = max(0, sum(sum(n.values()) >= s for s in langid.SIZES) - 1)
    return model.languages[model.owner[best]], near[best], 1 - near[best] > model.limit[best, size], near


def test_language_against_slow_cosines(spark):
    rng = random.Random(15)
    kinds = {"aa": "ka ko ki ta", "bb": "sch und ein ger", "cc": "eau oui ère que"}
    rows = [(i, " ".join("".join(rng.choices(v.split(), k=3)) for _ in range(rng.randrange(1, 60)))) for i, v in enumerate(list(kinds.values()) * 50)]
    df = table(spark, [*rows, (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (400, "x" * 9_000_000), (401, "Tako, KAKI 7 щюъ")], CLASH).withColumn("lang", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 3 + 1).cast("int")))
    model = langid.train(df)
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    got = collections.Counter((r["id"], r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert sum(got.values()) == df.count() and sum(c for (i, _), c in got.items() if i == 3) == 3
    out = {r["id"]: r for r in langid.predict(df, model).collect()}
    for i, t in texts:
        if i == 400:
            continue
        label, cosine, far, near = slow_language(model, t)
        assert out[i]["score"] == pytest.approx(cosine, abs=1e-4) and (out[i]["lang_pred"] == label or sorted(near)[-1] - sorted(near)[-2] < 1e-4)
        assert out[i]["rejected"] == far
    kept = langid.accepted_documents(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r["rejected"] for r in langid.predict(df, model).collect())


def test_many_labels_are_no_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    monkeypatch.setattr(langid, "TEXTS", 10)
    df = table(spark, [(i, f"ka ko text {i}") for i in range(90)]).withColumn("lang", (F.col("doc_id") % 30).cast("string"))
    model = langid.train(df)
    assert len(model.languages) == 5 and langid.training_sample(df, "doc_id", "text", "lang", 600).count() <= 10


def test_language_rejects_what_is_far(spark):
    rng = random.Random(1)
    df = table(spark, [(i, " ".join("".join(rng.choices(["ka", "ko", "ki"], k=3)) for _ in range(30))) for i in range(60)])
    far = table(spark, [(1, "щюъ эйц жзь чыв " * 20), (2, "kako kiko kaka")])
    out = {r["id"]: r["rejected"] for r in langid.predict(far, langid.train(df)).collect()}
    assert out == {1: True, 2: False}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_unlearned_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = langid.train(docs), random.Random(4)
    far = [
        "в чащах юга жил бы цитрус и фальшивый экземпляр рос около дома где люди читали книги ",
        "كان الرجل يقرأ الكتاب في البيت الكبير قرب النهر ",
        "ο άνθρωπος διάβαζε το βιβλίο στο μεγάλο σπίτι κοντά στο ποτάμι ",
        "mies luki kirjaa suuressa talossa joen lähellä ja ajatteli että huomenna sataisi lunta koko päivän ",
        "mężczyzna czytał książkę w dużym domu nad rzeką i myślał że jutro będzie padał śnieg przez cały dzień ",
        "adam nehrin yanındaki büyük evde kitap okuyordu ve yarın bütün gün kar yağacağını düşünüyordu ",
    ]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        far.append(" ".join("".join(rng.choices(letters, k=rng.randrange(2, 12))) for _ in range(40)) + " ")
    out = langid.predict(table(spark, [(i, t * 4) for i, t in enumerate(far)]), model)
    assert out.where("rejected").count() == len(far)
    clean = langid.predict(docs.where(langid._held_out(F.col("doc_id")) & F.col("text").rlike("[a-z]")), model)
    assert clean.where("rejected").count() <= 0.02 * clean.count()


def test_language_fit_holds_one_language_at_a_time(spark):
    """The driver spreads out the counts of one language's texts, not of all: 640 texts are 10 MB."""
    rows = [(i, f"{chr(97 + i % 16)} text of {chr(98 + i % 16) * 3} {i}", f"l{i % 16:02}", f"lang{i % 16:02}") for i in range(960)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    tracemalloc.start()
    model = langid.train(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 16 and model.vectors.shape[1] == langid.DIMENSIONS
    assert peak < 8e6


def test_language_without_labels_or_rows(spark):
    empty = table(spark, EMPTY)
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    one = langid.predict(table(spark, [(1, "abc")]), None).first()
    assert (one["lang_pred"], one["rejected"]) == ("und", True)


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "abc déf " * 500
    data, ends = langid._utf8(pa.array([text]))
    whole = langid._counts(data, ends, 512)
    monkeypatch.setattr(langid, "_BYTES", 64)
    assert np.allclose(whole, langid._counts(data, ends, 512))


# -- mixing --------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            budget -= target[s]
            open_.discard(s)
    return target


def mixed_rows():
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "c", "dé", None])) for i in range(160)]
    return rows + [(500, None, "a"), (501, "  ", None), (502, "one two", "tiny"), (503, "", "empty"), (7, "again again", "b"), (7, "again again", "b"), (None, "no id", "c")]


def test_mixing(spark):
    rows = mixed_rows()
    got = mixing.mix(table(spark, rows, CLASH)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = slow_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == sum(sizes.values())  # the whole budget and no word more
    assert all(abs(taken[s] - target[s]) <= 1 + len(sizes) for s in sizes)
    queue = {(r["id"], r["mark"], r["range"], r["nth"]): r["taken"] for r in got}
    assert queue == slow_queue(got, target, sizes)
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, again)))


def slow_queue(rows, target, sizes, repeats=3):
    """What each row gets: every word by its finish time, all sources in one list, cut at the budget."""
    line = []
    for s in sizes:
        at = 0
        queue = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["range"], r["nth"]))
        for r in queue * repeats:
            for _ in range(r["size"]):
                at += 1
                line.append((at / target[s], s is not None, s or "", at, (r["id"], r["mark"], r["range"], r["nth"])))
    got = collections.Counter(x[-1] for x in sorted(line, key=lambda x: x[:4])[: sum(sizes.values())])
    return {k: got[k] for k in ((r["id"], r["mark"], r["range"], r["nth"]) for r in rows)}


def test_the_budget_cuts_the_queue(spark, monkeypatch):
    """Queues go on past their targets: without the truncation every source gets more."""
    docs = table(spark, mixed_rows())
    cut = {(r["id"], r["mark"], r["nth"]): r["taken"] for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "_truncated", lambda position, offered, budget: offered)
    free = {(r["id"], r["mark"], r["nth"]): r["taken"] for r in mixing.mix(docs).collect()}
    assert cut != free and all(cut[k] <= free[k] for k in cut) and sum(cut.values()) < sum(free.values())


def test_rows_without_ids_are_dealt_by_text(spark):
    rows = mixing.schedule(table(spark, [(None, f"text {i}", "a") for i in range(60)])).collect()
    assert len({r["range"] for r in rows}) > 40


def test_long_documents_queue_in_pieces(spark, monkeypatch):
    """A source of one long document comes near a target below its size, whatever the size of pieces."""
    rows = [(1, "w " * 3000, "z"), *[(10 + i, "u v w x", "a") for i in range(200)]]
    for pieces in (1 << 12, 50):
        monkeypatch.setattr(mixing, "PIECES", pieces)
        got = mixing.mix(table(spark, rows)).collect()
        one = next(r for r in got if r["id"] == 1)
        assert abs(one["taken"] - one["target"]) <= one["target"] / pieces + 3 and sum(r["taken"] for r in got) == 3800


def test_mix_is_a_queue(spark):
    q = sorted(((r["position"], r["words"], r["finish"]) for r in mixing.schedule(table(spark, mixed_rows())).where("words > 0").collect()))
    at = 0
    for position, n, _ in q:
        assert position == at
        at += n
    assert [f for _, _, f in q] == sorted(f for _, _, f in q)


def test_mixed_documents(spark):
    rows = mixed_rows()
    docs = table(spark, rows, CLASH)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r["source"]] += len((r["text"] or "").split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert sum(got.values()) == sum(sizes.values()) and all(abs(got[s] - slow_targets(sizes)[s]) <= 1 + len(sizes) for s in sizes)
    assert mixing.mix(table(spark, EMPTY)).count() == 0 and mixing.mixed_documents(table(spark, EMPTY)).count() == 0


def test_mixing_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPANS", (2, 4))  # few ranges and slots: the same mix
    rows = [*mixed_rows(), (900, "long " * 300_000, "a"), (901, "x" * 2_000_000, "b")]
    few = mixing.mix(table(spark, rows)).collect()
    monkeypatch.undo()
    assert sorted(map(repr, map(tuple, [(r["id"], r["taken"], r["first_position"]) for r in few]))) == sorted(map(repr, [(r["id"], r["taken"], r["first_position"]) for r in mixing.mix(table(spark, rows)).collect()]))
    assert max(r["size"] for r in few) == 300_000


def test_blank_corpus(spark):
    got = mixing.mix(table(spark, [(1, ""), (2, None)])).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0)] * 2


# -- licenses ------------------------------------------------------------------


def slow_base(text):
    w = licenses.words_of(text)
    spots = []
    for p in licenses.PHRASES:
        q = p.split()
        spots += [(k, licenses.PHRASES[p]) for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
    return len(w), len(spots), min((k for k, _ in spots), default=None), max((k for k, _ in spots), default=None), ",".join(sorted({x for _, x in spots}))


def slow_labels(text, notices=None):
    """Labels of the notices that some block holds, and the largest part, counted in every block."""
    w, out, best = licenses.words_of(text), set(), 0.0
    for n in notices or licenses.NOTICES:
        q = licenses.words_of(n.text)
        s, step = set(q), max(1, len(q) // 4)
        for k in range(0, len(w), step):
            b = set(w[k : k + len(q) + 2 * step - 1])
            if len(s & b) >= 0.8 * len(s) and b >= set(n.must.split()) and not b & set(n.never.split()):
                out.add(n.label)
                best = max(best, len(s & b) / len(s))
    return out, best


def test_licenses(spark, corpus):
    rng = random.Random(2)
    bits = [n.text for n in licenses.NOTICES] + list(licenses.PHRASES)
    rows = list(corpus)
    for i in range(90):
        t = rng.choice(bits).split()
        if i % 3 == 1:
            for _ in range(1 + len(t) // 8):
                t[rng.randrange(len(t))] = f"other{i}"
        if i % 3 == 2:
            rng.shuffle(t)
        rows.append((200 + i, f"{words(rng, rng.randrange(0, 90))} {rng.choice([' ', '-', ', '])}{' '.join(t).upper()}. {words(rng, 30)}"))
    rows += [(400, "CC BY-NC; cc_by nc cc by nc"), (401, "under the MİT license"), (402, "worK K İ under the mit license"), (403, "mit"), (404, "a\x00b{c}d~é\x7f")]
    rows += [(405, " and ".join(n.text for n in licenses.NOTICES)), *[(None, licenses.NOTICES[4].text)] * 3]
    got = licenses.license_scan(table(spark, rows, CLASH)).collect()
    by = collections.defaultdict(list)
    for i, t in rows:
        by[i].append(t)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        base = slow_base(by[r["doc_id"]][0])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        labels, best = slow_labels(by[r["doc_id"]][0])
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, base[4].split(",")))))
        assert r["score"] == (1.0 if base[1] else best)
    assert sum(r["doc_id"] is None and r["labels"] == "mit" for r in got) == 3
    assert licenses.license_scan(table(spark, EMPTY)).count() == 0


def test_notices_are_told_apart(spark):
    """Each notice gets its own label alone; what only looks like one gets none."""
    rows = [(i, "a word before " + n.text + " and after it") for i, n in enumerate(licenses.NOTICES)]
    near_miss = [
        "This dataset is licensed under CC BY 4.0", "Licensed under the GPL License, version 2.0", "released under the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 2", "the mit group released a license manager under review", "CC BY-SA 4.0 licensed under",
        "released in spring, the film ran " + "long " * 30 + "under the title that a license of mit had",
    ]
    rows += [(1000 + i, t) for i, t in enumerate(near_miss)]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert all(got[i][0] == n.label for i, n in enumerate(licenses.NOTICES))
    assert all(got[1000 + i] == ("", "") for i in range(len(near_miss)))


# -- order minhash -------------------------------------------------------------


def slow_order(text, sketches=64, width=2, k=3):
    """A fingerprint by its definition: each sketch sorts all numbered k-mers in an order of its own."""
    full = (1 << 64) - 1
    long = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x & full), seed)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] or ([[" ".join(w)]] if w else [])
    if not grams:
        return "0" * 4 * sketches
    elements, seen = [], collections.Counter()
    for place, g in enumerate(grams):
        h = 42
        for x in g:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        h &= full ^ 0xFFFFFF
        nth = seen[h]
        seen[h] += 1
        elements.append((xxhash.xxh64_intdigest(struct.pack("<i", nth), long(h, 42)) & (full ^ 0xFFFFFF) if nth else h, place))
    out = ""
    for j in range(sketches):
        upper = ((j - sketches // 2) & full) << (65 - sketches.bit_length()) & full
        least = sorted(elements, key=lambda e: (e[0] ^ upper, e[1]))[:width]
        h = 42
        for x, _ in sorted(least, key=lambda e: e[1]):
            h = long(x >> 24, h)
        out += f"{h >> 48:04x}" if h >> 48 else "0001"
    return out


def slow_likeness(a, b):
    return 1.0 if a == b else sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def test_order_minhash(spark, corpus):
    rng = random.Random(12)
    corpus = [*corpus, *[(None, words(rng, rng.randrange(0, 40), 9)) for _ in range(12)], (None, None), (78, "a b c " * 700), (79, "a\tb\x0bc\r\nd \x0c e")]
    got = ordermin.edited_fingerprints(table(spark, corpus, CLASH)).collect()
    turn = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    order = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0, 0 if r[0] is not None else turn(r[1]), r[1] or ""))
    want, prints = [], [slow_order(t) for _, t in order]
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        e = slow_order(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k], e, slow_likeness(prints[k], e), slow_likeness(prints[k], prints[(k + 1) % len(order)])))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    long_ones = [r for r in got if r["n_chars"] > 200 and r["doc_id"] is not None and r["doc_id"] < 40]
    assert sum(r["near_edited"] for r in long_ones) > sum(r["near_next"] for r in long_ones)


@pytest.mark.parametrize("packed", [0, 5])
def test_elements_of_long_texts_are_the_same(spark, corpus, packed):
    both = table(spark, corpus).select(ordermin.fingerprint(F.col("text")).alias("a"), ordermin.fingerprint(F.col("text"), packed=packed).alias("b"))
    assert both.where("a <> b").count() == 0


def test_null_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "VOID_ROWS", 4)
    rng = random.Random(13)
    rows = [(None, words(rng, 12, 50)) for _ in range(60)] + [(1, "x"), (2, None)]
    beside = ordermin.beside_next(table(spark, rows)).where("ghost = 0").collect()
    turn = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    line = ["x", "", *sorted((t for i, t in rows if i is None), key=turn)]
    assert {(r["text"], r["next_text"]) for r in beside} == {(t, line[(k + 1) % len(line)]) for k, t in enumerate(line)}
    assert len({r["bucket"] for r in beside}) > 8


def test_order_matters_and_occurrences_count(spark):
    rng = random.Random(4)
    a = words(rng, 300, 3000).split()
    rows = [(1, " ".join(a)), (2, " ".join(a[:150] + ["zz"] + a[150:])), (3, " ".join(a[150:] + a[:150])), (4, " ".join(sorted(a)))]
    f = {r["doc_id"]: r["f"] for r in table(spark, rows).select("doc_id", ordermin.fingerprint(F.col("text")).alias("f")).collect()}
    near = lambda x, y: sum(f[x][i : i + 4] == f[y][i : i + 4] for i in range(0, len(f[x]), 4))
    assert near(1, 2) > near(1, 3) > near(1, 4)
    d = spark.createDataFrame([(1, "a b c"), (2, "a b c a b c")], "i int, t string").select(ordermin._numbered(ordermin._hashes(F.col("t"), 3)).alias("n"))
    assert [len(set(r["n"])) for r in d.collect()] == [1, 4]
    few = spark.createDataFrame([(0, "a b c d e f g"), (1, "g f e d c b a")], "i int, t string").select(ordermin.fingerprint(F.col("t"), k=1).alias("f")).collect()
    assert slow_likeness(few[0]["f"], few[1]["f"]) < 0.5  # the same few elements in another order


@pytest.mark.parametrize("n", [1, 2, 5, 16, 40])
def test_place_among_cuts(spark, n):
    rng = random.Random(n)
    cuts = sorted(rng.sample(range(-50, 50), n))
    got = spark.range(-55, 55).select("id", ordermin._place(F.col("id"), cuts).alias("p")).collect()
    assert all(r["p"] == sum(c < r["id"] for c in cuts) for r in got)


def test_single_document_is_its_own_next(spark):
    r = ordermin.edited_fingerprints(table(spark, [(5, "one two three four")])).first()
    t = "one two three four"
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256((t[:9] + t[:9]).encode()).hexdigest()
    assert ordermin.edited_fingerprints(table(spark, EMPTY)).count() == 0


# -- packing -------------------------------------------------------------------


def packed_is_right(spark, rows, out):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    seq, pieces = collections.defaultdict(list), collections.Counter()
    for r in out:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 4096
    total = sum(len(x) for _, x in ids)
    assert sum(n * c for (_, _, n, _, _), c in pieces.items()) == total
    for i, x in ids:  # every document's ids are covered by pieces of it
        at = 0
        while at < len(x):
            k = next(p for p in pieces if p[0] == i and p[1] == at and p[4] == len(x) and pieces[p] and p[3] == zlib.crc32(np.array(x[at : at + p[2]], "<u4").tobytes()))
            pieces[k] -= 1
            at += k[2]
    assert not +pieces
    return (4096 * len(seq) - total) / max(1, total), seq


def test_packing(spark, corpus):
    rng = random.Random(8)
    rows = [*corpus, *[(1000 + i, words(rng, rng.randrange(1, 2500))) for i in range(60)], (2000, "Don't <|endoftext|> ½ é́ 　x \x1c 'll")]
    padding, seq = packed_is_right(spark, rows, packing.pack(table(spark, rows, CLASH)).collect())
    assert 4096 * len(seq) - sum(n for p in seq.values() for _, n in p) < 4096 and sorted(seq) == list(range(len(seq)))
    assert packing.pack(table(spark, EMPTY)).count() == 0


def test_plan_fills_windows():
    rng = random.Random(6)
    histogram = collections.Counter(rng.randrange(1, 100) for _ in range(5000)) + collections.Counter({50: 9000, 1: 300, 99: 1})
    made = packing.plan(dict(histogram), window=100)
    used = collections.defaultdict(list)
    for n, c in histogram.items():
        for rank in range(c):
            at = 0
            for start, size, seq, offset in sorted(made.pieces(n, rank)):
                assert start == at
                at += size
                used[seq].append((offset, size))
            assert at == n
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100
    assert len(used) == made.sequences == math.ceil(sum(n * c for n, c in histogram.items()) / 100)


def test_plan_does_not_grow_with_counts():
    """Lengths that fill no window have few runs however many documents have them."""
    for histogram in ({3000: 10**9}, {2500: 200_000, 2600: 200_000, 2700: 200_000}, {n: 10**6 + 7 * n for n in range(3900, 4096)}):
        made = packing.plan(histogram)
        assert sum(map(len, made.runs.values())) <= 3 * len(histogram) ** 2
        assert made.sequences == math.ceil(sum(n * c for n, c in histogram.items()) / 4096)
    seen = collections.defaultdict(list)
    made = packing.plan({3000: 500, 700: 90, 4095: 11})
    for n, c in ((3000, 500), (700, 90), (4095, 11)):
        for rank in range(c):
            parts = made.pieces(n, rank)
            assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]]
            for _, size, seq, offset in parts:
                seen[seq].append((offset, size))
    for parts in seen.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(max(o + n for o, n in p) < 4096 for p in seen.values()) <= 1


@pytest.mark.parametrize("rows", [3, 1000])
def test_packing_of_hot_lengths(spark, rows):
    same = [(i % 50 if i % 3 else None, "one two three " * 10) for i in range(150)]
    packed_is_right(spark, same, packing.pack(table(spark, same), rows=rows).collect())


def test_least_squares_solution():
    cols = [{3: 1, 7: 1}, {5: 2}]
    assert packing.solve({3: 4, 7: 4, 5: 6}, cols) == pytest.approx([4, 3], abs=0.01)


# -- repeats -------------------------------------------------------------------


def slow_repeats(rows):
    seen, out = {}, []
    spread = collections.defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            spread[b[k : k + 50]].add(math.inf if i is None else i)
    low = {s: min(v) for s, v in spread.items()}
    for i, t in rows:
        b, mine = (t or "").encode(), math.inf if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < mine:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, kept))
    del seen
    return out


@pytest.mark.parametrize(("bits", "part_bytes"), [(3, 20_000), (27, 20_000), (31, 300), (None, 1000)])
def test_repeats(spark, corpus, bits, part_bytes):
    got = repeats.remove_repeats(table(spark, corpus, CLASH), bits=bits, part_bytes=part_bytes).collect()
    have = [(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, slow_repeats(corpus)))
    assert repeats.remove_repeats(table(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("depth", [5, 16, 17, 50])
def test_suffix_order(depth):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    at = np.arange(len(data) - depth)
    order, group = repeats.sort_suffixes(data, at, depth)
    keys = [data[p : p + depth].tobytes() for p in at[order]]
    assert keys == sorted(keys)
    assert [int(a != b) for a, b in zip(keys, keys[1:])] == np.diff(group).tolist()


def test_every_string_has_one_run():
    rng = np.random.default_rng(1)
    for n in (0, 10, 49, 50, 51, 400):
        s = repeats.strings(rng.integers(97, 100, n).astype(np.uint8))
        starts = [k for a, b in zip(s.first, s.last) for k in range(a, b + 1)]
        assert starts == list(range(max(0, n - 49)))


@pytest.mark.parametrize("letters", [2, 3, 26])
def test_equal_strings_share_a_context(letters):
    """Of two runs with an equal string one is unsure or their left or right hashes agree."""
    rng = np.random.default_rng(letters)
    a = rng.integers(97, 97 + letters, 600).astype(np.uint8)
    b = np.concatenate((rng.integers(97, 97 + letters, 40).astype(np.uint8), a[100:170], rng.integers(97, 97 + letters, 40).astype(np.uint8), a[300:351], a[:55]))
    held = {}
    for data in (a, b):
        s = repeats.strings(data)
        for k in range(len(s.first)):
            for at in range(s.first[k], s.last[k] + 1):
                held.setdefault(data[at : at + 50].tobytes(), []).append((s.anchor[k], s.left[k], s.right[k], s.unsure[k]))
    for runs in held.values():
        for x in runs[1:]:
            y = runs[0]
            assert x[0] == y[0] and ((x[3] and y[3]) or (x[1] == y[1] != 0) or (x[2] == y[2] != 0))


def test_texts_together_or_alone():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 3, 49, 50, 51, 200, 0, 120, 49, 300)]
    together = repeats.strings(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    begins = np.cumsum([0, *[len(t) for t in texts]])
    got = [(int(t), int(a - begins[t]), int(z - begins[t]), h, l, r, u) for a, z, h, l, r, u, t in zip(together.first, together.last, together.anchor, together.left, together.right, together.unsure, together.text)]
    want = []
    for k, t in enumerate(texts):
        s = repeats.strings(t)
        want += [(k, int(a), int(z), h, l, r, u) for a, z, h, l, r, u in zip(s.first, s.last, s.anchor, s.left, s.right, s.unsure)]
    assert got == want


def test_packed_numbers():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(0, 1 << 32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert (repeats._unpacked(repeats._packed(n)) == n).all() and len(repeats._unpacked(repeats._packed(n[:0]))) == 0


def test_chunks_hold_every_string(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 70)
    data = np.arange(400, dtype=np.int64).astype(np.uint8)
    seen = [at + k for at, piece in repeats._chunks(data) for k in range(len(piece) - 49)]
    assert sorted(seen) == list(range(351))


@pytest.mark.parametrize("parts", [82, 4769, 64])
def test_hashes_keep_their_place_at_part_edges(parts):
    edges = [(p << 64) // parts + d for p in range(1, parts) for d in (-2, -1, 0, 1, 2)]
    h = np.array(sorted(edges), np.uint64)
    part, inside = repeats._dealt(h, parts)
    assert [int(p) for p in part] == [((int(x) * parts) >> 32) >> 32 for x in h]
    assert (((part << np.uint64(32)) + inside) // np.uint64(parts) == h >> np.uint64(32)).all()


# -- pii -----------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = "a 4465758382889437, +1 (743) 555-3824; 743-555-3824 123-45-6789 70.23.22.57 2024-02-29 29.02.2024 31/12/1999 x.19@mail5.example.com 1234567890123456 300.1.1.1 2023-02-30 666-12-1234"
    docs = table(spark, [(1, text), (2, "card 4465 7583 8288 9437"), (3, None), (4, ""), (5, "no digits"), (6, text)], CLASH)
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs).collect()}
    assert pii.pseudonymise(docs).columns == docs.columns
    assert out[3] is None and out[4] == "" and out[5] == "no digits" and out[1] == out[6]
    card = re.search(r"a (\d{16}),", out[1])[1]
    assert card != "4465758382889437" and luhn(card) and out[2] == "card " + " ".join(card[k : k + 4] for k in (0, 4, 8, 12))
    phone = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}); (\d{3})-(\d{3}-\d{4})", out[1])
    assert phone and phone[1] == phone[3] and phone[2] == phone[4] and phone[1][0] in "23456789" and phone[2][0] in "23456789"
    for gone in ("555-3824", "123-45-6789", "70.23.22.57", "2024-02-29", "29.02.2024", "31/12/1999", "x.19@"):
        assert gone not in out[1]
    for stays in ("1234567890123456", "300.1.1.1", "2023-02-30", "666-12-1234", "@mail5.example.com"):
        assert stays in out[1]
    iso = re.search(r"\d{4}-\d{2}-\d{2}(?= )", out[1])[0]
    assert ".".join(reversed(iso.split("-"))) in out[1]


def test_cards_beside_other_numbers(spark):
    card = "4111111111111111"
    texts = [f"card {card} 12 items", f"room 12 {card} ok", f"{card}-2", f"1234 4111 1111 1111 1111 x", f"{card} 743-555-3824 {card}", f"{card} 70.23.22.57", f"{card} 4465758382889437"]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert re.sub(r"\d", "0", t) == re.sub(r"\d", "0", out[i]) or i == 5
        assert not any(x in out[i] for x in (card, "4111 1111 1111 1111", "743-555-3824", "70.23.22.57", "4465758382889437"))
    assert "12 items" in out[0] and "room 12 " in out[1]


def test_phones_of_every_class_change_one_to_one(spark):
    d = spark.range(3000).select(F.format_string("+1 (%03d) %03d-%04d", F.col("id") * 7 % 1000, F.col("id") * 13 % 1000, F.col("id")).alias("v"))
    got = [(r["v"], r["p"]) for r in d.select("v", pii.pseudonym(F.col("v")).alias("p")).collect()]
    assert len({p for _, p in got}) == 3000 and sum(v == p for v, p in got) <= 1
    assert all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p) and (v[4] in "01") == (p[4] in "01") for v, p in got)


def slow_feistel(a, b, na, nb, key, tweak, rounds=8):
    mixed = lambda i, half: int(hashlib.sha256(f"{key}|{tweak}|{na}|{nb}|{i}|{half}".encode()).hexdigest()[:15], 16)
    for i in range(rounds):
        if i % 2 == 0:
            a = (a + mixed(i, b)) % na
        else:
            b = (b + mixed(i, a)) % nb
    return a, b


def test_pseudonyms_against_another_network(spark):
    """Dates, addresses, cards and numbers abroad by a network written apart."""
    day0 = datetime.date(1900, 1, 1)

    def date(y, m, d):
        a, b = slow_feistel(*divmod((datetime.date(y, m, d) - day0).days, 4297), 17, 4297, "k", "date")
        return day0 + datetime.timedelta(days=a * 4297 + b)

    def month_first(y, m, d):
        a, b = (y - 1900) * 12 + m - 1, d - 13
        while True:
            a, b = slow_feistel(a, b, 2400, 19, "k", "month first")
            if b + 13 <= calendar.monthrange(1900 + a // 12, a % 12 + 1)[1]:
                return f"{a % 12 + 1:02d}/{b + 13:02d}/{1900 + a // 12}"

    ip = slow_feistel(70 * 256 + 23, 22 * 256 + 57, 65536, 65536, "k", "ipv4")
    abroad = slow_feistel(3090 - 1000, 1820, 9000, 10_000, "k", "abroad 49")
    body = slow_feistel(4465758, 38288943, 10**7, 10**8, "k", "card")
    body = f"{body[0]:07d}{body[1]:08d}"
    want = {
        "1999/12/31": date(1999, 12, 31).strftime("%Y/%m/%d"),
        "1999-12-31": date(1999, 12, 31).isoformat(),
        "05/06/2020": date(2020, 6, 5).strftime("%d/%m/%Y"),
        "12/31/2020": month_first(2020, 12, 31),
        "02/29/2024": month_first(2024, 2, 29),
        "70.23.22.57": ".".join(str(x) for h in ip for x in divmod(h, 256)),
        "+49 30 901820": f"+49 {str(abroad[0] + 1000)[:2]} {str(abroad[0] + 1000)[2:]}{abroad[1]:04d}",
        "0049 30 901820": f"0049 {str(abroad[0] + 1000)[:2]} {str(abroad[0] + 1000)[2:]}{abroad[1]:04d}",
        "4465758382889437": body + next(c for c in "0123456789" if luhn(body + c)),
        "13/32/2020": "13/32/2020",
    }
    d = spark.createDataFrame([(v,) for v in want], "v string").select("v", pii.pseudonym(F.col("v"), "k").alias("p"))
    assert {r["v"]: r["p"] for r in d.collect()} == want


def test_addresses_stay_different(spark):
    made = [f"{a}@x.org" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}@x.org" for a in "abcdefghij" for b in "0123456789"]
    d = spark.createDataFrame([(v,) for v in made], "v string").select("v", pii.pseudonym(F.col("v")).alias("p")).collect()
    assert len({r["p"] for r in d}) == len(made) and all(re.fullmatch("[a-z][0-9]?@x.org", r["p"]) for r in d)
    case = spark.createDataFrame([("Jo.Doe-7@X.org",), ("jo.doe-7@x.ORG",)], "v string").select(pii.pseudonym(F.col("v")).alias("p")).collect()
    assert case[0]["p"].lower() == case[1]["p"].lower() and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}-\d@X\.org", case[0]["p"])


def test_values_are_counted_when_they_change(spark):
    texts = ["1234567890123456 and 12/31/2020, +44 20 7946 0958 or 0044 20 7946 0958", "call +17435553824 = 743-555-3824", "2 + 2020 3000 is no number, 300.1.1.1 no address", None]
    out = {r["doc_id"]: r for r in pii.pseudonymise(table(spark, list(enumerate(texts))), count="n").collect()}
    assert [out[i]["n"] for i in range(4)] == [3, 2, 0, 0] and out[2]["text"] == texts[2]
    a, b = re.search(r"\+44 (.*) or 0044 (.*)", out[0]["text"]).groups()
    assert a == b and a != "20 7946 0958"
    assert re.sub(r"\D", "", out[1]["text"][5:17])[1:] == re.sub(r"\D", "", out[1]["text"][20:])


@pytest.mark.parametrize(("na", "nb"), [(7, 13), (10, 100), (17, 30)])
def test_feistel_is_a_permutation(spark, na, nb):
    d = spark.range(na * nb).select(pii.feistel(F.floor(F.col("id") / nb), F.col("id") % nb, na, nb, "k", "t").alias("p"))
    got = {(r["p"]["a"], r["p"]["b"]) for r in d.collect()}
    assert got == {(a, b) for a in range(na) for b in range(nb)}


def test_formats_are_permuted_one_to_one(spark):
    d = spark.range(400).select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("v"))
    got = [r[0] for r in d.select(pii.pseudonym(F.col("v"))).collect()]
    assert len(set(got)) == 400 and all(re.fullmatch(r"\d{3}-\d{2}-\d{4}", x) for x in got)
    assert all(x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] != "00" and x[7:] != "0000" for x in got)


def test_long_runs_do_not_blow_up(spark):
    docs = table(spark, [(1, "a" * 200_000), (2, "a.b" * 60_000 + "@"), (3, "1" * 100_000), (4, "@" + "a." * 50_000)])
    assert pii.pseudonymise(docs).where("text IS NOT NULL").count() == 4


# -- chat ----------------------------------------------------------------------


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["### ", "###", "#", "\\", "\\\\", "</turn>", "</turn", "\n", ":", "### Assistant: ", "ok", "é", "\n</turn>\n", "$1"]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\\b\nc:", "assistant"]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(0, 9)))])))
    rows += [(None, 0, "user", "x"), (30, None, "assistant", "late"), (30, 1, "assistant", "early"), (31, 5, "user", "same"), (31, 5, "user", "same")]
    back = chat.read_back(chat.chats(chat.linear_messages(conversations(spark, rows)))).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert len(back) == len(want)
    for b in back:
        turns = [(w[3], w[5]) for w in sorted(want[b["tree"]])]
        assert [(t["role"], t["text"]) for t in b["turns"]] == turns
        assert list(b["loss_texts"]) == [x for r, x in turns if r == "assistant"]
    assert chat.chats(chat.linear_messages(conversations(spark, []))).count() == 0


def test_chat_of_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "\\### </turn> " * 30_000), (1, 1, "assistant", "é\n</turn>\n" * 20_000)]
    extra = conversations(spark, rows).withColumns({c: F.lit("x") for c in ("tree", "leaf", "node", "depth", "p", "t", "up", "own", "all")})
    back = chat.read_back(chat.chats(chat.linear_messages(extra))).first()
    assert [t["text"] for t in back["turns"]] == [r[3] for r in rows] and list(back["loss_texts"]) == [rows[1][3]]


def test_branches_are_ranked(spark):
    nodes = [("t", 1, None, 0), ("t", 2, 1, 5), ("t", 3, 1, 4), ("t", 4, 3, 3), ("t", 5, 2, 0), ("t", 9, 77, 1), ("u", 1, 2, 1), ("u", 2, 1, 1)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score long")
    got = collections.defaultdict(list)
    for r in chat.reply_paths(df, branches=2).orderBy("leaf", "depth").collect():
        got[r["tree"], r["branch"], r["path_score"], r["leaf"]].append(r["node"])
    assert got == {("t", 1, 7, 4): [1, 3, 4], ("t", 2, 5, 5): [1, 2, 5], ("t", 1, 1, 9): [9]}


def test_long_chain(spark):
    df = spark.range(300).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).alias("score"))
    got = chat.reply_paths(df)
    assert got.count() == 300 and got.where("depth = node + 1 AND path_score = 300").count() == 300


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages_on_awkward_tables(spark, corpus):
    """Null ids, clashing extra columns and no rows at all pass through every stage."""
    import corpus_pipeline as cp

    for rows in (corpus[:12] + [(None, corpus[1][1]), (None, None)], []):
        docs = table(spark, rows, CLASH)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, "")
            if name != "packed":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), out.schema)
            else:
                assert (out.count() > 0) == bool(rows)


def test_pipeline_against_brute_force(spark, corpus):
    import corpus_pipeline as cp

    rows = [(i, t) for i, t in corpus if i is not None]
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, t, "en", rng.choice("abc"), len(t or "")) for i, t in rows], SCHEMA)
    assert [n for n, _ in cp.STAGES] == ["language", "exact_copies", "near_copies", "mixture", "packed"] and cp.ORACLE_SQL is None
    kept = cp.language(spark, docs, "")
    assert kept.columns == docs.columns
    langs = {r["id"] for r in langid.predict(docs, langid.train(docs)).where("rejected").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i not in langs}
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    once = cp.exact_copies(spark, kept, "")
    assert once.count() == len({SPACES.sub("", t or "") for _, t in left})
    near = cp.near_copies(spark, once, "")
    held = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert {r["doc_id"] for r in near.collect()} == {c for _, c in slow_near(held)}
    mixed = cp.mixture(spark, near, "")
    assert mixed.columns == docs.columns and mixed.where("n_chars <> length(text)").count() == 0
    final = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    packed_is_right(spark, final, cp.packed(spark, spark.createDataFrame([(i, t, "", "", 0) for i, t in final], SCHEMA), "").collect())
