"""Filter interactions, structure repair and token files against brute force, SQL and round trips."""

import io
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from loomgraph.llm import interactions, tokenfiles, turnrepair
from loomgraph.llm.packing import tokenizer_path

RND = random.Random(11)


def stored(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def by_sql(folder, sql, **names):
    con = duckdb.connect()
    for name in names:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    found = con.sql(sql)
    return sorted(map(repr, found.fetchall())), found.columns


# ---- filter interactions


def some_text():
    letters = [" ", "\n", "a", "b", "A", "é", "中", "$", "word ", "another ", "#", "\x0b", chr(0xA0)]
    return "".join(RND.choice(letters) for _ in range(RND.choice([0, 1, 4, 60, 900])))


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_scanner_counts_as_patterns_do(monkeypatch, block):
    monkeypatch.setattr(interactions, "BLOCK", block)
    scanner = interactions.Scanner()
    for _ in range(40):
        texts = [some_text() for _ in range(RND.randrange(1, 9))] + ["x" * 700 + " " + "x" * 700 + " " + "x" * 699 + "y"]
        column = pa.array(texts, pa.large_string())
        found = scanner.scan(np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1])
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            want = [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)]
            assert [int(found[k][i]) for k in ("words", "distinct", "capitals", "symbols", "chars")] == want


def test_colliding_word_hashes_are_told_apart():
    scanner = interactions.Scanner()
    scanner.values[:] = 5  # words of one length have one hash
    text = "aa bb aa cc bb a b " + "q" * 40 + "1 " + "q" * 40 + "2"
    data = np.frombuffer(text.encode(), np.uint8)
    assert scanner.scan(data, np.array([0, len(data)]))["distinct"].tolist() == [len(set(text.split()))]


def audit_rows():
    texts = [some_text() for _ in range(30)] + [None, "", "same words here", "Long " + "word%d " * 3, " ".join(f"w{i}" for i in range(260))]
    rows = [(i, RND.choice(texts), RND.choice(["en", "de", "", None]), "x", 1) for i in range(120)]
    rows += [(None, "same words here", "en", "x", 1), (None, "only void", "en", "x", 1), (None, "only void", "de", "x", 1)]
    rows += [(7, "twice", "en", "x", 1), (7, "twice", "en", "x", 1), (9, "twice", "de", "x", 1)]
    rows += [(1000 + i, "hot text", "fr", "x", 1) for i in range(90)] + [(5000, t, "en", "x", 1) for t in ("one id", "many texts", "same words here")]
    labels = [(i, RND.choice([0, 1, None]), RND.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (5000, 1, 0)]
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, mask string, salt int", "doc_id long, quality int, toxic int"


def test_interactions_match_brute_force_and_sql(spark, tmp_path):
    rows, labels = audit_rows()
    folder = stored(spark, tmp_path, documents=(rows, DOCS), labels=(labels, LABELS))
    found = interactions.op11_filter_interactions(spark, folder)
    mine = {(r["part"], r["filter_order"], r["step"]): r for r in found.collect()}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = any((u or "") == t and j is not None and (i is None or j < i) for j, u, *_ in rows)
        docs.append((lang or "", i, {k for k, v in fails.items() if v}))
    parts = {d[0] for d in docs}
    assert set(mine) == {(p, "".join(o), s) for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6)}
    shapley = {}
    for (part, order, step), r in mine.items():
        f, earlier = order[step - 1], set(order[: step - 1])
        own = [(i, x) for p, i, x in docs if p == part]
        gone = [i for i, x in own if f in x and not x & earlier]
        want = {
            "kept": sum(not x & (earlier | {f}) for _, x in own), "removed": len(gone), "redundant": sum(f in x and bool(x & earlier) for _, x in own),
            "unique_fails": sum(x == {f} for _, x in own), "good_lost": sum(i in good for i in gone), "toxic_lost": sum(i in toxic for i in gone),
        }
        assert {k: r[k] for k in want} == want
        shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in mine.items())
    theirs, columns = by_sql(folder, interactions.ORACLE, documents=1, labels=1)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in mine.values()) == theirs


def test_interactions_of_an_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, documents=([], DOCS), labels=([], LABELS))
    assert interactions.op11_filter_interactions(spark, folder).collect() == []


# ---- structure repair


def cheapest(signature):
    """Least (cost, edits) over all edit strings with at most two insertions in a row, by trying them."""
    best = []
    pattern = re.compile("(s?(ua)+)?")

    def go(i, cost, edits, roles):
        if pattern.fullmatch(roles) and i == len(signature):
            best.append((cost, edits, roles))
        if not edits.endswith("II"):
            for r in "ua":
                go(i, cost + 5, edits + "I", roles + r)
        if i == len(signature):
            return
        c = signature[i]
        go(i + 1, cost + 2, edits + "D", roles)
        if c != "x":
            more = 5 if c.isupper() else 0
            go(i + 1, cost + more, edits + "K", roles + c.lower())
            for r in "ua":
                go(i + 1, cost + more + 1, edits + "R", roles + r)

    go(0, 0, "", "")
    return min(best)


def test_edits_match_all_edit_strings():
    trie, all_of = turnrepair.Trie(), sorted("".join(p) for n in range(3) for p in itertools.product("xsuaoSUA", repeat=n))
    longer = sorted("".join(RND.choice("xsuaoSUA") for _ in range(3)) for _ in range(60))
    for s in all_of + longer:
        if s == longer[0]:
            assert trie.made == 8 + 64  # a layer for each node of the trie
        cost, audit, places, roles = trie.solve(s)
        want = cheapest(s)
        initials = "".join(r[0] if r else s[p - 1].lower() for p, r in zip(places, roles))
        assert (cost, audit, initials) == want, s


def test_a_long_conversation():
    cost, audit, places, roles = turnrepair.Trie().solve("s" + "ua" * 20_000 + "x")
    assert (cost, len(places), audit[-1], set(roles)) == (2, 40_001, "D", {""})


TURNS = "conv_id long, turn int, role string, text string, pos int, salt string"


def conversation_rows():
    says = ["Yes.", "No!", "", " \n", "cut off", "What? ", "Yes.", None, "same", "Ça va.\t"]
    roles = ["user", "assistant", "system", "tool", None, "User", "umpire"]
    rows = []
    for c in range(160):
        for t in range(RND.choice([0, 1, 2, 5, 9])):
            rows.append((c, t + RND.choice([0, 0, 0, 2]), RND.choice(roles[:2] * 4 + roles), RND.choice(says), 1, "x"))
    rows += [(None, 0, "user", "Hi.", 1, "x"), (None, None, "assistant", "Ho.", 1, "x"), (500, None, "user", "a.", 1, "x"), (500, None, "user", "a.", 1, "x")]
    for c in range(600, 700):
        rows += [(c, 3, "user", "One.", 1, "x"), (c, 4, "assistant", "Two.", 1, "x")]
    return rows


def test_repair_matches_sql(spark, tmp_path):
    folder = stored(spark, tmp_path, conversations=(conversation_rows(), TURNS))
    found = turnrepair.op12_structure_repair(spark, folder)
    theirs, columns = by_sql(folder, turnrepair.ORACLE, conversations=1)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == theirs


def test_damage_by_rule(spark):
    rows = [(c, t, "assistant", "A. b!", 0, "") for c in range(30) for t in range(5)] + [(None, None, None, None, 0, "")]
    out = turnrepair.damaged(spark.createDataFrame(rows, TURNS)).toPandas()
    for c, t, role, text, *_ in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = out[(out.conv_id.isna() if c is None else out.conv_id == c) & (out.turn.isna() if t is None else out.turn == t)]
        text = " " if text is None else text
        want = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        assert mine.alive.tolist() == [code != 0] * (2 if code == 3 else 1)
        assert set(mine.text) == {want} and set(mine.role) == {"user" if code == 4 else role or " "}


def test_repair_of_an_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, conversations=([], TURNS))
    assert turnrepair.op12_structure_repair(spark, folder).collect() == []


# ---- token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(tokenfiles.TOKENIZER))


ODD = [" ", " ", "\n", "\t", "\r", "a", "b", "Zé", "ß", "'s", "'ll", "'", "12", "²", "中", "<|endoftext|>", ".", "!!", "\x1c", "\x85", "_", "\0", "don't"]
ODD += [chr(c) for c in (0xA0, 0x2003, 0x200B, 0x1F600, 0x3000, 0xFEFF, 0x180E, 0x37E, 0xD7, 0x301)]


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    coder = tokenfiles.ByteEncoder(tokenizer_path(tokenfiles.TOKENIZER), cache=500)
    texts = ["".join(RND.choice(ODD) for _ in range(RND.randrange(14))) for _ in range(3000)]
    texts += ["".join(RND.choice([" ", "a", "\n", "bé", "1", "'s", "x."]) for _ in range(RND.randrange(9))) for _ in range(3000)]
    for text, ids in zip(texts, coder.many(pa.array(texts)), strict=True):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert ids.tolist() == want, repr(text)
        assert coder.ids(text).tolist() == want
    assert [i.tolist() for i in coder.many(pa.array([None, "", None], pa.string()))] == [[0]] * 3
    assert list(coder.many(pa.array([], pa.string()))) == []


def token_rows():
    rows = [(i * 3 % 101, "".join(RND.choice(ODD + ["word "] * 20) for _ in range(RND.randrange(80))), 1, "x") for i in range(101)]
    rows += [(None, "no id", 1, "x"), (50, None, 1, "x"), (51, "", 1, "x"), (200, "long text " * 9000, 1, "x"), (200, "same id", 1, "x")]
    return rows + [(300, "hot", 1, "x")] * 40


ROWS = "doc_id long, text string, part int, frame string"


@pytest.mark.parametrize("sizes", [{}, {"frame_ids": 64, "file_bytes": 400}])
def test_files_read_back(spark, tmp_path, tokenizer, sizes):
    rows = token_rows()
    docs, folder = spark.createDataFrame(rows, ROWS).repartition(5), f"{tmp_path}/ids"
    tokenfiles.write_token_files(docs, folder, **sizes)
    ids = {(k, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    found = sorted(tokenfiles.read_token_counts(spark, folder).collect(), key=lambda r: r["start"])
    key = lambda k: (k is not None, k or 0)
    assert [key(r["id"]) for r in found] == sorted(key(k) for k, *_ in rows)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    assert sorted((key(r["id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((key(k), len(ids[k, t]), crc(ids[k, t])) for k, t, *_ in rows)
    some = tokenfiles.read_tokens(spark, folder, [200, None, 51]).collect()
    assert sorted(crc(r["ids"]) for r in some) == sorted(crc(ids[k, t]) for k, t, *_ in rows if k in (200, None, 51))


def one_file(**sizes):
    maker, texts = tokenfiles.FileMaker(3, "<u2", **sizes), [np.arange(n, dtype="<u2") for n in (5, 40, 0, 64, 300, 7)]
    made = [x for n, ids in enumerate(texts) for x in maker.add(n, ids)] + list(maker.close())
    assert len(made) == 1
    return texts, made[0] + tokenfiles.CLOSING


def test_only_asked_frames_are_decompressed():
    texts, raw = one_file(frame_ids=64)
    f = tokenfiles.TokenFile(io.BytesIO(raw))
    assert f.ids(5).tolist() == texts[5].tolist() and f.decompressed == 1
    assert f.ids(4).tolist() == texts[4].tolist() and f.decompressed == 1 + 5
    assert len(f.firsts) - 1 == 1 + 1 + 5  # 5 + 40 ids, 64, 300, with the 7 in the last one's frame


def test_the_file_is_a_zstandard_file():
    import zstandard

    texts, raw = one_file(frame_ids=64)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(t.tobytes() for t in texts)


def test_damage_is_found():
    _, raw = one_file()
    table = raw.rindex(b"\x5e\x2a\x4d\x18")
    wrong = bytearray(raw)
    wrong[table + 8 + 8] ^= 1  # first frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        tokenfiles.TokenFile(io.BytesIO(bytes(wrong))).ids(0)
    with pytest.raises(ValueError, match="seek table"):
        tokenfiles.TokenFile(io.BytesIO(raw[:-1] + b"x"))


def test_token_files_query(spark, tmp_path, tokenizer):
    folder = stored(spark, tmp_path, documents=(token_rows(), ROWS))
    out = tokenfiles.op13_token_files(spark, folder).toPandas().sort_values("start")
    assert len(out) == len(token_rows()) and out.doc_id.dropna().is_monotonic_increasing and pd.isna(out.doc_id.iloc[0])


def test_token_files_of_an_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, documents=([], ROWS))
    assert tokenfiles.op13_token_files(spark, folder).collect() == []


# ---- near copies: recall can be asked for


def test_more_recall_and_distance_lose_no_version(spark):
    from loomgraph.llm import simhash

    rnd, vocabulary = random.Random(1), [f"w{i}" for i in range(5000)]
    versions = [[rnd.choice(vocabulary) for _ in range(300)]]
    while len(versions) < 200:
        w = list(rnd.choice(versions))
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        versions.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(versions)], "doc_id long, text string")
    assert simhash.near_components(docs, recall=0.99999, distance=48, neighbours=200).select("component_id").distinct().count() == 1


def test_full_buckets_are_split_by_further_coordinates(spark, monkeypatch):
    """Versions, each edited from a random earlier one, whose buckets are all too large: the further levels find links that the first misses."""
    from loomgraph.llm import simhash

    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(5000)]
    versions = [[rnd.choice(vocabulary) for _ in range(300)]]
    while len(versions) < 200:
        w = list(rnd.choice(versions))
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        versions.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(versions)], "doc_id long, text string")
    parts = {levels: simhash.near_components(docs, neighbours=4, levels=levels).select("component_id").distinct().count() for levels in ((), simhash.LEVELS)}
    assert parts[simhash.LEVELS] < parts[()] and parts[simhash.LEVELS] <= 3


@pytest.mark.parametrize("block", [24])
def test_full_buckets_lose_no_link(spark, monkeypatch, block):
    """Versions, each edited from a random earlier one, in buckets too large for their pairs: the components of all pairs, within blocks and across them."""
    from loomgraph.llm import simhash

    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(5000)]
    versions = [[rnd.choice(vocabulary) for _ in range(120)] for _ in range(3)]
    while len(versions) < 180:
        w = list(rnd.choice(versions))
        for _ in range(rnd.randrange(1, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        versions.append(w)
    texts = [" ".join(w) for w in versions] + ["a b c d e f g", "a b c d e f g", "", "x"]
    sets = [simhash.shingles(t) for t in texts]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if simhash.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = simhash._family_edges
    monkeypatch.setattr(simhash, "_family_edges", lambda *a: whole(*a, rows=block))
    want = {find(i) for i in range(len(sets))}
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs, neighbours=2).collect()} == want
    capped = simhash.drop_near_copies(docs, neighbours=2, whole=False).count()
    assert capped > len(want)


def test_texts_that_stand_alone_meet_no_other(spark, monkeypatch):
    """Only classes that can have a near copy go to the fingerprints' buckets and send their shingles; those that stay out have none."""
    from loomgraph.llm import simhash

    rnd, vocabulary = random.Random(9), [f"w{i}" for i in range(3000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(80)) for _ in range(60)]
    texts += [t + f" more{k}" for k, t in enumerate(texts[:5])] + [texts[7].upper(), "", None, " ", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, sent, pairs, links = [], [], simhash.near_pairs, simhash.missing_links
    monkeypatch.setattr(simhash, "near_pairs", lambda classes, *a: met.append(classes.count()) or pairs(classes, *a))
    monkeypatch.setattr(simhash, "missing_links", lambda sets, *a: sent.append(sets.count()) or links(sets, *a))
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert got == {*range(60), 66, 69} and 11 <= met[0] == sent[0] <= 16


def test_sets_with_a_similar_one_never_stand_alone(spark):
    from loomgraph.llm import simhash

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, rng.integers(1, 50))) for _ in range(150)]
    for t in texts[:100]:
        w = t.split()
        w[rng.integers(len(w))] = "z"
        texts.append(" ".join(w))
    sets = [simhash.shingles(t) for t in texts]
    table = simhash.repeated_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 12)
    every, n = np.unique(np.concatenate(sets) >> np.uint64(52), return_counts=True)
    want = np.zeros(1 << 12, bool)
    want[every[n > 1].astype(int)] = True
    assert np.array_equal(np.unpackbits(table).astype(bool), want)
    alone = simhash.stand_alone(sets, table)
    similar = [any(simhash.similarity(a, b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert alone.any() and not any(x and y for x, y in zip(alone, similar))


def test_ascending_numbers_come_back():
    from loomgraph.llm import simhash

    for spots in ([], [0], [255], [0, 254, 509, 764, 1275, 90_000], list(range(300))):
        assert simhash._unpacked(simhash._packed(np.array(spots, np.int64))).tolist() == spots


def test_similar_sets_share_a_leading_shingle():
    from loomgraph.llm import simhash

    rng = np.random.default_rng(3)
    common, count = np.arange(0, 400, 3, dtype=np.uint64), rng.integers(5, 50, 134)
    for _ in range(300):
        a = np.sort(rng.choice(400, rng.integers(1, 60), replace=False)).astype(np.uint64)
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.choice(400, 2).astype(np.uint64))
        if simhash.similarity(a, b) >= 0.8:
            assert np.intersect1d(*(simhash.leading_shingles(x, common, count) for x in (a, b))).size
