"""Repair of conversation structure at least cost, by dynamic programming over a trie of signatures.

A row's part of the signature is one letter: ``x`` where the row has to go, else the
initial of its role (``s``, ``u``, ``a``, ``o`` for any other), as a capital where its text is
truncated.  Only the signature matters for the edits, so each one is solved once however many
conversations share it, and signatures that start alike share the work on
what they start with: in sorted order each one continues the path of the one before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Conversations of one signature are dealt to as many groups.
SALTS = 64
#: States of the pattern ``(s?(ua)+)?``: nothing yet, after s, after u, after a; where it may end.
_START, _S, _U, _A = range(4)
_ENDS = (_START, _A)
_NEXT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
_STEPS = [(q, to) for r in "ua" for q, to in _NEXT[r].items()]
_NEVER = 1 << 60


def _edits(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, cost, from state, to state) of the ways to treat a row."""
    out = [("D", DELETE, q, q) for q in range(4)]
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        out += [("K", more, q, to) for q, to in _NEXT.get(letter.lower(), {}).items()]
        out += [("R", REROLE + more, q, to) for q, to in _STEPS]
    return out


_EDITS = {c: _edits(c) for c in "xsuaoSUAO"}


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):  # start or s, then u, then a
        for q, to in _STEPS:
            costs[to] = min(costs[to], costs[q] + INSERT)
    return tuple(costs)


class Trie:
    """The path of the signature at hand: for each row the least cost of every state before it."""

    def __init__(self):
        self.path, self.layers = "", [_with_inserts([0, _NEVER, _NEVER, _NEVER])]
        self.known: dict[tuple, tuple] = {}
        self.made, self.found = 0, None

    def _step(self, costs: tuple[int, ...], letter: str) -> tuple[int, ...]:
        least = min(costs)
        shape = (letter, *[min(c - least, _NEVER) for c in costs])
        if shape not in self.known:
            to = [_NEVER] * 4
            for _, cost, q, r in _EDITS[letter]:
                to[r] = min(to[r], shape[q + 1] + cost)
            self.known[shape] = _with_inserts(to)
        return tuple(min(c + least, _NEVER) for c in self.known[shape])

    def go(self, signature: str) -> None:
        """Moves to the signature: up to what both share, then down, a layer for each new row."""
        shared, most = 0, min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append(self._step(self.layers[-1], letter))
            self.made += 1
        self.path = signature

    def solve(self, signature: str) -> tuple[int, str, list[int], list[str]]:
        """The answer to a signature; one that comes again is answered as before."""
        if signature != self.path or self.found is None:
            self.go(signature)
            self.found = self.answer()
        return self.found

    def answer(self) -> tuple[int, str, list[int], list[str]]:
        """Cost, ASCII-least cheapest edits, and the repaired rows: places of the rows from 1 (0: inserted) and their roles ('': as it was)."""
        layers, path, n = self.layers, self.path, len(self.path)
        cost = min(layers[n][q] for q in _ENDS)
        good = [set() for _ in range(n + 1)]
        good[n] = {q for q in _ENDS if layers[n][q] == cost}
        for i in range(n, -1, -1):
            if i < n:
                good[i] = {q for _, c, q, to in _EDITS[path[i]] if to in good[i + 1] and layers[i][q] + c == layers[i + 1][to]}
            for _ in range(2):
                good[i] |= {q for q, to in _STEPS if to in good[i] and layers[i][q] + INSERT == layers[i][to]}
        at, i, edits = {_START}, 0, []
        while True:
            ways: dict[str, set[int]] = {}
            if i < n:
                for edit, c, q, to in _EDITS[path[i]]:
                    if q in at and to in good[i + 1] and layers[i][q] + c == layers[i + 1][to]:
                        ways.setdefault(edit, set()).add(to)
            elif any(q in _ENDS and layers[n][q] == cost for q in at):
                break
            for q, to in _STEPS:
                if q in at and to in good[i] and layers[i][q] + INSERT == layers[i][to]:
                    ways.setdefault("I", set()).add(to)
            edit = min(ways)
            at, i = ways[edit], i + (edit != "I")
            edits.append(edit)
        places, roles, row = [], [], 0
        for edit in edits:
            row += edit != "I"
            if edit == "D":
                continue
            turn = len(places) - (bool(places) and path[places[0] - 1] in "sS" and roles[0] == "")
            places.append(0 if edit == "I" else row)
            roles.append("" if edit == "K" else ROLES["ua"[turn % 2]])
        return cost, "".join(edits), places, roles


def solve(signatures: DataFrame) -> DataFrame:
    """``signatures(signature, salt)``, distinct, with cost, audit, places and roles.

    Range partitions of the sorted signatures are walked one after the other; memory is the longest signature's path.
    """

    def run(batches):
        trie = Trie()
        for batch in filter(len, batches):
            cost, audit, places, roles = zip(*map(trie.solve, batch.column(0).to_pylist()))
            arrays = [pa.array(cost, pa.int64()), pa.array(audit), pa.array(places, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["signature", "salt", "cost", "audit", "places", "roles"])

    kinds = "signature string, salt int, cost long, audit string, places array<int>, roles array<string>"
    return signatures.repartitionByRange("signature", "salt").sortWithinPartitions("signature", "salt").mapInArrow(run, kinds)


def _solid(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\f\r"))


def repair(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each value of ``key`` in ``rows(key, turn, role, text, alive boolean)``: faults, edits, repaired rows.

    Columns: the key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, an
    array of (role, text).  Rows that are not ``alive`` only name their conversation.  Rows stand by turn, nulls first,
    then role and text; null roles and texts count as one space.  A row's first
    fault counts: no character but white space, role and text seen before, or last such
    character none of ``.!?``.  Roles other than those with the initials s, u and a can't be
    kept.  A conversation is one group, as its repaired text is one value.
    """
    rows = rows.select(F.col(key).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "alive")
    line = Window.partitionBy("conv").orderBy(F.desc("alive"), F.asc_nulls_first("turn"), "role", "text")
    nth = Window.partitionBy("conv", "alive", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(line), initial)
    placed = rows.withColumns({"pos": F.row_number().over(line), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
    placed = placed.withColumns({"seen": F.row_number().over(nth) > 1, "solid": _solid(F.col("text"))})
    fault = F.when(F.col("solid") == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring("solid", -1, 1).isin(".", "!", "?"), "truncated")
    placed = placed.withColumn("fault", fault)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    live = F.col("alive")
    count = lambda which: F.count(F.when(live & which, 1))
    turn = F.when(live, F.col("turn").cast("long"))
    convs = placed.withColumn("letter", letter).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.when(live, F.struct("pos", "role", "text", "letter")))).alias("rows"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
    )
    signature = F.array_join(F.transform("rows", lambda r: r["letter"]), "")
    convs = convs.withColumns({"signature": signature, "salt": F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int")})
    solved = solve(convs.select("signature", "salt").distinct())
    both = convs.join(solved, ["signature", "salt"])
    original = lambda p: F.element_at("rows", F.greatest(p, F.lit(1)))
    turns = F.zip_with(
        "places",
        "roles",
        lambda p, r: F.struct(F.when(r == "", original(p)["role"]).otherwise(r).alias("role"), F.when(p == 0, "").otherwise(original(p)["text"]).alias("text")),
    )
    return both.select(F.col("conv").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", turns.alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)``: rows lost, emptied, cut, repeated and given another role by the CRC of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.col("code") != 0, F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("alive"))


def op12_structure_repair(spark, sf_dir):
    """Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null ids are one conversation; null turns come first, null roles and texts are one
    space; rows of one turn stand by role and text, repeated ones are duplicates; long texts stay
    whole; an empty table gives no row; other columns are not read.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(damaged(table)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))


_SOLID = r"rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _oracle() -> str:
    """The same costs with whole edit strings carried along: a state is the least of (cost, edits, repaired rows) that lead to it."""
    add = lambda q, cost, edit, row: f"{{'c': {q}.c + {cost}, 'e': {q}.e || '{edit}', 'r': {q}.r || [{row}]}}"
    insert = lambda q, role: add(q, INSERT, "I", f"'{role}:'")
    gone = lambda q: f"{{'c': {q}.c + {DELETE}, 'e': {q}.e || 'D', 'r': {q}.r}}"
    never = f"{{'c': {_NEVER}::BIGINT, 'e': '', 'r': []::VARCHAR[]}}"
    keep = lambda q, i: f"CASE WHEN letter IN ('{i}', '{i.upper()}') THEN {add(q, 'more', 'K', 'said')} ELSE {never} END"
    rerole = lambda q, role: f"CASE WHEN letter <> 'x' THEN {add(q, f'{REROLE} + more', 'R', chr(39) + role + ':' + chr(39) + ' || text')} ELSE {never} END"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), bits AS (SELECT i AS b, i AS v FROM range(256) r(i)
), tab AS (
  SELECT b, list_reduce([CAST(b AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM bits
), t AS (SELECT list(v ORDER BY b) AS v FROM tab
), keys AS (SELECT DISTINCT k FROM c
), coded AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda x, y: xor(x >> 8, t.v[1 + (xor(x, y) & 255)])), 4294967295) % 20 AS code
  FROM keys, t
), d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c JOIN coded USING (k), range(2) r(i) WHERE code <> 0 AND (i = 0 OR code = 3)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d
), f AS (
  SELECT *, {_SOLID} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
         right({_SOLID}, 1) NOT IN ('.', '!', '?') AS cut,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong
  FROM n
), g AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) AS n_rows,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
         count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM f GROUP BY conv_id
), x AS (
  SELECT conv_id, pos, role || ':' || text AS said, text, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS more,
         CASE WHEN blank OR seen THEN 'x' WHEN left(role, 1) NOT IN ('s', 'u', 'a') OR role = '' THEN 'o' ELSE left(role, 1) END AS letter
  FROM f
), p AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'e': '', 'r': []::VARCHAR[]}} AS q0, {never} AS q1,
         {{'c': {INSERT}::BIGINT, 'e': 'I', 'r': ['user:']}} AS q2, {{'c': {2 * INSERT}::BIGINT, 'e': 'II', 'r': ['user:', 'assistant:']}} AS q3
  FROM g
  UNION ALL
  SELECT conv_id, pos, n0, n1, m2, least(n3, {insert("m2", "assistant")})
  FROM (
    SELECT *, least(n2, {insert("n0", "user")}, {insert("n1", "user")}, {insert("n3", "user")}) AS m2
    FROM (
      SELECT p.conv_id, x.pos, {gone("q0")} AS n0, least({gone("q1")}, {keep("q0", "s")}) AS n1,
             least({gone("q2")}, {", ".join(f(q) for q in ("q0", "q1", "q3") for f in (lambda q: keep(q, "u"), lambda q: rerole(q, "user")))}) AS n2,
             least({gone("q3")}, {keep("q2", "a")}, {rerole("q2", "assistant")}) AS n3
      FROM p JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND x.pos = p.pos + 1
    )
  )
), e AS (
  SELECT g.*, least(q0, q3) AS best FROM g JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.pos = g.n_rows
), o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM o LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
