"""Chat formatting from reply trees; DataFrame functions only.

Template of a turn: ``### role:``, a new line, the text, a new line, ``</turn>``,
a new line.  Inside texts every ``###`` and ``</turn>``, with any backslashes before
it, gets one more backslash; the closing mark of the template follows a new line
and never a backslash, so parsing is unambiguous and the escape is undone by taking
one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import cut, depth_bound

END = "\n</turn>\n"
#: Whose texts are trained on.
SPEAKER = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)(###|</turn>)", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(###|</turn>)", "$1$2")


def _escape_role(role: Column) -> Column:
    """Roles stand on one line: backslash and new line become two-character marks."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``nodes(tree, node long, parent long, score long)``.

    Iterative self-joins double the reach of each node's ancestor pointer, so a
    chain of n replies takes log2(n) rounds, and nodes that have reached their root sit out;
    each round also adds up depth and score.  A leaf's path score is the sum along its path, and the ``branches`` best
    leaves of each root (ties: smallest leaf) are kept.  Their paths are then marked
    from the leaf upward through the same pointers, longest first.

    Returns ``(tree, leaf, node, depth, path_score, branch)``.  A parent that does not exist
    makes its node a root; null scores count 0.  Nodes on a cycle are on no
    root-to-leaf path and give no row.  An empty table gives no row.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    up = nodes.join(known, nodes["tree"].eqNullSafe(known["t"]) & (nodes["parent"] == known["p"]), "left")
    now = cut(up.select("tree", "node", F.col("p").alias("up"), F.coalesce("score", F.lit(0)).cast("long").alias("total"), F.lit(1).alias("depth"), F.col("node").alias("top")))
    levels, bound = [], depth_bound(now.count())
    while now.where(F.col("up").isNotNull()).limit(1).count() and len(levels) <= bound:
        levels.append(now.where(F.col("up").isNotNull()).select("tree", "node", "up"))
        a, b = now.where(F.col("up").isNotNull()).alias("a"), now.alias("b")
        joined = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")), "left")
        further = joined.select(
            "a.tree",
            "a.node",
            "b.up",
            (F.col("a.total") + F.coalesce("b.total", F.lit(0))).alias("total"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            F.coalesce("b.top", "a.top").alias("top"),
        )
        now = cut(now.where(F.col("up").isNull()).union(further))
    rooted = now.where(F.col("up").isNull())
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["node"] == parents["p"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree", "top").orderBy(F.desc("total"), "node"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("total").alias("path_score"), rank.alias("branch"))
    marked = cut(chosen.where(F.col("branch") <= branches))
    for level in reversed(levels):
        m, j = marked.alias("m"), level.alias("j")
        above = m.join(j, F.col("m.tree").eqNullSafe(F.col("j.tree")) & (F.col("m.node") == F.col("j.node")))
        marked = cut(marked.union(above.select("m.tree", "m.leaf", F.col("j.up").alias("node"), "m.path_score", "m.branch")))
    m, r = marked.alias("m"), rooted.alias("r")
    placed = m.join(r, F.col("m.tree").eqNullSafe(F.col("r.tree")) & (F.col("m.node") == F.col("r.node")))
    return placed.select("m.tree", "m.leaf", "m.node", "r.depth", "m.path_score", "m.branch")


def format_conversations(turns: DataFrame, speaker: str = SPEAKER) -> DataFrame:
    """``(tree, leaf, formatted, loss)`` from ``turns(tree, leaf, depth, role, text)``.

    ``loss`` lists the (start, length) of each of the speaker's escaped texts in
    ``formatted``, in code points from 0.  Null roles and texts count as empty.
    """
    head = F.concat(F.lit("### "), _escape_role(F.coalesce("role", F.lit(""))), F.lit(":\n"))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = turns.select("tree", "leaf", "depth", (F.coalesce("role", F.lit("")) == speaker).alias("own"), head.alias("head"), body.alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END)))
    line = Window.partitionBy("tree", "leaf").orderBy("depth")
    before = F.sum(F.char_length("piece")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece")
    spans = pieces.select(
        "tree", "leaf", "depth", "piece", "own", (before + F.char_length("head")).cast("int").alias("start"), F.char_length("body").alias("length")
    )
    whole = spans.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "own", "start", "length"))).alias("all"))
    own = F.filter("all", lambda x: x["own"])
    return whole.select(
        "tree",
        "leaf",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, parsed from the text and its mask alone."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    split_at = F.transform(pieces, lambda x: F.struct(x.alias("x"), F.instr(x, "\n").alias("at")))
    turns = F.transform(
        split_at,
        lambda s: F.struct(
            _unescape_role(F.substring(s["x"], F.lit(5), s["at"] - 6)).alias("role"),
            unescape(F.substring(s["x"], s["at"] + 1, F.char_length(s["x"]))).alias("text"),
        ),
    )
    own = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("*", turns.alias("turns"), own.alias("loss_texts"))


def chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the best branches of ``messages(tree, node, parent, score, role, text)``."""
    paths = reply_paths(messages.select("tree", "node", "parent", "score"), branches)
    p, m = paths.alias("p"), messages.alias("m")
    turns = p.join(m, F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node")))
    return format_conversations(turns.select("p.tree", "p.leaf", "p.depth", "m.role", "m.text"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations without parents as reply trees: each turn answers the one before.

    Turns are ordered by turn (nulls last), then role and text, so repeated turns
    keep a defined order.  The score of a turn is its number of characters.
    """
    line = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    nth = conversations.select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(line).cast("long").alias("node"))
    return nth.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.char_length("text").cast("long").alias("score"), "role", "text")


def op10_chat_formatting(spark, sf_dir):
    """Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output.

    Null roles and texts count as empty; long texts are formatted whole; turns of one number
    stand by role and text, null turns last, repeated rows each; an empty table has the
    added conversation only; other columns are not read.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)")
    table = table.unionByName(extra.withColumn("text", F.lit(probe)))
    back = read_back(chats(linear_messages(table)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS own,
         CAST(sum(length('### ' || role || ':' || chr(10))
             + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g'))
             + length(chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(own) AS BIGINT) AS loss_chars, sha256(own) AS loss_sha256, formatted_chars FROM g
"""
