"""Chat formatting of reply trees, in DataFrame functions only.

Messages (tree, node, parent, role, text, score) form reply trees.  Self-joins
enumerate root-to-leaf paths by pointer doubling: round k knows each message's
2^k-th ancestor, so a tree of depth d takes log2 d joins and no row ever holds a
path.  Branches are ranked per tree by the sum of their messages' scores (then
the longer one, then the smaller leaf), and the chosen leaves are walked back to
their roots through the same jump tables, from the longest jump to the shortest.
Each chosen path becomes one conversation.

Template: ``<s>`` then, per turn, ``[INST]text[/INST]`` (user), ``[ANS]text</s>``
(assistant), ``[SYS]text[/SYS]`` (system) or ``[TURN]role[ROLE]text[/TURN]``.
Control strings inside texts and roles get a backslash after their first
character (one more if they have some), which unescaping removes, so reading
back restores every text.  The loss mask holds the code-point ranges of the
assistants' texts.

Null text or role: empty.  Null tree ids are a tree of their own; a parent that
doesn't exist makes a root; messages on a cycle have no root and are left out.
Repeated rows are turns of their own.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

#: Control strings without their first character, which is < or [.
CONTROLS = r"/?s>|/?INST\]|/?SYS\]|/?TURN\]|ROLE\]|ANS\]"
ESCAPE = rf"([<\[])(\\*)({CONTROLS})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROLS})"
TURN = r"(?s)\[(?:INST|ANS|SYS|TURN)\].*?(?:\[/INST\]|</s>|\[/SYS\]|\[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up) of 1, 2, 4, ... steps, and (tree, node, depth, total) of all messages with a root."""
    state = messages.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")).checkpoint()
    tables = []
    for _ in range(state.count().bit_length() + 1):  # a longer way than all messages is a cycle
        going = state.where("up is not null")  # messages that have reached their root rest
        if going.limit(1).count() == 0:
            break
        tables.append(going.select("tree", "node", "up"))
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        going = going.join(far, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        state = state.where("up is null").select("tree", "node", "up", "depth", "total").union(going).checkpoint()
    return tables, state.where("up is null").select("tree", "node", "depth", "total")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, pos, role, text): the turns of the ``branches`` best root-to-leaf paths of each tree; pos counts from 1.

    messages: tree string, node long, parent long, role string, text string, score double; nodes are unique in a tree.
    """
    prepare(messages.sparkSession)
    shape = messages.select("tree", "node", "parent", "score").checkpoint()
    known = shape.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    shape = shape.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    tables, rooted = jumps(shape)
    leaves = rooted.join(shape.where("parent is not null").select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    path = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "node").checkpoint()
    for table in reversed(tables):
        path = path.union(path.join(table, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))).checkpoint()
    placed = path.join(rooted.select("tree", "node", F.col("depth").alias("pos")), ["tree", "node"])
    return placed.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "node", "pos", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): one conversation per path; loss: code-point ranges, end exclusive."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    piece = (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("[ANS]"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("[SYS]"), text, F.lit("[/SYS]")))
        .otherwise(F.concat(F.lit("[TURN]"), escape(role), F.lit("[ROLE]"), text, F.lit("[/TURN]")))
    )
    before = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = paths.select("tree", "leaf", "pos", piece.alias("piece"), (role == "assistant").alias("learn")).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + 3)
    span = F.when(F.col("learn"), F.struct((F.col("at") + 5).alias("start"), (F.col("at") + F.length("piece") - 4).alias("end")))
    grouped = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", span.alias("span")))).alias("turns"))
    return grouped.select(
        "tree", "leaf",
        F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""

    def turn(t: Column) -> Column:
        inner = lambda a, b: F.substring(t, a + 1, F.length(t) - a - b)
        other = inner(6, 7)
        cut = F.locate("[ROLE]", other)
        return (
            F.when(t.startswith("[INST]"), F.struct(F.lit("user").alias("role"), unescape(inner(6, 7)).alias("text")))
            .when(t.startswith("[ANS]"), F.struct(F.lit("assistant").alias("role"), unescape(inner(5, 4)).alias("text")))
            .when(t.startswith("[SYS]"), F.struct(F.lit("system").alias("role"), unescape(inner(5, 6)).alias("text")))
            .otherwise(F.struct(unescape(F.substring(other, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(other, cut + 6, F.length(other))).alias("text")))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each row replies to the one before it, by turn."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    turns, mask = F.col("read"), F.col("masked")
    read = formatted.select("tree", "formatted", read_turns(F.col("formatted")).alias("read"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    return read.select(
        F.when(F.col("tree").startswith("c"), F.expr("substring(tree, 2)").cast("long")).alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(mask).cast("long").alias("loss_chars"),
        F.sha2(mask, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_esc = lambda x: rf"regexp_replace({x}, '([<\[])(\\*)({CONTROLS})', '\1\\\2\3', 'g')"
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_esc("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 19 + length({_esc("role")}) END) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (3 + chars)::BIGINT AS formatted_chars
FROM g"""
