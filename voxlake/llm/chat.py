"""Operator 9, chat formatting of reply trees, in DataFrame operations only.

Messages (tree, id, parent) form trees. Self-joins that double their stride give each message its ancestor 2^k above;
leaves then walk to the root in log2(depth) joins, each adding every ancestor at one more binary digit of distance.
Branches are ranked by the sum of their messages' scores, and each chosen path is formatted as one conversation.

A turn is TURN role SAYS text END. Inside roles and texts a backslash goes before every backslash and after the first
character of every control string, so no control string is left in them, and dropping each backslash that precedes
a character restores them. The loss mask holds, for each turn, the code points of that turn that are trained on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that a chat tokenizer may read as special; all of the template's own start with the first.
CONTROL = ("<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, leaf, rank, dist, id: the messages of each tree's `top` best branches (dist: replies from message to leaf).

    nodes: tree, id (unique within the tree), parent (null for a root), score. A parent that is not there makes a message a
    root. Ties of score fall by leaf id. Messages that lie on or below a cycle reach no root and are left out.
    """
    nodes = nodes.select("tree", "id", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    up = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    jump = nodes.join(up, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), "score")
    jump = base.stored(jump, "chat-jump")
    jumps, n = [jump], jump.count()
    while jump.where("up is not null").limit(1).count() and 1 << (len(jumps) - 1) <= n:
        above = jump.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        jump = jump.join(above, ["tree", "up"], "left").select("tree", "id", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        jump = base.stored(jump, "chat-jump")
        jumps.append(jump)
    # the last jumps end above the roots, so their scores are those of whole branches
    parents = jumps[0].where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = jump.where("up is null").join(parents, ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "id")))
    path = ranked.where(F.col("rank") <= top).select("tree", F.col("id").alias("leaf"), "rank", F.lit(0).cast("long").alias("dist"), "id")
    for k in reversed(range(len(jumps) - 1)):
        step = jumps[k].where("up is not null").select("tree", "id", "up")
        further = path.join(step, ["tree", "id"]).select("tree", "leaf", "rank", (F.col("dist") + (1 << k)).alias("dist"), F.col("up").alias("id"))
        path = base.stored(path.unionByName(further), "chat-path")
    return path


def format_paths(paths: DataFrame, messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """tree, leaf, formatted, loss_mask (array of turn, start, length within the turn) of each path over messages (tree, id, role, text).

    Null roles and texts count as empty.
    """
    m = messages.select("tree", "id", escape(F.coalesce("role", F.lit(""))).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("loss"))
    turns = paths.join(m, ["tree", "id"]).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "r", "t", "loss"))).alias("turns"))
    piece = lambda x: F.concat(F.lit(TURN), x["r"], F.lit(SAYS), x["t"], F.lit(END))
    span = lambda x, i: F.struct(i.alias("turn"), (F.length(x["r"]) + len(TURN) + len(SAYS)).alias("start"), F.when(x["loss"], F.length(x["t"])).otherwise(0).alias("length"))
    return turns.select("tree", "leaf", F.array_join(F.transform("turns", piece), "").alias("formatted"), F.transform("turns", span).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, turns (array of role, text), loss_texts (array): what a formatted string and its mask say, unescaped."""
    chunks = F.expr("slice(chunks, 1, size(chunks) - 1)")
    parts = formatted.withColumn("chunks", F.split("formatted", re.escape(END).replace("<", "<"))).withColumn("chunks", chunks)
    halves = lambda c: F.split(F.substr(c, F.lit(len(TURN) + 1)), re.escape(SAYS), 2)
    turn = lambda c: F.struct(unescape(F.get(halves(c), F.lit(0))).alias("role"), unescape(F.get(halves(c), F.lit(1))).alias("text"))
    masked = lambda c, m: F.when(m["length"] > 0, unescape(F.substr(c, m["start"] + 1, m["length"]))).otherwise("")
    return parts.select("tree", "leaf", "formatted", F.transform("chunks", turn).alias("turns"), F.zip_with("chunks", "loss_mask", masked).alias("loss_texts"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: digests of what is read back from the formatted output.

    conversations: conv_id, turn, role, text. Each turn replies to the one before it (ties of turn fall by role, then
    text; nulls first), so a conversation is a tree with one branch. Longer texts score higher. A null conv_id is a key like others.
    Repeated rows are turns of their own, side by side. Null roles and texts are empty. Texts of any length are formatted whole; one
    conversation's output is one text, so its turns meet in one task. An empty table gives none; extra columns are ignored.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    key = F.when(F.col("conv_id").isNull(), F.lit("null")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    rows = conversations.select(key.alias("tree"), "conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    rows = rows.withColumns({"parent": F.when(F.col("id") > 1, F.col("id") - 1), "score": F.length("text").cast("double")})
    rows = base.stored(rows, "chat-rows")
    back = read_back(format_paths(reply_paths(rows), rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.when(F.col("tree") != "null", F.substr("tree", F.lit(2)).cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
