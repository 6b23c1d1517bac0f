"""Chat formatting: reply trees, their root-to-leaf paths, and one formatted conversation per chosen path.

Messages carry (tree, node, parent, role, text, score).  Iterative self-joins
over thin (tree, node, ancestor) rows, doubling the distance each round,
enumerate every root-to-leaf path; branches are ranked within their tree by the
mean score of their messages (ties: smaller leaf) and the best ``top`` are
formatted.

Template: ``<|im_start|>role LF text<|im_end|> LF`` per turn.  Control strings in a
text are escaped reversibly: a ``<`` followed by any number of backslashes and a
``|`` gets one more backslash, so ``<|`` never comes from a text; reading back takes
one backslash away.  Roles also write backslash and LF as backslash sequences.
The loss mask lists the code-point spans of assistant texts.

Defined results: null text and role are empty; null score counts as 0; a null
tree id is a tree of its own; turns with equal numbers are ordered by role
and text, nulls first; repeated rows are turns of their own; a message whose
parent is missing is a root; an empty table gives no conversation; other
columns are ignored.

Scale: the self-joins move ids only, log2(depth) rounds, each stored in the
shared folder; texts move once, into their conversation.  A conversation is
one output row and therefore gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverline.session import materialize

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Make control strings inert; reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: every turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                                  F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path; up counts replies between node and leaf."""
    thin = messages.select("tree", "node", "parent")
    known = thin.select("tree", F.col("node").alias("parent")).distinct()
    edges = thin.where("parent is not null and parent <> node").join(known, ["tree", "parent"], "left_semi")
    jump = materialize(edges.select("tree", "node", F.col("parent").alias("over")), "chat-jumps")
    leaves = thin.select("tree", "node").distinct().join(
        jump.select("tree", F.col("over").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    distance, most = 1, jump.count()  # a path has at most that many replies
    while not jump.isEmpty():
        # the rows so far reach `distance` nodes up from the leaf; their jumps reach as many more
        further = (found.join(jump, ["tree", "node"])
                   .select("tree", "leaf", F.col("over").alias("node"), (F.col("up") + distance).alias("up")))
        found = materialize(found.unionByName(further), "chat-paths")
        twice = (jump.select("tree", "node", F.col("over").alias("mid"))
                 .join(jump.select("tree", F.col("node").alias("mid"), "over"), ["tree", "mid"]).select("tree", "node", "over"))
        jump = materialize(twice, "chat-jumps")
        distance *= 2
        if distance > 2 * most:
            raise ValueError("replies form a cycle")
    return found


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """One row per chosen path: conv_id, tree, leaf, rank, n_turns, formatted, loss (code-point spans from 0, end excluded)."""
    found = paths(messages)
    scored = found.join(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    best = (scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))))
    if top is not None:
        best = best.where(F.col("rank") <= top)
    turn = messages.select(
        "conv_id", "tree", "node", F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), (F.col("role") == "assistant").alias("train"))
    rows = found.join(best.select("tree", "leaf", "rank"), ["tree", "leaf"]).join(turn, ["tree", "node"])
    part = F.struct((-F.col("up")).alias("at"), "head", "body", F.coalesce("train", F.lit(False)).alias("train"))
    talks = rows.groupBy("tree", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"),
                                             F.sort_array(F.collect_list(part)).alias("turns"))
    tail = F.lit(STOP + "\n")
    lengths = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(STOP) + 1)
    starts = F.aggregate(  # running start of every turn
        lengths, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
        lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all")), lambda a: a["all"])
    talks = talks.withColumn("starts", starts)
    span = F.transform(F.arrays_zip("turns", "starts"), lambda z: F.when(z["turns"]["train"], F.struct(
        (z["starts"] + F.length(z["turns"]["head"])).alias("start"),
        (z["starts"] + F.length(z["turns"]["head"]) + F.length(z["turns"]["body"])).alias("end"))))
    return talks.select("conv_id", "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"),
                        F.filter(span, lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts parsed from ``formatted`` and ``loss`` alone: adds turns (role, text) and loss_texts."""
    cut = F.split(F.col("formatted"), r"<\|im_start\|>", -1)
    raw = F.slice(cut, F.lit(2), F.size(cut))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substring(piece, cut + 1, F.length(piece) - cut - len(STOP) - 1)
        return F.struct(unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return (formatted.withColumn("turns", F.transform(raw, turn))
            .withColumn("loss_texts", F.transform("loss", lambda s: unescape(
                F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))))
