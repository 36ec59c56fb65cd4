"""Chat formatting of reply trees, by DataFrame operations only.

Messages are nodes with a parent.  Root-to-leaf paths are enumerated by self-joins that
double their reach: in round k every node knows its ancestor 2**k steps up, and every path
of up to 2**k nodes is continued by it, so the rounds grow with the logarithm of the depth
and the rows with what the paths hold.  Branches of a tree are ranked by their mean score;
each chosen path becomes one conversation in a template that marks turns.

Control strings inside texts are escaped reversibly: each backslash is doubled, and a
backslash is put after the first character of a control string; roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed control strings of common chat templates, as a pattern.
CONTROL = r"(<)(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """``messages(tree, node, parent)`` -> ``(tree, leaf, node, up)``: every node of the
    path from each leaf to its root, ``up`` steps above the leaf.  A parent that is null,
    unknown or the node itself makes a root; rows that only lead round a circle have no
    leaf, and a leaf that leads into one has no path.  Repeated rows count once (of several
    parents the least counts); an empty table gives no rows."""
    nodes = staged(messages.select("tree", "node", "parent").filter("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent")), "nodes")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = nodes.filter("parent <> node").join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi").select("tree", "node", F.col("parent").alias("to"))
    jump = staged(jump, "jumps")
    inner = jump.select(F.col("tree").alias("t"), F.col("to").alias("n"))
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    paths = staged(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    reach, size = 1, nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
    while True:
        step = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        more = staged(paths.join(step, same).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up")), "paths")
        if not more.take(1):
            return paths
        if reach >= size:  # longer than its tree: it goes round
            round_ = more.select(F.col("tree").alias("t"), F.col("leaf").alias("n")).distinct()
            return paths.join(round_, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")), "left_anti")
        paths = paths.unionByName(more)
        onward = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("far"))
        jump = staged(jump.join(onward, F.col("tree").eqNullSafe(F.col("t")) & (F.col("to") == F.col("n"))).select("tree", "node", F.col("far").alias("to")), "jumps")
        reach *= 2


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(tree, node, parent, role, text, score)`` -> one row for each of the
    ``branches`` best paths of a tree: ``tree, leaf, rank, score, n_turns, formatted,
    loss``; ``loss`` is an array of ``(start, end)`` code point offsets in ``formatted`` of
    the escaped assistant texts.  A null text or role is empty, a null score 0; ties go to
    the least leaf."""
    rows = staged(messages.groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")).select("tree", "node", "m.*"), "messages")
    paths = reply_paths(rows)
    node = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    scored = paths.join(node.drop("role", "text"), same).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= branches).select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank", F.col("score").alias("path_score"))
    turns = paths.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).join(node.drop("score"), same)
    turns = turns.select("tree", "leaf", "rank", "path_score", "up", "role", F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    whole = F.length("head") + F.length("body") + len(END) + 1
    so_far = F.sum(whole).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))) - whole
    begin = so_far + F.length("head")
    turns = turns.withColumn("turn", F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("marked"), F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), (begin + F.length("body")).alias("end"))).alias("span")))
    chats = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("score"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list("turn")).alias("_turns"))
    return chats.select("tree", "leaf", "rank", "score", "n_turns", F.array_join(F.col("_turns.marked"), "").alias("formatted"), F.filter(F.col("_turns.span"), lambda x: x.isNotNull()).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``, the array of ``(role, text)`` that the formatted
    conversation holds, and ``loss_texts``, the unescaped texts under the loss mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    inner = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    role = lambda x: F.substring_index(inner(x), "\n", 1)
    turn = lambda x: F.struct(F.url_decode(role(x)).alias("role"), unescape(F.substring(inner(x), F.length(role(x)) + 2, F.length(x))).alias("text"))
    text = lambda x: unescape(F.substring("formatted", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return chats.withColumns({"turns": F.transform(parts, turn), "loss_texts": F.transform("loss", text)})


def linear_messages(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as trees of one branch: each row answers
    the one before it by turn (ties: by role and text).  All scores are 0."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", at).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
