"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, formatted with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The template's control strings: <s> </s> [INST] [/INST] [ROLE] [/ROLE]. Escaping puts a backslash behind the first
#: character of any of them (and of any that already has some there), so they never occur inside a text.
_CONTROL = r"(/?(?:s>|INST\]|ROLE\]))"
_PLAIN = r"([<\[])(\\*)" + _CONTROL
_ESCAPED = r"([<\[])\\(\\*)" + _CONTROL


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _unique(messages: DataFrame, *more: Column) -> DataFrame:
    """One row per conv_id and node with parent, score and more: the least by parent, score and more, in this order."""
    one = F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), *more)
    return messages.where("conv_id is not null and node is not null").groupBy("conv_id", "node").agg(F.min(one).alias("m")).select("conv_id", "node", "m.*")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, leaf, branch (rank from 1), node, depth (from the leaf up) of the best paths of each reply tree.

    messages has conv_id, node, parent (null or unknown: a root) and score. Ancestors are found by doubling: after k
    self-joins each node knows its ancestor 2^k steps up, and each leaf's path all nodes fewer than 2^k steps up. So the number of
    joins is the logarithm of the deepest path, and only paths of leaves are expanded. Each round is written.
    Branches rank by the sum of their scores (null: 0), ties to the longer path, then the smaller leaf.
    A message above which there's no root (a circle of replies) has no path.
    """
    nodes = written(_unique(messages))
    known = nodes.select("conv_id", F.col("node").alias("up"))
    jump = written(nodes.where("parent is not null").select("conv_id", "node", F.col("parent").alias("up")).join(known, ["conv_id", "up"], "left_semi").select("conv_id", "node", "up"))
    parents = jump.select("conv_id", F.col("up").alias("node"))
    steps = nodes.join(parents, ["conv_id", "node"], "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    most, step = nodes.count(), 1
    while step <= most and not jump.isEmpty():
        higher = steps.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("depth") + step).alias("depth"))
        steps = written(steps.union(higher))
        then = jump.select("conv_id", F.col("node").alias("up"), F.col("up").alias("over"))
        jump = written(jump.join(then, ["conv_id", "up"]).select("conv_id", "node", F.col("over").alias("up")))
        step *= 2
    roots = nodes.join(nodes.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"], "left_anti").select("conv_id", "node", F.lit(1).alias("root"))
    seen = steps.join(nodes.select("conv_id", "node", "score"), ["conv_id", "node"]).join(roots, ["conv_id", "node"], "left")
    ranked = seen.groupBy("conv_id", "leaf").agg(F.sum("score").alias("total"), F.max("depth").alias("deep"), F.max("root").alias("root")).where("root = 1")
    order = Window.partitionBy("conv_id").orderBy(F.desc("total"), F.desc("deep"), "leaf")
    best = ranked.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches).select("conv_id", "leaf", "branch")
    return steps.join(best, ["conv_id", "leaf"]).select("conv_id", "leaf", "branch", "node", "depth")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, leaf, branch, formatted (string) and loss (spans start, end in code points) of each chosen path.

    messages: conv_id, node, parent, role, text, score; other columns aren't read. A turn is <s>[ROLE]role[/ROLE], the
    text (a user's within [INST] and [/INST]) and </s>. The loss mask covers each assistant's text as it stands there, escaped.
    Null role or text: empty. Null conv_id or node: left out. Of rows that repeat a node, the least by parent, score, role and text is taken.
    Trees of one message give one turn; an empty table gives no rows. A conversation is one row by its nature; its turns
    meet only when the row is built.
    """
    chosen = paths(messages, branches)
    text = _unique(messages, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select("conv_id", "node", "role", "text")
    turn = F.struct((-F.col("depth")).alias("at"), F.col("role"), escaped(F.col("text")).alias("text"))
    turns = chosen.join(text, ["conv_id", "node"]).groupBy("conv_id", "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<s>[ROLE]"), escaped(t["role"]), F.lit("[/ROLE]"), F.when(t["role"] == "user", "[INST]").otherwise(""))
    tail = lambda t: F.when(t["role"] == "user", "[/INST]</s>").otherwise("</s>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(head(t))
        last = first + F.length(t["text"])
        mask = F.when(t["role"] == "assistant", F.array_append(acc["loss"], F.struct(first.alias("start"), last.alias("end")))).otherwise(acc["loss"])
        return F.struct((last + F.length(tail(t))).alias("at"), mask.alias("loss"))

    whole = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], tail(t))), "")
    return turns.select("conv_id", "leaf", "branch", whole.alias("formatted"), F.aggregate("turns", start, step)["loss"].alias("loss"))


def read_back(formatted_text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted_text, "</s>", -1)

    def one(part: Column) -> Column:
        cut = F.split(F.substring(part, F.lit(10), F.length(part)), r"\[/ROLE\]", 2)
        body = cut[1]
        inner = F.when(cut[0] == "user", F.substring(body, F.lit(7), F.length(body) - 13)).otherwise(body)
        return F.struct(unescaped(cut[0]).alias("role"), unescaped(inner).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def loss_texts(formatted_text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted_text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def as_tree(conversations: DataFrame) -> DataFrame:
    """messages for formatted() from rows by turn: each row replies to the one before it (ties: by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


__all__ = ["as_tree", "formatted", "loss_texts", "paths", "read_back"]
