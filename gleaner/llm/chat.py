"""Chat formatting from reply trees, native.

Messages form trees by parent.  Ancestors are found by iterative self-joins that double the
distance each round, so that a thread of n turns takes about log2 n of them; from the leaves,
the same rounds enumerate the messages of every root-to-leaf path.  Paths of a tree are
ranked by the sum of their messages' scores (ties: the smaller leaf), and each chosen path is
formatted as one conversation.

Template: ``### <role>:`` newline, the text, ``</turn>`` newline.  Inside roles and texts a
backslash becomes ``\\b``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\t``; in roles also a
colon ``\\c`` and a newline ``\\n``.  After a backslash stands exactly one code letter, so that it
reads back without doubt.  The loss mask lists the character spans of assistant texts.

Defined results: null texts and roles are empty; a null conv_id is a conversation; turns that repeat a number are ordered by
role and text; a message whose parent is missing is a root; messages on a cycle belong to no
path; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HEAD, MID, END = "### ", ":\n", "</turn>\n"


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for a, b in (("###", "\\h"), ("</turn>", "\\t")) + (((":", "\\c"), ("\n", "\\n")) if role else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, role: bool = False) -> Column:
    for a, b in (("###", "\\h"), ("</turn>", "\\t")) + (((":", "\\c"), ("\n", "\\n")) if role else ()):
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def linear(turns: DataFrame) -> DataFrame:
    """Messages (conv_id, id, parent, role, text, score) of conversations whose turns reply to the turn before."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("id", F.row_number().over(w).cast("long"))
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, id, up): every message of every root-to-leaf path, `up` steps above its leaf; conv_id is a struct, as joins pass over nulls."""
    ids = messages.select("conv_id", "id")
    links = messages.where("parent is not null").select("conv_id", "id", F.col("parent").alias("to"))
    links = links.join(ids.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_semi")
    links = common.written(links.select("conv_id", "id", "to"), "links")
    leaves = ids.join(links.select("conv_id", F.col("to").alias("id")), ["conv_id", "id"], "left_anti")
    got = common.written(leaves.select("conv_id", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "paths")
    step, most = 1, ids.count()
    while not links.isEmpty():
        before, last = got, links
        got = common.written(got.unionByName(got.join(links, ["conv_id", "id"]).select("conv_id", "leaf", F.col("to").alias("id"), (F.col("up") + step).alias("up"))), "paths")
        onward = links.select("conv_id", F.col("id").alias("from"), F.col("to").alias("id")).join(links, ["conv_id", "id"])
        links = common.written(onward.select("conv_id", F.col("from").alias("id"), "to"), "links")
        common.dropped(before)
        common.dropped(last)
        step *= 2
        if step > most:  # only messages on a cycle go on so long, and no leaf reaches them
            break
    return got


def formatted(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """conv_id, leaf, rank, score, formatted, mask: the `best` paths of each tree (all, if None)."""
    messages = messages.withColumn("conv_id", F.struct("conv_id"))  # never null itself, so that a null conv_id joins too
    steps = paths(messages).join(messages.select("conv_id", "id", "role", "text", "score"), ["conv_id", "id"])
    if best is not None:
        scores = steps.groupBy("conv_id", "leaf").agg(F.sum("score").alias("total"))
        root = steps.groupBy("conv_id", "leaf").agg(F.max_by("id", "up").alias("root"))
        w = Window.partitionBy("conv_id", "root").orderBy(F.desc("total"), "leaf")
        chosen = scores.join(root, ["conv_id", "leaf"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= best)
        steps = steps.join(chosen.select("conv_id", "leaf"), ["conv_id", "leaf"], "left_semi")
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), True), F.lit(MID))
    body = escaped(F.col("text"))
    turn = F.concat(head, body, F.lit(END))
    # Where a turn starts: the length of the turns above it, by a running sum over the path.
    w = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up"))
    steps = steps.withColumn("turn", turn).withColumn("end", F.sum(F.length("turn").cast("long")).over(w)).withColumn("body", F.length(body).cast("long"))
    last = F.col("end") - len(END)
    span = F.when(F.col("role") == learn, F.struct((last - F.col("body")).alias("start"), last.alias("end")))
    both = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), F.col("turn"), span.alias("span"))))
    grouped = steps.groupBy("conv_id", "leaf").agg(both.alias("t"), F.sum("score").alias("score"))
    return grouped.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        "leaf",
        F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")).alias("rank"),
        "score",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"),
    )


def read_back(done: DataFrame) -> DataFrame:
    """turns (role, text) and loss texts of each formatted conversation, from its string and mask alone."""
    pieces = F.split("formatted", F.lit(END.replace("/", "\\/")))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, MID)
        return F.struct(unescaped(F.substring(x, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), True).alias("role"), unescaped(F.substring(x, at + len(MID), F.length(x))).alias("text"))

    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return done.select("*", F.transform(pieces, turn).alias("turns"), loss.alias("loss"))
