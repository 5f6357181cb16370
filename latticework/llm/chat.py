"""Conversations from reply trees, with DataFrame functions only.

Every row is a message with a parent. Pointers to ancestors double their reach in a self-join of each round and carry the
summed score of the stretch that they span, so a path of n messages takes log2(n) rounds. Leaves are ranked by the mean
score of their path; the paths of the chosen leaves are unrolled by the same pointers and each is formatted as one
conversation, whose turns are marked and whose texts are escaped reversibly.

Defined results: a null text is empty, a null role is an empty string; messages without text keep their turn; ties in rank
go to the smaller leaf; a parent that is missing makes a root; an empty table gives an empty result; rows that name each
other as parents in a ring belong to no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import discard, written

END = "<|end|>\n"
#: Control strings of this template and of common others; a backslash after the first character breaks them.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("<"), F.lit("\\<"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(messages: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A linear conversation as a tree: each row's parent is the row before it (by turn; ties by role, then text).

    Rows are sorted over all tasks by ranges, which cut a long conversation, and numbered within each range; a row's place is
    that number and the rows of its conversation in the ranges before.
    """
    order = ["tree", "turn", "role", "text"]
    rows = messages.select(messages[tree_col].alias("tree"), messages[turn_col].alias("turn"), F.coalesce(messages[role_col], F.lit("")).alias("role"), F.coalesce(messages[text_col], F.lit("")).alias("text"))
    # equal rows may fall into several ranges, in any order
    ranged = written(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "tie").withColumn("part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("tree", "part").orderBy("turn", "role", "text", "tie")
    sizes = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"))
    # a row for each range that a conversation has rows in
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("i", F.row_number().over(inner)).join(before.select(F.col("tree").alias("t"), F.col("part").alias("p"), "before"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return numbered.select("tree", (F.col("i") + F.col("before")).cast("long").alias("node"), "role", "text", F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def chosen_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, depth): the messages on the paths to the best leaves of each tree.

    messages: (tree, node, parent, score). Depth counts from the leaf, which has 0.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    parents = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    known = nodes.join(parents, (F.col("tree").eqNullSafe(F.col("t"))) & (F.col("parent") == F.col("p")), "left")
    # pointers that have passed the root (up is null) are done; only the others are joined again
    open_, done = [], []
    # a pointer that spans more messages than there are goes round a ring
    total = nodes.count()
    step = written(known.select("tree", "node", F.col("p").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("span")), "jump0")
    while True:
        done.append(step.where(F.col("up").isNull()))
        open_.append(step.where(F.col("up").isNotNull()))
        if 2 ** (len(open_) - 1) > total or open_[-1].isEmpty():
            break
        reach = open_[-1]
        for d in done:
            reach = reach.unionByName(d)
        far = reach.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("span").alias("span2"))
        step = written(
            open_[-1].join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("span") + F.col("span2")).alias("span")),
            f"jump{len(open_)}",
        )
    jump = done[0]
    for d in done[1:]:
        jump = jump.unionByName(d)
    inner = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = jump.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("span")), "node")
    used = []
    paths = leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_tree).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(open_) - 1)):
        # from the longest pointers down: each message found so far adds the one 2^k above it
        step = open_[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") + 2**k).alias("depth"))
        paths = paths.unionByName(more)
        if k:
            used.append(written(paths, f"paths{k}"))
            paths = used[-1]
    out = written(paths, "paths")
    discard(*open_, *used)
    return out


def formatted(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, segments, formatted): each chosen path as text; segments tell which parts the loss covers.

    messages: (tree, node, parent, role, text, score).
    """
    paths = chosen_paths(messages, per_tree)
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    grouped = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit("<|"), escaped_role(t["role"]), F.lit("|>\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    return grouped.select("tree", "leaf", segments.alias("segments")).withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def read_back(formatted_text: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    parts = F.split(formatted_text, r"<\|end\|>\n", -1)
    head = r"(?s)^<\|((?:[^|\\]|\\.)*+)\|>\n(.*)$"
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(turns, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted()."""
    read = conversations.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
