"""Chat formatting of reply trees, with DataFrame functions only.

Iterative self-joins double how far each message sees towards its root, which gives every message its depth and the score of its branch;
the best branches of a conversation are chosen, the same jumps taken back list the messages on them, and each branch becomes one
conversation in the template.  A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break.  Inside roles and texts a backslash
is doubled and a control string gets one after its first sign, so none can close or open a turn, and reading back restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import stored

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def best_branches(messages: DataFrame, conv: str, key: str, parent: str, order: str, role: str, text: str, score: str, branches: int = 1) -> DataFrame:
    """The turns of each conversation's best branches: ``__conv, __leaf, __depth`` (from 1), ``role, text``.

    A branch runs from a root to a message without replies; its score is the sum of its messages' scores, ties go to the longer branch, then to
    the greater leaf.  A message whose parent is NULL, absent or not earlier in (``order``, key) is a root, so there are no cycles.  Rows
    with equal conversation and key are one message, the greatest of them; NULL keys count as one key, NULL scores as 0.
    """
    row = F.struct(F.col(parent).alias("parent"), F.col(order).alias("order"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    found = messages.select(F.struct(F.col(conv).alias("v")).alias("conv"), F.struct(F.col(key).alias("v")).alias("node"), row.alias("row"))
    found = found.groupBy("conv", "node").agg(F.max("row").alias("row")).select("conv", "node", "row.*")
    # From here on a message is a number, written with it, so that jumps are rows of four numbers.
    nodes = stored(found.withColumn("n", F.monotonically_increasing_id()), "chat-messages")
    links = nodes.select("n", "conv", F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("v"))).alias("up_node"), F.struct("order", "node").alias("time"), "score")
    earlier = nodes.select("conv", F.col("node").alias("up_node"), F.struct("order", "node").alias("up_time"), F.col("n").alias("up"))
    checked = links.join(earlier, ["conv", "up_node"], "left").select("n", F.when(F.col("up_time") < F.col("time"), F.col("up")).alias("up"), F.lit(1).alias("depth"), F.col("score").alias("total"))
    jumps = [stored(checked, "chat-jump")]
    replied = jumps[0].where("up IS NOT NULL").select(F.col("up").alias("n"))
    while jumps[-1].where("up IS NOT NULL").limit(1).count():
        last = jumps[-1]
        above = last.select(F.col("n").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("total").alias("rest"))
        # A message that sees its root stays as it is.
        farther = last.where("up IS NOT NULL").join(above, "up").select("n", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("rest")).alias("total"))
        jumps.append(stored(last.where("up IS NULL").unionByName(farther), "chat-jump"))
    depths = jumps.pop()
    leaves = depths.join(replied, "n", "left_anti").select("n", "depth", "total").join(nodes.select("n", "conv", "node"), "n")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), F.desc("node")))
    path = leaves.withColumn("place", place).where(F.col("place") <= branches).select(F.col("n").alias("leaf"), "n")
    for jump in reversed(jumps):
        step = jump.where("up IS NOT NULL").select("n", "up")
        path = stored(path.unionByName(path.join(step, "n").select("leaf", F.col("up").alias("n"))), "chat-path")
    turns = path.join(nodes.select("n", "conv", "role", "text"), "n").join(depths.select("n", "depth"), "n")
    turns = turns.join(nodes.select(F.col("n").alias("leaf"), F.col("node").alias("leaf_node")), "leaf")
    return turns.select(F.col("conv.v").alias("__conv"), F.col("leaf_node.v").alias("__leaf"), F.col("depth").alias("__depth"), "role", "text")


def format_branches(turns: DataFrame) -> DataFrame:
    """One row per conversation and leaf: ``formatted`` and ``loss``, the spans (code points: start, length) of assistant texts in it."""
    body = escape(F.col("text"))
    pieces = turns.select("__conv", "__leaf", "__depth", "role", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR)).alias("head"), body.alias("body"))
    before = Window.partitionBy("__conv", "__leaf").orderBy("__depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    spans = pieces.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    turn = F.struct("__depth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    grouped = spans.groupBy("__conv", "__leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("__conv", "__leaf", F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def format_chats(messages: DataFrame, conv: str = "conv_id", key: str = "message_id", parent: str = "parent_id", order: str = "turn", role: str = "role", text: str = "text", score: str = "score", branches: int = 1) -> DataFrame:
    """``__conv, __leaf, formatted, loss`` for the best branches of every conversation.

    A NULL conversation id is a conversation like any other; NULL roles and texts are empty; other columns are not read; an empty table
    gives no rows.  One conversation is one output text, so its turns meet in one task; nothing else is gathered.
    """
    return format_branches(best_branches(messages, conv, key, parent, order, role, text, score, branches))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as ``role`` and ``text`` before escaping."""
    pieces = F.filter(F.split(formatted, "<\\|im_end\\|>\\n"), lambda p: p != "")
    part = lambda p, i: F.element_at(F.split(p, "<\\|im_sep\\|>"), i)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(part(p, 1), len(START) + 1, (1 << 31) - 1)).alias("role"), unescape(part(p, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, before escaping."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s.getField("start") + 1, s.getField("length"))))
