"""Chat formatting of reply trees, with DataFrame functions only.

Trees are tables of nodes with parents. Iterated self-joins by doubling (a node's ancestor 2^k steps
up comes from joining the table of 2^(k-1) steps with itself) give every root-to-leaf path in as many
joins as the logarithm of the deepest path. Paths are ranked in their tree by the sum of their nodes'
scores, and each chosen path becomes one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n    for each turn

Control strings inside texts and roles are escaped reversibly: between a control string's first
character and the rest goes one backslash more than stood there. Line ends and per cent signs of
roles are written as %0A and %25. The loss mask is a list of spans, in bytes of the UTF-8 form, one
for each assistant turn.

Results for odd input: null text and null role are empty; nodes without a tree or an id are left out;
a node whose parent is not in its tree is a root; of rows with one node id each makes a path of its own where it is a
leaf, and the first (by parent, role, text and score) stands for all of them where it is not; an empty table gives no rows; parents that form a circle raise ValueError; other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that a trainer may take for control marks, by first character and rest.
CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>|/?INST\])"
_PLAIN, _ESCAPED = rf"([<\[])(\\*){CONTROL}", rf"([<\[])\\(\\*){CONTROL}"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _PLAIN, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as trees of one path each: (tree, node, parent, role, text, score). Ties go by role and text."""
    w = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("tree"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def paths(nodes: DataFrame, scratch: Scratch, most: int = 40) -> DataFrame:
    """(tree, leaf, copy, node, at, above): every leaf (a row of a leaf's id, its ``copy``) with each node on its path, ``above`` steps up.

    ``at`` is the copy of the node: the leaf's own, and 1 above it. ``nodes`` has tree, node, copy and parent.
    """
    skeleton = scratch.save("skeleton", nodes.select("tree", "node", "copy", "parent"))
    own = skeleton.select("tree", "node", "copy")
    parents = own.where("copy = 1").select("tree", F.col("node").alias("up"))
    jump = skeleton.where("parent is not null").select("tree", "node", "copy", F.col("parent").alias("up")).join(parents, ["tree", "up"], "left_semi").select("tree", "node", "copy", "up")
    jumps = [scratch.save("jump-0", jump)]
    while not jumps[-1].isEmpty():
        if len(jumps) > most:
            raise ValueError("parents form a circle")
        a = jumps[-1]
        b = a.where("copy = 1").select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        jumps.append(scratch.save(f"jump-{len(jumps)}", a.join(b, ["tree", "up"]).select("tree", "node", "copy", F.col("far").alias("up"))))
    inner = jumps[0].select("tree", F.col("up").alias("node"))
    out = own.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "copy", "node", F.col("copy").alias("at"), F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps[:-1]):
        up = jump.withColumnRenamed("copy", "at")
        further = out.join(up, ["tree", "node", "at"]).select("tree", "leaf", "copy", F.col("up").alias("node"), F.lit(1).alias("at"), (F.col("above") + (1 << k)).alias("above"))
        out = scratch.save(f"paths-{k}", out.unionByName(further))
        scratch.drop(f"paths-{k - 1}", f"jump-{k}")
    return out


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``copy``: 1, 2, .. among the rows of one id. Where no id repeats, the rows do not move."""
    repeated = nodes.groupBy("tree", "node").count().where("count > 1").select("tree", "node")
    if repeated.isEmpty():
        return nodes.withColumn("copy", F.lit(1))
    order = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    many = nodes.join(repeated, ["tree", "node"], "left_semi").withColumn("copy", F.row_number().over(order))
    return nodes.join(repeated, ["tree", "node"], "left_anti").withColumn("copy", F.lit(1)).unionByName(many)


def format_trees(nodes: DataFrame, branches: int | None = 1, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of the ``branches`` best paths of each tree (None: of all).

    ``nodes`` has tree, node, parent, role, text and score; equal scores rank by leaf. loss_spans is an
    array of (start, length) in bytes.
    """
    scratch = Scratch(nodes.sparkSession)
    given = scratch.save("given", nodes.where("tree is not null and node is not null").select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    nodes = numbered(given)
    steps = paths(nodes, scratch)
    spot = [F.col("copy").alias("at") if c == "copy" else F.col(c) for c in ("tree", "node", "copy")]
    sums = steps.join(nodes.select(*spot, "score"), ["tree", "node", "at"]).groupBy("tree", "leaf", "copy").agg(F.sum("score").alias("total"))
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf", "copy")))
    if branches is not None:
        best = best.where(F.col("rank") <= branches)
    turns = steps.join(best.select("tree", "leaf", "copy", "rank"), ["tree", "leaf", "copy"]).join(nodes.select(*spot, "role", "text"), ["tree", "node", "at"])
    head = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", "rank", "above", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("above"), "role", "head", "body")
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - len(END) - F.octet_length("body")
    span = F.when(F.col("role") == trained, F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length")))
    turns = turns.select("tree", "leaf", "rank", F.struct("n", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span")).alias("part"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")
    at = lambda t: F.instr(t, "\n") if isinstance(t, str) else F.position(F.lit("\n"), t)

    def turn(t: Column) -> Column:
        role = F.substring(t, F.lit(len(BEGIN) + 1), at(t) - (len(BEGIN) + 1))
        text = F.substring(t, at(t) + 1, F.length(t))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    cut = F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.array_join(cut, "")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Conversations by turn, formatted as chains and read back from the output alone."""
    done = format_trees(chains(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("tree", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
