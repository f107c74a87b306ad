"""Chat formatting of reply trees.

Messages form trees by parent id.  Root-to-leaf paths are enumerated by
iterative self-joins that double the distance of the known ancestors, branches
are ranked by score, and each chosen path is formatted as one conversation.
Control strings inside texts are escaped reversibly, so a template mark in the
output is always a mark.  DataFrame operations only.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_or_empty, written

# The template.  No mark can occur in an escaped text, which has no "<" and no "[".
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """Backslash codes for the characters that begin control strings."""
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("["))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, up): every message on the path from each leaf to its root.

    messages: (node, parent), node unique, parent null at roots.  A message
    whose parent is missing is a root, and so is every message on a cycle of
    parents, which has no other.  Round k joins the paths known so far
    with the ancestors at distance 2^k, so the rounds are the logarithm of the
    depth; rows are the sum of the path lengths, which is the output's size.
    """
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent"))
    jump = written(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("above")), "jump")
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    got = written(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    step, n = 1, nodes.count()
    while jump.take(1):
        if step > n:      # ancestors further up than there are messages lie on cycles
            cycle = jump.select(F.col("above").alias("node")).distinct().withColumn("cyclic", F.lit(True))
            cut = nodes.join(cycle, "node", "left").select("node", F.when(F.col("cyclic").isNull(), F.col("parent")).alias("parent"))
            return paths(cut)
        more = got.join(jump, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        got = written(got.union(more), "paths")
        far = jump.withColumnRenamed("above", "middle").join(jump.select(F.col("node").alias("middle"), "above"), "middle")
        jump = written(far.select("node", "above"), "jump")
        step *= 2
    return got


def format_paths(messages: DataFrame, branches: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted conversation per chosen root-to-leaf path.

    messages: (node, parent, root, role, text, score); ``root`` names the tree.
    Paths of a tree are ranked by mean score, then leaf; ``branches`` keeps the
    best ones (all by default).  Returns root, leaf, formatted, loss_spans
    ((start, length) in code points of the escaped texts of the roles in
    ``learn``) and, with ``branches``, rank.  Null roles and texts count as empty,
    null scores as 0; an empty table gives no rows; messages that repeat need
    nodes of their own (as ``conversation_trees`` gives them).
    """
    p = paths(messages).join(messages.select("node", "root", text_or_empty("role").alias("role"), text_or_empty().alias("text"),
                                             F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    turn = F.struct((-F.col("up")).alias("at"), "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"), escape(F.col("text")).alias("body"))
    one = p.groupBy("root", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    if branches is not None:
        w = Window.partitionBy("root").orderBy(F.desc("score"), "leaf")
        one = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches)
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # running length of the output at each turn, kept as an array of spans
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))
    span = lambda s, t: F.struct((s["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))
    spans = F.aggregate("turns", zero, lambda s, t: F.struct(
        (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("long").alias("at"),
        F.when(t["role"].isin(*learn), F.concat(s["spans"], F.array(span(s, t)))).otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])
    return one.select("root", "leaf", formatted.alias("formatted"), spans.alias("loss_spans"), *(["rank"] if branches is not None else []))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, "<\\|end\\|>\\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda t: F.substring_index(F.substring(t, len(TURN) + 1, 1 << 30), BODY, 1)
    return F.transform(parts, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(F.substring_index(t, BODY, -1)).alias("text")))


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each row
    replies to the row before it by turn (then role and text; null turns
    first; repeated rows follow one another)."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    got = rows.withColumn("n", F.row_number().over(w))
    node = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    return got.select(node(F.col("n")).alias("node"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"), F.col("conv_id").alias("root"),
                      "role", "text", F.lit(None).cast("double").alias("score"))
