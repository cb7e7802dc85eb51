"""Reply trees to chat texts.

A tree's rows name their parents. Iterative self-joins with doubling steps find every
node's way to its root (a chain of n rows takes log2 n rounds), branches are ranked by
score, and each chosen root-to-leaf path becomes one conversation in a template whose
control strings are escaped inside texts, so that the text can be read back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm.common import blank_null, stored

# fixed values: the template
HEAD, MIDDLE, TAIL = "### ", "</role>\n", "</turn>\n"
TURN = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    """No ``##`` and no ``</`` is left, and every backslash starts a pair."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"#(?=#)|<(?=/)", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def reply_paths(
    df: DataFrame, tree: str, node: str, parent: str, score: str, branches: int = 1
) -> DataFrame:
    """``_tree, branch, leaf, _node, position``: the nodes of the ``branches`` best root-to-leaf
    paths of each tree, branch 1 first, positions from 0 at the root.

    A path's score is the mean of its nodes' scores (null: 0), ties go to the smaller leaf.
    A node whose parent is null or absent is a root. Nodes on or under a cycle reach no root
    and belong to no path. Nodes must be unique and non-null in a tree; a null tree is a tree.
    """
    nodes = df.select(
        F.col(tree).alias("_tree"), F.col(node).alias("_node"), F.col(parent).alias("_up"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_sum"),
    )
    known = nodes.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"))
    same = F.col("_tree").eqNullSafe(F.col("_t"))
    steps = stored(
        nodes.join(known, same & (F.col("_up") == F.col("_n")), "left").select(
            "_tree", "_node", F.col("_n").alias("_up"), "_sum", F.lit(1).cast("long").alias("_count")
        )
    )
    first, jumps, at_root = steps, [], []
    most = steps.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        # rows at their root are settled; only the others go on
        at_root.append(steps.where(F.col("_up").isNull()))
        going = steps.where(F.col("_up").isNotNull())
        if 2 ** len(jumps) > most or going.isEmpty():
            break
        jumps.append(going.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"), F.col("_up").alias("_a")))
        every = reduce(DataFrame.unionByName, at_root, going)
        beyond = every.select(
            F.col("_tree").alias("_t"), F.col("_node").alias("_n"), F.col("_up").alias("_a"),
            F.col("_sum").alias("_s"), F.col("_count").alias("_c"),
        )
        steps = stored(
            going.join(beyond, same & (F.col("_up") == F.col("_n"))).select(
                "_tree", "_node", F.col("_a").alias("_up"),
                (F.col("_sum") + F.col("_s")).alias("_sum"), (F.col("_count") + F.col("_c")).alias("_count"),
            )
        )
    settled = reduce(DataFrame.unionByName, at_root)
    parents = first.where(F.col("_up").isNotNull()).select(F.col("_tree").alias("_t"), F.col("_up").alias("_n")).distinct()
    leaves = settled.join(parents, same & (F.col("_node") == F.col("_n")), "left_anti")
    best = Window.partitionBy("_tree").orderBy((F.col("_sum") / F.col("_count")).desc(), "_node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    paths = stored(chosen.select("_tree", "branch", F.col("_node").alias("leaf"), "_node", (F.col("_count") - 1).alias("position")))
    for k, jump in enumerate(jumps):
        more = paths.join(jump, same & (F.col("_node") == F.col("_n")))
        more = more.select("_tree", "branch", "leaf", F.col("_a").alias("_node"), (F.col("position") - 2**k).alias("position"))
        paths = stored(paths.unionByName(more))
    return paths


def templated(turns: Column) -> Column:
    """The chat text of an array of (role, text)."""
    shown = F.transform(turns, lambda t: F.concat(F.lit(HEAD), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(TAIL)))
    return F.array_join(shown, "")


def loss_mask(turns: Column, roles: list[str]) -> Column:
    """Spans (start, length), in code points of the chat text, of the escaped texts of ``roles``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(HEAD) + F.length(escaped(t["role"])) + len(MIDDLE)
        length = F.length(escaped(t["text"]))
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct(
            (begin + length + len(TAIL)).alias("at"),
            F.when(t["role"].isin(roles), F.concat(state["found"], span)).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(turns, start, step, lambda s: s["found"])


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that a chat text was made of."""
    pieces = F.split(formatted, TAIL, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    parts = lambda p: F.split(F.substr(p, F.lit(len(HEAD) + 1)), MIDDLE, -1)
    return F.transform(whole, lambda p: F.struct(unescaped(parts(p)[0]).alias("role"), unescaped(parts(p)[1]).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(formatted, m["start"] + 1, m["length"]))), "")


def format_trees(
    df: DataFrame, tree: str, node: str, parent: str, score: str, role: str = "role", text: str = "text",
    branches: int = 1, learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per chosen path: ``tree, branch, formatted`` and ``mask`` (spans of the
    learned roles' texts). Null roles and texts are empty. A conversation is one text, so
    its rows meet in one task; trees do not."""
    paths = reply_paths(df, tree, node, parent, score, branches)
    rows = df.select(
        F.col(tree).alias("_t"), F.col(node).alias("_n"),
        F.struct(blank_null(role).alias("role"), blank_null(text).alias("text")).alias("_turn"),
    )
    placed = paths.join(rows, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_node") == F.col("_n")))
    grouped = placed.groupBy("_tree", "branch").agg(
        F.array_sort(F.collect_list(F.struct("position", "_turn"))).alias("_turns")
    )
    turns = F.col("_turns._turn")
    shown = grouped.select(F.col("_tree").alias(tree), "branch", templated(turns).alias("formatted"), loss_mask(turns, list(learned)).alias("mask"))
    return shown


def as_trees(df: DataFrame, conversation: str, *order: str) -> DataFrame:
    """Rows of linear conversations as trees: ``node`` numbers a conversation's rows by
    ``order`` from 1, ``parent`` is the row before, ``score`` is 1; columns of these names are
    replaced. Rows equal in ``order`` are numbered in any order among themselves."""
    numbered = Window.partitionBy(conversation).orderBy(*order)
    at = df.withColumn("node", F.row_number().over(numbered))
    return at.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))
