"""Violating and compliant sibling threads: path checks, candidates and the greedy choice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of ids."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok")), lambda s, e: F.struct((s["n"] + (s["ok"] & e).cast("int")).alias("n"), (s["ok"] & e).alias("ok")), lambda s: s["n"])


#: What can be wrong with a thread, in the order in which one comment is looked at.
ISSUES = ("removed_or_deleted", "has_media", "moderator_in_thread", "edited_comment", "mod_response")


def first_issue(paths: DataFrame, facts: DataFrame, node: str = "id") -> DataFrame:
    """(node, violating, compliant): the first fault of each root path, looking from its end upwards; null for sound paths.

    paths: node and path (array, root first); facts: id, removed, media, moderator, edited, mod_reply, where null is false. On
    every comment of the path the order is removed, media, moderator. The end itself must in a violating thread not be edited
    (its moderator's answer is expected), and in a compliant one have no moderator's answer (edits are no fault).
    """
    steps = paths.select(node, F.size("path").alias("__n"), F.posexplode("path").alias("__pos", "__at"))
    known = facts.select(F.col("id").alias("__at"), "removed", "media", "moderator", "edited", "mod_reply")
    leaf = F.col("__pos") == F.col("__n") - 1
    far = (F.col("__n") - F.col("__pos")).alias("far")
    names = F.array(*[F.lit(x) for x in ISSUES])

    def first(end: Column):
        code = F.when(F.col("removed"), 0).when(F.col("media"), 1).when(F.col("moderator"), 2).otherwise(F.when(leaf, end))
        return F.min(F.when(code.isNotNull(), F.struct(far, code.alias("code"))))

    worst = steps.join(known, "__at", "left").groupBy(node).agg(first(F.when(F.col("edited"), 3)).alias("v"), first(F.when(F.col("mod_reply"), 4)).alias("c"))
    return worst.select(node, *[F.when(F.col(k).isNotNull(), names[F.col(k + ".code")]).alias(m) for k, m in (("v", "violating"), ("c", "compliant"))])


def candidates(violating: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compliant candidates of each violating node in its tree: those of the same depth, and of one less from depth 2 on, but
    not itself or its parent. violating: pair, tree, id, parent, depth, path, ord; nodes: tree, id, depth, path, score. Both must
    hold sound threads only."""
    n = nodes.select("tree", F.col("id").alias("cand"), F.col("depth").alias("cdepth"), F.col("path").alias("cpath"), "score")
    # the depths wanted are listed first, so that the join is an equality and each node meets only its own level
    want = violating.withColumn("cdepth", F.explode(F.when(F.col("depth") >= 2, F.array("depth", F.col("depth") - 1)).otherwise(F.array("depth"))))
    rows = want.join(n, ["tree", "cdepth"]).where((F.col("cand") != F.col("id")) & ~F.col("cand").eqNullSafe(F.col("parent")))
    return rows.select("pair", "tree", "ord", "id", "cand", "cdepth", "score", common_prefix(F.col("path"), F.col("cpath")).cast("bigint").alias("common"), F.size("cpath").cast("bigint").alias("length"))


def best(cands: DataFrame) -> DataFrame:
    """The best candidate of each pair: most common ancestors, longest, lowest score, smallest id."""
    order = F.struct(-F.col("common"), -F.col("length"), F.coalesce("score", F.lit(0)), "cand")
    return cands.groupBy("pair").agg(F.min_by(F.struct("tree", "id", "cand", "common", "length"), order).alias("b")).select("pair", "b.*")


def greedy(cands: DataFrame) -> DataFrame:
    """(pair, tree, id, cand, common): candidates given out without replacement, in the order of ord within each tree.

    Inherently in order within a tree, so each tree is one group. Of a tree with k pairs only the best k candidates of each pair
    are in it: at most k - 1 of them can be gone when the pair's turn comes.
    """
    order = Window.partitionBy("pair").orderBy(F.desc("common"), F.desc("length"), F.coalesce("score", F.lit(0)), "cand")
    turns = cands.groupBy("tree").agg(F.count_distinct("pair").alias("__k"))
    cands = cands.withColumn("__i", F.row_number().over(order)).join(turns, "tree").where("__i <= __k").drop("__i", "__k")

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=pdf["score"].fillna(0)).sort_values(["ord", "pair", "common", "length", "score", "cand"], ascending=[True, True, False, False, True, True])
        used, out, done = set(), [], set()
        for r in pdf.itertuples(index=False):
            if r.pair not in done and r.cand not in used:
                used.add(r.cand)
                done.add(r.pair)
                out.append((r.pair, r.tree, r.id, r.cand, r.common))
        return pd.DataFrame(out, columns=["pair", "tree", "id", "cand", "common"])

    return cands.groupBy("tree").applyInPandas(give, "pair string, tree string, id string, cand string, common bigint")
