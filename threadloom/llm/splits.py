"""Problem 6: splits in which related records stay together, by grouped iterative stratification."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import TASK_ROWS, cut
from ..sources.tables import table
from .pairs import distinct_pairs, needed_authors, sides

SHARES = {"train": 0.70, "val": 0.10, "test": 0.20}


def related(pairs: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, node) and (node, component): a node is a community, or the pair itself where it has none.

    authors: (pair, author). Nodes are linked through each submission and author they share, by way of the smallest node
    that has it: as many links as there are nodes with it, so a token of a third of all pairs makes no pairs of pairs.
    """
    node = F.coalesce(F.concat(F.lit("c:"), "community"), F.concat(F.lit("p:"), "pair"))
    nodes = pairs.select("pair", "submission", node.alias("node"))
    tokens = nodes.where("submission is not null").select("node", F.concat(F.lit("s:"), "submission").alias("token")).unionByName(nodes.join(authors, "pair").select("node", F.concat(F.lit("a:"), "author").alias("token"))).distinct()
    least = tokens.groupBy("token").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = tokens.join(least, "token").select("node", "least").where("node != least").distinct()
    found = components(links, "node", "least")
    alone = nodes.select("node").distinct()
    return nodes.select("pair", "node"), alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def stratify(labels: DataFrame, shares: dict[str, float] = SHARES, *, task_rows: int = TASK_ROWS) -> DataFrame:
    """(component, split) from (component, label, n), the label counts of each component.

    Again and again the label with the fewest records still to place is taken; its components, largest first, each go to
    the split that lacks most of what the component holds: where it lowers most the squared gaps of all its labels, each
    measured by the split's goal. One task holds at most about task_rows label counts: of more, the largest components are
    placed first against the goals of all data, and what each split then lacks of each label is the goal of the rest, which
    is placed in hashed blocks, each against its part of it. A component larger than a split's share can only overfill it.
    Nulls count as a label of their own; an empty table gives an empty one.
    """
    whole = sum(shares.values())
    names = list(shares)
    keyed = labels.select("component", F.coalesce("label", F.lit("(none)")).alias("label"), "n")
    if keyed.count() <= task_rows:
        return keyed.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(1))).groupBy("block").applyInPandas(_placer(names, None, shares), "component string, split string")
    sizes = keyed.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("rows"))
    # as many of the largest as fit one task: sizes are numbers of records, of which there are few different ones
    by_size = sizes.groupBy("size").agg(F.sum("rows").alias("rows")).orderBy(F.desc("size")).limit(task_rows).collect()
    held, least = 0, math.inf
    for r in by_size:
        if held + r.rows > task_rows:
            break
        held, least = held + r.rows, r["size"]
    big = sizes.select("component", (F.col("size") >= F.lit(float(least))).alias("big"))
    keyed = cut(keyed.join(big, "component"))
    # goals: one row a label; labels are names of rule clusters, of which there are as many as moderators' kinds of rules
    goal = {r.label: {s: r.n * shares[s] / whole for s in names} for r in keyed.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    schema = "component string, split string"
    head = cut(keyed.where("big").withColumn("block", F.pmod(F.xxhash64("component"), F.lit(1))).groupBy("block").applyInPandas(_placer(names, {0: goal}, shares), schema))
    for r in keyed.where("big").join(head, "component").groupBy("label", "split").agg(F.sum("n").alias("n")).collect():
        goal[r.label][r.split] -= r.n
    rest = keyed.where("not big")
    blocks = max(1, math.ceil(rest.count() / task_rows))
    cells = rest.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"))
    left = {l: max(1, sum(v.values())) for l, v in goal.items()}
    part: dict[int, dict] = {k: {} for k in range(blocks)}
    for r in cells.groupBy("block", "label").agg(F.sum("n").alias("n")).collect():
        part[r.block][r.label] = {s: goal[r.label][s] * r.n / left[r.label] for s in names}
    tail = cells.groupBy("block").applyInPandas(_placer(names, part, shares), schema)
    return head.unionByName(tail)


def _placer(names: list[str], goals: dict[int, dict[str, dict[str, float]]] | None, shares: dict[str, float] = SHARES):
    """The function that places the components of one group; goals by group and label, or none for the group's own totals."""

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors: dict[str, dict[str, int]] = defaultdict(dict)
        for c, l, n in zip(pdf["component"], pdf["label"], pdf["n"]):
            vectors[c][l] = int(n)
        left: dict[str, int] = defaultdict(int)
        holders: dict[str, list[str]] = defaultdict(list)
        for c, v in vectors.items():
            for l, n in v.items():
                left[l] += n
                holders[l].append(c)
        whole = sum(shares[s] for s in names)
        lack = {s: {l: n * shares[s] / whole if goals is None else goals[int(key[0])][l][s] for l, n in left.items()} for s in names}
        goal = {s: {l: max(n, 1e-9) for l, n in lack[s].items()} for s in names}
        done: dict[str, str] = {}
        while left:
            label = min(left, key=lambda l: (left[l], l))
            for c in sorted((c for c in holders[label] if c not in done), key=lambda c: (-vectors[c][label], -sum(vectors[c].values()), c)):
                v = vectors[c]
                s = max(names, key=lambda s: (sum(n * (2 * lack[s][l] - n) / goal[s][l] for l, n in v.items()), lack[s][label], -names.index(s)))
                done[c] = s
                for l, n in vectors[c].items():
                    lack[s][l] -= n
                    if l in left:
                        left[l] -= n
            del left[label]
        return pd.DataFrame({"component": list(done), "split": list(done.values())})

    return place


def _related(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = cut(distinct_pairs(table(spark, folder, "thread_pairs")))
    each = sides(pairs)
    authors = each.join(needed_authors(table(spark, folder, "comments"), each), "comment").select("pair", "author").distinct()
    nodes, comps = related(pairs, authors)
    return pairs, nodes, cut(comps)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    _, _, comps = _related(spark, folder)
    named = comps.where("node like 'c:%'").select(F.substring("node", 3, 10**6).alias("name"), "component")
    a, b = named.withColumnRenamed("name", "subreddit_a"), named.withColumnRenamed("name", "subreddit_b")
    return a.join(b, "component").where("subreddit_a < subreddit_b").select("subreddit_a", "subreddit_b")


def assigned(pairs: DataFrame, nodes: DataFrame, comps: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(pair, component, label, split)."""
    rows = cut(nodes.join(comps, "node").join(pairs.select("pair", "label"), "pair").select("pair", "component", "label"))
    counts = cut(rows.groupBy("component", "label").agg(F.count("*").alias("n")))
    return rows.join(stratify(counts, shares), "component")


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(*_related(spark, folder)).select(F.col("pair").alias("mod_comment_id"), "split", "component")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = assigned(*_related(spark, folder)).groupBy("split", "label").agg(F.count("*").alias("pairs"))
    return rows


_FOUND = """WITH RECURSIVE pair AS (SELECT nullif(regexp_replace(trim(mod_comment_id), '^t[0-9]_', ''), '') AS pair, max(nullif(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '')) AS community,
  max(nullif(regexp_replace(trim(submission_id), '^t[0-9]_', ''), '')) AS sub, max(nullif(regexp_replace(trim(violating_comment_id), '^t[0-9]_', ''), '')) AS v, max(nullif(regexp_replace(trim(compliant_comment_id), '^t[0-9]_', ''), '')) AS k FROM thread_pairs GROUP BY 1),
author AS (SELECT DISTINCT regexp_replace(trim(id), '^t[0-9]_', '') AS id, regexp_replace(lower(trim(author)), '^/?u/', '') AS author FROM comments WHERE author IS NOT NULL AND regexp_replace(lower(trim(author)), '^/?u/', '') NOT IN ('', '[deleted]', '[removed]')),
side AS (SELECT pair, community, v AS id FROM pair UNION ALL SELECT pair, community, k FROM pair),
token AS (SELECT community, 's' || sub AS token FROM pair WHERE sub IS NOT NULL AND community IS NOT NULL UNION SELECT community, 'a' || author FROM side JOIN author USING (id) WHERE community IS NOT NULL),
link AS (SELECT DISTINCT a.community AS a, b.community AS b FROM token a JOIN token b USING (token)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS subreddit_a, b AS subreddit_b FROM reach WHERE a < b"""
ORACLE = {"p6_found": _FOUND}
QUERIES = {"p6_found": p6_found, "p6_splits": p6_splits, "p6_shares": p6_shares}
