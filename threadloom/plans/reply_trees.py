"""Problem 4: reply trees of comments, their broken and circular links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_id
from ..operators import hierarchy as H
from ..session import TASK_ROWS
from ..sources.tables import table

#: Stands for the parent of a comment that names none; no id looks like this.
NOWHERE = "?"


def comment_links(comments: DataFrame) -> DataFrame:
    """Comments as (id, parent, link); parent is null under a submission and NOWHERE where parent_id is missing."""
    parent, link = bare_id("parent_id"), bare_id("link_id")
    under = F.trim("parent_id").startswith("t3_") | (parent == link)
    return comments.select(bare_id("id").alias("id"), F.when(F.coalesce(under, F.lit(False)), F.lit(None)).otherwise(F.coalesce(parent, F.lit(NOWHERE))).alias("parent"), link.alias("link"))


def _whole(comments: DataFrame) -> DataFrame:
    # a comment delivered once without parent_id keeps the parent of its other rows
    known = F.max(F.when(F.col("parent") != NOWHERE, F.col("parent")))
    under = F.max(F.col("parent").isNull())
    return comment_links(comments).where(F.col("id").isNotNull()).groupBy("id").agg(F.when(under, F.lit(None)).otherwise(F.coalesce(known, F.lit(NOWHERE))).alias("parent"), F.max("link").alias("link"))


def reply_trees(comments: DataFrame, *, paths: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """hierarchy() of the distinct comments with their link; dangling holds comments whose parents lead nowhere."""
    return H.hierarchy(_whole(comments), extra=("link",), paths=paths, task_rows=task_rows)


def defects(comments: DataFrame, *, task_rows: int = TASK_ROWS) -> DataFrame:
    """(comment_id, defect): in_cycle, below_cycle, no_parent, cross_link."""
    tree = reply_trees(comments, task_rows=task_rows)
    name = F.when(F.col("state") == H.DANGLING, "no_parent").otherwise(F.col("state"))
    broken = tree.where(F.col("state") != H.TREE).select(F.col("id").alias("comment_id"), name.alias("defect"))
    above = tree.select(F.col("id").alias("parent"), F.col("link").alias("parent_link"))
    crossed = tree.where("parent is not null and parent != '?' and link is not null").join(above, "parent").where(F.col("link") != F.col("parent_link"))
    return broken.unionByName(crossed.select(F.col("id").alias("comment_id"), F.lit("cross_link").alias("defect")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "comments"))


def p4_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = reply_trees(table(spark, folder, "comments"), paths=True)
    return tree.select(F.col("id").alias("comment_id"), F.col("root").alias("root_id"), "depth", "state", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return H.descendants(reply_trees(table(spark, folder, "comments"), paths=True))


_LINKS = """
raw AS (SELECT nullif(regexp_replace(trim(id), '^t[0-9]_', ''), '') AS id, nullif(regexp_replace(trim(parent_id), '^t[0-9]_', ''), '') AS p,
  nullif(regexp_replace(trim(link_id), '^t[0-9]_', ''), '') AS link, coalesce(trim(parent_id) LIKE 't3\\_%' ESCAPE '\\', false) AS sub FROM comments),
node AS (SELECT id, CASE WHEN bool_or(sub OR coalesce(p = link, false)) THEN NULL ELSE coalesce(max(p), '?') END AS parent, max(link) AS link FROM raw WHERE id IS NOT NULL GROUP BY id),
walk AS (SELECT n.id, n.id AS root, n.parent AS top, 0 AS depth, n.id AS path, p.id IS NULL AND n.parent IS NOT NULL AS lost FROM node n LEFT JOIN node p ON n.parent = p.id WHERE p.id IS NULL
  UNION ALL SELECT n.id, w.root, w.top, w.depth + 1, w.path || '/' || n.id, w.lost FROM walk w JOIN node n ON n.parent = w.id),
stuck AS (SELECT id, parent FROM node WHERE id NOT IN (SELECT id FROM walk)),
tour AS (SELECT id AS start, parent AS spot, 1 AS step FROM stuck UNION ALL SELECT t.start, s.parent, t.step + 1 FROM tour t JOIN stuck s ON s.id = t.spot WHERE t.spot <> t.start AND t.step < 2000),
state AS (SELECT id, CASE WHEN lost THEN 'dangling' ELSE 'tree' END AS state FROM walk UNION ALL
  SELECT id, CASE WHEN id IN (SELECT start FROM tour WHERE start = spot) THEN 'in_cycle' ELSE 'below_cycle' END FROM stuck)"""

ORACLE = {
    "p4_found": f"""WITH RECURSIVE {_LINKS}
SELECT id AS comment_id, replace(state, 'dangling', 'no_parent') AS defect FROM state WHERE state <> 'tree'
UNION ALL SELECT n.id, 'cross_link' FROM node n JOIN node p ON n.parent = p.id WHERE n.link <> p.link""",
    "p4_tree": f"""WITH RECURSIVE {_LINKS}
SELECT s.id AS comment_id, w.root AS root_id, w.depth::BIGINT AS depth, s.state, w.path FROM state s LEFT JOIN walk w USING (id)""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT a AS ancestor, id AS descendant, (depth - pos + 1)::BIGINT AS distance FROM (SELECT id, depth, unnest(string_split(path, '/')) AS a, generate_subscripts(string_split(path, '/'), 1) AS pos FROM walk) WHERE a <> id""",
}
QUERIES = {"p4_found": p4_found, "p4_tree": p4_tree, "p4_descendants": p4_descendants}
