"""Thread pairs and the comments they name, in normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import author_key, bare_id, community_key, has_text


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row a mod_comment_id: pair, community, submission, split, label, violating, compliant.

    Of values that differ between deliveries the greatest is kept; nulls never win. Rows without mod_comment_id are left out.
    """
    label = F.nullif(F.lower(F.trim("rule_cluster_label")), F.lit(""))
    cols = {"community": community_key("subreddit"), "submission": bare_id("submission_id"), "split": F.nullif(F.lower(F.trim("split")), F.lit("")), "label": label, "violating": bare_id("violating_comment_id"), "compliant": bare_id("compliant_comment_id")}
    rows = pairs.select(bare_id("mod_comment_id").alias("pair"), *[c.alias(k) for k, c in cols.items()])
    return rows.where("pair is not null").groupBy("pair").agg(*[F.max(k).alias(k) for k in cols])


def sides(pairs: DataFrame) -> DataFrame:
    """(pair, side, comment) of distinct_pairs, two rows a pair; null comments are left out."""
    return pairs.select("pair", F.explode(F.array(F.struct(F.lit("violating").alias("side"), F.col("violating").alias("comment")), F.struct(F.lit("compliant").alias("side"), F.col("compliant").alias("comment")))).alias("s")).select("pair", "s.side", "s.comment").where("comment is not null")


def needed_texts(comments: DataFrame, wanted: DataFrame, *, few: bool = False) -> DataFrame:
    """(comment, text) for the ids in wanted.comment that have a text that wasn't removed.

    few: the ids are a sample of bounded size, and go to the comments instead of the comments to them.
    """
    ids = wanted.select("comment").distinct()
    ids = F.broadcast(ids) if few else ids
    rows = comments.where(has_text("body_clean")).select(bare_id("id").alias("comment"), F.col("body_clean").alias("text"))
    return rows.join(ids, "comment", "left_semi").groupBy("comment").agg(F.max("text").alias("text"))


def needed_authors(comments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(comment, author), distinct, for the ids in wanted.comment; removed and null authors are left out."""
    ids = wanted.select("comment").distinct()
    rows = comments.select(bare_id("id").alias("comment"), author_key("author").alias("author")).where("author is not null")
    return rows.join(ids, "comment", "left_semi").distinct()
