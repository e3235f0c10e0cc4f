"""Documents with bodies, their id-only form, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[NEEDS_HYDRATION]"


def thread_arrays(members: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys and thread, the array of (level, id, body, found) in order of level; comments without body are marked missing."""
    rows = members.join(bodies.select(F.col("id").alias("comment_id"), "body"), "comment_id", "left")
    item = F.struct("level", F.col("comment_id").alias("id"), "body", F.col("body").isNotNull().alias("found"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("thread"))


def dehydrate(threads: DataFrame) -> DataFrame:
    """Bodies replaced by a placeholder; length and ids stay."""
    return threads.withColumn("thread", F.transform("thread", lambda c: F.struct(c["level"].alias("level"), c["id"].alias("id"), F.lit(PLACEHOLDER).alias("body"))))


def hydrate(threads: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of dehydrate against a table of bodies (id, body)."""
    members = threads.select(*keys, F.explode("thread").alias("c")).select(*keys, F.col("c.level").alias("level"), F.col("c.id").alias("comment_id"))
    return thread_arrays(members, bodies, keys)
