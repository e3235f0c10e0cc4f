"""Streaming forms: the same filters and preference rules over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bare_id, has_text


def moderator_replies(comments: DataFrame) -> DataFrame:
    """Stateless; the same on a batch and on a stream."""
    return comments.where(F.col("distinguished").eqNullSafe("moderator") & F.trim("parent_id").startswith("t1_"))


def first_delivery(comments: DataFrame, late: str = "7 days") -> DataFrame:
    """One row an id within the watermark, for streams; a removed copy never stands in for a text, as it is dropped."""
    rows = comments.where(has_text("body_clean")).withColumn("key", bare_id("id"))
    return rows.withWatermark("retrieved_at", late).dropDuplicatesWithinWatermark(["key"])


def status_counts(rows: DataFrame, status: str, time: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, window), status).agg(F.count("*").alias("n"))
