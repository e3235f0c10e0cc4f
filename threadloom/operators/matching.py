"""Similarity of vectors, global thresholds and the choice of a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def similarities(items: DataFrame, rules: DataFrame, group: str, item: str, rule: str, vector: str = "vector") -> DataFrame:
    """(group, item, rule, sim) for every item with every rule of its own group."""
    left = items.select(group, item, F.col(vector).alias("__a"))
    right = rules.select(group, rule, F.col(vector).alias("__b"))
    return left.join(right, group).select(group, item, rule, dot(F.col("__a"), F.col("__b")).alias("sim"))


def pooled_thresholds(sims: DataFrame, gold: float = 0.992, ambiguous: float = 0.98, *, exact: bool = True) -> DataFrame:
    """One row (gold, ambiguous): percentiles of all similarities of all groups together; not exact ones come from a sketch."""
    of = F.percentile if exact else F.percentile_approx
    return sims.agg(of("sim", F.array(F.lit(gold), F.lit(ambiguous))).alias("p")).select(F.col("p")[0].alias("gold"), F.col("p")[1].alias("ambiguous"))


def match(sims: DataFrame, thresholds: DataFrame, group: str, item: str, rule: str) -> DataFrame:
    """(group, item, status, rule, sim): ambiguous where two rules lie above the ambiguous threshold, else matched to the best
    rule (the smallest among equals) where that reaches gold, else unmatched. thresholds has one row."""
    both = sims.crossJoin(F.broadcast(thresholds))
    best = both.groupBy(group, item).agg(F.count_if(F.col("sim") > F.col("ambiguous")).alias("__n"), F.max_by(F.struct(rule, "sim"), F.struct("sim", -F.col(rule))).alias("__b"), F.first("gold").alias("__g"))
    status = F.when(F.col("__n") > 1, "ambiguous").when(F.col("__b.sim") >= F.col("__g"), "matched").otherwise("unmatched")
    return best.select(group, item, status.alias("status"), F.when(status == "matched", F.col(f"__b.{rule}")).alias(rule), F.when(status == "matched", F.col("__b.sim")).alias("sim"))
