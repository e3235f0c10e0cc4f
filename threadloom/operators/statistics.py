"""Counts, divergence, percentiles, votes, ranks and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def divergence_from_uniform(df: DataFrame, group: str, count: str) -> DataFrame:
    """(group, divergence): squared Jensen-Shannon distance, in nats, of a group's counts from equal ones; 1 where they sum to 0."""
    w = Window.partitionBy(group)
    total, u = F.sum(count).over(w), 1.0 / F.count(F.lit(1)).over(w)
    rows = df.select(group, F.try_divide(F.col(count), total).alias("p"), u.alias("u"))
    p, u = F.col("p"), F.col("u")
    term = 0.5 * F.when(p > 0, p * F.ln(p / ((p + u) / 2))).otherwise(0.0) + 0.5 * u * F.ln(u / ((p + u) / 2))
    return rows.groupBy(group).agg(F.coalesce(F.sum(term), F.lit(1.0)).alias("divergence"))


def floor_percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at index floor(n * share) of the sorted ones; exact, by rank over counts of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).crossJoin(counts.agg(F.sum("n").alias("all")))
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * s), F.col("v"))).alias(k) for k, s in shares.items()])


def majority(df: DataFrame, group: str, vote: str, order: str) -> DataFrame:
    """(group, vote, votes): the most frequent vote; among equals the one seen first."""
    n = df.groupBy(group, vote).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return n.groupBy(group).agg(F.max_by(F.struct(vote, "votes"), F.struct("votes", -F.col("first"))).alias("m")).select(group, f"m.{vote}", "m.votes")


def filtered_rank(df: DataFrame, passes: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows that pass ranked 1..n in order, others 999999.

    The rank is global: rows are sorted into ranges, numbered within each, and the sizes of the ranges before are added, so
    that no task holds the table.
    """
    # written, as a second sort might cut its ranges elsewhere
    good = cut(df.where(passes).orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = good.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__low"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = good.join(F.broadcast(before.select("__p", "__low", "__before")), "__p").withColumn(name, (F.col("__i") - F.col("__low") + F.col("__before") + 1).cast("bigint")).drop("__p", "__i", "__low", "__before")
    return ranked.unionByName(df.where(~F.coalesce(passes, F.lit(False))).withColumn(name, F.lit(999999).cast("bigint")))


def accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of both sides and overall, in all and per value of each key, by grouping sets: kind, label, violating, compliant, overall, pairs."""
    sets = ", ".join(["()", *[f"(`{k}`)" for k in keys]])
    results.createOrReplaceTempView("threadloom_results")
    kind = "CASE " + " ".join(f"WHEN grouping(`{k}`) = 0 THEN '{k}'" for k in keys) + " ELSE 'overall' END"
    label = "coalesce(" + ", ".join(f"CAST(CASE WHEN grouping(`{k}`) = 0 THEN coalesce(`{k}`, 'none') END AS STRING)" for k in keys) + ", 'all')"
    return results.sparkSession.sql(f"""SELECT {kind} AS kind, {label} AS label, round(avg(violating), 6) AS violating, round(avg(compliant), 6) AS compliant,
      round((avg(violating) + avg(compliant)) / 2, 6) AS overall, count(*) AS pairs FROM threadloom_results WHERE violating IS NOT NULL AND compliant IS NOT NULL GROUP BY GROUPING SETS ({sets})""")


def bootstrap_interval(df: DataFrame, group: str, value: str, *, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(group, n, mean, low, high): percentile interval of the mean under resampling.

    Resampling n rows gives each a count; Poisson(1) counts drawn per row and replicate are that in the limit and need
    neither order nor a second pass: each partition sums its rows' contributions to every replicate, and partial sums add up.
    The numbers come from a generator keyed by seed and the row, so the layout of the data changes nothing.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for g, v, h in zip(pdf["g"], pdf["v"], pdf["h"]):
                n = np.random.Generator(np.random.Philox(key=[seed, int(h) & (2**63 - 1)])).poisson(1.0, replicates)
                s = sums.setdefault(g, np.zeros((2, replicates)))
                s[0] += n
                s[1] += n * v
        for g, s in sums.items():
            yield pd.DataFrame({"g": [g] * replicates, "r": np.arange(replicates), "n": s[0], "s": s[1]})

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))
    each = rows.mapInPandas(partial, "g string, r int, n double, s double").groupBy("g", "r").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    a = (1 - level) / 2
    found = each.groupBy("g").agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(a), F.lit(1 - a))).alias("p"))
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(found, "g").select(F.col("g").alias(group), "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def bootstrap_sides(df: DataFrame, group: str, sides: tuple[str, str], *, replicates: int = 100_000, seed: int = 42, level: float = 0.95, block: int = 2_000) -> DataFrame:
    """(kind, group, side, n, mean, low, high): percentile intervals of the mean of each side and of the two sides' mean, overall and per group.

    Resampling n rows gives each combination of group and values a multinomial count, so rows are counted first and each block
    of replicates draws the counts of all combinations at once. A replicate without a value of a group is skipped there.
    """
    cells = df.select(F.col(group).cast("string"), *[F.col(s).cast("double") for s in sides]).groupBy(group, *sides).agg(F.count("*").alias("n"))
    rows = sorted(cells.collect(), key=repr)
    spark, a = df.sparkSession, (1 - level) / 2
    total = sum(r.n for r in rows)
    sets = [("overall", "all", list(range(len(rows))))] + [("label", g, [i for i, r in enumerate(rows) if r[0] == g]) for g in sorted({r[0] for r in rows if r[0] is not None})]
    counts = np.array([r.n for r in rows], float)
    values = np.array([[np.nan if x is None else x for x in r[1:3]] for r in rows], float).reshape(-1, 2)

    def means(n: np.ndarray, at: list[int]) -> np.ndarray:
        """Means of both sides, and of the two, for rows of counts."""
        known, v = ~np.isnan(values[at]), np.nan_to_num(values[at])
        with np.errstate(invalid="ignore", divide="ignore"):
            m = (n[:, at] @ v) / (n[:, at] @ known)
        return np.column_stack([m, m.mean(axis=1)])

    def draw(batches):
        for pdf in batches:
            for b in pdf["id"]:
                n = np.random.default_rng([seed, int(b)]).multinomial(total, counts / total, size=min(block, replicates - int(b) * block)).astype(float)
                for k, (_, _, at) in enumerate(sets):
                    m = means(n, at)
                    for j in range(3):
                        yield pd.DataFrame({"k": k, "j": j, "m": m[:, j]})

    names = [*sides, "overall"]
    out = []
    for k, (kind, g, at) in enumerate(sets if total else []):
        m = means(counts[None, :], at)[0]
        known = ~np.isnan(values[at])
        size = [*(counts[at] @ known), counts[at] @ known.all(axis=1)]
        out += [(k, j, kind, g, names[j], int(size[j]), float(m[j])) for j in range(3) if not np.isnan(m[j])]
    whole = spark.createDataFrame(out, f"k int, j int, kind string, `{group}` string, side string, n long, mean double")
    drawn = spark.range(0, -(-replicates // block) if total else 0).mapInPandas(draw, "k int, j int, m double").where(~F.isnan("m"))
    found = drawn.groupBy("k", "j").agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("p"))
    return whole.join(found, ["k", "j"]).select("kind", group, "side", "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
