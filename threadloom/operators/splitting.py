"""Adaptive splits, shuffled answer options, batches and stratified samples, all in hash order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adaptive_split(df: DataFrame, group: str, key: str) -> DataFrame:
    """df with split: a group of one goes to test, of two to test and train, of 3-9 one each to test and val, from ten on a tenth each."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")), 256), F.col(key)))
    test = F.when(n < 10, 1).otherwise(F.greatest(F.lit(1), F.rint(0.1 * n).cast("int")))
    val = F.when(n < 3, 0).when(n < 10, 1).otherwise(F.greatest(F.lit(1), F.rint(0.1 * n).cast("int")))
    return df.withColumn("__n", n).withColumn("__i", place).withColumn("split", F.when(F.col("__i") <= test, "test").when(F.col("__i") <= test + val, "val").otherwise("train")).drop("__n", "__i")


def shuffled_options(options: Column, key: Column, suffix: str) -> Column:
    """Array of (label, option) in an order given by the key."""
    hashed = F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat(key, F.lit(suffix), o), 256).alias("h"), o.alias("o"))))
    return F.transform(hashed, lambda x, i: F.struct(F.concat(F.lit("("), F.char(97 + i), F.lit(")")).alias("label"), x["o"].alias("option")))


def stratified_sample(df: DataFrame, stratum: str, unique: str, key: str, total: int, fill: str = "other") -> DataFrame:
    """`total` rows, equally from each stratum, no value of `unique` twice, gaps filled from the stratum `fill`.

    Rows beyond what could ever be taken are left out first: of each stratum and value of `unique` one row, of each stratum the
    first `total` of these. So the group that chooses in order has at most strata x total rows.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    one = df.select(stratum, unique, key, h.alias("h")).groupBy(stratum, unique).agg(F.min_by(key, "h").alias(key), F.min("h").alias("h"))
    some = one.withColumn("i", F.row_number().over(Window.partitionBy(stratum).orderBy("h"))).where(F.col("i") <= total)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        strata = sorted(pdf[stratum].unique())
        base, rest = divmod(total, len(strata))
        used, out = set(), []

        def take(s, n):
            for r in pdf[pdf[stratum] == s].sort_values("h").itertuples(index=False):
                if n <= 0:
                    break
                u = getattr(r, unique)
                if u not in used:
                    used.add(u)
                    out.append((s, u, getattr(r, key)))
                    n -= 1
            return n

        lack = sum(take(s, base + (k < rest)) for k, s in enumerate(strata))
        if fill in strata:
            take(fill, lack)
        return pd.DataFrame(out, columns=[stratum, unique, key])

    t = dict(some.dtypes)
    return some.groupBy().applyInPandas(choose, f"`{stratum}` {t[stratum]}, `{unique}` {t[unique]}, `{key}` {t[key]}")


def least_loaded(df: DataFrame, key: str, load: str, buckets: int) -> DataFrame:
    """(key, bucket): keys by falling load, each to the bucket with least so far; for as many rows as there are communities."""

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        heap = [(0, b) for b in range(buckets)]
        out = []
        for r in pdf.fillna({load: 0}).sort_values([load, key], ascending=[False, True]).itertuples(index=False):
            n, b = heapq.heappop(heap)
            out.append((getattr(r, key), b))
            heapq.heappush(heap, (n + getattr(r, load), b))
        return pd.DataFrame(out, columns=[key, "bucket"])

    return df.select(key, load).groupBy().applyInPandas(give, f"`{key}` {dict(df.dtypes)[key]}, bucket int")
