"""Connected components of undirected links."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TASK_ROWS, cut, gather, parallelism


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find of one block: each node and the smallest node it is linked with."""
    names, at = np.unique(np.concatenate([a, b]).astype(object), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        small = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], small)
        np.minimum.at(new, low[y], small)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            return names, names[low]
        low = new


def components(links: DataFrame, a: str = "a", b: str = "b", *, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, component): every linked node with the smallest node it reaches. Rows with a null end are left out.

    Blocks of links shrink to stars first. What is left goes to one task if it has at most task_rows links, else rounds of
    large-star and small-star joins run until nothing changes.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))

    def contract(batches):
        for pdf in batches:
            if len(pdf):
                names, low = _stars(pdf["a"].to_numpy(object), pdf["b"].to_numpy(object))
                yield pd.DataFrame({"a": names, "b": low})

    def whole(batches):
        pdf = gather(batches)
        if pdf is not None:
            names, low = _stars(pdf["a"].to_numpy(object), pdf["b"].to_numpy(object))
            yield pd.DataFrame({"node": names, "component": low})

    links = cut(links.mapInPandas(contract, "a string, b string").distinct())
    rows = links.count()
    if rows <= task_rows:
        return links.coalesce(1).mapInPandas(whole, "node string, component string")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = links.where("a != b")
    before = None
    for _ in range(4 * math.ceil(math.log2(rows + 1))):
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a != b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct().repartition(parallelism(links.sparkSession)))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
