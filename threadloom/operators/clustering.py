"""A grid of clusterings behind one output contract, and the choice of the best."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = {"kmeans": KMeans, "bisecting": BisectingKMeans}


def grid(df: DataFrame, key: str, vector: str, settings: list[tuple[str, int]], seed: int = 1) -> DataFrame:
    """(method, k, clusters, smallest, largest, score) for each setting; score is the silhouette."""
    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).cache()
    out = []
    for method, k in settings:
        found = METHODS[method](k=k, seed=seed).fit(rows).transform(rows)
        sizes = found.groupBy("prediction").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
        out.append((method, k, *sizes, float(ClusteringEvaluator().evaluate(found))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "method string, k int, clusters long, smallest long, largest long, score double")


def best(results: DataFrame, least: int = 5, most: int = 30) -> DataFrame:
    """The setting with the best score among those with a sound number of clusters; the smaller k among equals."""
    return results.where(F.col("clusters").between(least, most) & F.col("score").isNotNull()).orderBy(F.desc("score"), "k", "method").limit(1)
