"""Sinks: routed JSON lines, whole documents, TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def routed(df: DataFrame, path: str, by: str, targets: Column | None = None, compression: str = "gzip") -> None:
    """JSON lines in one folder per value of `by`; with targets (an array column) a row goes to each of them."""
    df = df.withColumn(by, F.explode(targets)) if targets is not None else df
    df.write.mode("overwrite").option("compression", compression).partitionBy(by).json(path)


def document(groups: DataFrame, metadata: dict[str, Column], key: str, items: list[str]) -> DataFrame:
    """A one-row table `document`: {metadata, <key>: [...]} with the items in order of their first column."""
    rows = F.sort_array(F.collect_list(F.struct(*items)))
    return groups.agg(F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in metadata.items()]).alias("metadata"), rows.alias(key))).alias("document"))


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
