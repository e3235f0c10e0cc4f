"""Problem 9: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .tokens import FOLDER, VOCABULARY, with_tokens

#: Tokens of a block; a slot of the schedule holds one block.
BLOCK_TOKENS = 1024
#: Rows numbered by one window partition.
RUN = 50_000
GOLDEN = 0.6180339887498949


def source_key(c: Column | str) -> Column:
    """Source name in lower case with _ between words; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_"), F.lit(""))


def running_total(df: DataFrame, group: str, order: list[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Sum of value over the rows before each row of its group, in the order of (bucket, order).

    Buckets must rise with the order. Their totals, one row a group and bucket, are summed first; then each bucket by
    itself, so no task holds a whole group.
    """
    df = df.withColumn("__b", bucket)
    totals = df.groupBy(group, "__b").agg(F.sum(value).alias("__t"))
    before = totals.withColumn("__o", F.coalesce(F.sum("__t").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [group, "__b"]).withColumn(out, F.col("__i") + F.col("__o")).drop("__i", "__o", "__b")


def mix(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, seed: str = "mix-1") -> DataFrame:
    """(slot, source, doc_id, pass_no, n_tokens): the documents in mixed order, as large as shares and repeats allow.

    documents: doc_id, source (normalised), n_tokens; targets: source, target_share, max_repeats. The total is the most at
    which no source needs more than max_repeats times its tokens. Each source's documents are shuffled anew for each pass by
    a hash, and laid end to end; block k holds those that begin in its block_tokens tokens,
    whole; one that reaches into later blocks keeps their slots too, in which then nothing, or little, begins. Slot i goes to the source in
    whose part of the cumulative weights the i-th golden-ratio point falls, and takes that source's next block. Documents
    without source, target or tokens are left out; shares are taken relative to their sum; rows of targets with a null or
    no positive share or repeats are ignored, and a source without documents has its share left to the others. Equal hashes
    are ordered by doc_id. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id"), F.col("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("source is not null and n_tokens > 0")
    goal = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    # one row a source of the target table: as many as that table has, however large the corpus
    have = goal.join(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "source").orderBy("source").collect()
    schema = f"slot bigint, source string, doc_id {dict(docs.dtypes)['doc_id']}, pass_no int, n_tokens bigint"
    if not have:
        return spark.createDataFrame([], schema)
    whole = sum(r.share for r in have)
    total = min(r.tokens * r.repeats / (r.share / whole) for r in have)
    slots = max(1, math.floor(total / block_tokens))
    edges, low = [], 0.0
    for r in have:
        edges.append((r.source, low, low := low + r.share / whole))
    spot = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))
    source = F.lit(edges[-1][0])
    for name, _, high in reversed(edges[:-1]):
        source = F.when(spot < high, F.lit(name)).otherwise(source)
    plan = spark.range(slots).select(F.col("id").alias("slot")).withColumn("source", source).withColumn("one", F.lit(1))
    plan = running_total(plan, "source", ["slot"], "one", F.floor(F.col("slot") / RUN), "block").select("slot", "source", "block")
    passes = F.coalesce(*[F.when(F.col("source") == r.source, F.lit(min(r.repeats, math.ceil((total * r.share / whole + block_tokens) / r.tokens)))) for r in have])
    parts = F.coalesce(*[F.when(F.col("source") == r.source, F.lit(max(1, math.ceil(r.docs / RUN)))) for r in have])
    laid = docs.join(F.broadcast(spark.createDataFrame([(r.source,) for r in have], "source string")), "source", "left_semi")
    laid = laid.withColumn("pass_no", F.explode(F.sequence(F.lit(1), passes))).withColumn("h", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "pass_no", "doc_id"), 256), 1, 8), 16, 10).cast("bigint"))
    laid = running_total(laid, "source", ["h", "doc_id"], "n_tokens", F.col("pass_no") * F.lit(2**32) + F.floor(F.col("h") * parts / F.lit(2**32)), "start")
    laid = laid.withColumn("block", F.floor(F.col("start") / block_tokens))
    return laid.join(plan, ["source", "block"]).select("slot", "source", "doc_id", F.col("pass_no").cast("int").alias("pass_no"), "n_tokens")


def _documents_and_mix(spark: SparkSession, folder: str, *, tokenizers: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(table(spark, folder, "documents").withColumn("source", source_key("source")), ["doc_id", "source"], folder=tokenizers, vocabulary=vocabulary)
    targets = table(spark, folder, "mix_targets").withColumn("source", source_key("source"))
    docs = cut(docs)
    return docs, mix(docs, targets)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _documents_and_mix(spark, folder)[1]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: target and actual share of all tokens, tokens, distinct documents, the most often one was used, and how many
    documents and tokens the source has that no pass reached."""
    docs, mixed = _documents_and_mix(spark, folder)
    have = docs.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    per = uses.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum(F.col("n") / F.col("uses")).cast("bigint").alias("once"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    whole = per.agg(F.sum("tokens").alias("all"))
    targets = table(spark, folder, "mix_targets").withColumn("source", source_key("source"))
    return per.crossJoin(F.broadcast(whole)).join(F.broadcast(targets), "source").join(F.broadcast(have), "source").select("source", F.round("target_share", 4).alias("target_share"), F.round(F.col("tokens") / F.col("all"), 4).alias("actual_share"), "tokens", "documents", "most_uses", (F.col("all_docs") - F.col("documents")).alias("documents_left"), (F.col("all_tokens") - F.col("once")).alias("tokens_left"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
