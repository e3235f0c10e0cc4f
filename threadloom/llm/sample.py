"""Problem 2: a sample that is the same on every run and keeps its members as data arrives.

A ledger holds each record's first-seen epoch and the rate that was frozen for that epoch. A record is in the sample where
a counter-based generator, keyed by its identifier, draws a number below that rate: neither order, layout, later
deliveries nor later rates change a draw or a rate once written.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_id
from ..session import cut, shared_dir
from ..sources.tables import table
from .models import fingerprint

SEED = "threadloom-1"
#: The rate frozen for each delivery; later epochs take the last one.
RATES = {1: 0.30, 2: 0.30, 3: 0.20, 4: 0.20, 5: 0.10}


def draw(key: Column, seed: str = SEED, counter: int = 0) -> Column:
    """The counter-th number in [0, 1) of the generator keyed by key: 52 bits of SHA-256 over seed, key and counter."""
    block = F.sha2(F.concat(F.lit(f"{seed}|"), key, F.lit(f"|{counter}")), 256)
    return F.conv(F.substring(block, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def frozen_rate(epoch: Column, rates: dict[int, float]) -> Column:
    if not rates:
        raise ValueError("no rates")
    first, last = min(rates), max(rates)
    known = reduce(lambda w, e: w.when(epoch == e, F.lit(float(rates[e]))), rates, F.when(epoch < first, F.lit(float(rates[first]))))
    return known.otherwise(F.lit(float(rates[last])))


def ledger(records: DataFrame, key: Column, epoch: Column, rates: dict[int, float], before: DataFrame | None = None) -> DataFrame:
    """(record, epoch, rate) with one row a record: the row of `before` where there is one, else its first epoch here.

    Repeated deliveries and spellings fall together under the normalised key. Null keys name no record and are left out; a
    record whose epochs are all null counts as seen in the first epoch of the rates. An empty table adds nothing.
    """
    new = records.select(key.alias("record"), F.coalesce(epoch.cast("bigint"), F.lit(None)).alias("epoch")).where("record is not null")
    new = new.groupBy("record").agg(F.coalesce(F.min("epoch"), F.lit(min(rates))).alias("epoch")).withColumn("rate", frozen_rate(F.col("epoch"), rates))
    if before is None:
        return new
    return before.select("record", "epoch", "rate").unionByName(new.join(before.select("record"), "record", "left_anti"))


def selected(book: DataFrame, seed: str = SEED) -> DataFrame:
    """The ledger's rows that are in the sample."""
    return book.where(draw(F.col("record"), seed) < F.col("rate"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path; null where none was begun."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema("record string, rate double, epoch bigint").parquet(path) if there else None


def append(records: DataFrame, key: Column, epoch: Column, rates: dict[int, float], path: str) -> DataFrame:
    """The ledger at path after the records that aren't in it have been added, each with its first epoch and that epoch's rate.

    Rows that are there are neither changed nor written again: new ones are appended by one committed write, so a run that dies
    before it adds nothing and is repeated. Later rates and late deliveries of early epochs therefore
    leave every earlier record as it is.
    """
    spark = records.sparkSession
    before = stored(spark, path)
    now = ledger(records, key, epoch, rates, before)
    new = now if before is None else now.join(before.select("record"), "record", "left_anti")
    new = cut(new)
    if new.head() is not None:
        new.select("record", "rate", "epoch").write.mode("append").partitionBy("epoch").parquet(path)
    book = stored(spark, path)
    return new.limit(0) if book is None else book.select("record", "epoch", "rate")


def _book(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of the table's files, written when it is first asked for.

    It lies in the shared folder under a key of these files, so a run over the same files finds it and adds nothing; a table that
    grows is given a path of its own (append).
    """
    pairs = table(spark, folder, "thread_pairs")
    key = hashlib.sha256("\n".join([SEED, repr(RATES), *fingerprint(spark, [pairs])]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/ledgers/{key}"
    if stored(spark, path + "/done") is None:
        append(pairs, bare_id("mod_comment_id"), F.col("batch_no"), RATES, path + "/book")
        spark.createDataFrame([], "record string, rate double, epoch bigint").write.mode("overwrite").parquet(path + "/done")
    book = stored(spark, path + "/book")
    return ledger(pairs, bare_id("mod_comment_id"), F.col("batch_no"), RATES) if book is None else book.select("record", "epoch", "rate")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selected(_book(spark, folder)).select(F.col("record").alias("mod_comment_id"), "epoch", "rate")


def p2_growth(spark: SparkSession, folder: str) -> DataFrame:
    """Records and members of each first-seen epoch."""
    book = _book(spark, folder)
    return book.groupBy("epoch").agg(F.count("*").alias("records"), F.count_if(draw(F.col("record")) < F.col("rate")).alias("members"))


_BOOK = f"""WITH first AS (SELECT nullif(regexp_replace(trim(mod_comment_id), '^t[0-9]_', ''), '') AS record, coalesce(min(batch_no), 1)::BIGINT AS epoch FROM thread_pairs GROUP BY 1),
book AS (SELECT record, epoch, CASE {' '.join(f'WHEN epoch = {e} THEN {r}' for e, r in RATES.items())} ELSE {RATES[max(RATES)]} END::DOUBLE AS rate,
  ('0x' || substr(sha256('{SEED}|' || record || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM first WHERE record IS NOT NULL)"""
ORACLE = {
    "p2_sample": f"{_BOOK} SELECT record AS mod_comment_id, epoch, rate FROM book WHERE u < rate",
    "p2_growth": f"{_BOOK} SELECT epoch, count(*) AS records, count(*) FILTER (u < rate) AS members FROM book GROUP BY epoch",
}
QUERIES = {"p2_sample": p2_sample, "p2_growth": p2_growth}
