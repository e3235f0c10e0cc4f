"""Fitted models, stored once in the shared folder and read again by every query that needs them."""

from __future__ import annotations

import hashlib
import inspect
import pickle
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def fingerprint(spark: SparkSession, tables: list[DataFrame]) -> list[str]:
    """Path, length and time of change of every file the tables are read from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in sorted(p for t in tables for p in t.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append(f"{path}|{status.getLen()}|{status.getModificationTime()}")
    return out


def fitted(spark: SparkSession, name: str, tables: list[DataFrame], make: Callable[[], Any], parameters: tuple = ()) -> Any:
    """make(), or what it gave before for the same files of the same tables, the same parameters and the same code of its module.

    The key is a hash of these; the model lies as one row of a parquet table under models/ in the shared folder. Tables without
    files (made in memory) have no key that would outlive them: their model is made each time.
    """
    files = fingerprint(spark, tables)
    if not files:
        return make()
    code = inspect.getsource(inspect.getmodule(make))
    key = hashlib.sha256("\n".join([name, repr(parameters), code, *files]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/models/{name}-{key}"
    try:
        return pickle.loads(spark.read.parquet(path).head().model)
    except Exception:  # not there, or half written by a session that died
        model = make()
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model
