"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task may hold in Python at once; larger inputs are split or solved by joins.
TASK_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []
#: Folders made for local sessions without the setting, by application; the setting itself can't be changed in a running session.
_own: dict[str, str] = {}


def session(app: str = "threadloom", cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.cteRecursionLevelLimit", "100000")
        .config("spark.sql.cteRecursionRowLimit", "100000000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    A folder of this machine is made only where the setting is missing and the session runs on this machine alone.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return _own[app]


def cut(df: DataFrame, *cluster: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which ends its lineage there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{uuid.uuid4().hex}"
    if cluster:
        df = df.repartition(*cluster)
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


@atexit.register
def _drop() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            pass
    _made.clear()


def gather(batches):
    """All rows of one task as one frame; None where there are none."""
    import pandas as pd

    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None
