"""Readers: parquet tables, compressed JSON lines, whole JSON documents, TSV with quoted line breaks, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, keep_bad: bool = False) -> DataFrame:
    """One row per line of (compressed) JSON-lines files; blank lines are skipped, bad ones dropped unless keep_bad.

    Every line counts, also a last one without line break. With keep_bad, bad lines have null fields and `bad` true.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = lines.withColumn("row", F.from_json("value", schema)).withColumn("bad", F.expr("try_parse_json(value) is null"))
    rows = rows if keep_bad else rows.where(~F.col("bad"))
    return rows.select("row.*", *(["bad"] if keep_bad else []))


def json_lines_zstd(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As json_lines for zstd frames with a window beyond what the text reader decodes: one task a file, streamed."""

    def lines(batches):
        import io

        import pandas as pd
        import zstandard

        for batch in batches:
            for content in batch["content"]:
                stream = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(io.BytesIO(content), read_across_frames=True)
                out = []
                for line in io.TextIOWrapper(stream, "utf-8", errors="replace"):
                    if line.strip():
                        out.append(line.strip())
                    if len(out) == 20_000:
                        yield pd.DataFrame({"value": out})
                        out = []
                if out:
                    yield pd.DataFrame({"value": out})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
    return raw.where(F.expr("try_parse_json(value) is not null")).select(F.from_json("value", schema).alias("row")).select("row.*")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def tsv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated metadata; cells may hold quoted line breaks. Missing required columns are an error."""
    head = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if missing := [c for c in required if c not in head.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    fields = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return head.select(*[F.col(c).cast(fields[c]) if c in fields else F.col(c) for c in head.columns])


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated vector a line as array<double>."""
    return spark.read.text(path).select(F.split("value", "\t").cast("array<double>").alias("vector"))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length of each file below path, largest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy(F.desc("length"), "path")
