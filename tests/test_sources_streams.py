import json

import zstandard

from threadloom.sources import sinks, tables
from threadloom.streaming import dedup


def test_json_lines(spark, tmp_path):
    lines = ['{"id":"a","n":1}', "", "not json", '{"id":"b","n":2}']
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))
    for read in (tables.json_lines, tables.json_lines_zstd):
        assert {(r.id, r.n) for r in read(spark, str(tmp_path / "x.jsonl.zst"), "id string, n int").collect()} == {("a", 1), ("b", 2)}
    assert tables.json_lines(spark, str(tmp_path / "x.jsonl.zst"), "id string, n int", keep_bad=True).where("bad").count() == 1
    assert [r["name"] for r in tables.files(spark, str(tmp_path)).collect()] == ["x.jsonl.zst"]


def test_tsv_and_vectors(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('name\tn\n"two\nlines"\t3\n')
    assert [(r.name, r.n) for r in tables.tsv(spark, str(tmp_path / "m.tsv"), "name string, n int", ("name",)).collect()] == [("two\nlines", 3)]
    (tmp_path / "v.tsv").write_text("1.0\t2.5\n")
    assert tables.vectors(spark, str(tmp_path / "v.tsv")).first().vector == [1.0, 2.5]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.routed(df, str(tmp_path / "out"), "k")
    assert sorted(p.name for p in (tmp_path / "out").glob("k=*")) == ["k=a", "k=b"]
    from pyspark.sql import functions as F

    doc = json.loads(sinks.document(df, {"rows": F.count("*")}, "items", ["k", "n"]).first().document)
    assert doc == {"metadata": {"rows": 2}, "items": [{"k": "a", "n": 1}, {"k": "b", "n": 2}]}


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, parent_id string, distinguished string, body_clean string, retrieved_at timestamp"
    rows = [("t1_a", "t1_x", "moderator", "hi", "2024-01-01 00:00:00"), ("a", "t1_x", "moderator", "hi", "2024-01-01 01:00:00"), ("b", "t3_x", "moderator", "ho", "2024-01-01 00:00:00"), ("c", "t1_x", None, "[removed]", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("id", "parent_id", "distinguished", "body_clean", "cast(retrieved_at as timestamp) retrieved_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("s_mod", dedup.moderator_replies(stream), 2), ("s_first", dedup.first_delivery(stream), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
