import duckdb
import pytest

import __spark_entry__ as entry
from crosscheck import canonical
from threadloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_core_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("comments", "submissions", "subreddits", "thread_pairs", "thread_members", "documents", "subject_labels", "pack_sizes", "embeddings", "events", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    mine, other = catalog.QUERIES[name](spark, FOLDER).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(other.columns) and canonical(mine) == canonical(other)
