import pytest
from edges import make

from threadloom.plans import catalog


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    return make(tmp_path_factory.mktemp("edge") / request.param, request.param)


def test_all_core_queries_run(spark, folder):
    for name, query in catalog.QUERIES.items():
        if name != "ext10_cluster_grid":
            try:
                query(spark, folder).collect()
            except Exception as e:
                raise AssertionError(f"{name}: {str(e)[:400]}") from e
