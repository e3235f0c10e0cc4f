import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from edges import make  # noqa: E402

from threadloom.llm import catalog  # noqa: E402


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    return make(tmp_path_factory.mktemp("edge") / request.param, request.param)


def test_all_llm_queries_run(spark, folder):
    for name, query in catalog.QUERIES.items():
        try:
            query(spark, folder).collect()
        except Exception as e:
            raise AssertionError(f"{name}: {str(e)[:1500]}") from e
