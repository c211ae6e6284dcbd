import importlib

import pytest
from tests.twins import assert_twin, connect

MODULES = ["tallyforge.plans.record_queries", "tallyforge.plans.takeoff_queries", "tallyforge.plans.parse_queries", "tallyforge.plans.table_queries", "tallyforge.plans.model_queries", "tallyforge.plans.page_queries"]
CASES = [(m, n) for m in MODULES for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query(spark, con, module, name):
    m = importlib.import_module(module)
    if name in m.SQL:
        assert_twin(spark, con, m.QUERIES[name], m.SQL[name])
    else:
        assert m.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
