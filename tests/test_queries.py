"""Every registered query against its SQL, over whole tables."""

import compare
import pytest

from inkwell.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    compare.same(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"r6_search", "r4_look_up_index", "r4_turned_look_up", "r6_turned_search", "l1_page_search_stream", "r2_stored_matches"}))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, str(compare.DATA)).collect()
    assert rows


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
