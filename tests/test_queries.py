"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from compare import rows_of, sql_rows

from marlstone import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, rows = rows_of(QUERIES[name](spark, SF))
    if name in SQL:
        assert (names, rows) == sql_rows(SF, SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "doc_id", "score", "rank"]
    assert df.count() > 0


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["a5_filtered_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "embedding:array" not in plan
