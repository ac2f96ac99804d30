"""Rows that are cut out of files grow with them: none of their joins may send one side whole to the driver."""

import pytest

from graphloom.plans import registry

#: Queries on files whose joins are all between rows of the same files.
QUERIES = ("column_catalog", "structured_extraction", "template_by_file", "cobol_relationships", "cobol_links", "sql_table_columns", "sql_business_rules", "cross_file_flows")


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_is_broadcast(spark, sf_dir, name):
    rows = registry.queries()[name](spark, sf_dir)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert "Join" in plan and "BroadcastExchange" not in plan
