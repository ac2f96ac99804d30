"""The summary of scripts cuts them into tokens once, whatever the number of kinds of facts."""

from graphloom.extract import sql
from graphloom.operators import package


def test_summary_reads_tokens_that_are_cut_once(spark):
    files = spark.createDataFrame([("a", "DECLARE @d int = 1\nSELECT CASE WHEN t.x = 1 THEN 2 END AS y FROM t JOIN u ON u.a = t.a WHERE t.b = @d"), ("b", None)], "file_name string, text string")
    told = sql.summary(sql.prepared(files))
    assert "MapInArrow" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r["file_name"]: r for r in told.collect()}
    assert [got["a"][c] for c in ("variables", "set_statements", "tables", "joins", "cases", "business_rules", "where_conditions", "column_references", "status")] == [1, 0, 2, 1, 1, 1, 1, 4, "PASS"]
    assert (got["b"]["tables"], got["b"]["status"]) == (0, "REVIEW")


def test_facts_of_packages_read_tokens_that_are_cut_once(spark):
    files = spark.createDataFrame([("a", "SELECT t.x FROM t JOIN u ON u.a = t.a")], "file_name string, text string")
    facts = package.script_facts(sql.prepared(files))
    assert all("MapInArrow" not in f._jdf.queryExecution().executedPlan().toString() for f in facts)
    assert sorted(r["name"] for r in facts[0].collect()) == ["t", "t.a", "t.x", "u", "u.a"]
    assert [(r["source"], r["target"]) for r in facts[2].collect()] == [("t", "u")]
