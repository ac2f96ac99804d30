"""Extractors over small artifacts; tests/test_oracle.py holds the registered queries against stated facts."""

import pytest

from graphloom.extract import sql, ssis
from graphloom.sources.files import inline


def rows(df):
    return [r.asDict() for r in df.collect()]


def script(spark, text):
    return sql.prepared(inline(spark, {"x.sql": text}))


def test_sql_of_nothing(spark):
    for text in ("", "not a query at all"):
        prepared = sql.prepared(inline(spark, {"x.sql": text}))
        assert rows(sql.joins(prepared)) == []
        assert rows(sql.cases(prepared)) == []


def test_clauses_end_with_their_brackets(spark):
    text = "SELECT a FROM (SELECT b FROM m JOIN n ON m.k = n.k WHERE m.o = 'it''s (x' ) AS d RIGHT OUTER JOIN [a b].[c] w WITH (NOLOCK) ON w.k = d.b ORDER BY 1"
    found = script(spark, text)
    assert {(r["join_type"], r["table"], r["alias"], r["condition"]) for r in rows(sql.joins(found))} == {("JOIN", "n", None, "m.k = n.k"), ("RIGHT OUTER JOIN", "a b.c", "w", "w.k = d.b")}
    assert [r["condition"] for r in rows(sql.where_conditions(found))] == ["m.o = 'it''s (x'"]
    assert rows(sql.where_conditions(found, legacy=True))[0]["condition"].endswith("ON w.k = d.b")


def test_inner_cases(spark):
    found = script(spark, "SELECT CASE WHEN a = 1 THEN CASE WHEN b = 2 THEN 'x' WHEN c = 3 THEN f(4) END ELSE 5 END AS r, CASE WHEN d = 6 THEN 7 END")
    assert {(r["target_column"], r["condition"], r["result"]) for r in rows(sql.business_rules(found))} == {("r", "a = 1", "(CASE)"), (None, "b = 2", "'x'"), (None, "c = 3", "f(4)"), (None, "d = 6", "7")}
    assert {(r["target_column"], r["condition"], r["result"]) for r in rows(sql.business_rules(found, legacy=True))} == {("r", "a = 1", "CASE"), ("r", "b = 2", "'x'"), ("r", "c = 3", "f(4)"), (None, "d = 6", "7")}


def test_long_script(spark):
    """A megabyte in one condition."""
    found = script(spark, "SELECT a FROM t WHERE " + " AND ".join(f"c{i} = {i}" for i in range(60_000)))
    assert [len(r["condition"]) > 1_000_000 for r in rows(sql.where_conditions(found))] == [True]
    assert len(rows(sql.tables(found))) == 1


def test_steps_of_a_cycle_are_unknown(spark):
    rule = '<D:PrecedenceConstraint D:From="{}" D:To="{}"/>'
    pairs = [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), *((f"N{i}", f"N{i + 1}") for i in range(70))]
    package = '<D:Executable xmlns:D="urn:x"><D:PrecedenceConstraints>' + "".join(rule.format(*p) for p in pairs) + "</D:PrecedenceConstraints></D:Executable>"
    step = {r["task"]: r["step"] for r in rows(ssis.execution_order(ssis.facts(inline(spark, {"x.dtsx": package}))))}
    assert (step["A"], step["B"], step["C"], step["D"], step["N70"]) == (0, None, None, None, 70)


@pytest.mark.parametrize("text", ["", "<open>", "no xml"])
def test_broken_package_is_one_error(spark, text):
    found = rows(ssis.facts(inline(spark, {"x.dtsx": text})))
    assert [r["kind"] for r in found] == ["error"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_not_shuffled(spark):
    """Scripts are dealt out before they are cut; windows see the tokens that a clause is told by, not all of them."""
    found = script(spark, "SELECT a FROM t WHERE b = 1")
    assert "Window" not in _plan(sql.tokens(found))
    assert _plan(sql.tables(found)).count("Repartition") == 1
    words = sql.tokens(found).count()
    assert sql._until(sql.tokens(found), sql.F.col("word") == "WHERE", sql._starts("GROUP"), False).count() == 1 < words


def test_tokens_of_slices(spark, monkeypatch):
    """Places are those of the script whatever else its slice holds."""
    from graphloom.extract import sql_tokens as T

    texts = ["SELECT a FROM (SELECT b FROM t) d", "", " \n", "x", "UPDATE c SET e = 1 WHERE (f IN (SELECT g FROM h))"] * 3
    names = [f"f{i}" for i in range(len(texts))]
    batch = T.pa.RecordBatch.from_arrays([T.pa.array(names), T.pa.array(texts)], names=["file_name", "text"])
    whole = [r for b in T.batches(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(T, "SLICE", 1)
    assert [r for b in T.batches(iter([batch])) for r in b.to_pylist()] == whole
    assert {r["file_name"] for r in whole if r["parent"]} == {n for n, t in zip(names, texts, strict=True) if "(SELECT" in t}
