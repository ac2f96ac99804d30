"""Parsers by id, those of users among them, and packages in SQL."""

import pytest
from pyspark.sql import functions as F

from graphloom.extract import parsers


def test_register_and_get(spark):
    known = parsers.built_in()
    assert known.available() == ["cobol", "sql", "ssis"] and known.get("sql").source_type == "sql"
    with pytest.raises(parsers.ParserNotFoundError, match="cobol, sql, ssis"):
        known.get("pli")


def test_each_parser_reads_its_own_files(spark):
    def words(files):
        entities = files.select("file_name", F.explode(F.split("text", " ")).alias("name"), F.lit("WORD").alias("entity_type"))
        none = files.limit(0)
        return entities, none.selectExpr("file_name", "text AS rule_type", "text AS rule_id"), none.selectExpr("file_name", "text AS type", "text AS source", "text AS target")

    own = parsers.Parsers()
    own.register("words", "note", lambda files: pytest.fail("replaced"))
    own.register("words", "note", words)
    own.register("again", "note", words)
    files = spark.createDataFrame([("n", "note", "a b a"), ("s", "sql", "select 1"), ("u", None, "x"), ("e", "note", None)], "file_name string, source_type string, text string")
    got = sorted((r["file_name"], r["parser_id"], r["kind"], r["type"], r["name"]) for r in own.facts(files).collect())
    assert got == [("n", p, "ENTITY", "WORD", w) for p in ("again", "words") for w in "ab"]
    assert sorted(r["file_name"] for r in own.unparsed(files).collect()) == ["s", "u"]
    assert own.facts(files.limit(0)).collect() == []


def test_packages_in_sql(spark):
    parsers.register_sql(spark)
    files = spark.createDataFrame([("a", "<x/>"), ("b", "no"), ("c", None)], "file_name string, text string")
    rows = spark.sql("SELECT f.file_name, p.kind FROM {files} f, LATERAL package_facts(f.text) p", files=files).collect()
    assert sorted(map(tuple, rows)) == [("a", "package"), ("b", "error"), ("c", "error")]
