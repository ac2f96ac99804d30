"""Column functions on names, questions and identifiers."""

import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.windows import line_windows


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "c string").select(function(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "key"), [("PCX_Pc-Policy ", "pc_policy"), ("cc_Claim.ID", "claim_id"), ("__", ""), (None, "")])
def test_normalised_name(spark, name, key):
    assert one(spark, name, T.normalised_name) == key


@pytest.mark.parametrize(("question", "kind"), [("which packages consume X", "calculation"), ("list entities", "relationship"), ("exchange rates", "impact_analysis"), ("hello", "semantic")])
def test_intent(spark, question, kind):
    assert one(spark, question, T.intent) == kind


@pytest.mark.parametrize(("given", "canonical"), [("reads", "READS_FROM"), ("transforms", "TRANSFORMS"), ("what?", "USES"), (None, "USES")])
def test_relationship_type(spark, given, canonical):
    assert one(spark, given, T.relationship_type) == canonical


def test_entity_types(spark):
    assert one(spark, "field", T.entity_type) == "COLUMN"
    assert one(spark, "tables", T.entity_type) == "TABLE"


def test_sql_identifier(spark):
    assert one(spark, "[Db1] . [dbo].[tbl a]", T.sql_identifier) == "Db1.dbo.tbl a"


def test_point_id_is_a_version_5_uuid(spark):
    assert one(spark, "demo.sql#3", T.point_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "demo.sql#3"))


def test_comments_leave_their_lines(spark):
    assert one(spark, "a /* x\ny */ b -- c\nd", T.without_comments).count("\n") == 2


@pytest.mark.parametrize(("n", "windows"), [(1, 1), (50, 1), (51, 2), (90, 2), (91, 3)])
def test_window_count(spark, n, windows):
    df = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(n)))], "f string, t string")
    rows = line_windows(df, "f", "t").orderBy("chunk_index").collect()
    assert len(rows) == windows
    assert rows[-1]["line_end"] == n
