"""Every stage keeps what its operator keeps; the whole against the stages by hand."""

import hashlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.quality_rules import quality_rules
from graphloom.llm.toxicity import toxicity
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near




def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_one_after_another(spark, sf_dir, documents, labels):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "line dedup", "near dedup", "packing"]
    docs, columns = documents, documents.columns
    kept = {r["doc_id"] for r in quality_rules(docs).filter("kept").collect()}
    docs = pipeline.quality_stage(spark, docs, sf_dir)
    assert set(ids(docs)) == kept and docs.columns == columns
    toxic = {r["doc_id"] for r in toxicity(docs, labels).filter("predicted = 1").collect()}
    docs = pipeline.toxicity_stage(spark, docs, sf_dir)
    assert set(ids(docs)) == kept - toxic and docs.columns == columns
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = pipeline.line_stage(spark, docs, sf_dir)
    rows = docs.collect()
    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows) == sorted((d, h) for d, _, _, h in brute_lines(before))
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and docs.columns == columns
    one = {d for d, _, _, kept_ in brute_near([(r["doc_id"], r["text"]) for r in rows]) if kept_}
    docs = pipeline.near_stage(spark, docs, sf_dir)
    assert set(ids(docs)) == one and docs.columns == columns
    packed = pipeline.packing_stage(spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == one
    whole = pipeline.run(spark, sf_dir)
    assert set(r["doc_id"] for r in whole.collect()) == one


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            got = stage(spark, docs.select("*"), sf_dir)
            if name == "packing":
                assert got.count() >= docs.count()
            else:
                assert got.columns == list(pipeline.COLUMNS)
                assert got.count() <= docs.count()


def test_rows_of_one_id_are_judged_apart(spark, sf_dir):
    """A null or repeated id that is rejected once takes no other row of it along."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    good = [" ".join(f"{w}{k}" for w in words) for k in range(3)]
    rows = [(None, good[0]), (None, "junk"), (7, good[1]), (7, "junk"), (8, good[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = sorted(map(str, [(None, good[0]), (7, good[1]), (8, good[2])]))
    texts = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    docs = pipeline.quality_stage(spark, docs, sf_dir)
    assert texts(docs) == want
    docs = pipeline.toxicity_stage(spark, docs, sf_dir)
    assert texts(docs) == want
    more = docs.unionByName(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(9)))
    assert texts(pipeline.near_stage(spark, more, sf_dir)) == want
    # 7 has two texts; the one that is a copy of 3's goes, the other stays
    twice = docs.filter("doc_id = 8").withColumn("doc_id", F.explode(F.array(F.lit(3), F.lit(7)))).unionByName(docs.filter("doc_id IS NULL OR doc_id = 7"))
    assert texts(pipeline.near_stage(spark, twice, sf_dir)) == sorted(map(str, [(None, good[0]), (7, good[1]), (3, good[2])]))


def test_near_stage_is_of_one_mind_with_its_operator(spark, sf_dir, odd_docs):
    assert sorted(map(str, (r["doc_id"] for r in pipeline.near_stage(spark, odd_docs, sf_dir).collect()))) == sorted(str(r["doc_id"]) for r in near_duplicates(odd_docs).filter("kept").collect())


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()
    assert Path(pipeline.__file__).parent == Path(entry.__file__).parent
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
