"""The posting index over texts that many facts share."""

from graphloom.operators import postings


def test_shared_texts_are_indexed_once(spark, tmp_path, monkeypatch):
    rows = [("edge", f"e{i}", [f"NODE:{i % 3}", "Hub One"]) for i in range(60)] + [("rule", "r", ["hub", None]), ("rule", "none", None)]
    facts = spark.createDataFrame(rows, "source string, id string, texts array<string>")
    index = postings.TextIndex(spark, str(tmp_path / "index"), buckets=2).build(facts)
    # three nodes of six, one name of seven and one word of one character more than two: trigrams of five texts
    assert spark.read.parquet(f"{index.path}/postings").count() == 3 * 4 + 5 + 1
    for most in (postings.BROADCAST, 0):
        monkeypatch.setattr(postings, "BROADCAST", most)
        found = sorted((r["term_no"], r["id"]) for r in index.search(facts, ["HUB", "node:1", "o"]).select("term_no", "id").collect())
        want = [(0, r[1]) for r in rows[:61]] + [(1, f"e{i}") for i in range(60) if i % 3 == 1] + [(2, f"e{i}") for i in range(60)]
        assert found == sorted(want)
