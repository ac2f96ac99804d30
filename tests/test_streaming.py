"""Streams give what tables give."""

from pyspark.sql import functions as F

from graphloom.streaming.incremental import analyse_incrementally, changed, event_windows, file_stream


def test_only_new_content_is_analysed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("select 1")
    store = str(tmp_path / "store")

    def run():
        analyse_incrementally(file_stream(spark, str(tmp_path / "in")), store, lambda df: df, str(tmp_path / "state")).awaitTermination()
        return sorted((r["file_name"], r["text"]) for r in spark.read.parquet(store).collect())

    assert run() == [("a.sql", "select 1")]
    (tmp_path / "in" / "b.sql").write_text("select 2")
    assert run() == [("a.sql", "select 1"), ("b.sql", "select 2")]
    files = spark.createDataFrame([("a.sql", "select 1"), ("a.sql", "select 3")], "file_name string, text string")
    assert [r["text"] for r in changed(files, spark.read.parquet(store)).collect()] == ["select 3"]


def test_event_windows_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = event_windows(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    want = event_windows(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_state_of_each_file(spark, tmp_path):
    """New, changed, unchanged, back again; of two versions in a batch the last; no name, no text."""
    from graphloom.streaming.by_file import Progress, analyse_by_file, current

    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    progress = Progress()
    spark.streams.addListener(progress)

    def wave(*rows):
        spark.createDataFrame(rows, "file_name string, version bigint, text string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("file_name string, version bigint, text string").parquet(folder)
        before = {r["version"] for r in spark.read.parquet(store).collect()} if (tmp_path / "store").exists() else set()
        analyse_by_file(stream, store, lambda df: df, str(tmp_path / "progress"), name="files").awaitTermination()
        return sorted((r["file_name"], r["change"], r["text"]) for r in spark.read.parquet(store).collect() if r["version"] not in before)

    try:
        assert wave(("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "z")) == [("a", "NEW", "y"), ("b", "NEW", "")]
        assert wave(("a", 5, "y"), ("b", 6, "b"), ("c", 7, "l\r\nm")) == [("b", "CHANGED", "b"), ("c", "NEW", "l\r\nm")]
        assert wave(("a", 8, "x"), ("c", 9, "l\nm")) == [("a", "CHANGED", "x")]
        assert sorted((r["file_name"], r["version"]) for r in current(spark, store).collect()) == [("a", 8), ("b", 6), ("c", 7)]
        assert all(key in progress.of["files"] for key in ("batches", "rows", "files"))
    finally:
        spark.streams.removeListener(progress)


def test_state_goes_after_its_time(spark, tmp_path):
    import time

    from graphloom.streaming.by_file import analyse_by_file

    folder, store = str(tmp_path / "in"), tmp_path / "store"

    def arrive(version):
        spark.createDataFrame([("a", version, "same")], "file_name string, version bigint, text string").coalesce(1).write.mode("append").parquet(folder)

    def found():
        return sorted((r["version"], r["change"]) for r in spark.read.parquet(*map(str, store.glob("batch=*/*.parquet"))).collect()) if list(store.glob("batch=*/_SUCCESS")) else []

    arrive(1)
    stream = spark.readStream.schema("file_name string, version bigint, text string").parquet(folder)
    query = analyse_by_file(stream, str(store), lambda df: df, str(tmp_path / "progress"), ttl_ms=1, every="0 seconds")
    try:
        for version in (1, 2):
            until = time.time() + 60
            while len(found()) < version and time.time() < until and query.isActive:
                time.sleep(0.5)
            if version == 1:
                arrive(2)
        assert found() == [(1, "NEW"), (2, "NEW")]
    finally:
        query.stop()
