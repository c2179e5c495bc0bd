"""Job logs as streams give what they give in batch."""

from strata.streaming import jobs

ROWS = [("a", 1, "view", "2024-01-01 00:00:00"), ("a", 2, "click", "2024-01-01 00:00:00"), ("b", 3, "view", "2024-01-02 10:00:00"), ("b", 4, "error", "2024-01-02 09:00:00"), ("a", 5, "view", "2024-01-03 00:00:00")]


def events(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "job string, seq long, type string, ts string").selectExpr("job", "seq", "type", "cast(ts as timestamp) as ts")
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events")), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def test_newest_on_a_stream(spark, tmp_path):
    still, moving = events(spark, tmp_path)
    running = jobs.stream_newest(moving, "newest_events")
    running.awaitTermination(120)
    assert running.exception() is None
    want = {("a", 5, "view"), ("b", 3, "view")}
    assert {tuple(r) for r in spark.table("newest_events").collect()} == {tuple(r) for r in jobs.newest(still).collect()} == want


def test_windows_on_a_stream(spark, tmp_path):
    still, moving = events(spark, tmp_path)
    running = jobs.windowed_counts(moving, late="30 days").writeStream.outputMode("update").format("memory").queryName("window_counts").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert running.exception() is None
    last = {}
    for r in spark.table("window_counts").collect():  # an update replaces a window's count, which only grows
        last[r["start"], r["type"]] = max(r["n"], last.get((r["start"], r["type"]), 0))
    assert last == {(r["start"], r["type"]): r["n"] for r in jobs.windowed_counts(still).collect()} and sum(last.values()) == len(ROWS)
