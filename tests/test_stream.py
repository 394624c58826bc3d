import time

from shelfspark.streaming import dedupe


def test_repeats_are_dropped_across_files(spark, tmp_path):
    first = spark.sql("select 'a' key, timestamp'2024-01-01 00:00:00' ts union all "
                      "select 'b', timestamp'2024-01-01 00:01:00'")
    second = spark.sql("select 'a' key, timestamp'2024-01-01 00:05:00' ts union all "
                       "select 'c', timestamp'2024-01-01 00:06:00'")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = dedupe.read_feed(spark, str(tmp_path / "feed"), "*.parquet", first.schema)
    kept = dedupe.dedupe_stream(feed, ["key"], "ts", "1 hour")
    rows = dedupe.run_to_table(kept, "feed")
    assert sorted(r["key"] for r in rows.collect()) == ["a", "b", "c"]


def test_keys_leave_the_state(spark, tmp_path):
    batches = [
        [("a", "00:10"), ("b", "00:20"), ("a", "00:50"), (None, "00:30")],
        [("a", "00:55"), ("a", "01:05"), ("c", "04:30"), (None, "00:40")],  # the third moves the feed on
        [("a", "04:10"), ("c", "04:45")],
        [("b", "00:40"), ("d", "00:59"), ("e", "09:00"), ("a", "04:20"), ("a", None)],  # two come too late
        [("a", "09:30"), ("a", "09:40")],  # a counts anew
        [("c", "04:50")],  # too late
    ]
    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "key string, at string").selectExpr(
            "key", "to_timestamp('2024-01-01 ' || at) AS ts", f"{n} AS batch")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(1.1)  # files are taken by the second they were written in
    feed = dedupe.read_feed(spark, str(tmp_path / "feed"), "*.parquet", part.schema, files_per_batch=1)
    progress = []
    rows = dedupe.run_to_table(dedupe.dedupe_interval(feed, ["key"], "ts", "1 hour", "1 hour"), "feed", progress)
    got = sorted((r["batch"], str(r["key"]), r["interval"]["start"].strftime("%H")) for r in rows.collect())
    assert got == [(0, "None", "00"), (0, "a", "00"), (0, "b", "00"), (1, "a", "01"), (1, "c", "04"),
                   (2, "a", "04"), (3, "e", "09"), (4, "a", "09")]
    state = [p["stateOperators"][0] for p in progress]
    assert sum(s["numRowsRemoved"] for s in state) >= 6 and state[-1]["numRowsTotal"] <= 2
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 3
    assert spark.conf.get(dedupe.STATE_STORE, None) != dedupe.ROCKS_DB
