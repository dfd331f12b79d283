"""Streams give what the batch gives on a bounded source."""

import shutil

from pyspark.sql import functions as F

from freshet.streaming import events as E


def test_windows_and_state(spark, data, tmp_path):
    shutil.copy(f"{data}/events.parquet", tmp_path / "events.parquet")
    path = f"file://{tmp_path}"
    batch = spark.read.parquet(path)
    got = E.drain(E.windowed(E.event_stream(spark, path)), "windows", "complete")
    want = E.windowed(batch)
    key = lambda r: (r["event_type"], r["n"], r["peak"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    state = E.drain(E.running_peaks(E.event_stream(spark, path)), "states", "update")
    totals = {r["user_id"]: (r["n"], r["peak"]) for r in state.collect()}
    assert totals == {r["user_id"]: (r["n"], r["peak"]) for r in batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).collect()}
