"""Ends and time-outs that a stream tells of by itself."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fanfold.streaming import timers, watch

START = datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set(timers.STATE_STORE_CONF, timers.STATE_STORE)
    yield spark
    spark.conf.unset(timers.STATE_STORE_CONF)


def write(spark, df, folder, n):
    rows = df.collect()
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i::n], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def run(stream, name, tmp_path, n):
    """Runs until ``n`` rows have been told and all input is read; with timers a stream never ends by itself."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(processingTime="1 second").start()
    try:
        read = lambda: sum(p["numInputRows"] > 0 for p in query.recentProgress)
        assert wait_for(lambda: read() >= 4 and stream.sparkSession.table(name).count() >= n)
    finally:
        query.stop()


def wait_for(found, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not found():
        time.sleep(0.5)
    return found()


def test_job_ends_equal_batch_over_shuffled_batches(rocks, tmp_path):
    states = ["QUEUED", "RUNNING", "RUNNING"]
    data = [(f"job{j}", s, START + timedelta(hours=j, minutes=i)) for j in range(12)
            for i, s in enumerate(states + ([["SUCCEEDED"], ["FAILED"], []][j % 3]))]
    random.Random(1).shuffle(data)
    df = rocks.createDataFrame(data + data[:5], "job_id STRING, state STRING, ts TIMESTAMP")
    write(rocks, df, str(tmp_path / "in"), 4)
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(timers.job_ends(stream, 3600), "job_ends", tmp_path, 8)
    told = rocks.table("job_ends").collect()
    batch = watch.latest_states(df).where("terminal").collect()
    assert sorted((r.job_id, r.event, r.ts) for r in told) == sorted((r.job_id, r.state, r.ts) for r in batch) and len(told) == 8


def test_run_ends_equal_batch_over_shuffled_batches(rocks, tmp_path):
    rng = random.Random(2)
    runs = rocks.createDataFrame([(k, 70, datetime(2100, 1, 1)) for k in range(6)], "run_key INT, n_expected INT, deadline TIMESTAMP")
    data = [(k, i) for k in range(6) for i in range(-1, 72) if k % 2 or i != 40] + [(rng.randrange(6), rng.randrange(30)) for _ in range(50)]
    rng.shuffle(data)
    df = rocks.createDataFrame(data, "run_key INT, task_index INT").withColumn("status", F.lit("ok"))
    write(rocks, df, str(tmp_path / "in"), 4)
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(timers.run_ends(stream, runs), "run_ends", tmp_path, 3)
    told = {(r.run_key, r.event, r.n_arrived) for r in rocks.table("run_ends").collect()}
    batch = watch.arrival_status(df, runs, "2030-01-01T00:00:00Z").where("state = 'complete'").collect()
    assert told == {(r.run_key, r.state, r.n_arrived) for r in batch} and len(told) == 3


def test_timers_fire(rocks, tmp_path):
    jobs = rocks.createDataFrame([("a", "RUNNING", START), ("b", "FAILED", START)], "job_id STRING, state STRING, ts TIMESTAMP")
    jobs.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    stream = rocks.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    query = timers.job_ends(stream, 1).writeStream.format("memory").queryName("silent").outputMode("append").trigger(
        processingTime="1 second").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        assert wait_for(lambda: {(r.job_id, r.event) for r in rocks.table("silent").collect()} >= {("b", "FAILED"), ("a", "SILENT")})
        jobs.where("job_id = 'a'").withColumn("state", F.lit("SUCCEEDED")).coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs"))
        assert wait_for(lambda: ("a", "SUCCEEDED") in {(r.job_id, r.event) for r in rocks.table("silent").collect()})
    finally:
        query.stop()
    assert rocks.table("silent").where("job_id = 'b'").count() == 1


def test_a_late_run_is_timed_out_and_then_complete(rocks, tmp_path):
    runs = rocks.createDataFrame([("r", 3, START)], "run_key STRING, n_expected INT, deadline TIMESTAMP")
    first = rocks.createDataFrame([("r", 0), ("r", 1), ("r", 1)], "run_key STRING, task_index INT")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    query = timers.run_ends(stream, runs).writeStream.format("memory").queryName("late").outputMode("append").trigger(
        processingTime="1 second").option("checkpointLocation", str(tmp_path / "c2")).start()
    told = lambda: [tuple(r) for r in rocks.table("late").collect()]
    try:
        assert wait_for(lambda: told() == [("r", "timed out", 2)])
        rocks.createDataFrame([("r", 2)], first.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert wait_for(lambda: told() == [("r", "timed out", 2), ("r", "complete", 3)])
    finally:
        query.stop()


def test_the_state_store_must_be_set(spark, tmp_path):
    spark.createDataFrame([("a", "b", START)], "job_id STRING, state STRING, ts TIMESTAMP").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id STRING, state STRING, ts TIMESTAMP").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        timers.job_ends(stream, 1)
