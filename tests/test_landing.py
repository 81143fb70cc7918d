"""Landed folders that are compacted while streams go on, begin anew and run batches again."""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fanfold.streaming import landing
from fanfold.streaming.landing import Folder, compact, land, landed, live_folders, newest


def add_files(spark, folder, first, n, rows=10):
    for i in range(first, first + n):
        spark.range(i * rows, (i + 1) * rows).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def run(spark, tmp_path, checkpoint, merge=None, every=2, folder="in"):
    stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    land(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), once=True, merge=merge, compact_every=every).awaitTermination()


def distinct(rows):
    return rows.distinct()


def ids(spark, tmp_path):
    return sorted(r.id for r in landed(spark, str(tmp_path / "out")).collect())


def test_a_stream_compacts_itself_and_a_new_one_lands_beside_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing.compact, "__defaults__", (2, 0.0))  # runs are merged in pairs, without a time of grace
    add_files(spark, str(tmp_path / "in"), 0, 7)
    run(spark, tmp_path, "one", merge=distinct)
    folder = Folder(spark, str(tmp_path / "out"))
    assert ids(spark, tmp_path) == list(range(70))
    manifest, _ = newest(folder)
    assert list(manifest.upto.values()) == [5] and len(live_folders(folder)) <= 3
    # What was merged is gone from the disk as well, but for what the last compaction replaced.
    assert len(list((tmp_path / "out" / "batches").glob("*/*"))) <= 3 and len(list((tmp_path / "out" / "runs").iterdir())) <= 4
    # Another checkpoint begins at batch 0 again, with other input.
    add_files(spark, str(tmp_path / "more"), 7, 3)
    run(spark, tmp_path, "two", merge=distinct, folder="more")
    assert ids(spark, tmp_path) == list(range(100)) and len(newest(folder)[0].upto) == 2
    # The first stream goes on from its own checkpoint.
    add_files(spark, str(tmp_path / "in"), 10, 1)
    run(spark, tmp_path, "one", merge=distinct)
    assert ids(spark, tmp_path) == list(range(110))


def test_batches_that_land_during_a_compaction_are_read_once(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 4)
    run(spark, tmp_path, "one")
    began, go_on = threading.Event(), threading.Event()

    def slow(rows):
        began.set()
        go_on.wait(60)
        return rows.distinct()

    worker = threading.Thread(target=compact, args=(spark, str(tmp_path / "out"), slow))
    worker.start()
    began.wait(60)
    add_files(spark, str(tmp_path / "in"), 4, 3)
    run(spark, tmp_path, "one")
    assert ids(spark, tmp_path) == list(range(70))
    go_on.set()
    worker.join()
    assert ids(spark, tmp_path) == list(range(70))
    assert len(live_folders(Folder(spark, str(tmp_path / "out")))) == 4  # one run and three batches


def test_a_merged_batch_that_is_run_again_does_not_count_twice(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 3)
    run(spark, tmp_path, "one")
    compact(spark, str(tmp_path / "out"), distinct)
    # The commit of the last batch was lost: the stream runs it again.
    os.remove(tmp_path / "one" / "commits" / "2")
    os.remove(tmp_path / "one" / "commits" / ".2.crc")
    add_files(spark, str(tmp_path / "in"), 3, 1)
    run(spark, tmp_path, "one")
    assert ids(spark, tmp_path) == list(range(40))


def test_unfinished_batches_and_runs_are_not_read(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 2)
    run(spark, tmp_path, "one")
    last = max((tmp_path / "out" / "batches").glob("*/*"))
    (last / "_SUCCESS").unlink()
    assert ids(spark, tmp_path) == list(range(10))
    shutil.copytree(last, tmp_path / "out" / "runs" / "left-by-a-dead-compaction")
    assert ids(spark, tmp_path) == list(range(10))


def test_folders_stay_for_the_time_of_grace(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 3)
    run(spark, tmp_path, "one")
    path, before = str(tmp_path / "out"), landed(spark, str(tmp_path / "out"))
    assert compact(spark, path, distinct, grace_seconds=100)
    assert before.count() == 30 and not compact(spark, path, distinct, grace_seconds=100)
    assert compact(spark, path, distinct, grace_seconds=0) and not list((tmp_path / "out" / "batches").glob("*/*"))
    assert ids(spark, tmp_path) == list(range(30)) and not compact(spark, path, distinct, grace_seconds=0)


def test_of_two_compactions_one_gives_up(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 2)
    run(spark, tmp_path, "one")
    path = str(tmp_path / "out")

    def overtaken(rows):
        assert compact(spark, path, distinct)
        return rows.distinct()

    assert not compact(spark, path, overtaken)
    assert ids(spark, tmp_path) == list(range(20)) and newest(Folder(spark, path))[0].generation == 1


def test_a_half_written_manifest_is_passed_over(spark, tmp_path):
    add_files(spark, str(tmp_path / "in"), 0, 2)
    run(spark, tmp_path, "one")
    path = str(tmp_path / "out")
    compact(spark, path, distinct)
    Path(path, "manifests", f"{2:012d}.json").write_text(json.dumps({"generation": 2})[:-3])
    assert ids(spark, tmp_path) == list(range(20))
    add_files(spark, str(tmp_path / "in"), 2, 1)
    run(spark, tmp_path, "one")
    assert compact(spark, path, distinct) and newest(Folder(spark, path))[0].generation == 3
    assert ids(spark, tmp_path) == list(range(30))


def test_sums_add_up_over_tiers(spark, tmp_path):
    for i in range(9):
        spark.range(20).select((F.col("id") % 3).alias("k"), F.lit(1).alias("n")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    stream = spark.readStream.schema("k BIGINT, n INT").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    land(stream, path, str(tmp_path / "cp"), total, once=True).awaitTermination()
    for _ in range(2):
        compact(spark, path, total, fan=2)
    assert {(r.k, r.n) for r in total(landed(spark, path)).collect()} == {(0, 63), (1, 63), (2, 54)}


def test_nothing_landed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        landed(spark, str(tmp_path / "none"))
    assert not compact(spark, str(tmp_path / "none"), distinct)
