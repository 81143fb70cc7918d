"""Files, exported records and streams on temporary folders."""

from __future__ import annotations

import gzip
import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entries
from fanfold.operators import telemetry as M
from fanfold.operators.logs import fresh
from fanfold.operators.metrics import align_mean
from fanfold.session import in_tasks, materialize, shared_dir
from fanfold.sources import files, records
from fanfold.sources.catalogue import files_below, read_catalogue, write_catalogue
from fanfold.sources.walk import walk_store
from fanfold.streaming import follow, landing, watch


def test_listing_is_recursive_sorted_and_empty_for_absent_folders(spark, tmp_path):
    for name in ("b.txt", "a/c.pkl.gz", "a/d/e.csv"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"1234")
    found = files.list_artifacts(spark, str(tmp_path)).collect()
    assert [r.path.split(str(tmp_path))[1] for r in found] == ["/a/c.pkl.gz", "/a/d/e.csv", "/b.txt"]
    assert {r.length for r in found} == {4}
    assert files.list_artifacts(spark, str(tmp_path / "absent")).count() == 0


def test_walking_equals_listing(spark, tmp_path, rows):
    for name in ("top", "a/b/c/d/e/deep.gz", "a/b/x", "a/_SUCCESS", ".hidden/x", "_temporary/y", "k=_v/_n=1/z", "empty folder/"):
        target = tmp_path / "root" / name
        (target if name.endswith("/") else target.parent).mkdir(parents=True, exist_ok=True)
        if not name.endswith("/"):
            target.write_bytes(b"x" * len(name))
    for root in (str(tmp_path / "root"), f"file://{tmp_path}/root/"):
        assert rows(walk_store(spark, root, folders_per_task=1)) == rows(files.list_artifacts(spark, root))
    assert walk_store(spark, str(tmp_path / "root")).count() == 4 and walk_store(spark, str(tmp_path / "none")).isEmpty()


def test_listing_never_reads_contents(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    plan = files.list_artifacts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_manifest_prefixes_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("p/a/x", 1, None), ("q/x", 2, None)], files.LISTING).write.parquet(str(tmp_path / "m"))
    df = files.read_manifest(spark, str(tmp_path / "m"), ["p/a"])
    assert "PushedFilters: [StringStartsWith(path,p/a)" in df._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(path), ", "")
    assert [r.path for r in df.collect()] == ["p/a/x"]


def test_a_catalogue_opens_only_files_that_can_match(spark, tmp_path, rows):
    names = [f"p/y{2000 + i % 40}/exp{i % 7}/f{i}" for i in range(4000)] + ["p/y2004/odd name", "p/z", "q/y2004/exp1/f"]
    listing = spark.createDataFrame([(n, len(n)) for n in names], "path STRING, length BIGINT")
    root = str(tmp_path / "catalogue")
    write_catalogue(listing, root, 10)
    for patterns in (["y2004/*"], ["y2004/exp1/*", "y203[0-3]*"], ["z"], ["nothing*"], ["*"]):
        starts = ["p/" + p.split("*")[0].split("[")[0] for p in patterns]
        found = read_catalogue(spark, root, "p/", patterns)
        assert rows(found) == sorted(((n, len(n)) for n in names if n.startswith(tuple(starts))), key=repr)
    stored = len(list((tmp_path / "catalogue" / "data").glob("*.parquet")))
    narrow = read_catalogue(spark, root, "p/", ["y2004/exp1/*"])
    assert stored == 10 and len(narrow.inputFiles()) == 1 and len(files_below(spark, root, ["p/y2004/exp1/", "p/y2031/"])) <= 4
    assert "PushedFilters: [StringStartsWith(path,p/y2004/exp1/)" in narrow._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(path), ", "")


def test_outputs_are_zipped_counted_and_never_replaced(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "k INT, v STRING")
    report = files.write_outputs(spark, {"t": table, "p": (table, "parquet"), "fig": object()}, str(tmp_path), "20240101-000000", "m")
    assert {tuple(r) for r in report.collect()} == {("t", "csv.gz", True), ("p", "parquet", True), ("fig", None, False)}
    parts = list((tmp_path / "outputs" / "20240101-000000_m" / "t.csv.gz").glob("*.csv.gz"))
    assert gzip.decompress(parts[0].read_bytes()).startswith(b"k,v")
    with pytest.raises(FileExistsError):
        files.write_outputs(spark, {"other": table}, str(tmp_path), "20240101-000000", "m")
    with pytest.raises(AnalysisException):
        files.write_table(table, str(tmp_path / "outputs" / "20240101-000000_m" / "t.csv.gz"), "csv.gz")
    with pytest.raises(ValueError):
        files.output_dir("x", "today")


def test_exported_documents(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for i in range(2):
        page = {"executions": [{"name": f"w/executions/{i}{j}", "state": "ACTIVE", "argument": "{}"} for j in range(2)]}
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps(page, indent=1))
    read = records.read_executions(spark, str(tmp_path / "pages"))
    assert read.count() == 4 and read.where("labels is null and status.current_steps is null").count() == 4
    jobs = [{"name": "j/stage-b-1", "labels": {"stage": "runner"}, "createTime": "2024", "status": {"state": "RUNNING",
             "statusEvents": [{"eventTime": "t1"}], "taskGroups": {"g": {"counts": {"RUNNING": 3}}}}}]
    (tmp_path / "jobs.json").write_text(json.dumps(jobs))
    job = records.read_jobs(spark, str(tmp_path / "jobs.json")).first()
    assert (job.job_id, job.env, job.image_uri, job.task_groups["g"].counts["RUNNING"]) == ("stage-b-1", None, None, "3")


def test_fresh_logs_open_only_recent_days(spark, tmp_path):
    days = spark.range(60).select(F.expr("timestamp '2024-01-01' + make_dt_interval(cast(id as int))").alias("timestamp"))
    days.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(str(tmp_path / "logs"))
    df = fresh(spark.read.parquet(str(tmp_path / "logs")), "2024-02-29T00:00:00Z", days=10, date_column="day")
    assert df.count() == 11
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()


def test_telemetry_skips_bad_files_and_names_its_stage(spark, tmp_path):
    folder = tmp_path / "summaries" / "json"
    folder.mkdir(parents=True)
    for name, text in {"builder_summary.json": '{"duration": 2.0, "status": "ok"}', "runner_00000_summary.json": '{"duration": 4.0, "status": "success"}',
                       "runner_00001_summary.json": "{broken", "runner_00002_summary.json": '{"duration": 6.0, "status": "failed"}',
                       "other.json": "{}"}.items():
        (folder / name).write_text(text)
    df = M.read_telemetry(spark, str(tmp_path))
    assert {(r.stage, r.task_index) for r in df.collect()} == {("builder", None), ("runner", 0), ("runner", 2)}
    total = M.workflow_summary(df).where("stage = 'total'").first()
    assert (total.n, total.n_ok, total.total_duration, total.max_duration) == (3, 2, 12.0, 6.0)
    M.write_summary(M.workflow_summary(df), str(tmp_path / "out"), "workflow_summary")
    assert spark.read.text(str(tmp_path / "out" / "txt" / "workflow_summary")).count() == 3
    with pytest.raises(ValueError):
        M.write_summary(df, str(tmp_path), "a/b")


def test_materialized_rows_do_not_change(spark):
    df = materialize(spark.range(100).withColumn("r", F.rand()))
    assert df.exceptAll(df).count() == 0 and shared_dir(spark)


def write_batches(spark, df, folder, n, order=None):
    """One file per batch of equal size by time; ``order`` tells which comes first."""
    rows = df.orderBy("ts").collect()
    size = -(-len(rows) // n)
    for i in order or range(n):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in the order of their modification times


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [2, 3, 0, 1], [3, 1, 2, 0]])
def test_state_streams_over_batches_equal_batch(spark, tmp_path, rows, order):
    states = ["QUEUED", "SCHEDULED", "RUNNING", "RUNNING", "SUCCEEDED"]
    data = [(f"job{j}", states[s], j * 86_400 + s * 600) for j in range(20) for s in range(5)]
    df = spark.createDataFrame(data, "job_id STRING, state STRING, s BIGINT").select("job_id", "state", F.timestamp_seconds("s").alias("ts"))
    folder = str(tmp_path / "in")
    write_batches(spark, df, folder, 4, order)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    watch.watch_steps(stream, str(tmp_path / "w3"), str(tmp_path / "c3"), once=True).awaitTermination()
    assert rows(watch.read_steps(spark, str(tmp_path / "w3"))) == rows(watch.state_steps(df))
    watch.watch_status(stream, str(tmp_path / "w2"), str(tmp_path / "c2"), once=True).awaitTermination()
    latest = watch.read_status(spark, str(tmp_path / "w2"))
    assert rows(latest) == rows(watch.latest_states(df)) and latest.where("terminal").count() == 20


def test_late_reports_do_not_move_a_job_back(spark, rows):
    df = spark.createDataFrame([("j", "SUCCEEDED", 10), ("j", "RUNNING", 5), ("k", "FAILED", 7), ("k", "RUNNING", 7)],
                               "job_id STRING, state STRING, s BIGINT").select("job_id", "state", F.timestamp_seconds("s").alias("ts"))
    assert rows(watch.latest_states(df), "job_id", "state", "terminal") == [("j", "SUCCEEDED", True), ("k", "FAILED", True)]


def test_arrivals(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("b", 0, 4), ("c", 0, 5)], "run_key STRING, task_index BIGINT, s BIGINT").select(
        "run_key", "task_index", F.lit("ok").alias("status"), F.timestamp_seconds("s").alias("ts"))
    folder = str(tmp_path / "in")
    write_batches(spark, df, folder, 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    watch.watch_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    runs = spark.createDataFrame([("a", 2, 0), ("b", 2, 10**10), ("c", 2, 0)], "run_key STRING, n_expected INT, s BIGINT").select(
        "run_key", "n_expected", F.timestamp_seconds("s").alias("deadline"))
    assert rows(watch.arrival_status(landing.landed(spark, str(tmp_path / "out")), runs, "2024-01-01T00:00:00Z"), "run_key", "n_arrived", "state") == [
        ("a", 2, "complete"), ("b", 1, "waiting"), ("c", 1, "timed out")]


def test_followed_logs_keep_equal_timestamps_late_rows_and_drop_repeats(spark, tmp_path):
    df = spark.createDataFrame([(i % 150, 1_700_000_000 + 86_400 * (i // 60)) for i in range(300)], "insert_id BIGINT, s BIGINT").select(
        "insert_id", F.timestamp_seconds("s").alias("ts"), F.lit("INFO").alias("severity"))
    folder = str(tmp_path / "in")
    write_batches(spark, df, folder, 5, [2, 3, 4, 0, 1])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumnRenamed("ts", "timestamp")
    follow.follow_logs(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True, severity="INFO").awaitTermination()
    got = [r.insert_id for r in follow.followed_logs(spark, str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(150))


def test_followed_metrics_equal_batch_in_any_order_and_after_compaction(spark, tmp_path, rows):
    data = [("cpu", f"i{i % 3}", 1_700_000_000 + 43_200 * (i // 5), float(i % 7) if i % 11 else None) for i in range(100)]
    df = spark.createDataFrame(data, "metric STRING, instance_name STRING, s BIGINT, value DOUBLE").select(
        "metric", "instance_name", F.timestamp_seconds("s").alias("ts"), "value")
    folder = str(tmp_path / "in")
    write_batches(spark, df, folder, 5, [2, 3, 4, 0, 1])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    follow.follow_metrics(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 86_400, once=True).awaitTermination()
    expected = rows(align_mean(df, 86_400))
    assert rows(follow.followed_metrics(spark, str(tmp_path / "out"))) == expected
    assert landing.compact(spark, str(tmp_path / "out"), follow.added)
    assert rows(follow.followed_metrics(spark, str(tmp_path / "out"))) == expected


@pytest.mark.parametrize("name", ["w1_follow", "w2_watch", "w3_stream", "w4_arrivals", "w5_windows"])
def test_stream_queries_read_a_folder_of_parts(spark, tmp_path, rows, name):
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    query = entries.queries()[name]
    assert rows(query(spark, str(tmp_path))) == rows(query(spark, source))


def test_documents_are_dealt_one_to_a_file_without_folders_of_their_own(spark, tmp_path, monkeypatch, rows):
    from fanfold.plans import stored

    customers = spark.range(1200).select(
        F.col("id").alias("c_custkey"), F.expr("array('A', 'B', NULL)[id % 3]").alias("c_mktsegment"),
        (F.col("id") - 600).cast("decimal(12,2)").alias("c_acctbal"))
    customers.coalesce(1).write.parquet(str(tmp_path / "in/customer.parquet"))
    monkeypatch.setattr(stored, "fresh", lambda t: str(tmp_path / "out"))
    found = rows(entries.queries()["s6_documents"](spark, str(tmp_path / "in")))
    want = [(s, 400, sum(keys), sum(k < 600 for k in keys)) for s, keys in (("A", range(0, 1200, 3)), ("B", range(1, 1200, 3)), (None, range(2, 1200, 3)))]
    assert found == sorted(want, key=repr)
    documents = [p for p in (tmp_path / "out").rglob("part-*")]
    assert len(documents) == 12 + 3 * 12 and all(json.loads(p.read_text()) for p in documents)
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_dir()]) == 3
    assert len({p.name[:10] for p in documents}) > 1  # several tasks share the files of one small input


def test_written_steps_leave_no_shuffle_files(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import time
from pathlib import Path
from fanfold.session import FREE_SHUFFLES, build_session, materialize
spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.local.dir": {str(tmp_path / "local")!r},
    "spark.checkpoint.dir": {str(tmp_path / "shared")!r}, "spark.driver.memory": "1g"}})
before = spark.conf.get(FREE_SHUFFLES)
step = spark.range(1000).withColumnRenamed("id", "k")
for i in range(3):
    step = materialize(step.groupBy((step.k % (500 - i)).alias("k")).count().select("k"))
until = time.time() + 20
while (left := list(Path({str(tmp_path / "local")!r}).rglob("shuffle_*"))) and time.time() < until:
    time.sleep(0.2)
print("left", len(left), step.count(), spark.conf.get(FREE_SHUFFLES) == before)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=200,
                         env={k: v for k, v in os.environ.items() if k != "SPARK_LOCAL_DIRS"})
    assert "left 0 498 True" in run.stdout, run.stdout + run.stderr[-2000:]


def test_few_rows_go_to_few_tasks(spark):
    many = spark.range(0, 100, 1, 64)
    assert in_tasks(many, 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert in_tasks(many, 10**9).rdd.getNumPartitions() == 64


def test_a_written_step_sends_long_rows_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(1000, numPartitions=1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    found = materialize(texts.mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r.rows for r in found) == 1000 and max(r.bytes for r in found) < 5_000_000
    assert spark.conf.get(key) == before
