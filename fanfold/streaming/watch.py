"""Job states and arriving results as streams.

What a batch lands is merged on reading (:mod:`fanfold.streaming.landing`), so no state grows inside the stream and a report
that comes late still counts at its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fanfold.operators.ordering import previous_row
from fanfold.operators.tasks import gather
from fanfold.streaming.landing import land, landed

# States after which a job does not change any more.
TERMINAL = ["SUCCEEDED", "FAILED"]


def _standing(state: Column, ts: Column) -> Column:
    """Order of two reports on a job: by time, and a terminal state wins a tie."""
    return F.struct(ts, state.isin(TERMINAL), state)


def latest_states(events: DataFrame) -> DataFrame:
    """Last state of each job from ``(job_id, state, ts)``; a late report never moves it back."""
    last = F.max(_standing(F.col("state"), F.col("ts")).alias("s"))
    rows = events.groupBy("job_id").agg(last.alias("s"))
    return rows.select("job_id", F.col("s.state").alias("state"), F.col("s.ts").alias("ts"),
                       F.col("s.state").isin(TERMINAL).alias("terminal"))


def last_reports(events: DataFrame) -> DataFrame:
    return latest_states(events).select("job_id", "state", "ts")


def watch_status(stream: DataFrame, path: str, checkpoint: str, once: bool = False,
                 every: str = "10 seconds") -> StreamingQuery:
    """Lands the last state of each job in each batch; read with :func:`read_status`."""
    return land(stream, path, checkpoint, last_reports, once, every, merge=last_reports)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return latest_states(landed(spark, path))


def watch_arrivals(stream: DataFrame, path: str, checkpoint: str, once: bool = False,
                   every: str = "10 seconds") -> StreamingQuery:
    """Lands the arrived results ``(run_key, task_index, status)`` of each batch."""
    distinct = lambda rows: rows.select("run_key", "task_index", "status").distinct()
    return land(stream, path, checkpoint, distinct, once, every, merge=distinct)


def arrival_status(results: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """``complete``, ``waiting`` or ``timed out`` per run of ``(run_key, n_expected, deadline)``."""
    counts = gather(results, runs).join(runs.select("run_key", "deadline"), "run_key")
    state = (F.when(F.col("n_missing") == 0, "complete")
             .when(F.col("deadline") < F.lit(now).cast("timestamp"), "timed out").otherwise("waiting"))
    return counts.select("run_key", "n_expected", (F.col("n_expected") - F.col("n_missing")).alias("n_arrived"),
                         state.alias("state"))


# --- progression -------------------------------------------------------------------------------


def state_steps(events: DataFrame) -> DataFrame:
    """Changes of state of each job in time order; the first report is a change from NULL."""
    before = previous_row(events, ["job_id"], ["ts", "state"], ["state"])
    changed = ~F.col("prev_state").eqNullSafe(F.col("state"))
    return before.where(changed).select("job_id", F.col("prev_state").alias("from_state"),
                                        F.col("state").alias("to_state"), "ts")


def watch_steps(stream: DataFrame, path: str, checkpoint: str, once: bool = False,
                every: str = "10 seconds") -> StreamingQuery:
    """Lands the distinct reports of each batch; :func:`read_steps` puts them in order."""
    distinct = lambda rows: rows.select("job_id", "state", "ts").distinct()
    return land(stream, path, checkpoint, distinct, once, every, merge=distinct)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Streaming form of :func:`state_steps`: the same steps, whatever the order in which reports arrived."""
    return state_steps(landed(spark, path).distinct())
