"""Ends and time-outs of jobs and runs as rows of the stream itself.

Here state does live in the stream, one value per job or run, with a processing-time timer each: a row is given as soon as a
job ends or a run is complete, and when one has been waited for in vain. The readers in :mod:`fanfold.streaming.watch`
stay the exact way to look back; these streams tell of an event at once.

State is kept by Spark's RocksDB state store in the checkpoint folder, so it is not bounded by an executor's memory and
outlives the loss of one. It is dropped as soon as a job has ended or a run is settled, but for one short mark, which keeps
repeated and late reports from being told twice. Results do not depend on how reports are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fanfold.streaming.watch import TERMINAL

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
WORD = 64


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class _Processor(StatefulProcessor):
    """One value per key and one timer, which is set anew by deleting the one before."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def wait_until(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def stop_waiting(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


class JobEnds(_Processor):
    """Tells of a job's end, and of silence longer than ``patience_ms``."""

    schema = "done BOOLEAN"

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = None
        for batch in rows:
            last = batch[batch["state"].isin(TERMINAL)]
            if len(last):
                found = min(zip(last["ts"], last["state"]))
                ended = found if ended is None else min(ended, found)
        if self.value.exists() and self.value.get()[0]:
            return
        if ended is None:
            self.wait_until(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            return
        self.stop_waiting()
        self.value.update((True,))
        yield pd.DataFrame({"job_id": [key[0]], "event": [ended[1]], "ts": [ended[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Silence is no end: the job may still report, and its end is told then.
        yield pd.DataFrame({"job_id": [key[0]], "event": ["SILENT"], "ts": [_utc(expiredTimerInfo.getExpiryTimeInMs())]})


class RunEnds(_Processor):
    """Tells when all results of a run are there, or that they were not in time.

    Arrived numbers are kept as words of 64 bits, so a run of n tasks takes n / 64 whole numbers.
    """

    schema = "settled STRING, words ARRAY<BIGINT>"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, words = self.value.get() if self.value.exists() else (None, [])
        words, expected, deadline = list(words), None, None
        for batch in rows:
            expected, deadline = int(batch["n_expected"].iloc[0]), batch["deadline"].iloc[0]
            words += [0] * (-(-expected // WORD) - len(words))
            for index in batch["task_index"]:
                if 0 <= index < expected:
                    words[int(index) // WORD] |= 1 << (int(index) % WORD)
        if settled == "complete" or expected is None:
            return
        arrived = sum(w.bit_count() for w in map(_unsigned, words))
        if arrived >= expected:
            self.stop_waiting()
            self.value.update(("complete", []))
            yield pd.DataFrame({"run_key": [key[0]], "event": ["complete"], "n_arrived": [arrived]})
            return
        self.value.update((settled or "waiting", [_signed(w) for w in words]))
        if settled is None:
            due = int(deadline.tz_localize("UTC").timestamp() * 1000) if deadline.tzinfo is None else int(deadline.timestamp() * 1000)
            self.wait_until(max(due, timerValues.getCurrentProcessingTimeInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, words = self.value.get()
        # Late results may still complete the run; that is told as well.
        self.value.update(("timed out", words))
        arrived = sum(_unsigned(w).bit_count() for w in words)
        yield pd.DataFrame({"run_key": [key[0]], "event": ["timed out"], "n_arrived": [arrived]})


def _unsigned(word: int) -> int:
    return word & (1 << WORD) - 1


def _signed(word: int) -> int:
    word = _unsigned(word)
    return word - (1 << WORD) if word >> (WORD - 1) else word


def _with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark = stream.sparkSession
    if spark.conf.get(STATE_STORE_CONF) != STATE_STORE:
        raise ValueError(f"set {STATE_STORE_CONF} to {STATE_STORE}: timers need it")
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def job_ends(stream: DataFrame, patience_seconds: float) -> DataFrame:
    """A row ``(job_id, event, ts)`` when a job of ``(job_id, state, ts)`` ends, once per job, and one with event ``SILENT``
    whenever a job has sent nothing for ``patience_seconds``."""
    return _with_state(stream.select("job_id", "state", "ts"), "job_id", JobEnds(int(patience_seconds * 1000)),
                       "job_id STRING, event STRING, ts TIMESTAMP")


def run_ends(stream: DataFrame, runs: DataFrame) -> DataFrame:
    """A row ``(run_key, event, n_arrived)`` when all results of a run have arrived, once per run, and one with event
    ``timed out`` if they have not by the run's deadline.

    ``stream`` holds arrived results ``(run_key, task_index)``, ``runs`` is ``(run_key, n_expected, deadline)``. A run is known from
    its first result on; runs without any are found by :func:`fanfold.streaming.watch.arrival_status`.
    """
    known = stream.select("run_key", "task_index").join(runs.select("run_key", "n_expected", "deadline"), "run_key")
    key = runs.schema["run_key"].dataType.simpleString()
    return _with_state(known, "run_key", RunEnds(), f"run_key {key}, event STRING, n_arrived BIGINT")
