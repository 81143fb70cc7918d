"""Landing micro-batches so that no row is lost, and keeping the landed folder small while the stream goes on.

Files reach a stream in the order they were written, not in the order of event time. A watermark would therefore drop
rows, and how many would depend on the batches. So every batch lands its rows, or partial sums that can be merged, and
readers merge what has landed. Below the landing folder lie

* ``batches/<stream>/<number>``: what a batch landed. The stream's id comes from its checkpoint, so a stream that is begun
  anew lands beside what an earlier one left; a batch that is run again replaces its own folder and nothing else;
* ``runs/<name>``: what :func:`compact` has merged. Runs of a tier are merged into the next one when there are ``fan`` of
  them, so a row is rewritten once per tier and a reader opens few folders, however long the stream has run;
* ``manifests/<generation>.json``: the runs that are live, the last batch of each stream that is in them, and the folders
  that are no longer needed, each with the time since when.

Only a compaction writes a manifest, by creating a file that must not exist yet: of two compactions that began from the
same manifest one gives up. Live are the runs of the newest readable manifest and all finished batches beyond those in it, so
a batch counts exactly once whenever it lands, also when it is run again after it was merged. Folders are removed
``grace_seconds`` after they were replaced, for readers that began before. The rules hold on file systems whose exclusive
creation is atomic (HDFS, local disks); on an object store run one compaction at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

POLL = "5 seconds"
COMPACT_EVERY = 100
FAN = 8
GRACE_SECONDS = 3600
ORPHAN_SECONDS = 7 * 86_400  # a run that no manifest names after so long was left by a compaction that died
MANIFESTS_KEPT = 10

Merge = Callable[[DataFrame], DataFrame]


@dataclass
class Manifest:
    generation: int = 0
    runs: dict[str, int] = field(default_factory=dict)  # folder name: tier
    upto: dict[str, int] = field(default_factory=dict)  # stream: last batch in a run
    retired: dict[str, float] = field(default_factory=dict)  # folder: since when


class Folder:
    """The few file operations needed, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._hadoop = path.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def find(self, pattern: str) -> dict[str, float]:
        """Names below the folder that match, with the time of their last change."""
        depth = pattern.count("/") + 1
        found = self._fs.globStatus(self._at(pattern)) or []
        return {"/".join(s.getPath().toString().split("/")[-depth:]): s.getModificationTime() / 1000 for s in found}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; false if there is one of that name."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def newest(folder: Folder) -> tuple[Manifest, int]:
    """The newest readable manifest and the highest number in use; a half-written file is passed over."""
    names = sorted(folder.find("manifests/*.json"), reverse=True)
    number = lambda name: int(name.split("/")[-1].removesuffix(".json"))
    for name in names:
        try:
            return Manifest(**json.loads(folder.read(name))), number(names[0])
        except (ValueError, TypeError, Py4JJavaError):
            continue
    return Manifest(), number(names[0]) if names else 0


def batch_folder(stream: str, number: int) -> str:
    return f"batches/{stream}/{number:012d}"


def finished_batches(folder: Folder) -> list[tuple[str, int]]:
    """Stream and number of every batch whose write has ended."""
    return sorted((stream, int(number)) for stream, number in (
        name.split("/")[-3:-1] for name in folder.find("batches/*/*/_SUCCESS")))


def live_folders(folder: Folder) -> list[str]:
    """What a reader has to read: the manifest first, so that a batch that is merged meanwhile is seen once."""
    manifest, _ = newest(folder)
    beyond = [batch_folder(s, n) for s, n in finished_batches(folder) if n > manifest.upto.get(s, -1)]
    return [*(f"runs/{name}" for name in manifest.runs), *beyond]


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was begun."""
    return json.loads(Folder(spark, checkpoint).read("metadata"))["id"]


def land(stream: DataFrame, path: str, checkpoint: str, shrink: Merge | None = None, once: bool = False,
         every: str = POLL, merge: Merge | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Lands each batch, made smaller by ``shrink``, every few seconds or until all present input is read.

    With ``merge`` the stream itself compacts after every ``compact_every`` batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = batch_folder(stream_id(spark, checkpoint), number)
        (shrink(batch) if shrink else batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{target}")
        if merge and (number + 1) % compact_every == 0:
            compact(spark, path, merge)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All rows that have landed below ``path``."""
    folder = Folder(spark, path)
    names = live_folders(folder)
    if not names:
        raise FileNotFoundError(f"nothing has landed below {path}")
    return spark.read.parquet(*[f"{folder.path}/{name}" for name in names])


def compact(spark: SparkSession, path: str, merge: Merge, fan: int = FAN, grace_seconds: float = GRACE_SECONDS) -> bool:
    """Merges the batches beyond the manifest into a run, and runs of a full tier into one of the next.

    Returns false if there was nothing to do or another compaction was quicker. ``merge`` must give the same rows in whatever
    steps it is applied.
    """
    folder, now = Folder(spark, path), time.time()
    manifest, number = newest(folder)
    batches = finished_batches(folder)
    beyond = [(s, n) for s, n in batches if n > manifest.upto.get(s, -1)]
    runs, upto = dict(manifest.runs), manifest.upto | {s: n for s, n in beyond}
    retired = dict(manifest.retired)

    def merged(names: list[str], tier: int) -> None:
        name = uuid.uuid4().hex
        merge(spark.read.parquet(*[f"{folder.path}/{n}" for n in names])).write.parquet(f"{folder.path}/runs/{name}")
        runs[name] = tier
        retired.update(dict.fromkeys(names, now))

    if beyond:
        merged([batch_folder(s, n) for s, n in beyond], 0)
    tier = 0
    while tier <= max(runs.values(), default=-1):
        full = [name for name, t in runs.items() if t == tier]
        if len(full) >= fan:
            for name in full:
                del runs[name]
            merged([f"runs/{name}" for name in full], tier + 1)
        tier += 1
    # A batch that was run again after it had been merged.
    retired |= {f: now for f in (batch_folder(s, n) for s, n in batches if n <= manifest.upto.get(s, -1)) if f not in retired}

    gone = [name for name, since in retired.items() if since <= now - grace_seconds]
    # These have not been live since the manifest that retired them, so they may go before the next one is written.
    gone = [name for name in gone if name in manifest.retired]
    named = {f"runs/{name}" for name in (*runs, *manifest.runs)} | set(retired)
    orphans = [name for name, changed in folder.find("runs/*").items() if name not in named and changed < now - ORPHAN_SECONDS]
    for name in (*gone, *orphans):
        folder.remove(name)
    if not beyond and runs == manifest.runs and not gone and retired == manifest.retired:
        return False
    following = Manifest(number + 1, runs, upto, {n: t for n, t in retired.items() if n not in gone})
    won = folder.create(f"manifests/{following.generation:012d}.json", json.dumps(vars(following)))
    for name in sorted(folder.find("manifests/*.json"))[:-MANIFESTS_KEPT]:
        folder.remove(name)
    return won
