"""Resuming as a stream: new rows are answered as they arrive, each key once, also after a stop in the middle of a batch.

``answer_stream`` works on any sink of JSON lines and looks keys up in it. ``Run`` owns its sink: the keys that were answered are
in the stream's state, so a batch costs what its own rows cost, however long the run has been.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.records import append_missing, exists, todo
from ..sources.versions import Versions


def answer_stream(
    wanted: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, key: str, schema: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append ``answer(rows)`` of the streamed rows whose key the sink of JSON lines at ``path`` does not hold.

    Only those are given to ``answer``, which may be dear. Of rows with the same key in a batch one is answered; rows
    without a key are left out. A batch that is run again after a stop finds what it has written, so no key is answered
    twice. ``checkpoint`` must lie in storage that a new driver can reach. Without an ``interval`` the query ends when
    all that is there has been read.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = rows.where(rows[key].isNotNull()).dropDuplicates([key])
        done = _held(new.sparkSession, path, key, schema)
        append_missing(answer(new if done is None else todo(new, done, key)), path, key, schema)

    writer = wanted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _held(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame | None:
    """Keys of the sink; a torn line has none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path).select(F.from_json("value", schema)[key].alias(key)).where(F.col(key).isNotNull())


def seconds_left(elapsed: float, produced: int, done: int, total: int) -> float | None:
    """Time that the rest will take at the rate of this run; rows that were there before do not count in its rate."""
    return elapsed / produced * (total - done) if produced else None


def progress(spark: SparkSession, path: str, key: str, schema: str, total: int, before: int, elapsed: float) -> tuple[int, float | None]:
    """Keys that the sink holds, and the seconds left if ``before`` of them were there when this run began.

    The sink is counted, not the stream's input rows: those count again whenever a batch is read again.
    """
    held = _held(spark, path, key, schema)
    done = held.distinct().count() if held is not None else 0
    return done, seconds_left(elapsed, done - before, done, total)


class Progress(StreamingQueryListener):
    """Keys answered and the time left, from what is observed as batches are written; the sink is not read.

    A batch counts when the stream reports that it has ended, so one that was stopped does not count twice.
    """

    def __init__(self, total: int, before: int = 0) -> None:
        self.total, self.before, self.produced, self.began = total, before, 0, time.monotonic()
        self.written: dict[int, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.produced += self.written.pop(event.progress.batchId, 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def state(self) -> tuple[int, float | None]:
        """Keys done, and seconds left at the rate of this run."""
        done = self.before + self.produced
        return done, seconds_left(time.monotonic() - self.began, self.produced, done, self.total)


@dataclass(frozen=True)
class Run:
    """One generation of answers, all under the same token cap, in a folder of its own with the state of its stream."""

    spark: SparkSession
    root: str
    key: str
    schema: str
    info: dict = field(default_factory=dict)

    @property
    def cap(self) -> int | None:
        return self.info["cap"]

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.info['folder']}"

    def stream(self, wanted: DataFrame, answer: Callable[[DataFrame], DataFrame], interval: str | None = None, progress: Progress | None = None) -> StreamingQuery:
        """Answer the streamed rows whose key has not been answered in this generation; rows without a key are left out.

        The stream's state holds the keys. Each batch writes a folder of its own: a batch that is run again after a stop
        has the same rows and writes the same folder, so a key has one answer and the sink is never read. ``progress`` must
        be among the session's listeners.
        """
        new = wanted.where(wanted[self.key].isNotNull())
        if self.info["seeded"]:
            new = new.join(self._read("seed").select(self.key), self.key, "left_anti")
        new = new.dropDuplicates([self.key])

        def batch(rows: DataFrame, number: int) -> None:
            seen = Observation()
            answered = answer(rows).withColumn("max_tokens", F.lit(self.cap).cast("long")).observe(seen, F.count(F.lit(1)).alias("n"))
            answered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{self.folder}/answers/{number:08d}")
            if progress is not None:
                progress.written[number] = seen.get["n"]

        writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/state")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def _read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, max_tokens long").option("mode", "FAILFAST").option("recursiveFileLookup", True)
        return rows.json(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """All answers of this generation, one for each key."""
        found = [self._read(name) for name in ("seed", "answers") if exists(self.spark, f"{self.folder}/{name}")]
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, max_tokens long")
        return found[0].unionByName(found[1]) if len(found) > 1 else found[0]

    def finish(self, wanted: DataFrame) -> str | None:
        """Once every key of ``wanted (key, pos)`` has its answer: the folder of JSON lines of these, in their order.

        The order of a run that was stopped says when it was stopped; the finished file does not. None while keys are missing.
        """
        rows = self.rows()
        if not wanted.join(rows.select(self.key), self.key, "left_anti").isEmpty():
            return None
        path = f"{self.folder}/finished"
        ordered = rows.join(wanted.select(self.key, "pos"), self.key).repartitionByRange("pos").sortWithinPartitions("pos")
        ordered.drop("pos").write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return path


def resume_run(spark: SparkSession, root: str, key: str, schema: str, cap: int | None, fresh: bool = False, completed: DataFrame | None = None) -> Run:
    """The run to go on with: the last one if it was under this cap, else, or with ``fresh``, a new one.

    Answers under another cap do not count as done, as one file must not average two. They are kept: the folder of the run
    that is superseded stays, and the commit of the new one names it and its cap. ``completed`` are usable rows of an older
    sink under this cap (``load_completed``), which a new run takes over unless it is ``fresh``.
    """
    versions = Versions(spark, root)
    current = versions.current()
    if current is not None and current["cap"] == cap and not fresh:
        return Run(spark, root, key, schema, current)
    folder, seeded = versions.staged(), completed is not None and not fresh
    if seeded:
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        taken = completed.where(F.col(key).isNotNull()).dropDuplicates([key]).select(*names, F.lit(cap).cast("long").alias("max_tokens"))
        taken.write.option("ignoreNullFields", False).json(f"{folder}/seed")
    superseded = None
    if current is not None and not Run(spark, root, key, schema, current).rows().isEmpty():
        superseded = {"folder": current["folder"], "suffix": ".uncapped" if current["cap"] is None else f".cap{current['cap']}"}
    info = versions.commit({"cap": cap, "folder": folder.rpartition("/")[2], "seeded": seeded, "superseded": superseded})
    return Run(spark, root, key, schema, info)
