"""Job events as streams: states, progress and a bounded log for each job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import KEPT_LOG, parse_progress

EVENTS = "job long, seq long, ts timestamp, action string, line string, progress double"
FILES = "path string, modificationTime timestamp, length long, content binary"
OUTPUT = "job long, state string, progress double, log_id long, kept_log long, last_line string"
_ENDED = ("completed", "failed", "cancelled")


def step(state: str, action: str | None) -> str:
    """The same machine as operators.jobs.next_state, a step at a time."""
    if state in _ENDED or not action:
        return state
    if action == "cancel":
        return {"queued": "cancelled", "running": "cancelling"}.get(state, state)
    if state == "queued":
        return "running" if action == "start" else state
    if state == "cancelling":
        return "cancelled" if action in ("finish", "fail", "stop") else state
    return {"finish": "completed", "fail": "failed"}.get(action, state)


class JobProcessor(StatefulProcessor):
    """Keeps state, clamped progress and the last KEPT_LOG lines of a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "state string, progress double, log_id long")
        self.log = handle.getListState("log", "line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, progress, log_id = self.job.get() if self.job.exists() else ("queued", 0.0, 0)
        kept = [x[0] for x in self.log.get()] if self.log.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for r in batch.itertuples(index=False):
            state = step(state, r.action if isinstance(r.action, str) else None)
            if r.progress == r.progress:
                progress = round(max(0.0, min(float(r.progress), 100.0)), 2)
            if isinstance(r.line, str):
                log_id += 1
                kept.append(r.line)
        kept = kept[-KEPT_LOG:]
        self.job.update((state, progress, log_id))
        if kept:
            self.log.put([(x,) for x in kept])
        yield pd.DataFrame({"job": [key[0]], "state": [state], "progress": [progress], "log_id": [log_id], "kept_log": [len(kept)], "last_line": [kept[-1] if kept else None]})

    def close(self) -> None:
        pass


def states(events: DataFrame) -> DataFrame:
    """One row for each job of a micro-batch, with its state after it. Needs the RocksDB state store."""
    return events.groupBy("job").transformWithStateInPandas(statefulProcessor=JobProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Progress lines of a folder of text files."""
    return parse_progress(spark.readStream.text(path).withColumnRenamed("value", "line"))


def new_files(spark: SparkSession, path: str, within: str = "30 days") -> DataFrame:
    """Files that land in a folder, each content once ``within`` a time; contents that were seen longer ago aren't held, so the state is bounded.

    The time is that of reading, by which no file is late, whatever its own date.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    files = files.withColumn("sha256", F.sha2("content", 256)).withColumn("_seen", F.current_timestamp())
    return files.withWatermark("_seen", within).dropDuplicatesWithinWatermark(["sha256"]).drop("_seen")
