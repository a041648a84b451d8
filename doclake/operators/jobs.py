"""Job events: logs, progress and states, as batch tables. Events have job, seq, ts, level, line, state, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import clamp
from ..functions.text import log_level, strip

KEPT_LOG = 400
PROGRESS_LINE = r"\[([0-9]+)/([0-9]+)\] +(.*?) +-> +(.+)"


def parse_progress(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines like "[3/9] suite -> file" with their parts; others are left out."""
    part = lambda k: F.regexp_extract(line, PROGRESS_LINE, k)
    index = part(1).cast("long")
    found = lines.where(F.col(line).rlike(PROGRESS_LINE))
    return found.withColumns({"index": index, "total": part(2).cast("long"), "suite": strip(part(3)), "file": strip(part(4)), "completed": F.greatest(F.lit(0), index - 1), "level": log_level(F.col(line))})


def log(events: DataFrame, keep: int = KEPT_LOG) -> DataFrame:
    """The last ``keep`` entries of each job, numbered from its first."""
    order = Window.partitionBy("job").orderBy("ts", "seq")
    back = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("seq"))
    rows = events.withColumn("log_id", F.row_number().over(order).cast("long")).withColumn("_back", F.row_number().over(back))
    return rows.where(F.col("_back") <= keep).drop("_back")


def latest(events: DataFrame) -> DataFrame:
    """Each job's last state and progress: one aggregation, no sort."""
    at = F.struct("ts", "seq")
    return events.groupBy("job").agg(F.max_by("state", at).alias("state"), clamp(F.max_by("progress", at)).alias("progress"), F.count("*").alias("events"))


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs (job, state, total, completed) with the share done; a completed job has done all."""
    total = F.coalesce("total", F.lit(0))
    done = F.when((F.col("state") == "completed") & (total > 0), total).otherwise(F.coalesce("completed", F.lit(0)))
    return jobs.select("job", "state", total.alias("total"), done.alias("completed"), F.when(total > 0, F.round(done * 100 / total, 2)).otherwise(0.0).alias("progress_pct"))


def next_state(state: Column, action: Column) -> Column:
    """State machine of a job: queued, running, then completed, failed or, by way of cancelling, cancelled."""
    ended = state.isin("completed", "failed", "cancelled")
    return (
        F.when(ended, state)
        .when((action == "cancel") & (state == "queued"), "cancelled")
        .when((action == "cancel") & (state == "running"), "cancelling")
        .when((action == "start") & (state == "queued"), "running")
        .when((state == "cancelling") & action.isin("finish", "fail", "stop"), "cancelled")
        .when((action == "finish") & (state == "running"), "completed")
        .when((action == "fail") & (state == "running"), "failed")
        .otherwise(state)
    )
