"""Figures of a run: result rows, seconds, throughput; and what a stage moved, from Spark's own counters."""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Run:
    rows: int
    seconds: float
    #: Bytes and rows that exchanges wrote.
    shuffled_bytes: int = 0
    shuffled_rows: int = 0

    @property
    def million_rows_a_second(self) -> float:
        return self.rows / 1e6 / self.seconds if self.seconds else 0.0


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and an observation that has ``rows`` once an action on it has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def timed(df: DataFrame) -> Run:
    """Runs df to its last row, keeping none; what its exchanges moved is from Spark's own stage counters."""
    sc = df.sparkSession.sparkContext
    group, watched = uuid.uuid4().hex, observed(df)
    sc.setJobGroup(group, "timed")
    try:
        began = time.monotonic()
        watched[0].write.format("noop").mode("overwrite").save()
        took = time.monotonic() - began
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    jvm = sc._jsc.sc()
    jvm.listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), jvm.statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    moved = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s)]
    run = Run(watched[1].get["rows"], took, sum(x.shuffleWriteBytes() for x in moved), sum(x.shuffleWriteRecords() for x in moved))
    log.info("%d rows in %.3f s, %.3f million a second; exchanges wrote %d bytes, %d rows", run.rows, took, run.million_rows_a_second, run.shuffled_bytes, run.shuffled_rows)
    return run


def key_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, cnt), largest first for a report."""
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), *keys)
