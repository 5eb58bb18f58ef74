"""What the phases of a run cost, by Spark's own counts.

A wall clock around a lazy plan measures nothing.  A phase gives the jobs that
are started in it a job group of their own; when it ends, the time that their
tasks ran and the rows and bytes that they read, wrote and shuffled are added
up.  Without a collector a phase does nothing."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Cost:
    """Sums over the runs of a phase, without those of phases within it."""

    runs: int = 0
    seconds: float = 0.0
    jobs: int = 0
    task_seconds: float = 0.0
    rows_read: int = 0
    rows_written: int = 0
    shuffle_bytes: int = 0

    def add(self, other: Cost) -> None:
        for f in fields(Cost):
            setattr(self, f.name, getattr(self, f.name) + getattr(other, f.name))


class Phases:
    """Collects costs by name while it is active."""

    def __init__(self) -> None:
        self.costs: dict[str, Cost] = {}

    @contextmanager
    def active(self) -> Iterator[Phases]:
        token = _collector.set(self)
        try:
            yield self
        finally:
            _collector.reset(token)

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, runs, seconds, mean_seconds, jobs, task_seconds, mean_task_seconds, rows_read, rows_written, shuffle_bytes)."""
        rows = [(name, c.runs, c.seconds, c.seconds / c.runs, c.jobs, c.task_seconds, c.task_seconds / c.runs, c.rows_read, c.rows_written, c.shuffle_bytes) for name, c in self.costs.items()]
        return spark.createDataFrame(rows, "stage string, runs int, seconds double, mean_seconds double, jobs int, task_seconds double, mean_task_seconds double, rows_read long, rows_written long, shuffle_bytes long")


_collector: ContextVar[Phases | None] = ContextVar("phases", default=None)
GROUP = "spark.jobGroup.id"


def _cost_of(spark: SparkSession, group: str) -> Cost:
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()  # counts arrive after the jobs end
    tracker, store, cost, seen = context.statusTracker(), context._jsc.sc().statusStore(), Cost(), set()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        cost.jobs += 1
        for stage in info.stageIds if info else ():
            if stage in seen or tracker.getStageInfo(stage) is None:
                continue
            seen.add(stage)
            data = store.lastStageAttempt(stage)
            if data.status().toString() == "SKIPPED":
                continue
            cost.add(Cost(0, 0.0, 0, data.executorRunTime() / 1000, data.inputRecords(), data.outputRecords(), data.shuffleWriteBytes()))
    return cost


@contextmanager
def phase(spark: SparkSession, name: str) -> Iterator[None]:
    """The jobs started within are name's; those of a phase inside are that one's alone."""
    collector = _collector.get()
    if collector is None:
        yield
        return
    context = spark.sparkContext
    before, group, began = context.getLocalProperty(GROUP), f"{name}-{uuid.uuid4().hex}", time.perf_counter()
    context.setLocalProperty(GROUP, group)
    try:
        yield
    finally:
        context.setLocalProperty(GROUP, before)
        cost = _cost_of(spark, group)
        cost.runs, cost.seconds = 1, time.perf_counter() - began
        collector.costs.setdefault(name, Cost()).add(cost)
