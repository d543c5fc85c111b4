"""Progress while a job runs: counts from tasks and from Spark's own job status, told by a thread of the driver.

``Counter`` is an accumulator for tasks that run Python anyway; ``watched`` reads it while the job runs and tells each ``step`` it passes.
``Records`` needs no Python in tasks: it sums the records that the stages of its jobs have read, as Spark reports them. What is told is a status: a
task that runs twice may be counted twice.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

Tell = Callable[[int, "int | None"], None]
#: Seconds between two looks at a running job.
PAUSE = 0.2


class Counter:
    """A sum over all tasks; tasks call ``add``, the driver reads ``value``."""

    def __init__(self, spark: SparkSession):
        self._sum = spark.sparkContext.accumulator(0)

    def add(self, n: int) -> None:
        self._sum.add(n)

    @property
    def value(self) -> int:
        return self._sum.value


class Records:
    """Records read so far by the jobs that this thread has started since ``begin``."""

    def __init__(self, spark: SparkSession):
        self._spark, self._group = spark, f"strandloom-{uuid.uuid4().hex}"

    def begin(self) -> None:
        self._spark.sparkContext.setJobGroup(self._group, "strandloom")

    def end(self) -> None:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            self._spark.sparkContext.setLocalProperty(key, None)

    @property
    def value(self) -> int:
        sc, total = self._spark.sparkContext, 0
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(self._group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        for s in stages:
            try:
                total += store.lastStageAttempt(s).inputRecords()
            except Exception:  # the store has dropped an old stage, or not met it yet
                continue
        return total


@contextmanager
def watched(count: Counter | Records, step: int, tell: Tell, total: int | None = None) -> Iterator[None]:
    """Tells ``tell(n, total)`` for each multiple n of ``step`` that the count passes while the body runs, and those left at its end."""
    told, stop = 0, threading.Event()

    def look() -> None:
        nonlocal told
        now = count.value // step
        while told < now:
            told += 1
            tell(told * step, total)

    def run() -> None:
        while not stop.wait(PAUSE):
            look()

    if isinstance(count, Records):
        count.begin()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        if isinstance(count, Records):
            count.end()
        look()
