"""Live progress of a run, from Spark's own count of finished tasks."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from roadgrid import config as C


def tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """Finished and known tasks of the jobs of a group. Stages that a finished job has skipped don't count."""
    tracker, running, stages = spark.sparkContext.statusTracker(), set(), set()
    for j in tracker.getJobIdsForGroup(group):
        if (job := tracker.getJobInfo(j)) is not None:
            (running if job.status == "RUNNING" else stages).update(job.stageIds)
    done = total = 0
    for s in stages | running:
        info = tracker.getStageInfo(s)
        if info is not None and (info.numCompletedTasks or s in running):
            done, total = done + info.numCompletedTasks, total + info.numTasks
    return done, total


def line(done: int, total: int, elapsed: float) -> str:
    """A bar, the tasks and the seconds left, as scaling.progress_bar() and eta() have them in columns."""
    full = C.BAR_CELLS * done // total if total else 0
    left = f"{elapsed / done * (total - done):.0f}s" if 0 < done < total else "-" if done < total else "0s"
    return f"{'█' * full}{'░' * (C.BAR_CELLS - full)} {done}/{total} ETA {left}"


class Progress:
    """with Progress(spark): what runs in it reports (done, total, elapsed) every so often, and at its end.

    The jobs belong to the calling thread's job group while it lasts. What is
    known of a run grows as its stages begin, and so may the total.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[int, int, float], None] | None = None, every: float = 0.5):
        self.spark, self.every = spark, every
        self.group, self.over = f"progress-{uuid.uuid4().hex}", threading.Event()
        self.tell = tell or (lambda *now: print(f"\r{line(*now)}", end="", file=sys.stderr, flush=True))

    def _now(self) -> None:
        self.tell(*tasks(self.spark, self.group), time.perf_counter() - self.begin)

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            self._now()

    def __enter__(self) -> Progress:
        self.begin = time.perf_counter()
        self.before = self.spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        self.spark.sparkContext.setJobGroup(self.group, "progress")
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self.before)
        self._now()
