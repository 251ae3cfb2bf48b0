"""Counters of what an engine has planned and run, and a monitor that tells them while it runs."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import SparkSession


class Counters:
    """Counts by name, from any thread: queries, scans, counted_scans, joins, by_key, null_results, milliseconds."""

    def __init__(self) -> None:
        self._lock, self._counts = threading.Lock(), Counter()

    def add(self, **counts: int) -> None:
        with self._lock:
            self._counts.update(counts)

    def taken(self) -> dict[str, int]:
        with self._lock:
            return dict(self._counts)


def running(spark: SparkSession) -> dict[str, int]:
    """Jobs, stages and tasks that run now; tasks that have ended of these stages."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    return {"jobs": len(tracker.getActiveJobsIds()), "stages": len(stages), "tasks": sum(s.numActiveTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}


class Monitor:
    """with Monitor(engine): every so many seconds a line of counters and of what runs, as long as something does."""

    def __init__(self, engine, every: float = 1.0, tell: Callable[[str], None] = print):
        self.engine, self.every, self.tell = engine, every, tell
        self._over, self._thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        began = time.monotonic()
        while not self._over.wait(self.every):
            if (now := running(self.engine.spark))["jobs"]:
                told = self.engine.counters.taken() | now
                self.tell(f"{time.monotonic() - began:.0f} s: " + ", ".join(f"{k} {v}" for k, v in told.items()))

    def __enter__(self) -> Monitor:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
