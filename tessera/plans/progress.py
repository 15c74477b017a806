"""Live progress of a run: its phase, Spark's tasks and the counters so far."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds between two looks.
EVERY = 0.12


class Progress:
    """Calls ``tell`` with a dict every EVERY seconds while it is entered: phase,
    seconds, tasks_done and tasks of the stages at work, and what ``count`` was
    given. Only Spark's status tracker is asked, so a run is not slowed down.
    Errors of ``tell`` end the reports, never the run."""

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None] | None):
        self.tracker, self.tell = spark.sparkContext.statusTracker(), tell
        self.state: dict = {"phase": "start"}
        self.began = time.time()
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True) if tell else None

    def __enter__(self) -> Progress:
        if self.thread:
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        if self.thread:
            self.thread.join()

    def phase(self, name: str) -> None:
        self.state["phase"] = name

    def count(self, **counters) -> None:
        self.state |= counters

    def look(self) -> dict:
        stages = [s for k in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(k))]
        return {**self.state, "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages), "seconds": time.time() - self.began}

    def _run(self) -> None:
        try:
            while not self.over.wait(EVERY):
                self.tell(self.look())
            self.tell(self.look())
        except Exception:  # noqa: BLE001  a report that fails is no reason to stop
            self.over.set()
