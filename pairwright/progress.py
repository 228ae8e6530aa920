"""Progress of running jobs on standard error."""

from __future__ import annotations

import sys
import threading
from typing import TextIO

from pyspark.sql import SparkSession


class Progress:
    """While it is open, how many tasks of the active stages have ended, a few times a second."""

    def __init__(self, spark: SparkSession, shown: bool = True, out: TextIO | None = None, each: float = 0.3):
        self.tracker, self.shown, self.out, self.each = spark.sparkContext.statusTracker(), shown, out or sys.stderr, each
        self.ended = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def line(self) -> str:
        """Empty if nothing runs."""
        stages = [s for i in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(i))]
        done, every = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
        return f"{done} of {every} tasks, {len(stages)} stages" if stages else ""

    def _run(self) -> None:
        wide = 0
        while not self.ended.wait(self.each):
            text = self.line()
            self.out.write("\r" + text.ljust(wide))
            self.out.flush()
            wide = len(text)
        self.out.write("\r" + " " * wide + "\r")
        self.out.flush()

    def __enter__(self) -> Progress:
        if self.shown:
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        if self.shown:
            self.thread.join()
