"""Control of a run: hold it between stages, end it, and see how far it is."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")
#: Shares of a run's time by stage, about; what isn't listed counts as 1.
WEIGHTS = {"sieve": 3, "regions": 5, "vertices": 1, "dense": 3, "arcs": 3, "smooth": 5, "rebuild": 3}


class Cancelled(RuntimeError):
    """A run was ended by its job; finished stages in a work folder are found again."""


class Job:
    """Goes to an entry point as ``job``; ``pause``, ``resume`` and ``cancel`` may be called from any thread.

    A pause takes effect before the next stage; a cancellation also ends the Spark jobs of the running one.
    """

    def __init__(self, spark: SparkSession, name: str = "seamcover", said: Callable[[str], None] | None = None):
        self.spark, self.name, self.said = spark, name, said or (lambda line: None)
        self.open, self.cancelled, self.done = threading.Event(), False, {}
        self.open.set()

    def pause(self) -> None:
        self.open.clear()

    def resume(self) -> None:
        self.open.set()

    def toggle(self) -> None:
        self.resume() if not self.open.is_set() else self.pause()

    def cancel(self) -> None:
        self.cancelled = True
        self.open.set()
        self.spark.sparkContext.cancelJobGroup(self.name)

    def stage(self, name: str, run: Callable[[], R]) -> R:
        """What ``run`` gives, once the job is neither held nor ended."""
        self.open.wait()
        if self.cancelled:
            raise Cancelled(self.name)
        self.spark.sparkContext.setJobGroup(self.name, name, interruptOnCancel=True)
        began = time.monotonic()
        try:
            out = run()
        except Exception as error:
            if self.cancelled:
                raise Cancelled(self.name) from error
            raise
        self.done[name] = time.monotonic() - began
        self.said(f"{name}: {self.done[name]:.1f} s")
        return out

    def eta(self, stages: tuple[str, ...]) -> float | None:
        """Seconds left for the stages of a run that aren't done, at the rate of those that are; none before the first."""
        rate = sum(self.done.values()) / weight if (weight := sum(WEIGHTS.get(s, 1) for s in self.done)) else None
        return None if rate is None else rate * sum(WEIGHTS.get(s, 1) for s in stages if s not in self.done)
