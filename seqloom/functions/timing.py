"""Driver-side timers and counters that ride along with a job."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, functions as F


class Stopwatch:
    """Start, pause, resume and stop; every stop adds one sample in nanoseconds."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.samples: list[int] = []
        self._running: int | None = None
        self._held = 0

    def start(self) -> None:
        self._held, self._running = 0, time.perf_counter_ns()

    restart = start

    def pause(self) -> None:
        if self._running is not None:
            self._held += time.perf_counter_ns() - self._running
            self._running = None

    def resume(self) -> None:
        if self._running is None:
            self._running = time.perf_counter_ns()

    def stop(self) -> int:
        self.pause()
        self.samples.append(self._held)
        return self._held

    @property
    def total(self) -> int:
        return sum(self.samples)


def observed(df: DataFrame, amount: Column, name: str = "counter") -> tuple[DataFrame, Observation]:
    """The same rows, plus a counter over ``amount`` that is filled by the next action."""
    watch = Observation(name)
    seen = df.observe(
        watch,
        F.sum(amount).alias("total"),
        F.count(amount).alias("samples"),
        F.min(amount).alias("min"),
        F.max(amount).alias("max"),
        F.avg(amount).alias("mean"),
    )
    return seen, watch
