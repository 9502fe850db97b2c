"""Progress of long runs: steps with times in a log, and Spark jobs grouped by step."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("marketloom")


class Progress:
    """Named steps of a run; each sets the job group that Spark's pages show, and its time goes to the log and an optional file."""

    def __init__(self, spark: SparkSession, name: str, steps: int | None = None, path: str | Path | None = None, quiet: bool = False) -> None:
        self.spark, self.name, self.steps, self.path, self.quiet = spark, name, steps, Path(path) if path else None, quiet
        self.done: list[tuple[str, float]] = []

    def say(self, text: str) -> None:
        if not self.quiet:
            LOG.info(text)
        if self.path:
            with self.path.open("a", encoding="utf-8") as out:
                out.write(f"{time.strftime('%H:%M:%S')} {text}\n")

    def left(self) -> float | None:
        """Seconds left, if the remaining steps take the mean time of the finished ones."""
        if not self.steps or not self.done:
            return None
        return max(0, self.steps - len(self.done)) * sum(t for _, t in self.done) / len(self.done)

    @contextmanager
    def step(self, what: str) -> Iterator[None]:
        self.spark.sparkContext.setJobGroup(self.name, what)
        start = time.monotonic()
        try:
            yield
        except Exception:
            self.say(f"{self.name}: {what} failed after {time.monotonic() - start:.1f} s")
            raise
        else:
            self.done.append((what, time.monotonic() - start))
            left = self.left()
            self.say(f"{self.name}: {what} in {self.done[-1][1]:.1f} s" + ("" if left is None else f", about {left:.0f} s left"))
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
