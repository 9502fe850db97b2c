"""Run policy (embargo, purge, horizons) and the generic future-perturbation check."""

from __future__ import annotations

import random
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical time columns, and the causal order of events (fixed names).
EVENT_TIME, INGEST_TIME, SEQUENCE, AVAILABILITY = "event_ts", "ingest_ts", "sequence", "availability_ts"
CAUSAL_ORDER = (EVENT_TIME, SEQUENCE)


def in_nanoseconds(last: float) -> bool:
    """Whether a largest time is in nanoseconds since 1970 (from 1970-01-02 on)."""
    return last >= 1e14


def seeded(seed: int) -> np.random.Generator:
    """Seeds Python's and numpy's shared generators and gives one of its own; Spark columns take the seed as rand(seed)."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)


SECTION = ("split_strategy", "embargo_ns", "horizon", "interval_ns", "profile_interval_ns")


@dataclass(frozen=True)
class TemporalPolicy:
    embargo_ns: int = 1_000_000_000
    window: int = 5
    stride: int = 1
    horizon: int = 1

    @classmethod
    def read(cls, path: str | Path, **changes: int) -> TemporalPolicy:
        """From the [temporal] table of a TOML file, with changes; unknown keys raise, an absent file gives defaults."""
        table = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("temporal", {}) if Path(path).is_file() else {}
        if unknown := sorted(set(table) - set(SECTION)):
            raise ValueError(f"unknown [temporal] keys: {unknown}")
        return cls(**({k: int(table[k]) for k in ("embargo_ns", "horizon") if k in table} | changes))

    def purge(self) -> int:
        """Training rows to leave out before a test block: window overlap or label horizon, whichever is more."""
        overlap = -(-(self.window - 1) // self.stride) if self.window > 1 else 0
        return max(overlap, self.horizon, 0)

    def embargo(self, interval_ns: int) -> int:
        """At least the window's span and one bucket."""
        if interval_ns < 1:
            raise ValueError(f"interval_ns must be at least 1, not {interval_ns}")
        return max(self.embargo_ns, (self.window - 1) * self.stride * interval_ns + interval_ns)


def grid_context(intervals: list[int], default_ns: int) -> tuple[int, bool]:
    """Longest interval of a grid, and whether the grid mixes intervals."""
    own = [i for i in intervals if i > 0]
    return (max(own), min(own) != max(own)) if own else (default_ns, False)


def aligned_horizon(horizon: int, research_ns: int, context_ns: int) -> int:
    """A horizon of one bar covers the context interval."""
    return max(1, context_ns // research_ns) if horizon == 1 and context_ns > research_ns else horizon


@dataclass(frozen=True)
class LeakageReport:
    cuts: tuple[int, ...]
    leaking: tuple[int, ...]

    @property
    def clean(self) -> bool:
        return not self.leaking

    def check(self) -> None:
        if self.leaking:
            raise AssertionError(f"results before {list(self.leaking)} change with the future")


def shift_future(df: DataFrame, ts: str, cut: int) -> DataFrame:
    """Prices and sizes after the cut moved, deterministically."""
    after = F.col(ts) >= cut
    moves = {c: F.when(after, F.col(c) + step).otherwise(F.col(c)) for c, step in (("price", 750_000_000), ("size", 3), ("value", 1.5)) if c in df.columns}
    return df.withColumns(moves)


def detect_leakage(compute: Callable[[DataFrame], DataFrame], df: DataFrame, cuts: list[int], ts: str = "event_ts", known: str = "availability_ts", perturb: Callable[[DataFrame, str, int], DataFrame] = shift_future) -> LeakageReport:
    """Runs compute on df and on df with its future after each cut changed; what was known before the cut must be equal."""
    bad = []
    for cut in cuts:
        a, b = (compute(x).where(F.col(known) < cut) for x in (df, perturb(df, ts, cut)))
        if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
            bad.append(cut)
    return LeakageReport(tuple(cuts), tuple(bad))
