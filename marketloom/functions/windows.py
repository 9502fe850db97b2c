"""Causal window expressions: past-only means, medians and quantiles, run ids, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def past(window: WindowSpec, size: int, end: int = -1) -> WindowSpec:
    """The `size` rows that end `-end` rows before the current one."""
    return window.rowsBetween(end - size + 1, end)


def gated(value: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """value where the frame has at least `least` non-null entries of `counted`."""
    return F.when(F.count(counted).over(frame) >= least, value)


def past_mean(column: str | Column, window: WindowSpec, size: int, least: int | None = None, end: int = -1) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    frame = past(window, size, end)
    return gated(F.avg(c).over(frame), c, frame, size if least is None else least)


def _sorted_frame(c: Column, frame: WindowSpec) -> Column:
    return F.array_sort(F.collect_list(c).over(frame))


def past_median(column: str, window: WindowSpec, size: int, least: int = 1, end: int = -1) -> Column:
    """Exact median of a bounded frame."""
    frame = past(window, size, end)
    values = _sorted_frame(F.col(column).cast("double"), frame)
    n = F.size(values)
    half = F.call_function("div", n, F.lit(2)).cast("int")
    middle = F.when(n % 2 == 1, F.get(values, half)).otherwise((F.get(values, half - 1) + F.get(values, half)) / 2)
    return F.when(n >= least, middle)


def past_quantile_nearest(column: str, q: float, window: WindowSpec, size: int, least: int = 1, end: int = -1) -> Column:
    """Element at index round(q * (n - 1)) of the sorted frame."""
    frame = past(window, size, end)
    values = _sorted_frame(F.col(column).cast("double"), frame)
    n = F.size(values)
    return F.when(n >= least, F.get(values, F.floor(F.lit(q) * (n - 1) + 0.5).cast("int")))


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "run_id") -> DataFrame:
    """Numbers the stretches of equal `value` in order, from 0, in each key group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & F.lag(F.lit(1)).over(w).isNotNull()
    return df.withColumn("_changed", changed.cast("bigint")).withColumn(out, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def average_rank(column: str, *keys: str) -> Column:
    """Rank in ascending order, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2


def clip(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
