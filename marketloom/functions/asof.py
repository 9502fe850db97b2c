"""Backward as-of joins.

Left and right rows are laid in one order by time, right rows first at equal
times, and each left row takes the last right row so far.  Rows of a key go to
one window partition; with `slice_ns` a key is cut into time slices, and each
slice's opening value (the last right row of the slices before it) is carried
in from a table with one row for each slice, so that a long or hot key is not
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, columns: list[str] | None = None, tie: list[str] | None = None, slice_ns: int | None = None) -> DataFrame:
    """left's columns and right's `columns` (all but keys, by default) at the last right_on <= left_on.

    `tie` orders right rows of equal time; the last one counts.  Null times
    match nothing.  Right columns that clash with left ones must be renamed first.
    """
    by = by or []
    columns = columns or [c for c in right.columns if c not in (*by, right_on)]
    tie = tie or []
    l = left.select(*[F.col(c) for c in by], F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull()).select(*[F.col(c) for c in by], F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(columns)]).alias("_right"), F.struct(F.lit(0).alias("_z"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)]).alias("_tie"))
    both = l.unionByName(r, allowMissingColumns=True)
    last = lambda w: F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    order = ["_t", "_side", "_tie"]
    if slice_ns is None:
        joined = both.withColumn("_right", last(Window.partitionBy(*by).orderBy(*order)))
    else:
        both = both.withColumn("_slice", F.call_function("div", F.col("_t") - F.pmod(F.col("_t"), F.lit(slice_ns)), F.lit(slice_ns)))
        ends = both.groupBy(*by, "_slice").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
        carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "_slice", "_carry")
        joined = both.withColumn("_right", last(Window.partitionBy(*by, "_slice").orderBy(*order))).join(carried, [*by, "_slice"], "left").withColumn("_right", F.coalesce("_right", "_carry"))
    return joined.where("_side = 1").select("_left.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_right._r{i}")).alias(c) for i, c in enumerate(columns)])


def pulse_join(left: DataFrame, right: DataFrame, on: list[str], pulses: list[str]) -> DataFrame:
    """Exact left join; unmatched pulses are 0, other right columns stay null."""
    joined = left.join(right, on, "left")
    return joined.withColumns({p: F.coalesce(F.col(p), F.lit(0).cast(right.schema[p].dataType)) for p in pulses})
