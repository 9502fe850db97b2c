"""Research features of two contracts' event stream: last states by interval, steps inside a session, and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import regimes, store, ticks


def research_frame(m: DataFrame, a: int, b: int, interval_ns: int) -> DataFrame:
    """The tick stream's last state of each interval with mids, their returns, signed-volume steps and phase flags.

    Signed volumes run through a session date and start anew with the next, so
    an interval's own flow is the step of the running sum; a return needs a mid
    in the interval before, of any date.
    """
    t = ticks.tick_stream(m, a, b, interval_ns)
    for side in "ab":
        t = store.differences(t, f"{side}_signed", ["session_date"], ["availability_ts"], f"{side}_delta")
    clock = Window.partitionBy(F.lit(0)).orderBy("availability_ts")  # a pair's clock of intervals, as its replay is
    for side in "ab":
        mid = (F.col(f"{side}_bid_px") + F.col(f"{side}_ask_px")) / 2
        t = t.withColumn(f"{side}_mid", mid).withColumn(f"{side}_return", F.coalesce(F.try_divide(F.col(f"{side}_mid") - F.lag(f"{side}_mid").over(clock), F.lag(f"{side}_mid").over(clock)), F.lit(0.0)))
    phase = regimes.heuristic_phase(F.col("in_value"), F.col("trail_bid"), F.col("trail_ask"))
    return t.withColumns({"phase_balance": (phase == regimes.BALANCE).cast("double"), "phase_expansion": (phase == regimes.EXPANSION).cast("double")})
