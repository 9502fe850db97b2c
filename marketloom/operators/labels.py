"""Forward labels with censoring, causal memory, and wave geometry over story groups.

A label's outcome time is when its window showed it; a window cut by the end of
its group is censored, never a failure.  Looking ahead is confined to these
functions; memory looks back only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import past

TS = "availability_ts"


@dataclass(frozen=True)
class Outcome:
    name: str
    triggers: tuple[str, ...]
    success: tuple[str, ...]
    fail: tuple[str, ...]
    window: int = 8


def _active(df: DataFrame, columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        if c in df.columns:
            out = out | (F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) > 0.5)
    return out


def _ahead(group: list[str], order: list[str], window: int):  # noqa: ANN202
    w = Window.partitionBy(*group).orderBy(*order)
    return w, w.rowsBetween(1, window)


def labeled_outcomes(df: DataFrame, specs: list[Outcome], group: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each onset of a spec's trigger: resolved at the first success or failure in the window,
    ambiguous if both fall on that row, failed after a complete window, else censored."""
    order = order or [TS]
    parts = []
    for spec in specs:
        w, frame = _ahead(group, order, spec.window)
        rows = df.select(*group, *order, _active(df, spec.triggers).alias("_t"), _active(df, spec.success).alias("_s"), _active(df, spec.fail).alias("_f"))
        rows = rows.withColumns({"_onset": F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False)), "_i": F.row_number().over(w)})
        first = F.min(F.when(F.col("_s") | F.col("_f"), F.struct("_i", TS, "_s", "_f"))).over(frame)
        rows = rows.withColumns({"_hit": first, "_seen": F.count(F.lit(1)).over(frame), "_last": F.last(TS).over(w.rowsBetween(0, spec.window))})
        rows = rows.where("_onset")
        both = F.col("_hit._s") & F.col("_hit._f")
        status = F.when(both, "ambiguous").when(F.col("_hit").isNotNull() | (F.col("_seen") >= spec.window), "resolved").otherwise("censored")
        y = F.when(status == "resolved", F.coalesce(F.col("_hit._s"), F.lit(False)).cast("double"))
        parts.append(
            rows.select(
                *group,
                F.col(TS).alias("setup_availability_ts"),
                F.coalesce(f"_hit.{TS}", "_last").alias("outcome_available_ts"),
                F.lit(spec.name).alias("outcome_name"),
                y.alias("y"),
                F.coalesce(F.col("_hit._i") - F.col("_i"), F.col("_seen")).cast("bigint").alias("horizon_bars"),
                status.alias("label_status"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_transition(df: DataFrame, trigger: str, classes: dict[str, str], window: int, group: list[str], order: list[str] | None = None) -> DataFrame:
    """Which of several classes comes first after an onset; two on one row are ambiguous."""
    order = order or [TS]
    w, frame = _ahead(group, order, window)
    hits = F.array_compact(F.array(*[F.when(_active(df, (c,)), F.lit(name)) for name, c in classes.items()]))
    rows = df.select(*group, *order, _active(df, (trigger,)).alias("_t"), hits.alias("_c")).withColumns({"_onset": F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False)), "_i": F.row_number().over(w)})
    rows = rows.withColumns({"_hit": F.min(F.when(F.size("_c") > 0, F.struct("_i", TS, "_c"))).over(frame), "_seen": F.count(F.lit(1)).over(frame), "_last": F.last(TS).over(w.rowsBetween(0, window))}).where("_onset")
    status = F.when(F.size("_hit._c") > 1, "ambiguous").when(F.col("_hit").isNotNull() | (F.col("_seen") >= window), "resolved").otherwise("censored")
    name = F.when(status == "resolved", F.coalesce(F.get("_hit._c", F.lit(0)), F.lit("no_transition")))
    return rows.select(*group, F.col(TS).alias("setup_availability_ts"), F.coalesce(f"_hit.{TS}", "_last").alias("outcome_available_ts"), name.alias("first_transition_class"), F.coalesce(F.col("_hit._i") - F.col("_i"), F.col("_seen")).cast("bigint").alias("horizon_bars"), status.alias("label_status"))


def known_by(labels: DataFrame, ts: int) -> DataFrame:
    return labels.where(F.col("outcome_available_ts") <= ts)


def causal_lags(df: DataFrame, columns: list[str], group: list[str], lags: tuple[int, ...] = (1, 2, 3, 5), order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*(order or [TS]))
    return df.withColumns({f"{c}__lag{k}": F.lag(F.col(c).cast("double"), k).over(w) for c in columns for k in lags})


def market_memory(df: DataFrame, columns: list[str], group: list[str], windows: tuple[int, ...] = (3, 8), events: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Means, sums and event counts of the rows before, inside the group."""
    w = Window.partitionBy(*group).orderBy(*(order or [TS]))
    made = {}
    for n in windows:
        frame = past(w, n)
        for c in columns:
            made[f"{c}__rmean{n}"], made[f"{c}__rsum{n}"] = F.avg(F.col(c).cast("double")).over(frame), F.sum(F.col(c).cast("double")).over(frame)
        for c in events or []:
            made[f"{c}__ecount{n}"] = F.sum((F.abs(F.col(c).cast("double")) > 0).cast("double")).over(frame)
    return df.withColumns(made)


def time_since(df: DataFrame, pulse: str, group: list[str], out: str, order: list[str] | None = None) -> DataFrame:
    """Rows since the last earlier pulse of the group, else rows since its start; and how many there were."""
    w = Window.partitionBy(*group).orderBy(*(order or [TS]))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    hit = F.abs(F.coalesce(F.col(pulse).cast("double"), F.lit(0.0))) > 0.5
    last = F.max(F.when(hit, F.col("_i"))).over(before)
    return df.withColumns({out: (F.col("_i") - F.coalesce(last, F.lit(0))).cast("bigint"), f"{out}_count": F.coalesce(F.sum(hit.cast("bigint")).over(before), F.lit(0))}).drop("_i")


def dwell(df: DataFrame, state: str, group: list[str], out: str, order: list[str] | None = None) -> DataFrame:
    """Length of the current stretch of a state before each row (0 where the row before is in another one)."""
    w = Window.partitionBy(*group).orderBy(*(order or [TS]))
    rows = df.withColumn("_new", (~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*group, "_run").orderBy(*(order or [TS]))) - 1
    return rows.withColumn(out, place.cast("bigint")).drop("_new", "_run")


def wave_geometry(df: DataFrame, group: str, extent: str, onset: Column, start: float = 4.0) -> DataFrame:
    """Per story: onset, peak, end, where the expansion starts and how far it runs from there."""
    whole = Window.partitionBy(group)
    rows = df.withColumns({"_x": F.col(extent).cast("double"), "_on": F.min(F.when(onset, F.col(TS))).over(whole)})
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_bars"))
    after = rows.where(F.col(TS) >= F.col("_on"))
    waves = after.groupBy(group).agg(
        F.min("_on").alias("wave_onset_ts"),
        F.max_by(TS, F.struct("_x", -F.col(TS))).alias("wave_peak_ts"),
        F.max(TS).alias("wave_end_ts"),
        F.min_by("_x", TS).alias("onset_extent"),
        F.max("_x").alias("wave_peak"),
        F.min(F.when(F.col("_x") >= start, F.col(TS))).alias("expansion_start_ts"),
        F.min_by("_x", F.when(F.col("_x") >= start, F.col(TS))).alias("expansion_start_extent"),
        F.count(F.lit(1)).alias("n_bars_after_onset"),
    )
    run = F.greatest(F.lit(0.0), F.col("wave_peak") - F.coalesce("expansion_start_extent", F.lit(0.0)))
    return waves.join(n, group).withColumn("expansion_run", run)


def wave_bin(fraction: Column, early: float = 0.2, continued: float = 0.4, middle: float = 0.6) -> Column:
    return F.when(fraction < early, "early_prediction").when(fraction < continued, "early_continuation").when(fraction < middle, "mid_wave").when(fraction.isNotNull(), "late_prediction")


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.min_by(F.struct(*[c for c in df.columns if c not in group]), F.struct(*order)).alias("x")).select(*group, "x.*")


def forward_returns(df: DataFrame, price: str, horizon: int, group: list[str], order: list[str]) -> DataFrame:
    ahead = F.lead(price, horizon).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("forward_return", F.try_divide(ahead - F.col(price), F.col(price)))


def execution_returns(df: DataFrame, bid: str, ask: str, horizon: int, group: list[str], order: list[str], slippage_ticks: float = 0.0, tick: float = 0.25, commission_bps: float = 0.0) -> DataFrame:
    """Returns of crossing the spread both ways, long and short."""
    w = Window.partitionBy(*group).orderBy(*order)
    slip, fee = slippage_ticks * tick, commission_bps / 10_000
    buy, sell = F.col(ask) + slip, F.col(bid) - slip
    return df.withColumns({"long_return": F.try_divide(F.lead(F.col(bid), horizon).over(w) - slip - buy, buy) - fee, "short_return": F.try_divide(sell - (F.lead(F.col(ask), horizon).over(w) + slip), sell) - fee})


def directional_returns(df: DataFrame, signal: str) -> DataFrame:
    """The long or short return by the signal's sign; null at 0."""
    return df.withColumn("directional_return", F.when(F.col(signal) > 0, F.col("long_return")).when(F.col(signal) < 0, F.col("short_return")))
