"""Trade-tape operators: buckets, footprint, order flow, liquidity, profiles, bars, gaps, failed breakouts.

Every operator keeps instruments apart (KEY) and states its order; aggregates
by bucket combine on the map side, and windows run on bucket-level rows only.
Aggregates become known at bucket_end (availability_ts).  Buckets without a
qualifying event have no row.  Null prices or sizes do not occur after
sources.mbo.sanitize; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.session import ETH, session_phase
from ..functions.windows import gated, past, past_mean

KEY = "instrument_id"
SCALE = 1e-9
HOUR = 3_600_000_000_000
RUNNING = (Window.unboundedPreceding, 0)


def by_bucket(order: str = "bucket_start"):  # noqa: ANN201
    return Window.partitionBy(KEY).orderBy(order)


def add_time_bucket(df: DataFrame, interval_ns: int, ts: str = "event_ts") -> DataFrame:
    """bucket_start, bucket_end and availability_ts (its end), aligned to the epoch; integers throughout."""
    if interval_ns < 1:
        raise ValueError(f"interval_ns must be at least 1, not {interval_ns}")
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(interval_ns))
    return df.withColumns({"bucket_start": start, "bucket_end": start + interval_ns, "availability_ts": start + interval_ns})


def extract_trades(df: DataFrame) -> DataFrame:
    """Trades with volume by aggressor; a trade without a side counts for neither."""
    buy = F.when(F.col("side") == "B", F.col("size")).otherwise(0).cast("bigint")
    sell = F.when(F.col("side") == "A", F.col("size")).otherwise(0).cast("bigint")
    return df.where("action = 'T'").withColumns({"buy_volume": buy, "sell_volume": sell, "signed_volume": buy - sell})


def _ends(df: DataFrame, interval_ns: int) -> DataFrame:
    end = F.col("bucket_start") + interval_ns
    return df.withColumns({"bucket_end": end, "availability_ts": end})


def _imbalance(delta: Column, total: Column) -> Column:
    return F.when(total > 0, delta / total).otherwise(0.0)


def footprint_cells(df: DataFrame, interval_ns: int) -> DataFrame:
    """Buy, sell, delta, total and imbalance of each bucket and price."""
    trades = extract_trades(add_time_bucket(df, interval_ns))
    cells = trades.groupBy(KEY, "bucket_start", "price").agg(F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"))
    delta, total = F.col("buy_volume") - F.col("sell_volume"), F.col("buy_volume") + F.col("sell_volume")
    return _ends(cells.withColumns({"delta": delta, "total_volume": total, "imbalance": _imbalance(delta, total)}), interval_ns)


def footprint_summary(df: DataFrame, interval_ns: int, price_tick: int = 1) -> DataFrame:
    """Per bucket: volumes, running delta, range in ticks and volume per tick of range."""
    if price_tick < 1:
        raise ValueError(f"price_tick must be at least 1, not {price_tick}")
    trades = extract_trades(add_time_bucket(df, interval_ns))
    b = trades.groupBy(KEY, "bucket_start").agg(F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"), F.max("price").alias("hi"), F.min("price").alias("lo"))
    b = b.withColumns({"delta": F.col("buy_volume") - F.col("sell_volume"), "total_volume": F.col("buy_volume") + F.col("sell_volume"), "price_range": F.expr(f"(hi - lo) div {price_tick}")}).drop("hi", "lo")
    b = b.withColumns({"cumulative_delta": F.sum("delta").over(by_bucket().rowsBetween(*RUNNING)), "absorption_ratio": F.col("total_volume") / (F.col("price_range") + 1)})
    return _ends(b, interval_ns)


def order_flow_summary(df: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket: aggressive volumes and trade counts, delta, consumption, running delta."""
    trades = extract_trades(add_time_bucket(df, interval_ns))
    b = trades.groupBy(KEY, "bucket_start").agg(
        F.sum("buy_volume").alias("buy_volume"),
        F.sum("sell_volume").alias("sell_volume"),
        F.count_if(F.col("buy_volume") > 0).alias("buy_trades"),
        F.count_if(F.col("sell_volume") > 0).alias("sell_trades"),
    )
    b = b.withColumns({"delta": F.col("buy_volume") - F.col("sell_volume"), "consumption": F.col("buy_volume") + F.col("sell_volume")})
    return _ends(b.withColumn("cumulative_delta", F.sum("delta").over(by_bucket().rowsBetween(*RUNNING))), interval_ns)


def order_acceleration(df: DataFrame, lookback: int = 3, accel_mult: float = 1.5, balanced: str | None = None, session: str | None = None) -> DataFrame:
    """Adds order_accel_rate (consumption over its past mean, signed by delta) and the early_imbalance pulse."""
    if lookback < 1 or accel_mult <= 0:
        raise ValueError("lookback must be at least 1 and accel_mult above 0")
    w = by_bucket()
    base = past_mean("consumption", w, lookback, 1)
    same = F.lit(True) if session is None else F.coalesce(F.lag(session).over(w), F.col(session)) == F.col(session)
    rate = F.when(same & (base > 0), F.col("consumption") / base).otherwise(0.0)
    sign = F.signum("delta").cast("double")
    fast = (rate >= accel_mult) & (sign != 0)
    if balanced is not None:
        now = F.coalesce(F.col(balanced), F.lit(False))
        fast = fast & (now | (F.coalesce(F.lag(balanced).over(w), F.lit(True)) & ~now))
    return df.withColumns({"order_accel_rate": sign * rate, "early_imbalance": F.when(fast, sign).otherwise(0.0)})


def liquidity_summary(df: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket: size added, size cancelled, and their difference."""
    size = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("size"))), F.lit(0)).cast("bigint")
    b = add_time_bucket(df, interval_ns).groupBy(KEY, "bucket_start").agg(size("A").alias("added_volume"), size("C").alias("pulled_volume"))
    return _ends(b.withColumn("net_liquidity", F.col("added_volume") - F.col("pulled_volume")), interval_ns)


def volume_profile(df: DataFrame) -> DataFrame:
    """Traded volume by price."""
    return extract_trades(df).groupBy(KEY, "price").agg(F.sum("size").alias("volume"))


def classify_nodes(profile: DataFrame) -> DataFrame:
    """High- and low-volume nodes: strict extremes among neighbouring traded prices."""
    w = Window.partitionBy(KEY).orderBy("price")
    v, before, after = F.col("volume"), F.lag("volume").over(w), F.lead("volume").over(w)
    return profile.withColumns({"is_hvn": F.coalesce((v > before) & (v > after), F.lit(False)), "is_lvn": F.coalesce((v < before) & (v < after), F.lit(False))})


def point_of_control(profile: DataFrame) -> DataFrame:
    """Price of most volume; ties go to the volume centre, then the middle of the range, then the lower price."""
    centre = profile.groupBy(KEY).agg(F.sum(F.col("price").cast("double") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"), F.max("volume").alias("top"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    near = F.struct(F.abs(F.col("price") - F.col("pv") / F.col("v")), F.abs(F.col("price") - (F.col("lo") + F.col("hi")) * 0.5), F.col("price"))
    return profile.join(centre, KEY).where("volume = top").groupBy(KEY).agg(F.min_by("price", near).alias("poc"), F.max("volume").alias("poc_volume"), F.max("v").alias("total_volume"))


def ohlcv_bars(df: DataFrame, interval_ns: int) -> DataFrame:
    """Bars of trades in real prices; open and close by (event_ts, sequence)."""
    trades = add_time_bucket(extract_trades(df), interval_ns).withColumn("px", F.col("price") * F.lit(SCALE))
    at = F.struct("event_ts", "sequence")
    total = lambda c: F.sum(F.col(c)).cast("double")
    b = trades.groupBy(KEY, "bucket_start").agg(
        F.min_by("px", at).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", at).alias("c"),
        total("size").alias("volume"), total("buy_volume").alias("buy_volume"), total("sell_volume").alias("sell_volume"),
    )
    return _ends(b.withColumns({"delta": F.col("buy_volume") - F.col("sell_volume"), "range": F.col("h") - F.col("l")}), interval_ns)


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps: a low above the high two bars before (Bull) or the mirror (Bear); known at the bar's end."""
    w = by_bucket()
    b = bars.withColumns({"h2": F.lag("h", 2).over(w), "l2": F.lag("l", 2).over(w)})
    kinds = F.array(
        F.when(F.col("l") > F.col("h2"), F.struct(F.lit("Bull").alias("fvg_type"), F.col("h2").alias("fvg_low"), F.col("l").alias("fvg_high"))),
        F.when(F.col("h") < F.col("l2"), F.struct(F.lit("Bear").alias("fvg_type"), F.col("h").alias("fvg_low"), F.col("l2").alias("fvg_high"))),
    )
    g = b.select(KEY, F.col("bucket_start").alias("formed_at"), F.col("bucket_end").alias("availability_ts"), F.explode(F.array_compact(kinds)).alias("g")).select(KEY, "formed_at", "availability_ts", "g.*")
    return g.withColumn("fvg_mid", (F.col("fvg_low") + F.col("fvg_high")) / 2).withColumn("fvg_id", F.format_string("%d_%s_%.4f_%.4f", "formed_at", "fvg_type", "fvg_low", "fvg_high"))


def effort_features(bars: DataFrame, window: int = 20) -> DataFrame:
    """Past means of range and volume, null until a whole window has passed."""
    w = by_bucket()
    return bars.withColumns({"atr20": past_mean("range", w, window), "volume_sma20": past_mean("volume", w, window)})


def volume_baselines(bars: DataFrame, atr_window: int = 20, vol_window: int = 20, cum_window: int = 5) -> DataFrame:
    """Past-only baselines of range, volume, running volume, absolute delta and volume per range."""
    w = by_bucket()
    least = lambda n: max(3, n // 2)
    b = bars.withColumns(
        {
            "atr_past": past_mean("range", w, atr_window, least(atr_window)),
            "vol_sma_past": past_mean("volume", w, vol_window, least(vol_window)),
            "cum_volume": F.sum("volume").over(past(w, max(1, cum_window), 0)),
            "cum_delta": F.sum("delta").over(w.rowsBetween(*RUNNING)),
            "absorption": F.col("volume") / (F.abs("range") + 1e-9),
            "abs_delta": F.abs("delta"),
        }
    )
    return b.withColumns({f"{out}_sma_past": past_mean(c, w, vol_window, least(vol_window)) for c, out in (("cum_volume", "cum_vol"), ("abs_delta", "abs_delta"), ("absorption", "absorption"))})


def trend_average(bars: DataFrame, period: int = 50) -> DataFrame:
    """Past mean of closes; the period adapts to half the number of bars of the instrument (3 at least)."""
    w = by_bucket()
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    effective = F.least(F.lit(max(period, 3)), F.greatest(F.lit(3), F.call_function("div", n, F.lit(2))))
    least = F.greatest(F.lit(3), F.call_function("div", effective, F.lit(2)))
    frame = w.rowsBetween(-max(period, 3), -1)
    closes = F.collect_list("c").over(frame)
    recent = F.slice(closes, F.greatest(F.lit(1), F.size(closes) - effective.cast("int") + 1), effective.cast("int"))
    mean = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / F.size(recent)
    return bars.select(KEY, "availability_ts", F.when(F.size(recent) >= least, mean).alias("sma")).where("sma IS NOT NULL")


def failed_breakout_candidates(
    bars: DataFrame,
    trend: DataFrame | None = None,
    lookback: int = 5,
    atr_window: int = 20,
    vol_window: int = 20,
    cum_window: int = 5,
    range_mult: float = 1.1,
    vol_mult: float = 1.2,
    result_mult: float = 1.2,
    vol_mode: str = "bar",
    priority: str = "structure_first",
    sma_period: int = 50,
    rth_only: bool = True,
) -> DataFrame:
    """Bars that pierce the past lookback's extreme and close back inside it with enough volume.

    -1: a failed break upward (short), 1: downward (long); the short is tried
    first.  `trend` bars add a filter by their past mean close, for instruments
    that have one.  No rows for instruments with too few bars.
    """
    if vol_mode not in ("bar", "cum", "delta", "effort_result") or priority not in ("structure_first", "volume_first") or lookback < 1:
        raise ValueError("unknown vol_mode or priority, or lookback below 1")
    w = by_bucket()
    b = volume_baselines(bars, atr_window, vol_window, cum_window).withColumns(
        {
            "prior_h": F.max("h").over(past(w, lookback)),
            "prior_l": F.min("l").over(past(w, lookback)),
            "seen": F.count(F.lit(1)).over(past(w, lookback)),
            "n_bars": F.count(F.lit(1)).over(Window.partitionBy(KEY)),
            "effort_prev": F.coalesce(F.lag(F.when(F.col("vol_sma_past") > 0, F.col("volume") / F.col("vol_sma_past"))).over(w), F.lit(0.0)),
        }
    )
    if trend is None:
        b = b.withColumns({"sma": F.lit(None).cast("double"), "has_sma": F.lit(False)})
    else:
        sma = trend_average(trend, sma_period)
        known = sma.groupBy(KEY).agg(F.lit(True).alias("has_sma"))
        b = asof_backward(b, sma, "availability_ts", "availability_ts", by=[KEY]).join(known, KEY, "left").withColumn("has_sma", F.coalesce("has_sma", F.lit(False)))
    b = b.where((F.col("n_bars") >= max(12, lookback + atr_window)) & (F.col("seen") == lookback) & (F.col("atr_past") > 0) & (F.col("vol_sma_past") > 0) & (F.col("range") > 0))
    if rth_only:
        b = b.where(session_phase(F.col("bucket_start")) != ETH)
    over = lambda c, base: F.coalesce(F.when(F.col(base) > 0, F.col(c) / F.col(base)), F.lit(0.0))
    b = b.withColumns({"er": F.col("range") / F.col("atr_past"), "ev": F.col("volume") / F.col("vol_sma_past"), "ec": over("cum_volume", "cum_vol_sma_past"), "ed": over("abs_delta", "abs_delta_sma_past"), "ea": over("absorption", "absorption_sma_past")})
    range_ok = F.col("er") > range_mult
    short = (F.col("h") > F.col("prior_h")) & (F.col("c") < F.col("prior_h")) & (~F.col("has_sma") | F.coalesce(F.col("c") < F.col("sma"), F.lit(False)))
    long = (F.col("l") < F.col("prior_l")) & (F.col("c") > F.col("prior_l")) & (~F.col("has_sma") | F.coalesce(F.col("c") > F.col("sma"), F.lit(False)))
    gate = {
        "bar": lambda _: F.col("ev") > vol_mult,
        "cum": lambda _: F.col("ec") > vol_mult,
        "delta": lambda side: (F.col("ed") > vol_mult) & (F.col("delta") * -side > 0),
        "effort_result": lambda _: (F.col("ev") > vol_mult) & (F.col("ea") > result_mult),
    }[vol_mode]
    # the range gate applies in either priority; only its place in the scan differs
    side = F.when(range_ok & short & gate(-1), -1.0).when(range_ok & long & gate(1), 1.0)
    b = b.withColumn("fail_breakout", side).where("fail_breakout IS NOT NULL")
    is_short = F.col("fail_breakout") < 0
    return b.select(
        KEY, "bucket_start", "bucket_end", "availability_ts", "fail_breakout",
        F.when(is_short, F.col("prior_h")).otherwise(F.col("prior_l")).alias("fb_break_level"),
        F.col("c").alias("fb_entry_ref"), F.col("er").alias("fb_effort_range_ratio"), F.col("ev").alias("fb_effort_volume_ratio"), F.col("ea").alias("fb_effort_result_ratio"),
        F.col("volume").alias("fb_bar_volume"), F.col("cum_volume").alias("fb_cum_volume"), F.col("delta").alias("fb_delta"), F.col("cum_delta").alias("fb_cum_delta"),
        F.when(F.col("volume") > 0, F.col("delta") / F.col("volume")).otherwise(0.0).alias("fb_vol_imbalance"), F.col("absorption").alias("fb_absorption"),
        F.greatest(F.lit(1.5), F.when(is_short, F.col("h") - F.col("prior_h")).otherwise(F.col("prior_l") - F.col("l"))).alias("fb_risk_pts"),
        F.col("effort_prev").alias("fb_effort_volume_prev"),
    )


def hold_filter(candidates: DataFrame, mode: str = "none", vol_mult: float = 1.2, result_mult: float = 1.2, imbalance_min: float = 0.15) -> DataFrame:
    """Keeps candidates by persistence of volume, absorption, or imbalance on the failing side."""
    keep = {
        "none": F.lit(True),
        "persist": F.col("fb_effort_volume_prev") > vol_mult * 0.85,
        "absorption": F.col("fb_effort_result_ratio") > result_mult,
        "imbalance": F.col("fb_vol_imbalance") * -F.col("fail_breakout") > imbalance_min,
    }
    if mode not in keep:
        raise ValueError(f"unknown hold mode {mode!r}")
    return candidates.where(keep[mode]).drop("fb_effort_volume_prev")


def failed_breakouts(df: DataFrame, signal_interval_ns: int, trend_interval_ns: int, hold_mode: str = "none", **options) -> DataFrame:  # noqa: ANN003
    """Events to failed breakouts."""
    return hold_filter(failed_breakout_candidates(ohlcv_bars(df, signal_interval_ns), ohlcv_bars(df, trend_interval_ns), **options), hold_mode)


def market_windows(df: DataFrame, top_of_book: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket: last mid, bid and ask (both sides present) full-joined with delta."""
    tob = add_time_bucket(top_of_book.where("best_bid IS NOT NULL AND best_ask IS NOT NULL"), interval_ns)
    at = F.struct("event_ts", "sequence")
    close = tob.groupBy(KEY, "bucket_start").agg(F.max_by((F.col("best_bid") + F.col("best_ask")) / 2, at).alias("close"), F.max_by("best_bid", at).alias("bid"), F.max_by("best_ask", at).alias("ask"))
    return close.join(order_flow_summary(df, interval_ns).select(KEY, "bucket_start", "delta"), [KEY, "bucket_start"], "full")


def rolling_corr(x: Column, y: Column, window, size: int) -> Column:  # noqa: ANN001
    """Population correlation of a frame of `size` complete pairs; null where a variance is not above 0."""
    frame = window.rowsBetween(-(size - 1), 0)
    mean = lambda c: gated(F.avg(c).over(frame), c, frame, size)
    spread = mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    denominator = F.sqrt(F.greatest(F.lit(0.0), spread[0])) * F.sqrt(F.greatest(F.lit(0.0), spread[1]))
    return F.when(denominator > 0, (mean(x * y) - mean(x) * mean(y)) / denominator)


def cross_market(lead: DataFrame, follow: DataFrame, interval_ns: int, size: int = 20, min_trap_delta: int = 1, latency_ns: int = 0) -> DataFrame:
    """Lead and follow windows (market_windows of one instrument each) on one clock, with divergence,
    confirmation failure, lead-lag correlations and trap setups.  A latency matches each bucket with
    the follower's last one at or before its start less the latency."""
    if size < 2 or latency_ns < 0:
        raise ValueError("size must be at least 2 and latency not negative")
    a = lead.select("bucket_start", F.col("close").alias("a_close"), F.coalesce("delta", F.lit(0)).alias("a_delta"))
    b = follow.select("bucket_start", F.col("close").alias("b_close"), F.coalesce("delta", F.lit(0)).alias("b_delta"))
    if latency_ns:
        right = b.withColumnRenamed("bucket_start", "b_start")
        j = asof_backward(a.withColumn("at", F.col("bucket_start") - latency_ns), right, "at", "b_start").drop("at").withColumn("b_delta", F.coalesce("b_delta", F.lit(0)))
    else:
        j = a.join(b, "bucket_start")
    from ..functions.session import trade_date

    j = j.withColumns({"availability_ts": F.col("bucket_start") + interval_ns, "session_date": trade_date(F.col("bucket_start") + interval_ns)})
    w = Window.partitionBy(F.lit(0)).orderBy("bucket_start")  # one row a bucket: a month of minutes is 43,200 rows
    d = Window.partitionBy("session_date").orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumns({"a_return": F.col("a_close") - F.lag("a_close").over(w), "b_return": F.col("b_close") - F.lag("b_close").over(w)})
    flag = lambda c: F.coalesce(c, F.lit(False))
    j = j.withColumns({f"{m}_new_{n}": flag(F.col(f"{m}_close") > F.max(f"{m}_close").over(d) if n == "high" else F.col(f"{m}_close") < F.min(f"{m}_close").over(d)) for m in "ab" for n in ("high", "low")})
    j = j.withColumns({"a_before": F.lag("a_return").over(w), "b_before": F.lag("b_return").over(w)})
    j = j.withColumns({"a_leads_corr": rolling_corr(F.col("a_before"), F.col("b_return"), w, size), "b_leads_corr": rolling_corr(F.col("b_before"), F.col("a_return"), w, size)})
    high, low = (F.col("b_new_high"), F.col("a_new_high")), (F.col("b_new_low"), F.col("a_new_low"))
    return j.withColumns(
        {
            "divergence": flag(F.signum("a_return") * F.signum("b_return") < 0),
            "confirmation_failure": (high[0] != high[1]) | (low[0] != low[1]),
            "lead_lag": F.when(F.col("a_leads_corr") > F.col("b_leads_corr"), 1).when(F.col("a_leads_corr") < F.col("b_leads_corr"), -1).otherwise(0),
            "trap_setup": F.when(high[0] & ~high[1] & (F.col("b_delta") >= min_trap_delta), 1).when(low[0] & ~low[1] & (F.col("b_delta") <= -min_trap_delta), -1).otherwise(0),
        }
    ).drop("a_before", "b_before")
