"""Registered queries over the trade tape, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import session
from ..operators import tape
from ..sources import mbo as source
from .sql import MBO, TAPE, bars, rounded, trades

H1, H4, D7, D28 = tape.HOUR, 4 * tape.HOUR, 7 * 24 * tape.HOUR, 28 * 24 * tape.HOUR


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that two engines' sums compare."""
    return df.withColumns({f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def _mbo(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: tidy(f(source.events_as_mbo(s, d)))


def _tape(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: tidy(f(source.lineitem_as_tape(s, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ENDS = lambda i: f"bucket_start + {i} AS bucket_end, bucket_start + {i} AS availability_ts"
B = lambda x, n: f"CAST({x} AS BIGINT) AS {n}"

QUERIES["mbo_contract_check"] = _mbo(source.contract_counts)
SQL["mbo_contract_check"] = f"WITH {MBO} SELECT count(*) AS n_rows, count(*) FILTER (ingest_ts < event_ts) AS ingest_before_event, count(*) FILTER (action NOT IN ('A','C','M','R','T','F','N')) AS bad_action, count(*) FILTER (side NOT IN ('B','A','N')) AS bad_side, count(*) FILTER (size < 0) AS negative_size, count(*) FILTER (price IS NULL) AS null_price FROM mbo"

QUERIES["integrity_counts"] = _mbo(source.integrity)
SQL["integrity_counts"] = f"""WITH {MBO}, s AS (SELECT instrument_id, sequence - lag(sequence) OVER (PARTITION BY instrument_id ORDER BY event_ts, sequence) AS step FROM mbo)
SELECT instrument_id, count(*) AS n_events, count(*) FILTER (step <= -1000) AS n_resets, count(*) FILTER (step <= 0 AND step > -1000) AS n_non_monotonic,
  count(*) FILTER (step > 1) AS n_gaps, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS n_skipped FROM s GROUP BY 1"""

_ET = "(make_timestamp(event_ts // 1000) - INTERVAL 5 HOUR)"  # the events lie in January
_M = f"(hour({_ET}) * 60 + minute({_ET}))"
QUERIES["session_columns"] = _mbo(lambda m: session.add_session_columns(m).withColumn("vp_liquidity_session", session.liquidity_session(F.col("event_ts"))).withColumn("label", session.session_label(F.col("vp_liquidity_session"))).select("sequence", "session_phase", "minutes_since_open", "session_date", "vp_liquidity_session", "label"))
SQL["session_columns"] = f"""WITH {MBO}, m AS (SELECT *, {_M} AS m, CASE WHEN {_M} >= 1080 OR {_M} < 180 THEN 0 WHEN {_M} < 570 THEN 1 ELSE 2 END AS v FROM mbo)
SELECT sequence, CAST(CASE WHEN m < 570 OR m >= 960 THEN 0 WHEN m < 600 THEN 1 WHEN m < 690 THEN 2 WHEN m < 780 THEN 3 WHEN m < 900 THEN 4 ELSE 5 END AS TINYINT) AS session_phase,
  CAST(CASE WHEN m >= 570 AND m < 960 THEN m - 570 END AS INT) AS minutes_since_open, strftime(CAST({_ET} + INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS session_date,
  CAST(v AS TINYINT) AS vp_liquidity_session, CASE v WHEN 0 THEN 'asia' WHEN 1 THEN 'london' ELSE 'new_york' END AS label FROM m"""

QUERIES["trade_date_counts"] = _mbo(lambda m: m.groupBy("instrument_id", session.trade_date(F.col("event_ts")).alias("session_date")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume")))
SQL["trade_date_counts"] = f"WITH {MBO} SELECT instrument_id, strftime(CAST({_ET} + INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS session_date, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM mbo GROUP BY ALL"


def _bounds(m: DataFrame) -> DataFrame:
    start, end = session.session_bounds(F.col("event_ts"))
    return m.select("sequence", start.alias("session_start"), end.alias("session_end"))


QUERIES["session_bounds"] = _mbo(_bounds)
SQL["session_bounds"] = f"""WITH {MBO}, m AS (SELECT *, {_M} AS m, epoch_us(date_trunc('day', {_ET}))*1000 + 18000000000000 AS day FROM mbo)
SELECT sequence, CASE WHEN m < 180 THEN day - 21600000000000 WHEN m < 570 THEN day + 10800000000000 WHEN m < 1080 THEN day + 34200000000000 ELSE day + 64800000000000 END AS session_start,
  CASE WHEN m < 180 THEN day + 10800000000000 WHEN m < 570 THEN day + 34200000000000 WHEN m < 1080 THEN day + 64800000000000 ELSE day + 97200000000000 END AS session_end FROM m"""

for _name, _f, _src, _i in (("footprint_cells", _mbo, MBO, H1), ("footprint_cells_tape", _tape, TAPE, D7)):
    QUERIES[_name] = _f(lambda m, i=_i: tape.footprint_cells(m, i))
    SQL[_name] = rounded(f"""WITH {_src}, {trades('mbo' if _src is MBO else 'tape', _i)}, c AS (SELECT instrument_id, bucket_start, price, {B('sum(bv)', 'buy_volume')}, {B('sum(sv)', 'sell_volume')} FROM trades GROUP BY ALL)
SELECT *, buy_volume - sell_volume AS delta, buy_volume + sell_volume AS total_volume, CASE WHEN buy_volume + sell_volume > 0 THEN (buy_volume - sell_volume) / CAST(buy_volume + sell_volume AS DOUBLE) ELSE 0.0 END AS imbalance, {ENDS(_i)} FROM c""", "imbalance")
for _name, _f, _src, _i, _t in (("footprint_summary", _mbo, MBO, H1, 250_000_000), ("footprint_summary_tape", _tape, TAPE, D7, 1_000_000_000)):
    QUERIES[_name] = _f(lambda m, i=_i, t=_t: tape.footprint_summary(m, i, t))
    SQL[_name] = rounded(f"""WITH {_src}, {trades('mbo' if _src is MBO else 'tape', _i)}, b AS (SELECT instrument_id, bucket_start, {B('sum(bv)', 'buy_volume')}, {B('sum(sv)', 'sell_volume')}, {B(f'(max(price) - min(price)) // {_t}', 'price_range')} FROM trades GROUP BY ALL)
SELECT *, buy_volume - sell_volume AS delta, buy_volume + sell_volume AS total_volume, CAST(sum(buy_volume - sell_volume) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS BIGINT) AS cumulative_delta,
  (buy_volume + sell_volume) / CAST(price_range + 1 AS DOUBLE) AS absorption_ratio, {ENDS(_i)} FROM b""", "absorption_ratio")

_FLOW = f"""{trades('mbo', H1)}, flow AS (SELECT *, buy_volume - sell_volume AS delta, buy_volume + sell_volume AS consumption FROM (SELECT instrument_id, bucket_start, {B('sum(bv)', 'buy_volume')}, {B('sum(sv)', 'sell_volume')},
  count(*) FILTER (bv > 0) AS buy_trades, count(*) FILTER (sv > 0) AS sell_trades FROM trades GROUP BY ALL))"""
_FLOWX = f"*, CAST(sum(delta) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS BIGINT) AS cumulative_delta, {ENDS(H1)}"
QUERIES["order_flow_summary"] = _mbo(lambda m: tape.order_flow_summary(m, H1))
SQL["order_flow_summary"] = f"WITH {MBO}, {_FLOW} SELECT {_FLOWX} FROM flow"
QUERIES["order_acceleration"] = _mbo(lambda m: tape.order_acceleration(tape.order_flow_summary(m, H1)).select("instrument_id", "bucket_start", "order_accel_rate", "early_imbalance"))
SQL["order_acceleration"] = rounded(f"""WITH {MBO}, {_FLOW}, r AS (SELECT *, avg(consumption) OVER (PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base FROM flow),
q AS (SELECT *, CASE WHEN base > 0 THEN consumption / base ELSE 0.0 END AS rate FROM r)
SELECT instrument_id, bucket_start, sign(delta) * rate AS order_accel_rate, CASE WHEN rate >= 1.5 AND delta <> 0 THEN CAST(sign(delta) AS DOUBLE) ELSE 0.0 END AS early_imbalance FROM q""", "order_accel_rate")
QUERIES["liquidity_summary"] = _mbo(lambda m: tape.liquidity_summary(m, H1))
SQL["liquidity_summary"] = f"""WITH {MBO}, b AS (SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, CAST(coalesce(sum(size) FILTER (action='A'), 0) AS BIGINT) AS added_volume, CAST(coalesce(sum(size) FILTER (action='C'), 0) AS BIGINT) AS pulled_volume FROM mbo GROUP BY ALL)
SELECT *, added_volume - pulled_volume AS net_liquidity, {ENDS(H1)} FROM b"""

_PROFILE = f"profile AS (SELECT instrument_id, price, {B('sum(size)', 'volume')} FROM tape GROUP BY ALL)"
QUERIES["volume_profile"] = _tape(tape.volume_profile)
SQL["volume_profile"] = f"WITH {TAPE}, {_PROFILE} SELECT * FROM profile"
QUERIES["hvn_lvn"] = _tape(lambda t: tape.classify_nodes(tape.volume_profile(t)))
SQL["hvn_lvn"] = f"""WITH {TAPE}, {_PROFILE}, n AS (SELECT *, lag(volume) OVER w AS p, lead(volume) OVER w AS q FROM profile WINDOW w AS (PARTITION BY instrument_id ORDER BY price))
SELECT instrument_id, price, volume, coalesce(volume > p AND volume > q, false) AS is_hvn, coalesce(volume < p AND volume < q, false) AS is_lvn FROM n"""
QUERIES["profile_poc"] = _tape(lambda t: tape.point_of_control(tape.volume_profile(t)))
SQL["profile_poc"] = f"""WITH {TAPE}, {_PROFILE}, c AS (SELECT *, sum(CAST(price AS DOUBLE) * volume) OVER w / sum(volume) OVER w AS centre, (min(price) OVER w + max(price) OVER w) * 0.5 AS mid, max(volume) OVER w AS top, sum(volume) OVER w AS total FROM profile WINDOW w AS (PARTITION BY instrument_id))
SELECT instrument_id, price AS poc, volume AS poc_volume, CAST(total AS BIGINT) AS total_volume FROM c WHERE volume = top QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY abs(price - centre), abs(price - mid), price) = 1"""

_BARS = bars("bars", D7, "tape")
DOUBLES = ("o", "h", "l", "c", "volume", "buy_volume", "sell_volume", "delta", "range")
QUERIES["ohlcv_bars"] = _tape(lambda t: tape.ohlcv_bars(t, D7))
SQL["ohlcv_bars"] = rounded(f"WITH {TAPE}, {_BARS} SELECT * FROM bars", *DOUBLES)
QUERIES["fair_value_gaps"] = _mbo(lambda m: tape.fair_value_gaps(tape.ohlcv_bars(m, H1)))
SQL["fair_value_gaps"] = rounded(f"""WITH {MBO}, {bars('bars', H1, 'mbo')}, g AS (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start)),
u AS (SELECT instrument_id, bucket_start AS formed_at, availability_ts, 'Bull' AS fvg_type, h2 AS fvg_low, l AS fvg_high FROM g WHERE l > h2 UNION ALL SELECT instrument_id, bucket_start, availability_ts, 'Bear', h, l2 FROM g WHERE h < l2)
SELECT *, (fvg_low + fvg_high) / 2 AS fvg_mid, format('{{}}_{{}}_{{:.4f}}_{{:.4f}}', formed_at, fvg_type, fvg_low, fvg_high) AS fvg_id FROM u""", "fvg_low", "fvg_high", "fvg_mid")
_MEAN = lambda c, n, least: f"CASE WHEN count({c}) OVER (PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {least} THEN avg({c}) OVER (PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
QUERIES["effort_features"] = _tape(lambda t: tape.effort_features(tape.ohlcv_bars(t, D7)).select("instrument_id", "bucket_start", "atr20", "volume_sma20"))
SQL["effort_features"] = rounded(f"WITH {TAPE}, {_BARS} SELECT instrument_id, bucket_start, {_MEAN('range', 20, 20)} AS atr20, {_MEAN('volume', 20, 20)} AS volume_sma20 FROM bars", "atr20", "volume_sma20")

_W = "(PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN {} PRECEDING AND {})"
_FB = f"""base AS (SELECT *, {_MEAN('range', 20, 10)} AS atr_past, {_MEAN('volume', 20, 10)} AS vol_sma_past, sum(volume) OVER {_W.format(4, 'CURRENT ROW')} AS cum_volume,
    sum(delta) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS cum_delta, volume / (abs(range) + 1e-9) AS absorption, abs(delta) AS abs_delta,
    max(h) OVER {_W.format(5, '1 PRECEDING')} AS prior_h, min(l) OVER {_W.format(5, '1 PRECEDING')} AS prior_l, count(*) OVER {_W.format(5, '1 PRECEDING')} AS seen, count(*) OVER (PARTITION BY instrument_id) AS n_bars FROM bars),
  base2 AS (SELECT *, {_MEAN('cum_volume', 20, 10)} AS cum_sma, {_MEAN('abs_delta', 20, 10)} AS delta_sma, {_MEAN('absorption', 20, 10)} AS absorption_sma,
    coalesce(lag(CASE WHEN vol_sma_past > 0 THEN volume / vol_sma_past END) OVER (PARTITION BY instrument_id ORDER BY bucket_start), 0.0) AS effort_prev FROM base),
  k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS rn, greatest(3, least(50, greatest(3, count(*) OVER (PARTITION BY instrument_id) // 2))) AS eff FROM trend),
  sma AS (SELECT a.instrument_id, a.availability_ts, avg(b.c) AS sma FROM k a JOIN k b ON a.instrument_id = b.instrument_id AND b.rn < a.rn AND b.rn >= a.rn - a.eff GROUP BY a.instrument_id, a.availability_ts, a.eff HAVING count(*) >= greatest(3, a.eff // 2)),
  j AS (SELECT base2.*, s.sma, base2.instrument_id IN (SELECT instrument_id FROM sma) AS has_sma FROM base2 ASOF LEFT JOIN sma s ON base2.instrument_id = s.instrument_id AND base2.availability_ts >= s.availability_ts),
  e AS (SELECT *, range / atr_past AS er, volume / vol_sma_past AS ev, CASE WHEN cum_sma > 0 THEN cum_volume / cum_sma ELSE 0 END AS ec, CASE WHEN delta_sma > 0 THEN abs_delta / delta_sma ELSE 0 END AS ed, CASE WHEN absorption_sma > 0 THEN absorption / absorption_sma ELSE 0 END AS ea
    FROM j WHERE n_bars >= 25 AND seen = 5 AND atr_past > 0 AND vol_sma_past > 0 AND range > 0),
  f AS (SELECT *, CASE WHEN er > 1.1 AND h > prior_h AND c < prior_h AND (NOT has_sma OR coalesce(c < sma, false)) AND {{short}} THEN -1.0
    WHEN er > 1.1 AND l < prior_l AND c > prior_l AND (NOT has_sma OR coalesce(c > sma, false)) AND {{long}} THEN 1.0 END AS side FROM e)
SELECT instrument_id, bucket_start, bucket_end, availability_ts, CAST(side AS DOUBLE) AS fail_breakout, CASE WHEN side < 0 THEN prior_h ELSE prior_l END AS fb_break_level, c AS fb_entry_ref, er AS fb_effort_range_ratio, ev AS fb_effort_volume_ratio,
  ea AS fb_effort_result_ratio, volume AS fb_bar_volume, cum_volume AS fb_cum_volume, delta AS fb_delta, cum_delta AS fb_cum_delta, CASE WHEN volume > 0 THEN delta / volume ELSE 0.0 END AS fb_vol_imbalance, absorption AS fb_absorption,
  greatest(1.5, CASE WHEN side < 0 THEN h - prior_h ELSE prior_l - l END) AS fb_risk_pts FROM f WHERE side IS NOT NULL AND {{hold}}"""
_FB_COLUMNS = ("fail_breakout", "fb_break_level", "fb_entry_ref", "fb_effort_range_ratio", "fb_effort_volume_ratio", "fb_effort_result_ratio", "fb_bar_volume", "fb_cum_volume", "fb_delta", "fb_cum_delta", "fb_vol_imbalance", "fb_absorption", "fb_risk_pts")
_GATES = {"bar": ("ev > 1.2", "ev > 1.2"), "cum": ("ec > 1.2", "ec > 1.2"), "delta": ("ed > 1.2 AND delta > 0", "ed > 1.2 AND delta < 0"), "effort_result": ("ev > 1.2 AND ea > 1.2",) * 2}
_HOLDS = {"none": "true", "persist": "effort_prev > 1.2 * 0.85", "absorption": "ea > 1.2", "imbalance": "(CASE WHEN volume > 0 THEN delta / volume ELSE 0.0 END) * -side > 0.15"}
for _mode, _hold, _prio in (("bar", "none", "structure_first"), ("cum", "persist", "volume_first"), ("delta", "imbalance", "structure_first"), ("effort_result", "absorption", "volume_first"), ("cum", "none", "volume_first"), ("delta", "none", "volume_first")):
    _name = f"failed_breakout_{_mode}_{_hold}"
    QUERIES[_name] = _mbo(lambda m, mode=_mode, hold=_hold, prio=_prio: tape.failed_breakouts(m, H1, H4, hold, vol_mode=mode, priority=prio, rth_only=False))
    SQL[_name] = rounded(f"WITH {MBO}, {bars('bars', H1, 'mbo')}, {bars('trend', H4, 'mbo')}, " + _FB.format(short=_GATES[_mode][0], long=_GATES[_mode][1], hold=_HOLDS[_hold]), *_FB_COLUMNS)
