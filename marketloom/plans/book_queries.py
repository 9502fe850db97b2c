"""Registered queries that replay events in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import auction, book, quality, tape
from .sql import MBO, TAPE, rounded
from .tape_queries import D28, H1, H4, _mbo, _tape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "top_of_book": _mbo(book.top_of_book),
    "crossed_count": _mbo(lambda m: book.crossed_events(book.top_of_book(m))),
    "ofi_events": _mbo(lambda m: book.order_flow_imbalance(book.top_of_book(m)).select("instrument_id", "sequence", "ofi", "ofi_cumulative")),
    "ofi_buckets": _mbo(lambda m: book.ofi_by_bucket(book.top_of_book(m), H1)),
    "depth_bars": _mbo(lambda m: book.depth_bars(m, [H1, H4])),
    "vwap_walk": _mbo(lambda m: book.depth_bars(m, [H4]).select("instrument_id", "bucket_start", book.sweep_vwap(F.col("ask_px"), F.col("ask_sz"), 20).alias("buy_vwap"), book.sweep_vwap(F.col("bid_px"), F.col("bid_sz"), 20).alias("sell_vwap"))),
    "icebergs": _mbo(book.icebergs),
    "noise_filter": _mbo(quality.filter_noise),
    "deceptive_score": _mbo(quality.deceptive_scores),
    "deceptive_filter": _mbo(lambda m: quality.filter_deceptive(quality.deceptive_scores(m))),
    "deceptive_buckets": _mbo(lambda m: quality.deceptive_buckets(quality.deceptive_scores(m), H1)),
    "value_area_bucket": _tape(lambda t: auction.developing_value_area(t, D28)),
    "developing_value_area": _mbo(lambda m: auction.developing_value_area(m, H1, cumulative=True, by_session=True)),
    "auction_states": _mbo(lambda m: auction.auction_states(m, H1)),
    "fixed_range": _mbo(lambda m: auction.attach_fixed_range(auction.auction_states(m, H1), m, H1).select("instrument_id", "bucket_start", *auction.RANGE_COLUMNS)),
    "action_states": _mbo(lambda m: auction.action_states(m, H4, H1)),
    "auction_fsm": _mbo(lambda m: auction.signal_columns(auction.action_states(m, H4, H1)).select("instrument_id", "bucket_start", *auction.SIGNALS)),
    "failed_gap": _mbo(lambda m: auction.failed_gaps(tape.ohlcv_bars(m, H4), tape.ohlcv_bars(m, H1), 48 * H1)),
}


def _truth(m: DataFrame) -> DataFrame:
    return auction.market_truth(auction.action_states(m, H4, H1), quality.bucketed_deception(m, H1), auction.TruthRules(hold=2))


def _windows(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = tape.market_windows(m, book.top_of_book(m), H1)
    return both.where("instrument_id = 1"), both.where("instrument_id = 2")


QUERIES |= {
    "market_truth": _mbo(_truth),
    "edge_trades": _mbo(lambda m: auction.edge_trades(_truth(m), m)),
    "edge_summary": _mbo(lambda m: auction.summarize_trades(auction.edge_trades(_truth(m), m))),
    "cross_market": _mbo(lambda m: tape.cross_market(*_windows(m), H1, 6)),
    "cross_market_latency": _mbo(lambda m: tape.cross_market(*_windows(m), H1, 6, latency_ns=60_000_000_000)),
}
SQL: dict[str, str] = {}

SQL["icebergs"] = f"""WITH RECURSIVE {MBO}, e AS (SELECT instrument_id, price, action, size, row_number() OVER (PARTITION BY instrument_id, price ORDER BY event_ts, sequence) AS rn FROM mbo WHERE action IN ('A','C','T','F')),
s AS (SELECT DISTINCT instrument_id, price, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS resting, CAST(0 AS BIGINT) AS peak, CAST(0 AS BIGINT) AS executed, CAST(0 AS BIGINT) AS at_add, CAST(0 AS BIGINT) AS refills FROM e
  UNION ALL SELECT s.instrument_id, s.price, e.rn, CASE WHEN action='A' THEN resting + size ELSE greatest(0, resting - size) END, CASE WHEN action='A' THEN greatest(peak, resting + size) ELSE peak END,
    CASE WHEN action IN ('T','F') THEN executed + size ELSE executed END, CASE WHEN action='A' THEN executed ELSE at_add END, CASE WHEN action='A' AND executed > at_add THEN refills + 1 ELSE refills END
  FROM s JOIN e ON s.instrument_id = e.instrument_id AND s.price = e.price AND e.rn = s.rn + 1),
z AS (SELECT instrument_id, price, arg_max(peak, rn) AS peak_display, arg_max(executed, rn) AS executed, arg_max(refills, rn) AS replenish_count FROM s GROUP BY 1, 2)
SELECT *, replenish_count >= 2 AND executed >= 2.0 * peak_display AS is_iceberg FROM z WHERE peak_display > 0"""

SQL["value_area_bucket"] = f"""WITH RECURSIVE {TAPE}, lv AS (SELECT instrument_id, event_ts - event_ts % {D28} AS bucket_start, price, CAST(sum(size) AS BIGINT) AS v, row_number() OVER (PARTITION BY instrument_id, event_ts - event_ts % {D28} ORDER BY price) AS i FROM tape GROUP BY 1, 2, 3),
g AS (SELECT instrument_id, bucket_start, CAST(sum(v) AS BIGINT) AS total, sum(CAST(price AS DOUBLE) * v) / sum(v) AS centre, (min(price) + max(price)) * 0.5 AS mid, max(v) AS top FROM lv GROUP BY 1, 2),
p AS (SELECT instrument_id, bucket_start, price AS poc, i, v, total FROM lv JOIN g USING (instrument_id, bucket_start) WHERE v = top QUALIFY row_number() OVER (PARTITION BY instrument_id, bucket_start ORDER BY abs(price - centre), abs(price - mid), price) = 1),
r AS (SELECT instrument_id, bucket_start, poc, total, i AS lo, i AS hi, v AS acc FROM p
  UNION ALL SELECT r.instrument_id, r.bucket_start, poc, total, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN lo ELSE lo - 1 END, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN hi + 1 ELSE hi END, acc + greatest(coalesce(u.v, -1), coalesce(d.v, -1))
  FROM r LEFT JOIN lv u ON u.instrument_id = r.instrument_id AND u.bucket_start = r.bucket_start AND u.i = hi + 1 LEFT JOIN lv d ON d.instrument_id = r.instrument_id AND d.bucket_start = r.bucket_start AND d.i = lo - 1
  WHERE acc < CAST(0.7 AS DOUBLE) * total AND (u.v IS NOT NULL OR d.v IS NOT NULL)),
f AS (SELECT instrument_id, bucket_start, poc, total, arg_max(lo, acc) AS lo, arg_max(hi, acc) AS hi FROM r GROUP BY 1, 2, 3, 4)
SELECT f.instrument_id, f.bucket_start, poc, h.price AS vah, l.price AS val, total AS total_volume, coalesce(poc - lag(poc) OVER (PARTITION BY f.instrument_id ORDER BY f.bucket_start), 0) AS poc_migration, CAST(0 AS BIGINT) AS vp_liquidity_session, f.bucket_start + {D28} AS bucket_end, f.bucket_start + {D28} AS availability_ts
FROM f JOIN lv l ON l.instrument_id = f.instrument_id AND l.bucket_start = f.bucket_start AND l.i = f.lo JOIN lv h ON h.instrument_id = f.instrument_id AND h.bucket_start = f.bucket_start AND h.i = f.hi"""

#: The book in SQL: each order's state after each of its events by recursion, then every order as of every event.
TOB = f"""{MBO}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY event_ts, sequence) AS n FROM mbo),
oe AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, order_id ORDER BY n) AS k FROM n WHERE action IN ('A','C','M')),
os AS (SELECT DISTINCT instrument_id, order_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, false AS live, false AS bid, CAST(0 AS BIGINT) AS price, CAST(0 AS BIGINT) AS size, 0 AS unknown, 0 AS twice FROM oe
  UNION ALL SELECT os.instrument_id, os.order_id, oe.n, oe.k, CASE action WHEN 'A' THEN true WHEN 'C' THEN live AND oe.size > 0 AND os.size > oe.size ELSE live END, CASE WHEN action='A' THEN side='B' ELSE bid END,
    CASE WHEN action IN ('A','M') THEN oe.price ELSE os.price END, CASE WHEN action IN ('A','M') THEN oe.size WHEN live THEN os.size - oe.size ELSE os.size END,
    CASE WHEN action IN ('C','M') AND NOT live THEN 1 ELSE 0 END, CASE WHEN action='A' AND live THEN 1 ELSE 0 END
  FROM os JOIN oe ON os.instrument_id = oe.instrument_id AND os.order_id = oe.order_id AND oe.k = os.k + 1),
eo AS (SELECT n.instrument_id, n.n, i.order_id FROM n JOIN (SELECT DISTINCT instrument_id, order_id FROM oe) i USING (instrument_id)),
lv AS (SELECT eo.instrument_id, eo.n, os.bid, os.price, sum(os.size) AS size FROM eo ASOF JOIN os ON eo.instrument_id = os.instrument_id AND eo.order_id = os.order_id AND eo.n >= os.n WHERE os.live GROUP BY ALL),
best AS (SELECT instrument_id, n, max(price) FILTER (bid) AS best_bid, CAST(arg_max(size, price) FILTER (bid) AS BIGINT) AS bid_size, min(price) FILTER (NOT bid) AS best_ask, CAST(arg_min(size, price) FILTER (NOT bid) AS BIGINT) AS ask_size FROM lv GROUP BY 1, 2),
refs AS (SELECT instrument_id, n, sum(unknown) AS u, sum(twice) AS t FROM os WHERE k > 0 GROUP BY 1, 2),
tob AS (SELECT n.instrument_id, n.event_ts, n.sequence, best_bid, bid_size, best_ask, ask_size, CAST(sum(coalesce(u, 0)) OVER w AS BIGINT) AS unknown_refs, CAST(sum(coalesce(t, 0)) OVER w AS BIGINT) AS duplicate_adds
  FROM n LEFT JOIN best USING (instrument_id, n) LEFT JOIN refs USING (instrument_id, n) WINDOW w AS (PARTITION BY n.instrument_id ORDER BY n.n))"""
SQL["top_of_book"] = f"WITH RECURSIVE {TOB} SELECT * FROM tob"
SQL["crossed_count"] = f"WITH RECURSIVE {TOB} SELECT instrument_id, count(*) AS n_events, count(*) FILTER (best_bid >= best_ask) AS crossed, max(unknown_refs) AS unknown_refs, max(duplicate_adds) AS duplicate_adds FROM tob GROUP BY 1"

_LAG = "PARTITION BY instrument_id ORDER BY event_ts, sequence"
OFI = f"""{TOB}, q AS (SELECT *, lag(best_bid) OVER w AS b1, lag(bid_size) OVER w AS bs1, lag(best_ask) OVER w AS a1, lag(ask_size) OVER w AS as1 FROM tob WINDOW w AS ({_LAG})),
ofi AS (SELECT *, coalesce(CASE WHEN best_bid >= b1 THEN bid_size ELSE 0 END - CASE WHEN best_bid <= b1 THEN bs1 ELSE 0 END + CASE WHEN best_ask >= a1 THEN as1 ELSE 0 END - CASE WHEN best_ask <= a1 THEN ask_size ELSE 0 END, 0) AS ofi FROM q)"""
SQL["ofi_events"] = f"WITH RECURSIVE {OFI} SELECT instrument_id, sequence, ofi, CAST(sum(ofi) OVER ({_LAG}) AS BIGINT) AS ofi_cumulative FROM ofi"
SQL["ofi_buckets"] = f"""WITH RECURSIVE {OFI}, b AS (SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, CAST(sum(ofi) AS BIGINT) AS ofi FROM ofi GROUP BY 1, 2)
SELECT *, bucket_start + {H1} AS bucket_end, bucket_start + {H1} AS availability_ts, CAST(sum(ofi) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS BIGINT) AS ofi_cumulative FROM b"""

SQL["market_windows"] = f"""WITH RECURSIVE {TOB}, w AS (SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, arg_max((best_bid + best_ask) / 2.0::DOUBLE, (event_ts, sequence)) AS close, arg_max(best_bid, (event_ts, sequence)) AS bid, arg_max(best_ask, (event_ts, sequence)) AS ask
  FROM tob WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL GROUP BY 1, 2), d AS (SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta FROM mbo WHERE action = 'T' GROUP BY 1, 2)
SELECT coalesce(w.instrument_id, d.instrument_id) AS instrument_id, coalesce(w.bucket_start, d.bucket_start) AS bucket_start, close, bid, ask, delta FROM w FULL JOIN d ON w.instrument_id = d.instrument_id AND w.bucket_start = d.bucket_start"""
QUERIES["market_windows"] = _mbo(lambda m: tape.market_windows(m, book.top_of_book(m), H1))

#: Cumulative value areas by session run in SQL (the events lie in January, five hours behind UTC).
_ET_MINUTE = "(hour(make_timestamp(bucket_start // 1000) - INTERVAL 5 HOUR) * 60 + minute(make_timestamp(bucket_start // 1000) - INTERVAL 5 HOUR))"


def developing(interval: int) -> str:
    """dva: cumulative value areas of `mbo` trades with a reset at each session, and bar statistics."""
    return f"""{MBO}, tr AS (SELECT *, event_ts - event_ts % {interval} AS bucket_start FROM mbo WHERE action = 'T'),
bl AS (SELECT instrument_id, bucket_start, price, CAST(sum(size) AS BIGINT) AS v FROM tr GROUP BY 1, 2, 3),
bk AS (SELECT *, CASE WHEN {_ET_MINUTE} >= 1080 OR {_ET_MINUTE} < 180 THEN 0 WHEN {_ET_MINUTE} < 570 THEN 1 ELSE 2 END AS session FROM (SELECT DISTINCT instrument_id, bucket_start FROM bl)),
rn AS (SELECT instrument_id, bucket_start, session, CAST(sum(CASE WHEN p IS NOT NULL AND p <> session THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS BIGINT) AS session_run
  FROM (SELECT *, lag(session) OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS p FROM bk)),
lv AS (SELECT b.instrument_id, b.bucket_start, bl.price, CAST(sum(bl.v) AS BIGINT) AS v, row_number() OVER (PARTITION BY b.instrument_id, b.bucket_start ORDER BY bl.price) AS i
  FROM rn b JOIN rn a ON a.instrument_id = b.instrument_id AND a.session_run = b.session_run AND a.bucket_start <= b.bucket_start JOIN bl ON bl.instrument_id = a.instrument_id AND bl.bucket_start = a.bucket_start GROUP BY 1, 2, 3),
g AS (SELECT instrument_id, bucket_start, CAST(sum(v) AS BIGINT) AS total, sum(CAST(price AS DOUBLE) * v) / sum(v) AS centre, (min(price) + max(price)) * 0.5 AS mid, max(v) AS top FROM lv GROUP BY 1, 2),
p AS (SELECT instrument_id, bucket_start, price AS poc, i, v, total FROM lv JOIN g USING (instrument_id, bucket_start) WHERE v = top QUALIFY row_number() OVER (PARTITION BY instrument_id, bucket_start ORDER BY abs(price - centre), abs(price - mid), price) = 1),
r AS (SELECT instrument_id, bucket_start, poc, total, i AS lo, i AS hi, v AS acc FROM p
  UNION ALL SELECT r.instrument_id, r.bucket_start, poc, total, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN lo ELSE lo - 1 END, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN hi + 1 ELSE hi END, acc + greatest(coalesce(u.v, -1), coalesce(d.v, -1))
  FROM r LEFT JOIN lv u ON u.instrument_id = r.instrument_id AND u.bucket_start = r.bucket_start AND u.i = hi + 1 LEFT JOIN lv d ON d.instrument_id = r.instrument_id AND d.bucket_start = r.bucket_start AND d.i = lo - 1
  WHERE acc < CAST(0.7 AS DOUBLE) * total AND (u.v IS NOT NULL OR d.v IS NOT NULL)),
f AS (SELECT instrument_id, bucket_start, poc, total, arg_max(lo, acc) AS lo, arg_max(hi, acc) AS hi FROM r GROUP BY 1, 2, 3, 4),
dva AS (SELECT f.instrument_id, f.bucket_start, poc, h.price AS vah, l.price AS val, total AS total_volume, CASE WHEN lag(session) OVER w = session THEN poc - lag(poc) OVER w ELSE 0 END AS poc_migration, CAST(session AS BIGINT) AS vp_liquidity_session,
    f.bucket_start + {interval} AS bucket_end, f.bucket_start + {interval} AS availability_ts, session_run
  FROM f JOIN lv l ON l.instrument_id = f.instrument_id AND l.bucket_start = f.bucket_start AND l.i = f.lo JOIN lv h ON h.instrument_id = f.instrument_id AND h.bucket_start = f.bucket_start AND h.i = f.hi
    JOIN rn ON rn.instrument_id = f.instrument_id AND rn.bucket_start = f.bucket_start WINDOW w AS (PARTITION BY f.instrument_id ORDER BY f.bucket_start)),
bs AS (SELECT instrument_id, bucket_start, max(price) AS high, min(price) AS low, arg_max(price, (event_ts, sequence)) AS close, CAST(sum(size) AS BIGINT) AS bucket_volume FROM tr GROUP BY 1, 2)"""


SQL["developing_value_area"] = f"WITH RECURSIVE {developing(H1)} SELECT * EXCLUDE (session_run) FROM dva"

_RUN = "PARTITION BY instrument_id, session_run ORDER BY bucket_start"


def states(interval: int) -> str:
    """st: auction states of bars."""
    return f"""{developing(interval)}, dd AS (SELECT *, lag(poc) OVER w AS decision_poc, lag(vah) OVER w AS decision_vah, lag(val) OVER w AS decision_val FROM dva WINDOW w AS ({_RUN})),
iv AS (SELECT d.instrument_id, d.bucket_start, CAST(sum(bl.v) AS BIGINT) AS in_value_volume FROM dd d JOIN bl ON bl.instrument_id = d.instrument_id AND bl.bucket_start = d.bucket_start AND bl.price BETWEEN d.decision_val AND d.decision_vah GROUP BY 1, 2),
s1 AS (SELECT dd.*, high, low, close, bucket_volume, coalesce(in_value_volume, 0) AS in_value_volume, high - low AS range FROM dd JOIN bs USING (instrument_id, bucket_start) LEFT JOIN iv USING (instrument_id, bucket_start)),
s2 AS (SELECT *, CASE WHEN bucket_volume > 0 THEN in_value_volume / CAST(bucket_volume AS DOUBLE) ELSE 0.0 END AS in_value_fraction, quantile_cont(CAST(range AS DOUBLE), 0.5) OVER ({_RUN} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS base,
    coalesce(high > lag(high) OVER w, false) AS made_new_high, coalesce(low < lag(low) OVER w, false) AS made_new_low, close BETWEEN decision_val AND decision_vah AS close_in_value,
    greatest(0, coalesce(high - decision_vah, 0)) AS excess_upper, greatest(0, coalesce(decision_val - low, 0)) AS excess_lower FROM s1 WINDOW w AS ({_RUN})),
s3 AS (SELECT * EXCLUDE (base), CASE WHEN base > 0 THEN range / base END AS expansion_ratio FROM s2),
s4 AS (SELECT *, coalesce(expansion_ratio >= 1.5 AND (made_new_high OR made_new_low), false) AS is_expansion, (made_new_high OR made_new_low) AND close_in_value AS pullback_defended FROM s3),
s5 AS (SELECT *, close_in_value AND NOT is_expansion AND in_value_fraction >= 0.6 AS raw FROM s4),
s6 AS (SELECT *, avg(CAST(raw AS DOUBLE)) OVER ({_RUN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS balance_confidence FROM s5),
st AS (SELECT * EXCLUDE (raw), raw AND balance_confidence >= CAST(2 AS DOUBLE) / 3 AS is_balanced FROM s6)"""


SQL["auction_states"] = rounded(f"WITH RECURSIVE {states(H1)} SELECT * FROM st", "in_value_fraction", "expansion_ratio", "balance_confidence")

QUERIES["action_states_plain"] = _mbo(lambda m: auction.action_states(m, H4, H1, fixed_range=False))
_PROFILE = ", ".join(f"st.{c}" for c in auction.PROFILE)
SQL["action_states_plain"] = rounded(
    f"""WITH RECURSIVE {states(H4)}, sb AS (SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, max(price) AS high, min(price) AS low, arg_max(price, (event_ts, sequence)) AS close, CAST(sum(size) AS BIGINT) AS bucket_volume,
    CAST(sum(CASE side WHEN 'B' THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE side WHEN 'A' THEN size ELSE 0 END) AS BIGINT) AS sell_volume FROM tr GROUP BY 1, 2),
b1 AS (SELECT *, bucket_start + {H1} AS bucket_end, bucket_start + {H1} AS availability_ts, buy_volume - sell_volume AS delta, buy_volume + sell_volume AS consumption FROM sb),
b2 AS (SELECT b1.*, {_PROFILE} FROM b1 ASOF LEFT JOIN st ON b1.instrument_id = st.instrument_id AND b1.availability_ts >= st.availability_ts),
b3 AS (SELECT * REPLACE (coalesce(is_balanced, false) AS is_balanced, coalesce(is_expansion, false) AS is_expansion), high - low AS range, close BETWEEN decision_val AND decision_vah AS close_in_value, greatest(decision_vah - decision_val, 1) * 0.2 AS touch FROM b2 WHERE decision_poc IS NOT NULL),
b4 AS (SELECT *, CASE WHEN lag(range) OVER w > 0 THEN range / CAST(lag(range) OVER w AS DOUBLE) END AS expansion_ratio, coalesce(high > lag(high) OVER w, false) AS made_new_high, coalesce(low < lag(low) OVER w, false) AS made_new_low,
    CASE WHEN abs(low - decision_val) <= touch AND sell_volume > buy_volume AND close_in_value THEN 1.0 WHEN abs(high - decision_vah) <= touch AND buy_volume > sell_volume AND close_in_value THEN -1.0 ELSE 0.0 END::DOUBLE AS absorb,
    CASE WHEN high > decision_vah AND close_in_value AND delta < 0 THEN -1.0 WHEN low < decision_val AND close_in_value AND delta > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS look_fail,
    avg(consumption) OVER (PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base, coalesce(lag(vp_liquidity_session) OVER w, vp_liquidity_session) = vp_liquidity_session AS same, coalesce(lag(is_balanced) OVER w, true) AS was
  FROM b3 WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start)),
b5 AS (SELECT *, is_balanced AND (((made_new_high OR made_new_low) AND close_in_value) OR absorb <> 0 OR look_fail <> 0) AS pullback_defended, CASE WHEN same AND base > 0 THEN consumption / base ELSE 0.0 END AS rate FROM b4)
SELECT * EXCLUDE (touch, base, same, was, rate), sign(delta) * rate AS order_accel_rate, CASE WHEN rate >= 1.5 AND delta <> 0 AND (is_balanced OR was) THEN CAST(sign(delta) AS DOUBLE) ELSE 0.0 END AS early_imbalance FROM b5""",
    "in_value_fraction",
    "expansion_ratio",
    "order_accel_rate",
)
