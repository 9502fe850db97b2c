"""Registered queries of ticks, hypothesis research and reports (no SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import auction, book, edges, labels, period, quality, regimes, research, symbolic, tape, ticks
from ..sources import mbo as source
from .relational_queries import _STORY, ORDER, _story, book_descriptors, sequences
from .sql import rounded
from .model_queries import AXES, _axes
from .tape_queries import H1, H4, _mbo, tidy

#: Specs whose intervals suit the driver's sparse events.
HOUR = 60 * research.MINUTE
SPECS: list[research.GapSpec | research.BreakoutSpec] = [research.GapSpec(4 * HOUR, HOUR, w * HOUR, 1.4, v) for w in (24, 72) for v in (1.0, 1.2)]
SPECS += [research.BreakoutSpec(HOUR, 4 * HOUR, k, 1.1, m, "volume_first", h) for k in (3, 5) for m in ("bar", "cum") for h in ("none", "persist")]
NAMES = [s.name() for s in SPECS]


def _clock(m: DataFrame) -> DataFrame:
    bars = tape.ohlcv_bars(m, H1)
    pulses = research.materialize(m, SPECS)
    rows = labels.forward_returns(bars, "c", 2, ["instrument_id"], ["bucket_start"])
    return _pooled(research.on_clock(rows.select("instrument_id", "availability_ts", "c", "volume", "delta", F.col("forward_return").alias("ret")), pulses, NAMES))


def _pooled(df: DataFrame) -> DataFrame:
    """Both contracts on one clock; the instrument's number, as nanoseconds, tells equal times apart."""
    return df.withColumn("clock", F.col("availability_ts") + F.col("instrument_id"))


def _coverage(s: SparkSession, d: str) -> DataFrame:
    m = source.events_as_mbo(s, d)
    bars = tape.ohlcv_bars(m, H1).select("instrument_id", "bucket_start", "c", "volume", "delta", "range")
    both = bars.join(book_descriptors(m, H1), ["instrument_id", "bucket_start"]).orderBy("instrument_id", "bucket_start").toPandas()
    return tidy(research.coverage(s, both[["volume", "delta", "range"]], both[["add_count", "cancel_count", "trade_count", "trade_volume", "cancel_ratio", "spread", "depth_change"]], both["c"].to_numpy(), 50))


def _ssl(m: DataFrame) -> DataFrame:
    windows = sequences(tape.ohlcv_bars(m, H1), ["volume", "delta", "range"], 4, 1, ["instrument_id"], ["availability_ts"])
    return research.ssl_folds(_pooled(windows), "window", "clock")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tick_stream": _mbo(lambda m: ticks.tick_stream(m, 1, 2, H1)),
    "tick_events": _mbo(lambda m: ticks.tick_stream(m, 1, 2, None)),
    "hypothesis_pulses": _mbo(lambda m: research.materialize(m, SPECS)),
    "signal_screen": _mbo(lambda m: research.screen(_clock(m), [*NAMES, "delta"], "ret", "clock", n=50)),
    "causal_gate": _mbo(lambda m: research.causal_gate(_clock(m), ["delta"], "volume").select("instrument_id", "availability_ts", "delta__gated")),
    "fold_selection": _mbo(lambda m: research.walk_forward_select(_clock(m), [*NAMES, "delta", "volume"], "ret", "clock", n=20)[0]),
    "selection_null": _mbo(lambda m: research.walk_forward_select(_clock(m), [*NAMES, "delta", "volume"], "ret", "clock", n=20)[1]),
    "coverage_metrics": _coverage,
    "ssl_folds": _mbo(_ssl),
}
SQL: dict[str, str] = {}


def _classed(s: SparkSession, d: str) -> DataFrame:
    """Stories with stand-ins for the lagged columns that lead and sequence classes read."""
    b = _story(s, d).withColumns({"proj_outside_volume_share": F.col("value") / 100, "path_beyond_asia_ticks": F.col("value") / 20, "vp_balance": (F.col("event_type") == "view").cast("double"), "vp_imbalance": (F.col("event_type") == "signup").cast("double"), "vp_fsm_break": F.col("tested")})
    b = labels.causal_lags(b, ["proj_outside_volume_share", "path_beyond_asia_ticks", "vp_balance", "vp_imbalance", "vp_fsm_break"], ["user_id"], (3, 5), ORDER)
    return period.auction_sequence(period.volume_price_lead(b)).withColumn("y", F.col("accepted"))


_L = "lag({}, {}) OVER (PARTITION BY user_id ORDER BY availability_ts, event_id)"
_CLASSED = f"""WITH {_STORY}, l AS (SELECT *, coalesce({_L.format('value', 5)}, 0) AS v5, coalesce({_L.format("event_type = 'view'", 5)}, false) AS bal5, coalesce({_L.format("event_type = 'signup' OR event_type = 'click'", 3)}, false) AS imb3 FROM story),
c AS (SELECT accepted AS y, CASE WHEN v5 / 100 >= 0.35 AND v5 / 20 >= 4 THEN 'both_already' WHEN v5 / 100 >= 0.35 THEN 'volume_lead' WHEN v5 / 20 >= 4 THEN 'price_lead' ELSE 'neither' END AS lead_class,
  CASE WHEN value / 20 > 0.5 THEN CASE WHEN v5 / 20 > 0.5 THEN 'already_expanding' WHEN bal5 AND imb3 THEN 'balance_imbalance_expansion' WHEN bal5 THEN 'balance_then_expansion' WHEN imb3 THEN 'imbalance_then_expansion' ELSE 'already_expanding' END
    WHEN (bal5 AND NOT v5 / 20 > 0.5) OR event_type = 'view' THEN 'still_balanced' ELSE 'unclassified' END AS sequence_class FROM l)"""
_TABLE = """, g AS (SELECT {c}, count(*) AS n, CAST(sum(y) AS DOUBLE) AS n_pos, CAST(count(*) - sum(y) AS DOUBLE) AS n_neg, avg(y) AS pos_rate FROM c GROUP BY 1), e AS (SELECT unnest({classes}) AS {c}),
j AS (SELECT {c}, coalesce(n, 0) AS n, coalesce(n_pos, 0.0) AS n_pos, coalesce(n_neg, 0.0) AS n_neg, coalesce(pos_rate, 0.0) AS pos_rate FROM e LEFT JOIN g USING ({c}))
SELECT *, n_pos / sum(n_pos) OVER () AS share_of_successes, n_neg / sum(n_neg) OVER () AS share_of_failures FROM j"""
_SHARES = ("n_pos", "n_neg", "pos_rate", "share_of_successes", "share_of_failures")
for _name, _column, _classes in (("volume_price_lead", "lead_class", period.LEADS), ("auction_sequence", "sequence_class", period.SEQUENCES)):
    QUERIES[_name] = lambda s, d, c=_column, k=_classes: tidy(period.class_table(_classed(s, d), c, k))
    SQL[_name] = rounded(_CLASSED + _TABLE.format(c=_column, classes=list(_classes)), *_SHARES)


def _gated(m: DataFrame) -> DataFrame:
    bars = labels.forward_returns(tape.ohlcv_bars(m, H1), "c", 2, ["instrument_id"], ["bucket_start"]).withColumnRenamed("forward_return", "ret")
    depth = book.depth_bars(m, [H1]).select("instrument_id", "bucket_start", "path_pressure", "path_imbalance_delta", "queue_pressure", "iceberg_hit")
    return period.depth_gates(bars.join(depth, ["instrument_id", "bucket_start"]), ["delta"])


QUERIES["depth_gates"] = _mbo(lambda m: _gated(m).select("instrument_id", "availability_ts", "delta__depth__pressure_q0p7", "delta__depth__queue_q0p7", "delta__depth__iceberg", "delta__depth__sign"))
QUERIES["gate_layers"] = _mbo(lambda m: period.layers(_pooled(_gated(m)), "delta__depth__sign", "ret", 50, order="clock"))
QUERIES["symbolic_search"] = _mbo(lambda m: symbolic.search(_pooled(_gated(m)), ["delta", "volume", "range", "path_pressure"], "ret", "clock"))


def _edges(m: DataFrame) -> DataFrame:
    states = auction.action_states(m, H4, H1)
    return edges.search_edges(states, quality.deceptive_buckets(quality.deceptive_scores(m), H1), m, edges.edge_grid())[0]


def _masked(m: DataFrame) -> DataFrame:
    t = ticks.tick_stream(m, 1, 2, H1).withColumn("pair", F.lit(1))
    w = sequences(t, list(ticks.FEATURES), 4, 2, ["pair"], ["availability_ts"])
    last = F.element_at("window", -1)
    at = {n: i for i, n in enumerate(ticks.FEATURES)}
    rows = w.withColumns({"trap": F.get(last, F.lit(at["trap_setup"])) != 0, "phase": regimes.heuristic_phase(F.get(last, F.lit(at["in_value"])), F.get(last, F.lit(at["trail_bid"])), F.get(last, F.lit(at["trail_ask"])))})
    return regimes.masked_windows(rows.select("availability_ts", "window", "trap", "phase")).select("availability_ts", "trap", "phase", "n_masked")


QUERIES["edge_search"] = _mbo(_edges)
QUERIES["structural_masks"] = _mbo(_masked)
QUERIES["causal_regimes"] = _mbo(lambda m: regimes.causal_regimes(tape.ohlcv_bars(m, H1), ["volume", "delta", "range"]))
QUERIES["silhouette"] = lambda s, d: tidy(regimes.silhouette(_axes(s, d), AXES, "label", "vec_id"))
