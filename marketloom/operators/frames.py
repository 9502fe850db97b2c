"""Behaviour frames: session and scenario summaries, states, predictions and their guards.

A state frame says what is known now; predictions stand apart from it, with
where they come from and whether they may be backtested.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import ASIA, LONDON, session_label, trade_date
from ..functions.windows import run_ids
from .period import TS

SETUP, DONE = "setup_availability_ts", "outcome_available_ts"
SESSION = "vp_liquidity_session"
#: Columns of a state frame where they exist, and starts of such names (fixed names).
STATE = (
    "signal_quality", "signal_evidence", "vp_balance", "vp_imbalance", "vp_fsm_break", "vp_fsm_retest", "vp_fsm_expand", "vp_absorb", "vp_look_fail", "deceptive_score", "real_liquidity_ratio",
    "decision_poc", "decision_vah", "decision_val", "auction_phase", "asia_poc", "asia_vah", "asia_val", "composite_poc", "composite_vah", "composite_val",
    "mem_time_since_break", "mem_time_since_retest", "mem_dwell_inside_value", "mem_poc_migration_abs", "mem_value_transfer_gradual",
)
STATE_STARTS = ("proj_", "lf_", "rel_")
#: Numbers of a state vector.
VECTOR = ("vp_balance", "vp_expansion", "vp_close_in_value", "vp_absorb", "vp_look_fail", "vp_fsm_break", "vp_fsm_retest", "vp_fsm_expand", "vp_early_imbalance", SESSION, "deceptive_score", "real_liquidity_ratio", "signal_quality")
#: Outputs of trading, which a behaviour frame never has.
TRADE_COLUMNS = ("pnl", "position", "order_qty", "edge_pnl", "edge_signal", "entry_price", "exit_price", "stop_price", "target_price")
TRADE_STARTS = ("trade_", "exec_")
DECISIONS = (("decision_vah", "decision_val", "decision_poc"), ("vp_upper", "vp_lower", "vp_mid"))


def _runs(states: DataFrame, keys: list[str]) -> DataFrame:
    return run_ids(states.where(F.col(SESSION).isNotNull()), keys, [TS], SESSION, "session_run")


def session_profiles(states: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each stretch of a liquidity session: its times, bars, and the decision and completed areas at its last bar."""
    g = _runs(states, keys).groupBy(*keys, "session_run")
    last = lambda c: F.max_by(F.col(c).cast("double"), TS) if c in states.columns else F.lit(None).cast("double")
    made = {"decision_poc": "decision_poc", "decision_vah": "decision_vah", "decision_val": "decision_val", "completed_poc": "poc", "completed_vah": "vah", "completed_val": "val"}
    rows = g.agg(F.first(SESSION).cast("bigint").alias("liquidity_session"), F.min(TS).alias("session_start_ts"), F.max(TS).alias("session_end_ts"), F.count(F.lit(1)).alias("n_bars"), *[last(c).alias(n) for n, c in made.items()])
    return rows.withColumns({"session_name": session_label(F.col("liquidity_session")), "va_width": F.col("completed_vah") - F.col("completed_val")})


def london_scenarios(states: DataFrame, keys: list[str]) -> DataFrame:
    """Each London stretch that follows an Asian one: where it opened against Asia's completed area, and whether it left it; known at London's last bar."""
    opening = F.coalesce(F.min_by("open", TS), F.min_by("close", TS)) if "open" in states.columns else F.min_by("close", TS)
    runs = _runs(states, keys).groupBy(*keys, "session_run").agg(
        F.first(SESSION).alias("s"), F.min(TS).alias("london_open_ts"), F.max(TS).alias("outcome_available_ts"), opening.alias("london_open"), F.max("high").alias("hi"), F.min("low").alias("lo"),
        F.max_by("poc", TS).alias("poc"), F.max_by("vah", TS).alias("vah"), F.max_by("val", TS).alias("val"),
    )
    w = Window.partitionBy(*keys).orderBy("session_run")
    before = {"asia_end_ts": "outcome_available_ts", "asia_completed_poc": "poc", "asia_completed_vah": "vah", "asia_completed_val": "val"}
    pairs = runs.withColumns({"_s": F.lag("s").over(w), **{n: F.lag(c).over(w) for n, c in before.items()}})
    pairs = pairs.where((F.col("s") == LONDON) & (F.col("_s") == ASIA) & F.col("asia_completed_vah").isNotNull() & F.col("asia_completed_val").isNotNull() & F.col("london_open").isNotNull())
    above, below = F.col("london_open") > F.col("asia_completed_vah"), F.col("london_open") < F.col("asia_completed_val")
    return pairs.select(
        *keys, "asia_end_ts", "london_open_ts", "outcome_available_ts", F.when(above, "open_above_asia_vah").when(below, "open_below_asia_val").otherwise("inside_asia_va").alias("scenario"),
        "london_open", "asia_completed_poc", "asia_completed_vah", "asia_completed_val", (~above & ~below).alias("open_inside_asia_va"),
        F.coalesce(F.col("hi") > F.col("asia_completed_vah"), F.lit(False)).alias("london_broke_asia_vah"), F.coalesce(F.col("lo") < F.col("asia_completed_val"), F.lit(False)).alias("london_broke_asia_val"),
    )


def mean_confidence(column: str = "signal_quality") -> Column:
    """Mean of the finite values, as an aggregate; 0 without any."""
    x = F.col(column).cast("double")
    return F.coalesce(F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)), F.lit(0.0))


def state_vector(df: DataFrame, columns: tuple[str, ...] = VECTOR) -> DataFrame:
    """df with every state number as a double, 0 where it is null or absent."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns})


def latest_state(df: DataFrame, keys: list[str], columns: tuple[str, ...] = VECTOR) -> DataFrame:
    """The state vector of each key's last row, by a combined maximum."""
    own = state_vector(df, columns)
    return own.groupBy(*keys).agg(F.max(TS).alias(TS), *[F.max_by(c, TS).alias(c) for c in columns])


def state_frame(blended: DataFrame, keys: list[str]) -> DataFrame:
    """The state columns of a blended frame; predictions among them raise."""
    names = [c for c in blended.columns if c in STATE or c.startswith(STATE_STARTS)]
    leak = [c for c in names if c.startswith(("p_y_", "p_hat"))]
    if leak:
        raise AssertionError(f"predictions in a state frame: {leak}")
    return blended.select(*keys, TS, *names)


@dataclass
class Analysis:
    """What a behaviour run made; frames that a step did not make are None."""

    blended: DataFrame
    events: DataFrame
    rates: DataFrame
    sessions: DataFrame
    scenarios: DataFrame
    oof: DataFrame | None = None
    live: DataFrame | None = None
    competing_oof: DataFrame | None = None
    competing_live: DataFrame | None = None
    keys: list[str] = field(default_factory=lambda: ["instrument_id"])

    def states(self) -> DataFrame:
        return state_frame(self.blended, self.keys)

    #: The former name of `states`; it never had predictions.
    probabilities = states

    def _none(self) -> DataFrame:
        return self.blended.sparkSession.createDataFrame([], f"{TS} bigint, prediction_source string, prediction_is_oof boolean, eligible_for_backtest boolean, model_train_end_ts bigint")

    def oof_predictions(self) -> DataFrame:
        return self._none() if self.oof is None else self.oof

    def live_predictions(self) -> DataFrame:
        return self._none() if self.live is None else self.live

    def predictions(self) -> DataFrame:
        """Out-of-fold predictions where there are any, else live ones."""
        return self.oof if self.oof is not None else self.live_predictions()

    def competing_predictions(self) -> DataFrame:
        found = self.competing_oof if self.competing_oof is not None else self.competing_live
        return self._none() if found is None else found

    def summary(self) -> DataFrame:
        return rate_summary(self.rates, self.blended)


def rate_summary(rates: DataFrame, blended: DataFrame) -> DataFrame:
    """One row: each target's training rate averaged over folds by their test size, when that was known, and the mean evidence, which is no calibrated probability."""
    by = rates.groupBy("target").agg(F.when(F.sum("test_n") > 0, F.sum(F.col("train_rate") * F.col("test_n")) / F.sum("test_n")).otherwise(0.0).alias("p"))
    names = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "p")))))).alias("p"))
    whole = blended.agg(F.max(TS).alias("available_after_ts"), mean_confidence("signal_quality").alias("confidence"), F.count(F.lit(1)).alias("n_samples"))
    return whole.crossJoin(names).withColumns({"confidence_is_calibrated_probability": F.lit(False), "probability_source": F.lit("train_only_walk_forward_base_rates"), "probabilities_are_joint_distribution": F.lit(False)})  # one row each


# ---- guards


def refuse_trades(df: DataFrame) -> DataFrame:
    """df, unless it has outputs of trading."""
    found = sorted(c for c in df.columns if c in TRADE_COLUMNS or c.startswith(TRADE_STARTS))
    if found:
        raise AssertionError(f"trade outputs in a behaviour frame: {found}")
    return df


def need_decisions(df: DataFrame) -> DataFrame:
    """df, unless it lacks the lagged bounds that decisions are taken on."""
    if not any(set(names) <= set(df.columns) for names in DECISIONS):
        raise ValueError("a behaviour frame needs decision bounds")
    return df


def label_guards(labeled: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row of counts: labels known before their setup, labels whose window leaves its trade date, and (with `days`: availability_ts, period_day_id) labels that leave their day's file or stand in none."""
    rows = labeled.select(SETUP, DONE, (F.col(DONE) < F.col(SETUP)).alias("early"), (trade_date(F.col(SETUP)) != trade_date(F.col(DONE))).alias("dates"))
    made = [F.count_if("early").alias("known_before_setup"), F.count_if("dates").alias("crossed_dates")]
    if days is None:
        return rows.agg(*made)
    own = days.select(F.col(TS).alias("_t"), "period_day_id").distinct()
    for c, name in ((SETUP, "_a"), (DONE, "_b")):
        rows = rows.join(own.select(F.col("_t").alias(c), F.col("period_day_id").alias(name)), c, "left")
    return rows.agg(*made, F.count_if(F.col("_a") != F.col("_b")).alias("crossed_days"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("outside_days"))


def assert_labels(labeled: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """labeled, unless a guard counts something."""
    found = {k: v for k, v in label_guards(labeled, days).first().asDict().items() if v}
    if found:
        raise AssertionError(f"labels break their window: {found}")
    return labeled


HELPERS = frozenset(("period_day_id", "behavior_story_run", "liquidity_run", "session_run"))


def assert_predictions(folds: DataFrame, oof: DataFrame, live: DataFrame, features: list[str]) -> None:
    """Folds in time order, out-of-fold rows eligible and after their training, live rows not eligible, no helper among the features."""
    if HELPERS & set(features):
        raise AssertionError(f"helper columns among the features: {sorted(HELPERS & set(features))}")
    late = folds.where("train_n > 0 AND test_n > 0 AND train_end_ts >= test_start_ts").limit(1).count()
    leaked = oof.where(~F.col("eligible_for_backtest") | (F.col(TS) <= F.col("model_train_end_ts"))).limit(1).count()
    alive = live.where("eligible_for_backtest").limit(1).count()
    if late or leaked or alive:
        raise AssertionError(f"folds out of order: {late}, out-of-fold rows not out of fold: {leaked}, live rows eligible: {alive}")


def validate(df: DataFrame, keys: list[str], event_ts: str | None = None, folds: DataFrame | None = None) -> DataFrame:
    """One row: counts, whether time only rises and nothing is known before it happened, whether decision bounds and no trade outputs are there, and all of it."""
    w = Window.partitionBy(*keys).orderBy(TS)
    early = (F.col(event_ts) > F.col(TS)) if event_ts and event_ts in df.columns else F.lit(False)
    rows = df.select(*keys, TS, early.alias("early")).withColumn("twice", F.col(TS) == F.lag(TS).over(w))
    a = rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.count_if(F.col("early") | F.col(TS).isNull()) == 0).alias("causal_ok"), F.count_if("twice").alias("repeated_times"))
    bounds = any(set(n) <= set(df.columns) for n in DECISIONS)
    clean = not any(c in TRADE_COLUMNS or c.startswith(TRADE_STARTS) for c in df.columns)
    n = 0 if folds is None else folds.select("fold").distinct().count()
    a = a.withColumns({"n_folds": F.lit(n), "decision_bounds_present": F.lit(bounds), "no_trade_outputs": F.lit(clean)})
    return a.withColumn("ok", F.col("causal_ok") & F.col("decision_bounds_present") & F.col("no_trade_outputs"))
