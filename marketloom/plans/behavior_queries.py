"""Registered queries of auction behaviour (no SQL; tests replay them on small streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.session import trade_date
from ..operators import auction, behavior, quality
from . import folds
from .tape_queries import H1, H4, _mbo

RULES = behavior.ProjectionRules(interval_ns=H1, min_coverage=0.5, acceptance_ticks=1.0, repricing_ticks=2.0)
STORY = ["instrument_id", "story_date"]


def projected(m: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Action states with signals, and the projection (all of its levels, or `columns`) as of the same story."""
    found = behavior.overnight_projection(m, RULES)
    columns = columns or [c for c in found.columns if c.startswith(("proj_", "asia_", "composite_"))]
    return asof_backward(_signals(m), found.select(*STORY, F.col("availability_ts").alias("_known"), *columns), "availability_ts", "_known", by=STORY, columns=columns)


def paths(m: DataFrame) -> DataFrame:
    """Projected states with flow near levels and path."""
    return behavior.path_confirmation(behavior.with_level_flow(projected(m), m, H1), STORY)


def realized(m: DataFrame) -> DataFrame:
    """Movements after each onset, which depend on the bars' place and on no flow."""
    return behavior.realized_paths(behavior.path_position(projected(m, ["asia_vah", "asia_val", "proj_poc_step_ticks"]), STORY), STORY)


def blended(m: DataFrame) -> DataFrame:
    """paths with deception and reliability, which no path depends on."""
    return paths(m).join(behavior.evidence(quality.deceptive_scores(m), H1), ["instrument_id", "bucket_start"], "left")


def _signals(m: DataFrame) -> DataFrame:
    return auction.signal_columns(auction.action_states(m, H4, H1)).withColumn("story_date", trade_date(F.col("bucket_start")))


def _rates(m: DataFrame) -> DataFrame:
    events = behavior.behavior_events(_signals(m), STORY).withColumn("clock", F.col("availability_ts") + F.col("instrument_id"))
    targets = ["evt_true_break", "evt_failed_breakout", "evt_retest_success", "evt_retest_fail"]
    return behavior.base_rates(folds.purged_walk_forward(events.select("clock", *targets).cache(), "clock", 3, purge=1, least_train=8, order=["clock"]), targets)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "overnight_projection": _mbo(lambda m: behavior.overnight_projection(m, RULES)),
    "structure_features": _mbo(lambda m: behavior.structure(_signals(m)).select("instrument_id", "bucket_start", "struct_dist_vah_ticks", "struct_dist_poc_ticks", "struct_close_in_value", "struct_near_poc", "struct_break_pressure")),
    "reliability_evidence": _mbo(lambda m: behavior.reliability(quality.deceptive_scores(m), H1)),
    "level_flow": _mbo(lambda m: behavior.level_flow(m, auction.action_states(m, H4, H1), H1)),
    "order_lifecycle": _mbo(lambda m: behavior.order_lifecycle(m, H1)),
    "path_confirmation": _mbo(lambda m: paths(m).select("instrument_id", "bucket_start", "path_beyond_asia_ticks", "path_extreme_ticks", "path_held_frac", "path_depth_confirm", "path_change_progress", "path_change_fail")),
    "behavior_events": _mbo(lambda m: behavior.behavior_events(_signals(m), STORY)),
    "signal_quality": _mbo(lambda m: behavior.signal_quality(blended(m)).select("instrument_id", "bucket_start", "signal_evidence", "signal_quality")),
    "realized_paths": _mbo(realized),
    "path_binaries": _mbo(lambda m: behavior.path_binaries(realized(m), STORY)),
    "base_rates": _mbo(_rates),
}
SQL: dict[str, str] = {}
