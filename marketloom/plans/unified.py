"""Unified research run: events of two contracts to a feature frame, three channels, and sinks."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asof import asof_backward, pulse_join
from ..operators import auction, book, labels, period, quality, research, tape
from .policy import TemporalPolicy
from .relational_queries import book_descriptors, sequences

KEYS = ["instrument_id", "availability_ts"]


@dataclass(frozen=True)
class RunConfig:
    interval_ns: int = 60_000_000_000
    profile_interval_ns: int = 300_000_000_000
    horizon: int = 1
    filter_noise: bool = True
    latency_ns: int = 0
    lead_lag_window: int = 20
    n_permutations: int = 200
    n_splits: int = 3
    alpha: float = 0.05
    seed: int = 0

    @classmethod
    def read(cls, path: str | Path) -> RunConfig:
        """From [research], with [micro] first and [temporal] last where an interval stands in several."""
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        known = set(cls.__dataclass_fields__)
        merged = {k: v for name in ("temporal", "research", "micro") for k, v in raw.get(name, {}).items() if k in known}
        return cls(**merged)


def research_features(m: DataFrame, lead: int, follow: int, cfg: RunConfig) -> DataFrame:
    """The lead contract's bars with signals (state as of, pulses exact), depth as of, cross-market columns and returns.

    Depth columns stay null where there was no book yet; pulses are 0 where they did not fire.
    """
    one = m.where(F.col("instrument_id") == lead)
    clean = quality.filter_noise(one) if cfg.filter_noise else one
    bars = labels.forward_returns(tape.ohlcv_bars(one, cfg.interval_ns), "c", cfg.horizon, ["instrument_id"], ["bucket_start"])
    signals = auction.signal_columns(auction.action_states(one, max(cfg.profile_interval_ns, cfg.interval_ns), cfg.interval_ns))
    states = ["is_balanced", "is_expansion", "in_value_fraction", "decision_poc", "decision_vah", "decision_val", "vp_liquidity_session"]
    right = signals.select("instrument_id", F.col("availability_ts").alias("_known"), *states)
    out = asof_backward(bars, right, "availability_ts", "_known", by=["instrument_id"], columns=states)
    pulses = [*auction.SIGNALS, "absorb", "look_fail", "early_imbalance"]
    out = pulse_join(out, signals.select(*KEYS, *pulses), KEYS, pulses)
    broken = tape.hold_filter(tape.failed_breakout_candidates(tape.ohlcv_bars(one, cfg.interval_ns), rth_only=False)).select(*KEYS, "fail_breakout", "fb_break_level")
    out = pulse_join(out, broken, KEYS, ["fail_breakout"])
    depth = book.depth_bars(clean, [cfg.interval_ns])
    columns = ["path_imbalance", "path_imbalance_delta", "path_pressure", "low_imbalance", "queue_pressure", "iceberg_hit"]
    out = asof_backward(out, depth.select("instrument_id", F.col("availability_ts").alias("_known"), *columns), "availability_ts", "_known", by=["instrument_id"], columns=columns)
    tob = book.top_of_book(m.where(F.col("instrument_id").isin(lead, follow)))
    windows = tape.market_windows(m, tob, cfg.interval_ns)
    cross = tape.cross_market(windows.where(F.col("instrument_id") == lead), windows.where(F.col("instrument_id") == follow), cfg.interval_ns, cfg.lead_lag_window, latency_ns=cfg.latency_ns)
    return pulse_join(out, cross.select("availability_ts", "lead_lag", "trap_setup", "divergence", "confirmation_failure"), ["availability_ts"], ["trap_setup"])


def run(spark: SparkSession, m: DataFrame, lead: int, follow: int, out_dir: str, cfg: RunConfig | None = None) -> dict[str, str]:
    """Features, self-supervised folds, coverage, signal screen and selection, written below out_dir; returns the paths."""
    cfg = cfg or RunConfig()
    policy = TemporalPolicy(horizon=cfg.horizon)
    paths = {n: f"{out_dir}/{n}.parquet" for n in ("features", "ssl", "coverage", "alpha", "folds", "selection")}
    research_features(m, lead, follow, cfg).write.mode("overwrite").parquet(paths["features"])
    features = spark.read.parquet(paths["features"])
    names = [c for c in (*auction.SIGNALS, "absorb", "look_fail", "early_imbalance", "fail_breakout", "trap_setup") if c in features.columns] + ["delta"]
    features = period.depth_gates(features, names)
    every = [c for c in features.columns if c in names or "__depth__" in c]
    research.ssl_folds(sequences(features, ["volume", "delta", "range"], policy.window, policy.stride, ["instrument_id"], ["availability_ts"]), "window", "availability_ts", cfg.n_splits, seed=cfg.seed).write.mode("overwrite").parquet(paths["ssl"])
    both = features.select("bucket_start", "c", "volume", "delta", "range").join(book_descriptors(m.where(F.col("instrument_id") == lead), cfg.interval_ns).drop("instrument_id"), "bucket_start").orderBy("bucket_start").toPandas()
    research.coverage(spark, both[["volume", "delta", "range"]], both[["add_count", "cancel_count", "trade_count", "trade_volume", "cancel_ratio", "spread", "depth_change"]], both["c"].to_numpy(), cfg.n_permutations, cfg.seed).write.mode("overwrite").parquet(paths["coverage"])
    research.screen(features, every, "forward_return", n=cfg.n_permutations, alpha=cfg.alpha, seed=cfg.seed).write.mode("overwrite").parquet(paths["alpha"])
    folds, summary = research.walk_forward_select(features, every, "forward_return", splits=cfg.n_splits, purge=policy.purge(), n=cfg.n_permutations, seed=cfg.seed)
    folds.write.mode("overwrite").parquet(paths["folds"])
    summary.write.mode("overwrite").parquet(paths["selection"])
    store, findings = research.EvidenceStore(), []
    for r in spark.read.parquet(paths["alpha"]).collect():
        store.add(research.Evidence(f"ic:{r.signal}", "ic", r.ic, r.adjusted))
        findings.append(research.Finding(f"{r.signal} predicts the next return", (f"ic:{r.signal}",)))
    s = spark.read.parquet(paths["selection"]).first()
    store.add(research.Evidence("selection", "oos_ic", s.oos_ic, s.pvalue))
    findings.append(research.Finding("the selected signals hold out of sample", ("selection",)))
    text = research.report("Unified research report", store, findings, cfg.alpha) + f"\n```json\n{json.dumps(asdict(cfg))}\n```\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/report.md")
    return paths | {"report": f"{out_dir}/report.md"}
