"""Strategy runs: connected auction flow, failed breakouts and failed gaps, for one stream or for many days at once.

Days are closed worlds: a day is part of the key, so books, profiles and
selections of one day never see another, and Spark's tasks and retries stand in
for a process pool.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.session import trade_date
from ..operators import auction, behavior, edges, evaluation, quality, research, tape
from .unified import RunConfig, research_features

KEY, TS = tape.KEY, "availability_ts"
EXECUTION = ("thesis_dir", "hold_ok", "market_verdict", "market_true", "market_false", "entry_gate", "edge_signal", "vp_flip_gated", "vp_imbalance_gated", "vp_expansion_gated")
GATED = {"vp_flip_to_imbalance": "vp_flip_gated", "vp_imbalance": "vp_imbalance_gated", "vp_expansion": "vp_expansion_gated"}
#: Signals that a run concentrates on (fixed names).
FOCUS = {"auction": ("vp_flip_to_imbalance", "vp_imbalance", "vp_expansion", "vp_fsm_break", "vp_fsm_retest", "vp_fsm_expand"), "failed_breakout": ("fail_breakout",), "failed_gap": ("fail_fvg",)}


def employed_signal(features: DataFrame, folds: DataFrame, signals: list[str], ts: str = TS) -> DataFrame:
    """features with each fold's chosen signal times its sign on the rows of its test block, 0 (fold -1, no name) elsewhere.

    Test blocks are disjoint; a selection never reaches the rows it learned from.
    """
    cut = folds.select(F.col("fold").alias("_fold"), "selected", F.col("employed_sign").alias("_sign"), "test_start_ts", "test_end_ts")
    rows = features.join(F.broadcast(cut), F.col(ts).between(F.col("test_start_ts"), F.col("test_end_ts")) & F.col("selected").isin(*signals), "left")  # a row a fold
    value = F.lit(0.0)
    for s in signals:
        value = F.when(F.col("selected") == s, F.coalesce(F.col(s).cast("double"), F.lit(0.0))).otherwise(value)
    made = {"employed": F.coalesce(F.col("_sign") * value, F.lit(0.0)), "employed_fold": F.coalesce("_fold", F.lit(-1)), "employed_sign": F.coalesce("_sign", F.lit(0.0)), "employed_signal": F.coalesce("selected", F.lit(""))}
    return rows.withColumns(made).drop("_fold", "_sign", "selected", "test_start_ts", "test_end_ts")


def gated_columns(edge: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """edge with the auction signals known by then, times the entry gate (absent ones 0)."""
    own = [c for c in GATED if c in features.columns]
    rows = edge.drop(*own)
    if own:
        rows = asof_backward(rows, features.select(*by, F.col(TS).alias("_known"), *own), TS, "_known", by=by, columns=own)
    gate = behavior.value(rows, "entry_gate")
    return rows.withColumns({out: behavior.value(rows, c) * gate for c, out in GATED.items()})


def execution_layer(features: DataFrame, edge: DataFrame, by: list[str]) -> DataFrame:
    """features with the verdicts and gates known by then; gates are 0 where there are none."""
    own = [c for c in EXECUTION if c in edge.columns]
    if not own:
        return features
    rows = asof_backward(features.drop(*own), edge.select(*by, F.col(TS).alias("_known"), *own), TS, "_known", by=by, columns=own)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in own if c not in ("thesis_dir", "market_verdict")})


def attach_embeddings(features: DataFrame, embeddings: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """features with the embedding known by then."""
    return asof_backward(features, embeddings.select(*by, F.col(TS).alias("_known"), *columns), TS, "_known", by=by, columns=columns)


def outer_summary(outer: DataFrame) -> DataFrame:
    """One row: the sealed test of the best trade rule where it ran, else zeros."""
    zero = lambda f, n: F.coalesce(f, F.lit(0.0)).alias(n)
    return outer.agg(F.max("name").alias("best_edge_spec"), F.coalesce(F.max("n_trades"), F.lit(0)).alias("edge_n_trades"), zero(F.max("expectancy"), "edge_oos_expectancy"), zero(F.max("win_rate"), "edge_oos_win_rate"))


@dataclass(frozen=True)
class StrategyConfig:
    run: RunConfig = RunConfig()
    drop_deceptive: bool = True
    with_execution: bool = True
    strategy: str = "auction"


def edge_frame(m: DataFrame, cfg: StrategyConfig) -> tuple[DataFrame, DataFrame]:
    """(states, deceptive buckets) that trades are judged on."""
    r = cfg.run
    states = auction.action_states(m, max(r.profile_interval_ns, r.interval_ns), r.interval_ns)
    return states, quality.deceptive_buckets(quality.deceptive_scores(m), r.interval_ns)


def strategy_features(m: DataFrame, lead: int, follow: int, cfg: StrategyConfig) -> DataFrame:
    """Research features of a strategy, from events without deceptive ones where asked, with gates attached."""
    clean = quality.filter_deceptive(m) if cfg.drop_deceptive else m
    features = research_features(clean, lead, follow, cfg.run)
    if cfg.strategy == "failed_gap":
        r = cfg.run
        one = clean.where(F.col(KEY) == lead)
        gaps = auction.failed_gaps(tape.ohlcv_bars(one, max(r.profile_interval_ns, r.interval_ns)), tape.ohlcv_bars(one, r.interval_ns), 4 * max(r.profile_interval_ns, r.interval_ns)).select(KEY, TS, "fail_fvg")
        features = features.drop("fail_fvg").join(gaps, [KEY, TS], "left").withColumn("fail_fvg", F.coalesce("fail_fvg", F.lit(0.0)))
    if cfg.strategy == "auction" and cfg.with_execution:
        states, deceptive = edge_frame(m.where(F.col(KEY) == lead), cfg)
        truth = auction.market_truth(states, deceptive).withColumn(TS, F.col("bucket_end"))
        features = execution_layer(features, gated_columns(truth.select(KEY, TS, *[c for c in EXECUTION if c in truth.columns]), features, [KEY]), [KEY])
    return features


def focus(features: DataFrame, strategy: str) -> list[str]:
    own = [c for c in FOCUS[strategy] if c in features.columns]
    return own + [c for c in GATED.values() if strategy == "auction" and c in features.columns]


def run(spark: SparkSession, m: DataFrame, lead: int, follow: int, out_dir: str, cfg: StrategyConfig | None = None) -> dict[str, str]:
    """Features, selection by folds, the signal as employed out of sample, trade search and a summary, written below out_dir."""
    cfg = cfg or StrategyConfig()
    r = cfg.run
    paths = {n: f"{out_dir}/{n}.parquet" for n in ("features", "folds", "employed", "edge_specs", "edge_outer", "summary")}
    strategy_features(m, lead, follow, cfg).write.mode("overwrite").parquet(paths["features"])
    features = spark.read.parquet(paths["features"])
    names = focus(features, cfg.strategy)
    folds, selection = research.walk_forward_select(features, names, "forward_return", splits=r.n_splits, n=r.n_permutations, seed=r.seed)
    folds.write.mode("overwrite").parquet(paths["folds"])
    folds = spark.read.parquet(paths["folds"])
    employed_signal(features, folds, names).write.mode("overwrite").parquet(paths["employed"])
    if cfg.strategy == "auction" and cfg.with_execution:
        one = m.where(F.col(KEY) == lead)
        specs, outer = edges.search_edges(*edge_frame(one, cfg), one, edges.edge_grid(), folds=r.n_splits)
        specs.write.mode("overwrite").parquet(paths["edge_specs"])
        outer.write.mode("overwrite").parquet(paths["edge_outer"])
        tail = outer_summary(spark.read.parquet(paths["edge_outer"]))
    else:
        tail = outer_summary(spark.createDataFrame([], "name string, n_trades bigint, expectancy double, win_rate double"))
        del paths["edge_specs"], paths["edge_outer"]
    best = folds.groupBy("selected").count().agg(F.max_by("selected", F.struct("count", "selected")).alias("best_signal"))
    hits = evaluation.signal_hits(features, names)
    # each side is one row
    selection.crossJoin(best).crossJoin(evaluation.selection_stability(folds)).crossJoin(hits).crossJoin(tail).write.mode("overwrite").parquet(paths["summary"])
    spark.createDataFrame([(json.dumps(asdict(cfg), default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/config.json")
    return paths


def run_auction(spark: SparkSession, m: DataFrame, lead: int, follow: int, out_dir: str, cfg: StrategyConfig | None = None) -> dict[str, str]:
    return run(spark, m, lead, follow, out_dir, replace(cfg or StrategyConfig(), strategy="auction"))


def run_failed_breakout(spark: SparkSession, m: DataFrame, lead: int, follow: int, out_dir: str, cfg: StrategyConfig | None = None) -> dict[str, str]:
    return run(spark, m, lead, follow, out_dir, replace(cfg or StrategyConfig(), strategy="failed_breakout"))


def run_failed_gap(spark: SparkSession, m: DataFrame, lead: int, follow: int, out_dir: str, cfg: StrategyConfig | None = None) -> dict[str, str]:
    return run(spark, m, lead, follow, out_dir, replace(cfg or StrategyConfig(), strategy="failed_gap"))


# ---- many days at once

DAYS = 1 << 20


def by_day(m: DataFrame, day: str = "session_date") -> DataFrame:
    """m with the day number in the instrument key, so that every operator keeps days apart and runs them side by side."""
    number = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))
    rows = m if day in m.columns else m.withColumn(day, trade_date(F.col("event_ts")))
    return rows.withColumn(KEY, F.col(KEY).cast("bigint") * DAYS + number).drop(day)


def unkeyed(df: DataFrame) -> DataFrame:
    """A result with the instrument and the day out of the key again."""
    return df.withColumns({KEY: F.call_function("div", F.col(KEY), F.lit(DAYS)), "day_id": F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.col(KEY), F.lit(DAYS)).cast("int")), "yyyy-MM-dd")})


def day_bars(m: DataFrame, interval_ns: int) -> DataFrame:
    return unkeyed(tape.ohlcv_bars(by_day(m), interval_ns))


def day_signals(m: DataFrame, interval_ns: int, horizon: int = 1) -> DataFrame:
    """Failed-breakout pulses and forward returns of every day by itself."""
    bars = tape.ohlcv_bars(by_day(m), interval_ns)
    pulses = tape.hold_filter(tape.failed_breakout_candidates(bars, rth_only=False)).select(KEY, TS, "fail_breakout")
    w = Window.partitionBy(KEY).orderBy("bucket_start")
    ahead = F.try_divide(F.lead("c", horizon).over(w) - F.col("c"), F.col("c"))
    rows = bars.select(KEY, "bucket_start", TS, "c", "volume", "delta", ahead.alias("forward_return")).join(pulses, [KEY, TS], "left").withColumn("fail_breakout", F.coalesce("fail_breakout", F.lit(0.0)))
    return unkeyed(rows)


def day_results(rows: DataFrame, signals: list[str], forward: str = "forward_return", least: int = 8) -> DataFrame:
    """One row a day and instrument: the signal of largest |IC| in the first half of the day, its sign there, and its IC in the second half.

    Days are never compared to choose; the table is a description.
    """
    w = Window.partitionBy(KEY, "day_id").orderBy(TS)
    rows = rows.withColumn("half", F.when(F.row_number().over(w) * 2 <= F.count(F.lit(1)).over(Window.partitionBy(KEY, "day_id")), "train").otherwise("test"))
    long = rows.where(F.col(forward).isNotNull()).unpivot([KEY, "day_id", "half", forward], signals, "signal", "value")
    keys = [KEY, "day_id", "half", "signal"]
    from ..functions import stats

    ics = stats.spearman(long.withColumn("value", F.col("value").cast("double")), "value", forward, keys)
    wide = ics.groupBy(KEY, "day_id", "signal").agg(*[F.max(F.when(F.col("half") == h, F.when(F.col("n") >= least, F.col("ic")).otherwise(0.0))).alias(f"{h}_ic") for h in ("train", "test")], F.max(F.when(F.col("half") == "test", F.col("n"))).alias("oos_n"))
    best = wide.groupBy(KEY, "day_id").agg(F.max_by(F.struct("signal", "train_ic", "test_ic", "oos_n"), F.struct(F.coalesce(F.abs("train_ic"), F.lit(0.0)), "signal")).alias("x"))
    sign = F.when(F.col("x.train_ic") < 0, -1.0).otherwise(1.0)
    return best.select(KEY, "day_id", F.col("x.signal").alias("best_signal"), F.coalesce("x.train_ic", F.lit(0.0)).alias("train_ic"), sign.alias("employed_sign"), (F.coalesce("x.test_ic", F.lit(0.0)) * sign).alias("oos_ic"), F.coalesce("x.oos_n", F.lit(0)).alias("oos_n"))


def period_aggregate(results: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """One row over all days: how many, mean out-of-sample IC, the signal chosen most often, pooled trades, and a verdict on those alone."""
    mode = results.groupBy("best_signal").count().agg(F.max_by("best_signal", F.struct("count", "best_signal")).alias("mode_signal"))
    days = results.agg(F.count_distinct("day_id").alias("n_days"), F.coalesce(F.avg("oos_ic"), F.lit(0.0)).alias("mean_oos_ic"), F.coalesce(F.avg((F.col("oos_ic") > 0).cast("double")), F.lit(0.0)).alias("positive_days"))
    if trades is None:
        pooled = results.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_trades"), F.lit(0.0).alias("expectancy"), F.lit(0.0).alias("win_rate"))
    else:
        pooled = trades.agg(F.count(F.lit(1)).alias("n_trades"), F.coalesce(F.avg("pnl"), F.lit(0.0)).alias("expectancy"), F.coalesce(F.avg((F.col("pnl") > 0).cast("double")), F.lit(0.0)).alias("win_rate"))
    verdict = F.when((F.col("n_trades") >= 30) & (F.col("expectancy") > 0), "EDGE_FOUND_POOLED").when(F.col("n_trades") > 0, "NO_EDGE_POOLED").otherwise("INSUFFICIENT_POOLED_TRADES")
    return days.crossJoin(mode).crossJoin(pooled).withColumn("verdict", verdict)  # one row each


def run_days(spark: SparkSession, m: DataFrame, out_dir: str, interval_ns: int, signals: tuple[str, ...] = ("fail_breakout", "delta"), make: Callable[[DataFrame, int], DataFrame] = day_signals) -> dict[str, str]:
    """Signals, results by day and the period's aggregate of all days in one plan, with a manifest; returns the paths."""
    paths = {n: f"{out_dir}/{n}.parquet" for n in ("signals", "day_results", "aggregate")}
    make(m, interval_ns).write.mode("overwrite").partitionBy("day_id").parquet(paths["signals"])
    day_results(spark.read.option("basePath", paths["signals"]).parquet(paths["signals"]).withColumn("day_id", F.col("day_id").cast("string")), list(signals)).write.mode("overwrite").parquet(paths["day_results"])
    results = spark.read.parquet(paths["day_results"])
    period_aggregate(results).write.mode("overwrite").parquet(paths["aggregate"])
    total = spark.read.parquet(paths["aggregate"]).first().asDict()
    manifest = {"n_days": total["n_days"], "principles": ["a day is a closed world", "days are never compared to choose"], "aggregate": total}
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/manifest.json")
    return paths | {"manifest": f"{out_dir}/manifest.json"}
