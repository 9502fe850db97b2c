"""Behaviour runs: states, events, base rates and summaries of a stream; labels, folds, calibrated models, drift and holdout over them.

Models of all folds and outcomes are fitted in one pass a round.  Predictions
out of fold come from folds that ended before them; live ones from the last fit
and are never eligible for a backtest.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asof import asof_backward
from ..functions.lineage import settled
from ..functions.session import trade_date
from ..operators import auction, behavior, evaluation, frames, labels, models, period, quality
from . import folds

TS, SETUP, DONE = "availability_ts", "setup_availability_ts", "outcome_available_ts"
STORY = ["instrument_id", "story_date"]
#: Outcomes by trigger, success and failure columns (fixed names).
OUTCOMES = (
    labels.Outcome("y_true_break", ("vp_fsm_break",), ("evt_true_break",), ("evt_failed_breakout",)),
    labels.Outcome("y_retest_success", ("vp_fsm_retest",), ("evt_retest_success",), ("evt_retest_fail",)),
    labels.Outcome("y_expansion_continue", ("vp_fsm_expand",), ("evt_expansion_continue",), ("evt_return_to_value",)),
    labels.Outcome("y_return_to_value", ("vp_fsm_break", "vp_fsm_expand"), ("evt_return_to_value",), ("evt_expansion_continue",)),
)
#: Competing families and their classes (fixed names).
FAMILIES = {"realized_path": (*behavior.PATHS, "no_path"), "assumed_scripts": ("break", "retest", "expand", "return", "no_transition")}
TARGETS = {"balanced": "vp_balance", "imbalanced": "vp_imbalance", "true_break": "evt_true_break", "false_break": "evt_failed_breakout", "retest_success": "evt_retest_success", "retest_fail": "evt_retest_fail", "expansion_continue": "evt_expansion_continue", "return_to_value": "evt_return_to_value"}


def competing_family(name: str) -> tuple[str, ...]:
    if name not in FAMILIES:
        raise ValueError(f"unknown competing family {name!r}")
    return FAMILIES[name]


def outcome_targets(paths: bool = True) -> tuple[str, ...]:
    """Names of the binary outcomes that models are fitted for."""
    return tuple(o.name for o in OUTCOMES) + (behavior.PATHS if paths else ())


def competing_outcomes(df: DataFrame, family: str, window: int, story: list[str]) -> DataFrame:
    """First transition or first realised movement of each setup, as first_transition_class."""
    competing_family(family)
    if family == "assumed_scripts":
        return labels.first_transition(df, "vp_fsm_break", {"retest": "vp_fsm_retest", "expand": "vp_fsm_expand", "return": "evt_return_to_value"}, window, story)
    return behavior.realized_paths(df, story, window).withColumnRenamed("next_path", "first_transition_class")


@dataclass(frozen=True)
class ScienceConfig:
    window: int = 8
    n_splits: int = 3
    purge: int = 1
    embargo: int = 0
    least_train: int = 12
    holdout_share: float = 0.2
    holdout_months: int | None = None
    month_folds: bool = False
    least_months: int = 4
    calibration_share: float = 0.2
    most_features: int = 24
    l2: float = 1.0
    evaluate_holdout: bool = False
    include_paths: bool = True
    competing_family: str = "realized_path"

    def __post_init__(self) -> None:
        competing_family(self.competing_family)
        if self.n_splits < 1 or not 0 < self.holdout_share < 1 or self.window < 1:
            raise ValueError("splits and window must be at least 1, the holdout's share within (0, 1)")


def period_config() -> ScienceConfig:
    """Protocol of a pooled period: expanding month folds and months held out."""
    return ScienceConfig(month_folds=True, holdout_months=3, least_months=4)


@dataclass(frozen=True)
class BehaviorConfig:
    interval_ns: int = 180_000_000_000
    profile_interval_ns: int = 900_000_000_000
    n_splits: int = 3
    purge: int = 1
    embargo: int = 0
    with_projection: bool = True
    with_science: bool = False
    science: ScienceConfig = field(default_factory=ScienceConfig)
    projection: behavior.ProjectionRules | None = None

    def __post_init__(self) -> None:
        if self.interval_ns < 1 or self.profile_interval_ns < self.interval_ns or self.n_splits < 1:
            raise ValueError("intervals must be positive, the profile's not shorter than the bar's, and splits at least 1")


def blended(m: DataFrame, cfg: BehaviorConfig) -> DataFrame:
    """Action states with signals, projection as of the same story, deception, reliability, flow near levels, path, events and evidence."""
    i = cfg.interval_ns
    states = auction.signal_columns(auction.action_states(m, cfg.profile_interval_ns, i)).withColumn("story_date", trade_date(F.col("bucket_start")))
    b = states
    if cfg.with_projection:
        projected = behavior.overnight_projection(m, cfg.projection or behavior.ProjectionRules(interval_ns=i))
        columns = [c for c in projected.columns if c.startswith(("proj_", "asia_", "composite_"))]
        b = asof_backward(b, projected.select(*STORY, F.col(TS).alias("_known"), *columns), TS, "_known", by=STORY, columns=columns)
    at = ["instrument_id", "bucket_start"]
    b = b.join(behavior.evidence(quality.deceptive_scores(m), i), at, "left")
    b = b.join(behavior.level_flow(m, states, i), at, "left")
    b = behavior.path_confirmation(b, STORY)
    events = behavior.behavior_events(b, STORY)
    b = b.join(events.select(*STORY, TS, *[c for c in events.columns if c.startswith("evt_")]), [*STORY, TS])
    balanced = F.coalesce(F.col("is_balanced").cast("double"), F.lit(0.0))
    b = b.withColumns({"vp_balance": balanced, "vp_imbalance": 1 - balanced, "vp_expansion": F.coalesce(F.col("is_expansion").cast("double"), F.lit(0.0))})
    return frames.refuse_trades(behavior.signal_quality(b))


def base_rates(b: DataFrame, cfg: BehaviorConfig) -> DataFrame:
    """Train-only base rates over purged folds of distinct times."""
    own = b.select(TS, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in TARGETS.items()])
    return behavior.base_rates(folds.setup_folds(own, TS, cfg.n_splits, cfg.embargo, cfg.purge, least_train=8), list(TARGETS))


def analyse(m: DataFrame, cfg: BehaviorConfig | None = None, out_dir: str | None = None) -> frames.Analysis:
    """All frames of a behaviour run; the blended frame is computed once (written below out_dir, where given) and read by every later step."""
    cfg = cfg or BehaviorConfig()
    b = frames.need_decisions(blended(m, cfg))
    if out_dir:
        b.write.mode("overwrite").parquet(f"{out_dir}/blended.parquet")
        b = m.sparkSession.read.parquet(f"{out_dir}/blended.parquet")
    else:
        b = settled(b)
    states = b.withColumns({"high": F.col("close"), "low": F.col("close")})
    made = frames.Analysis(
        blended=b, events=b.select(*STORY, TS, *[c for c in b.columns if c.startswith("evt_")]), rates=base_rates(b, cfg),
        sessions=frames.session_profiles(b, ["instrument_id"]), scenarios=frames.london_scenarios(states, ["instrument_id"]),
    )
    if cfg.with_science:
        science = run_science(b, cfg.science)
        made.oof, made.live = science.oof, science.live
    return made


# ---- science


@dataclass
class Science:
    labeled: DataFrame
    features: list[str]
    folds: DataFrame
    scored: DataFrame
    metrics: DataFrame
    oof: DataFrame
    live: DataFrame
    drift: DataFrame
    stability: DataFrame
    holdout: DataFrame
    holdout_metrics: DataFrame | None


def labels_of(b: DataFrame, cfg: ScienceConfig, story: list[str] = STORY) -> DataFrame:
    """Resolved binary outcomes of all setups, with their state's columns."""
    named = labels.labeled_outcomes(b, [replace(o, window=cfg.window) for o in OUTCOMES], story).drop("horizon_bars")
    if cfg.include_paths:
        named = named.unionByName(behavior.path_binaries(behavior.realized_paths(b, story, cfg.window), story).select(*named.columns))
    resolved = named.where("label_status = 'resolved' AND y IS NOT NULL")
    return resolved.join(b.withColumnRenamed(TS, SETUP), [*story, SETUP])


def run_science(b: DataFrame, cfg: ScienceConfig | None = None, story: list[str] = STORY) -> Science:
    """Labels, holdout, folds, models with calibration, predictions out of fold and live, drift and stability."""
    cfg = cfg or ScienceConfig()
    labeled = settled(labels_of(b, cfg, story))
    carved = folds.holdout_by_months(labeled, SETUP, cfg.holdout_months) if cfg.holdout_months else folds.frozen_holdout(labeled, SETUP, cfg.holdout_share)
    develop, held = (carved.where(w).drop("cut_ts", "is_holdout") for w in ("NOT is_holdout", "is_holdout"))
    features = evaluation.features_by_family(develop, cfg.most_features)
    if cfg.month_folds:
        folded = folds.month_folds(develop, SETUP, cfg.least_months, cfg.embargo).drop("test_month")
    else:
        folded = folds.setup_folds(develop, SETUP, cfg.n_splits, cfg.embargo, cfg.purge, cfg.least_train)
    table = folds.fold_table(folded, SETUP)
    keyed = folded.withColumn("model", F.concat_ws(":", F.col("fold").cast("string"), "outcome_name"))
    train, test = keyed.where("role = 'train'"), keyed.where("role = 'test'")
    cut = train.groupBy("fold").agg(F.percentile(SETUP, 1 - cfg.calibration_share).alias("_cut"))
    train = train.join(F.broadcast(cut), "fold")  # a row a fold
    fit, cal = train.where(F.col(SETUP) <= F.col("_cut")), train.where(F.col(SETUP) > F.col("_cut"))
    model = models.fit_logistic_groups(fit, "model", features, "y", cfg.l2)
    lines = evaluation.fit_calibrators(model.transform(cal).withColumn("outcome_name", F.col("model")))
    base = train.groupBy("model").agg(F.avg("y").alias("baseline_p"))
    scored = evaluation.apply_calibrators(model.transform(test), lines, key="model").join(F.broadcast(base), "model").where("p_hat IS NOT NULL")
    scored = settled(scored)
    metrics = evaluation.metrics_by_outcome(scored, p="p_cal")
    by_fold = evaluation.metrics_by_outcome(scored.withColumn("outcome_name", F.col("fold").cast("string")), p="p_cal")
    known = table.select("fold", F.col("train_end_ts").alias("model_train_end_ts"))
    oof = scored.join(F.broadcast(known), "fold").select(*story, F.col(SETUP).alias(TS), "outcome_name", F.col("p_cal").alias("p"), "fold", "model_train_end_ts", F.lit("walk_forward").alias("prediction_source"), F.lit(True).alias("prediction_is_oof"), F.lit(True).alias("eligible_for_backtest"))
    last = models.fit_logistic_groups(develop.withColumn("model", F.col("outcome_name")), "model", features, "y", cfg.l2)
    until = develop.agg(F.max(SETUP).alias("model_train_end_ts"))
    newest = b.select(*story, TS, *features).join(F.broadcast(b.agg(F.max(TS).alias("_t"))), F.col(TS) == F.col("_t")).drop("_t")  # one row
    names = b.sparkSession.createDataFrame([(n,) for n in sorted(last.weights)], "model string")
    live = last.transform(newest.crossJoin(F.broadcast(names))).crossJoin(F.broadcast(until))  # a row an outcome, one row
    live = live.select(*story, TS, F.col("model").alias("outcome_name"), F.col("p_hat").alias("p"), "model_train_end_ts", F.lit("final_model").alias("prediction_source"), F.lit(False).alias("prediction_is_oof"), F.lit(False).alias("eligible_for_backtest"))
    halves = folds.frozen_holdout(develop, SETUP, 0.5).withColumnRenamed("is_holdout", "later")
    drift = evaluation.drift(halves.where("NOT later"), halves.where("later"), features, halves.where("NOT later"), halves.where("later"))
    outside = None
    if cfg.evaluate_holdout:
        rates = develop.groupBy("outcome_name").agg(F.avg("y").alias("baseline_p"))
        outside = evaluation.metrics_by_outcome(last.transform(held.withColumn("model", F.col("outcome_name"))).join(F.broadcast(rates), "outcome_name").where("p_hat IS NOT NULL"))
    return Science(labeled, features, table, scored, metrics, oof, live, drift, evaluation.stability(by_fold), held, outside)


def run_period(spark: SparkSession, path: str, out_dir: str, cfg: ScienceConfig | None = None) -> dict[str, str]:
    """Science over the finished states of all days below `path`, whose events and books are never pooled; writes its frames."""
    pooled = period.story_runs(period.read_days(spark, path))
    story = ["behavior_story_run"]
    science = run_science(pooled.drop("period_day_id", "liquidity_run"), cfg or period_config(), story)
    frames.assert_labels(science.labeled.select(SETUP, DONE), pooled.select(TS, "period_day_id"))
    frames.assert_predictions(science.folds, science.oof, science.live, science.features)
    return write_science(spark, science, out_dir)


def write_science(spark: SparkSession, science: Science, out_dir: str) -> dict[str, str]:
    """Tables, a manifest and a short report below out_dir."""
    tables = {"folds": science.folds, "metrics": science.metrics, "oof": science.oof, "live": science.live, "drift": science.drift, "stability": science.stability}
    if science.holdout_metrics is not None:
        tables["holdout_metrics"] = science.holdout_metrics
    paths = {n: f"{out_dir}/{n}.parquet" for n in tables}
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(paths[n])
    rows = spark.read.parquet(paths["metrics"]).orderBy("outcome_name").collect()
    text = "# Behaviour science\n\n| outcome | n | brier | skill | ece | auc |\n|-|-|-|-|-|-|\n" + "".join(f"| {r.outcome_name} | {r.n} | {r.brier:.4f} | {r.brier_skill:.4f} | {r.ece:.4f} | {'' if r.auc is None else f'{r.auc:.3f}'} |\n" for r in rows)
    for name, body in (("report.md", text), ("manifest.json", json.dumps({"features": science.features, "tables": sorted(paths)}))):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/{name}")
    return paths | {"report": f"{out_dir}/report.md", "manifest": f"{out_dir}/manifest.json"}


# ---- diagnoses of labelled setups


def expansion_mechanics(labeled: DataFrame, outcome: str, cut_ts: int | None = None, oof: DataFrame | None = None, columns: tuple[str, ...] = ("proj_outside_volume_share", "path_beyond_asia_ticks", "path_depth_follow", "vp_balance", "vp_imbalance")) -> dict[str, DataFrame]:
    """What led and what followed of one outcome, on the development part only: class tables and means by label."""
    rows = evaluation.scoped(evaluation.by_outcome(evaluation.developed(labeled, cut_ts), outcome), oof)
    rows = annotate(rows)
    return {
        "volume_lead": period.class_table(rows, "lead_class", period.LEADS), "depth_lead": period.class_table(rows, "depth_lead_class", ("both_already", "depth_lead", "price_lead", "neither")),
        "sequence": period.class_table(rows, "sequence_class", period.SEQUENCES), "means": evaluation.means_by_label(rows, list(columns)),
        "protection": protection(rows, [c for c in columns if c in rows.columns]),
    }


def annotate(df: DataFrame, share: float = 0.35, beyond: float = 4.0, follow: float = 1.0) -> DataFrame:
    """Lead, depth lead and sequence classes, and whether an expansion was accepted already."""
    v = lambda c: behavior.value(df, c)
    accepted = (v("proj_outside_volume_share") >= share) & (v("path_beyond_asia_ticks") >= beyond) & (v("path_depth_follow") >= follow)
    return period.auction_sequence(period.depth_price_lead(period.volume_price_lead(df))).withColumns({"already_accepted_expansion": accepted.cast("double"), "already_expanded": (v("path_beyond_asia_ticks") >= beyond) & (v("proj_outside_volume_share") >= share)})


def protection(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: counts, means at either label, their difference, and the rank correlation with the label."""
    from ..functions import stats

    long = rows.select("y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).unpivot(["y"], columns, "feature", "x")
    at = lambda hit: F.avg(F.when(hit, F.col("x")))
    g = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0.5).alias("n_pos"), at(F.col("y") > 0.5).alias("mean_pos"), at(F.col("y") <= 0.5).alias("mean_neg"))
    return g.withColumn("delta_pos_minus_neg", F.col("mean_pos") - F.col("mean_neg")).join(stats.spearman(long, "x", "y", ["feature"]).select("feature", F.col("ic").alias("spearman_ic")), "feature")


def wave_position(labeled: DataFrame, waves: DataFrame, group: str, outcome: str, extent: str, scores: DataFrame | None = None, threshold: float = 0.5, cut_ts: int | None = None, oof: DataFrame | None = None, smallest: float = 4.0) -> DataFrame:
    """Where in its wave each first success (and each first setup that the model takes) stands: counts, mean and median fraction by role and bin."""
    rows = evaluation.scoped(evaluation.by_outcome(evaluation.developed(labeled, cut_ts), outcome), oof)
    rows = rows.join(waves.select(group, "wave_peak", F.coalesce("expansion_start_extent", "onset_extent").alias("_from")), group).where(F.col("wave_peak") >= smallest)
    span = F.col("wave_peak") - F.col("_from")
    rows = rows.withColumn("fraction", F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(extent) - F.col("_from")) / span))))
    parts = [evaluation.first_success(rows, [group], [SETUP]).select(F.lit("first_success").alias("role"), "fraction")]
    if scores is not None:
        parts.append(evaluation.first_model(rows, scores, "p", [group], threshold, [SETUP]).select(F.lit("first_model").alias("role"), "fraction"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    every = every.withColumn("wave_bin", labels.wave_bin(F.col("fraction"))).where("wave_bin IS NOT NULL")
    g = every.groupBy("role", "wave_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("fraction").alias("mean_fraction"), F.percentile("fraction", 0.5).alias("median_fraction"))
    whole = every.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    return g.join(whole, "role").withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, title: str) -> dict[str, str]:
    """Parquet tables and one Markdown file with the first rows of each."""
    paths = {n: f"{out_dir}/{n}.parquet" for n in tables}
    lines = [f"# {title}", ""]
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(paths[n])
        back = spark.read.parquet(paths[n])
        lines += [f"## {n}", "", f"| {' | '.join(back.columns)} |", "|" + "-|" * len(back.columns), *[f"| {' | '.join(map(str, r))} |" for r in back.limit(20).collect()], ""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/report.md")
    return paths | {"report": f"{out_dir}/report.md"}


def config_json(cfg: BehaviorConfig | ScienceConfig) -> str:
    return json.dumps(asdict(cfg), default=str, sort_keys=True)
