"""Grouped fits, calibrators, guards, runs by day, behaviour and strategy runs on small inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.lineage import settled
from marketloom.operators import evaluation, frames, models, period, regimes, research, symbolic, tape
from marketloom.plans import behavior_run, folds, policy, progress, strategies
from marketloom.sources import mbo

from .conftest import SF

H1 = 3_600_000_000_000


def _labelled(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(2, 5)
        for name, z in (("one", a - 0.3), ("two", 0.4 * b - 1)):
            rows.append((i, name, a, b, float(rng.random() < 1 / (1 + math.exp(-z)))))
    rows += [(n, "flat", 1.0, 2.0, 1.0)] * 20
    return spark.createDataFrame(rows, "id int, outcome_name string, a double, b double, y double")


def test_grouped_fit_is_as_separate_fits(spark):
    rows = settled(_labelled(spark))
    model = models.fit_logistic_groups(rows, "outcome_name", ["a", "b"], "y")
    assert sorted(model.weights) == ["one", "two"]
    got = {(r.id, r.outcome_name): r.p_hat for r in model.transform(rows).collect()}
    for name in ("one", "two"):
        own = rows.where(F.col("outcome_name") == name).withColumn("label", F.col("y").cast("int"))
        for r in models.fit_logistic(own, ["a", "b"], "label", [1, 0]).transform(own).collect():
            assert got[r.id, name] == pytest.approx(r.p_1, abs=1e-6)
    assert got[600, "flat"] is None
    assert models.fit_logistic_groups(rows.limit(0), "outcome_name", ["a"], "y").weights == {}


def test_calibrators_by_outcome(spark):
    rows = settled(_labelled(spark).withColumn("p_hat", 1 / (1 + F.exp(-3 * F.col("a")))))
    lines = evaluation.fit_calibrators(rows)
    assert sorted(lines) == ["one", "two"]  # an outcome with one class has no line
    own = models.fit_platt(rows.where("outcome_name = 'one'"), "p_hat", "y")
    want = {r.id: r.p for r in rows.where("outcome_name = 'one'").select("id", own(F.col("p_hat")).alias("p")).collect()}
    made = evaluation.apply_calibrators(rows, lines).collect()
    assert all(r.p_cal == pytest.approx(want[r.id]) if r.outcome_name == "one" else r.p_cal == r.p_hat or r.outcome_name == "two" for r in made)
    metrics = {r.outcome_name: r for r in evaluation.metrics_by_outcome(rows).collect()}
    after = {r.outcome_name: r for r in evaluation.metrics_by_outcome(evaluation.apply_calibrators(rows, lines), p="p_cal").collect()}
    assert after["one"].log_loss < metrics["one"].log_loss and metrics["flat"].auc is None


def test_turns_and_quotas():
    assert evaluation.in_turns([["a", "b"], ["c"], ["a", "d", "e"]], 5) == ["a", "c", "d", "b", "e"]
    assert evaluation.in_turns([["a", "b"], ["c"]], 3, [1, 1]) == ["a", "c", "b"]
    assert evaluation.in_turns([["a"]], 0) == [] and evaluation.stack_columns([["x"], ["x", "y"], ["z"]], 1) == ["x", "y"]


def test_guards(spark):
    day = 86_400_000_000_000
    base = 1_704_200_000_000_000_000
    good = spark.createDataFrame([(base, base + H1)], "setup_availability_ts bigint, outcome_available_ts bigint")
    frames.assert_labels(good)
    with pytest.raises(AssertionError):
        frames.assert_labels(good.withColumn("outcome_available_ts", F.lit(base + 2 * day)))
    with pytest.raises(AssertionError):
        frames.assert_labels(good.withColumn("outcome_available_ts", F.lit(base - 1)))
    days = spark.createDataFrame([(base, "d1"), (base + H1, "d2")], "availability_ts bigint, period_day_id string")
    with pytest.raises(AssertionError):
        frames.assert_labels(good, days)
    with pytest.raises(AssertionError):
        frames.refuse_trades(good.withColumn("edge_pnl", F.lit(1.0)))
    with pytest.raises(ValueError):
        frames.need_decisions(good)
    table = spark.createDataFrame([(1, 5, 5, 10, 11)], "fold int, train_n int, test_n int, train_end_ts bigint, test_start_ts bigint")
    oof = spark.createDataFrame([(12, 10, True)], "availability_ts bigint, model_train_end_ts bigint, eligible_for_backtest boolean")
    live = oof.withColumn("eligible_for_backtest", F.lit(False))
    frames.assert_predictions(table, oof, live, ["a"])
    for broken in ((table.withColumn("test_start_ts", F.lit(10)), oof, live, []), (table, oof.withColumn("availability_ts", F.lit(9)), live, []), (table, oof, oof, []), (table, oof, live, ["period_day_id"])):
        with pytest.raises(AssertionError):
            frames.assert_predictions(*broken)
    with pytest.raises(AssertionError):
        frames.refuse_trades(good.withColumn("trade_x", F.lit(1)))
    with pytest.raises(ValueError):
        folds.holdout_by_months(good, "setup_availability_ts", 1)
    with pytest.raises(ValueError):
        behavior_run.competing_family("other")
    with pytest.raises(ValueError):
        behavior_run.ScienceConfig(n_splits=0)


def test_small_definitions(tmp_path, spark):
    assert policy.in_nanoseconds(1.7e18) and not policy.in_nanoseconds(1.7e9)
    assert policy.seeded(3).random() == policy.seeded(3).random()
    mbo.Event(1, 2, 3, 4, "X", "A", "B", 5, 6, 7)
    with pytest.raises(ValueError):
        mbo.Event(2, 1, 3, 4, "X", "A", "B", 5, 6, 7)
    with pytest.raises(ValueError):
        mbo.Event(1, 2, 3, 4, "X", "A", "B", 5, -6, 7)
    centers = np.zeros((3, 8))
    centers[1, 2], centers[2, 6] = 1, 1
    assert regimes.phase_map(centers) == {0: regimes.NEUTRAL, 1: regimes.BALANCE, 2: regimes.EXPANSION}
    x = np.arange(8.0).reshape(2, 2, 2)
    masks = np.array([[[True, False], [False, False]], [[False, False], [False, False]]])
    assert regimes.masked_error(x + 2, x, masks) == 4.0 and regimes.masked_error(x, x, masks & False) == 0.0
    assert research.block_columns(["volume", "c"]) == {"price": ["c"], "flow": ["volume"]} and symbolic.default_columns(["x", "delta"]) == ["delta"]
    assert research.day_seed(1, "2024-01-01") != research.day_seed(1, "2024-01-02")
    run = progress.Progress(spark, "run", 2, tmp_path / "log")
    with run.step("one"):
        pass
    assert run.left() is not None and "run: one" in (tmp_path / "log").read_text()


def test_assistant(spark):
    rng = np.random.default_rng(1)
    a = research.Assistant(spark, narrate=str.upper)
    labels = np.repeat([0, 1, 0, 1], 30)
    found = [a.compare_regimes(labels + rng.normal(0, 0.1, 120), labels, "level", 99), a.assess_signal(rng.normal(0.5, 1, 200), "steady", 99), a.assess_signal(rng.normal(0, 1, 200), "noise", 99)]
    assert [a.store.verify(f) for f in found[1:]] == [True, False]
    own = research.Evidence("x", "m", 1.0, 0.001)
    found.append(a.hypothesis("claim", [own, own]))
    text = a.write(found)
    assert "## Narrative" in text and "CLAIM" in text and "## Rejected" in text


def test_days_are_closed_worlds(spark):
    m = mbo.events_as_mbo(spark, SF)
    every = strategies.day_bars(m, H1).select("instrument_id", "day_id", "bucket_start", "c", "volume")
    from marketloom.functions.session import trade_date

    dated = m.withColumn("d", trade_date(F.col("event_ts")))
    for day in ("2024-01-03", "2024-01-09"):
        own = tape.ohlcv_bars(dated.where(F.col("d") == day).drop("d"), H1).select("instrument_id", F.lit(day).alias("day_id"), "bucket_start", "c", "volume")
        assert {tuple(r) for r in own.collect()} == {tuple(r) for r in every.where(F.col("day_id") == day).collect()}


def test_runs_write_their_frames(spark, tmp_path):
    m = mbo.events_as_mbo(spark, SF)
    paths = strategies.run_days(spark, m, str(tmp_path / "days"), H1)
    assert spark.read.parquet(paths["aggregate"]).first().n_days > 5
    analysis = behavior_run.analyse(m, behavior_run.BehaviorConfig(interval_ns=H1, profile_interval_ns=4 * H1, with_projection=False), str(tmp_path / "behavior"))
    assert analysis.states().count() == analysis.blended.count() > 20
    assert analysis.predictions().count() == 0 and analysis.summary().count() == 1
    science = behavior_run.run_science(analysis.blended, behavior_run.ScienceConfig(window=3, n_splits=2, least_train=4, most_features=4, include_paths=False))
    frames.assert_predictions(science.folds, science.oof, science.live, science.features)
    frames.assert_labels(science.labeled.where("outcome_available_ts >= setup_availability_ts").limit(0))
    assert set(behavior_run.write_science(spark, science, str(tmp_path / "science"))) >= {"folds", "metrics", "oof", "live", "drift", "stability", "report", "manifest"}
    tables = behavior_run.expansion_mechanics(science.labeled, "y_true_break", columns=("deceptive_score", "signal_evidence"))
    assert set(behavior_run.write_tables(spark, tables, str(tmp_path / "expansion"), "Expansion")) == {*tables, "report"}


def test_counterfactual_and_links(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        s, g = float(rng.choice([-1.0, 1.0])), float(rng.random() < 0.5)
        rows.append((i, s, s * g, float(s * g * 0.5 + rng.normal(0, 0.3)), abs(s * g) * 2.0))
    df = spark.createDataFrame(rows, "availability_ts bigint, sig double, sig__depth__big double, fwd double, z double")
    r = period.depth_counterfactual(df, "sig__depth__big", "fwd", 50).first()
    assert r.ic_with > r.ic_without and r.p < 0.1 and period.depth_counterfactual(df, "sig", "fwd") is None
    link = period.state_link(df, "sig__depth__big", ["z"]).first()
    assert link.n == 400 and link.ic == pytest.approx(1.0)
