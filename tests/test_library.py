"""Sources, sessions, as-of joins, models, streaming and research on small inputs."""

from __future__ import annotations

import io
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marketloom.functions import session, stats
from marketloom.functions.asof import asof_backward
from marketloom.operators import labels, models, research, store, tape
from marketloom.plans import folds, research_queries
from marketloom.sources import mbo
from marketloom.streaming import book_stream

from .conftest import SF

ET = ZoneInfo("America/New_York")


def test_sessions_across_both_clock_changes(spark):
    walls = [datetime(2024, m, d, h, mi, tzinfo=ET) for m, d in ((3, 9), (3, 10), (3, 11), (11, 2), (11, 3), (11, 4), (7, 1)) for h, mi in ((0, 30), (2, 59), (3, 0), (9, 29), (9, 30), (11, 30), (15, 59), (16, 0), (17, 59), (18, 0), (23, 59))]
    df = spark.createDataFrame([(i, int(w.timestamp()) * 10**9 + 123) for i, w in enumerate(walls)], "i int, ts bigint")
    start, end = session.session_bounds(F.col("ts"))
    rows = df.select("i", "ts", session.liquidity_session(F.col("ts")).alias("s"), session.trade_date(F.col("ts")).alias("d"), session.minutes_since_open(F.col("ts")).alias("m"), start.alias("a"), end.alias("b"), session.session_phase(F.col("ts")).alias("p")).collect()
    for r in rows:
        w = datetime.fromtimestamp(r.ts // 10**9, ET)
        m = w.hour * 60 + w.minute
        assert r.s == (0 if m >= 1080 or m < 180 else 1 if m < 570 else 2)
        assert r.d == (w.date() if w.hour < 18 else (pd.Timestamp(w.date()) + pd.Timedelta(days=1)).date()).isoformat()
        assert r.m == (m - 570 if 570 <= m < 960 else None) and r.a <= r.ts < r.b and (r.p == 0) == (r.m is None)
    assert spark.range(1).select(session.liquidity_session(F.lit(None).cast("bigint"))).first()[0] is None


def test_contract_and_readers(spark, tmp_path):
    events = mbo.events_as_mbo(spark, SF)
    assert mbo.validate(events) is events
    with pytest.raises(ValueError, match="missing"):
        mbo.validate(events.drop("flags"))
    with pytest.raises(ValueError, match="breaches"):
        mbo.validate(events.withColumn("ingest_ts", F.col("event_ts") - 1))
    table = events.limit(50).toArrow()
    pq.write_table(table, str(tmp_path / "a.parquet"))
    for name, make in (("a.arrow", pa.ipc.new_file), ("b.ipc", pa.ipc.new_stream)):
        with make(str(tmp_path / name), table.schema) as out:
            out.write_table(table)
    import zstandard

    buffer = io.BytesIO()
    pq.write_table(table, buffer)
    (tmp_path / "c.parquet.zst").write_bytes(zstandard.ZstdCompressor().compress(buffer.getvalue()))
    table.to_pandas().to_csv(tmp_path / "d.csv", index=False)
    want = sorted(map(tuple, mbo.read(spark, str(tmp_path / "a.parquet")).collect()))
    for name in ("a.arrow", "b.ipc", "c.parquet.zst", "d.csv"):
        assert sorted(map(tuple, mbo.read(spark, str(tmp_path / name)).collect())) == want
    assert [r.event_ts for r in mbo.read(spark, str(tmp_path / "a.parquet"), 3).collect()] == [w[0] for w in sorted(want, key=lambda w: (w[0], w[2]))[:3]]


def test_vendor_frames(spark):
    df = spark.createDataFrame([(5, 7, 1, "Add", "Bid", 99.25, 3, 8), (6, 8, 1, "Clear", "None", float("nan"), 0, 0), (7, 9, 1, "trade", "sell", None, 1, 0)], "ts_event bigint, ts_recv bigint, instrument_id bigint, action string, side string, price double, size bigint, order_id bigint")
    got = mbo.prepare(df).orderBy("event_ts").collect()
    assert [(r.action, r.side, r.price, r.sequence) for r in got] == [("A", "B", 99_250_000_000, 1), ("R", "N", 0, 2)]


@pytest.mark.parametrize("slice_ns", [None, 10])
def test_asof_ties_nulls_and_keys(spark, slice_ns):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (2, 10), (2, None), (3, 1)], "k int, t bigint")
    right = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 11, 1, None), (2, 20, 1, "z"), (2, None, 1, "n")], "k int, u bigint, o int, v string")
    got = sorted(map(str, asof_backward(left, right, "t", "u", by=["k"], columns=["v", "o"], tie=["o"], slice_ns=slice_ns).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(1, 5, "b", 2), (1, 10, "b", 2), (1, 99, None, 1), (2, 10, None, None), (2, None, None, None), (3, 1, None, None)], "k int, t bigint, v string, o int").collect()))


def test_feature_store(spark, tmp_path):
    own = store.FeatureStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("f", 1, 1.0, 5, 6, "v1"), ("f", 1, 2.0, 7, 9, "v1"), ("g", 1, None, 7, 9, "v2")], "feature string, instrument_id bigint, value double, event_ts bigint, availability_ts bigint, version string")
    own.ingest(rows)
    assert [r.version for r in own.versions().collect()] == ["v1", "v2"] and own.data("v1", 1).count() == 2
    assert store.as_of(own.data(), 8).first().value == 1.0
    with pytest.raises(Exception, match="availability before event"):
        own.ingest(rows.withColumn("availability_ts", F.lit(1).cast("bigint")))


def test_folds_never_share_a_time(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(40)], "t bigint, k bigint")
    rows = folds.purged_walk_forward(df, "t", 3, embargo=1, purge=2, order=["k"]).collect()
    for f in {r.fold for r in rows}:
        train, test = [r for r in rows if r.fold == f and r.role == "train"], [r for r in rows if r.fold == f and r.role == "test"]
        assert max(r.t for r in train) <= min(r.t for r in test) - 1
        assert max(r.k for r in train) < min(r.k for r in test) - 2
    held = folds.frozen_holdout(df, "t", 0.2).collect()
    assert {r.t for r in held if r.is_holdout}.isdisjoint({r.t for r in held if not r.is_holdout}) and any(r.is_holdout for r in held)


def test_labels_censor_and_do_not_stick(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0), (1, 2, 1, 0, 0), (1, 3, 0, 1, 0), (2, 4, 1, 0, 0), (2, 5, 0, 0, 0), (3, 6, 1, 0, 0), (3, 7, 0, 1, 1), (4, 8, 1, 0, 0), (4, 9, 0, 0, 0), (4, 10, 0, 0, 0)], "g int, availability_ts bigint, trig int, good int, bad int")
    rows = labels.labeled_outcomes(df, [labels.Outcome("y", ("trig",), ("good",), ("bad",), 2)], ["g"]).orderBy("g").collect()
    assert [(r.g, r.y, r.horizon_bars, r.label_status, r.outcome_available_ts) for r in rows] == [(1, 1.0, 2, "resolved", 3), (2, None, 1, "censored", 5), (3, None, 1, "ambiguous", 7), (4, 0.0, 2, "resolved", 10)]


def test_models_as_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) @ np.diag([3, 2, 1, 0.5])
    y = (x @ [0.8, -0.5, 0.2, 0] + rng.normal(size=400) > 0).astype(int)
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(np.column_stack((x, y, x @ [1, 2, 3, 4] + 5, range(400))), columns=[*names, "y", "t", "k"])).repartition(5)
    pca = models.fit_pca(df, names, 2)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(pca.components @ v[:2].T), np.eye(2), atol=1e-6)
    back = pca.reconstruct(pca.transform(df)).agg(F.avg((F.col("a") - F.col("r_a")) ** 2)).first()[0]
    assert back < 1.0
    assert np.allclose(models.fit_ridge(df, names, ["t"], 1e-9).weights.ravel(), [1, 2, 3, 4, 5], atol=1e-5)
    model = models.fit_logistic(df, names, "y", [1, 0], 1.0)
    z = (x - model.scaler.mean) / model.scaler.std
    p = 1 / (1 + np.exp(-(z @ model.weights[0, :-1] + model.weights[0, -1])))
    assert np.allclose(z.T @ (p - y) + model.weights[0, :-1], 0, atol=1e-4) and abs((p - y).sum()) < 1e-4
    scored = model.transform(df).select("k", "p_1", "p_0").orderBy("k").toPandas()
    assert np.allclose(scored["p_1"], p) and np.allclose(scored.p_1 + scored.p_0, 1)
    centers = models.fit_kmeans(df.withColumn("a", F.col("a") + F.when(F.col("k") % 2 == 0, 50).otherwise(0)), ["a"], 2, "k").centers
    assert centers[1, 0] - centers[0, 0] == pytest.approx(50, abs=1)
    auc = stats.roc_auc(stats.scored(model.transform(df), "y", "p_1")).first()[0]
    assert auc == pytest.approx((p[y == 1][:, None] > p[y == 0][None, :]).mean(), abs=1e-6)
    three = df.withColumn("cls", F.when(F.col("a") > 2, "u").when(F.col("a") < -2, "v").otherwise("w"))
    fitted = models.fit_temperature(three, models.fit_logistic(three, names, "cls", ["u", "v", "w"]), "cls")
    sums = fitted.transform(three).select((F.col("p_u") + F.col("p_v") + F.col("p_w")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_resampling_finds_effects_only_where_they_are(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    assert models.permutation_test(spark, a, b, 300).first().pvalue > 0.05
    assert models.permutation_test(spark, a, b + 1, 300).first().pvalue < 0.02
    ci = models.bootstrap_ci(spark, a, 300).first()
    assert ci.low < ci.point < ci.high
    assert models.distance_correlation(a, a**2) > models.distance_correlation(a, b)


def test_streaming_equals_batch(spark, tmp_path):
    from marketloom.operators import book

    events = mbo.events_as_mbo(spark, SF).orderBy("event_ts", "sequence")
    source = str(tmp_path / "in")
    rows = events.toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 3)):
        pd_part = rows.iloc[part]
        spark.createDataFrame(pd_part, events.schema).coalesce(1).write.mode("append").parquet(f"{source}/p={i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/p=*")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(book_stream.top_of_book(stream), "tob")
    want = book.top_of_book(events).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    flow = run(book_stream.order_flow(stream, tape.HOUR), "flow")
    batch = tape.order_flow_summary(events, tape.HOUR).select("instrument_id", "bucket_start", "availability_ts", "buy_volume", "sell_volume", "buy_trades", "sell_trades")
    assert 0 < flow.count() <= batch.count() and flow.select(*batch.columns).exceptAll(batch).isEmpty()


def test_research(spark):
    assert len(research.gap_grid()) == 72 and len(research.breakout_grid()) == 144
    names = [s.name() for s in [*research.gap_grid(), *research.breakout_grid(), *research.gap_grid(False), *research.breakout_grid(False), *research.hold_grid()]]
    assert all("." not in n for n in names)
    rng = np.random.default_rng(2)
    r = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"availability_ts": range(300), "ret": r, "good": r + rng.normal(size=300), "noise": rng.normal(size=300)}))
    screened = {x.signal: x for x in research.screen(df, ["good", "noise"], "ret", n=60).collect()}
    assert screened["good"].selected and not screened["noise"].selected
    table, summary = research.walk_forward_select(df, ["good", "noise"], "ret", n=30)
    assert [x.selected for x in table.collect()] == ["good"] * 3 and summary.first().pvalue < 0.05
    evidence = research.EvidenceStore()
    evidence.add(research.Evidence("e1", "ic", 0.5, 0.01))
    with pytest.raises(ValueError):
        evidence.add(research.Evidence("e1", "ic", 0.5))
    text = research.report("t", evidence, [research.Finding("x", ("e1",)), research.Finding("y", ("e2",))])
    assert "- x (e1)" in text.split("## Rejected")[0] and "- y (e2)" in text.split("## Rejected")[1]
    assert research.day_seed(1, "2024-01-01") == research.day_seed(1, "2024-01-01") != research.day_seed(2, "2024-01-01")
    assert len(research_queries.NAMES) == len(set(research_queries.NAMES))


def test_policy_and_leakage(spark, tmp_path):
    from marketloom.plans import policy

    (tmp_path / "c.toml").write_text("[temporal]\nembargo_ns = 5\nhorizon = 3\n")
    own = policy.TemporalPolicy.read(tmp_path / "c.toml", window=9, stride=4)
    assert (own.purge(), own.embargo(10), policy.TemporalPolicy.read(tmp_path / "none").embargo_ns) == (3, 330, 1_000_000_000)
    (tmp_path / "d.toml").write_text("[temporal]\nwhat = 5\n")
    with pytest.raises(ValueError, match="unknown"):
        policy.TemporalPolicy.read(tmp_path / "d.toml")
    assert policy.grid_context([3, 9], 1) == (9, True) and policy.aligned_horizon(1, 2, 9) == 4 and policy.aligned_horizon(2, 2, 9) == 2
    events = mbo.events_as_mbo(spark, SF)
    cut = int(events.agg(F.percentile("event_ts", 0.5)).first()[0]) // tape.HOUR * tape.HOUR
    policy.detect_leakage(lambda m: tape.ohlcv_bars(m, tape.HOUR), events, [cut]).check()
    leaky = policy.detect_leakage(lambda m: tape.ohlcv_bars(m, tape.HOUR).withColumn("top", F.max("h").over(__import__("pyspark").sql.Window.partitionBy("instrument_id"))), events.withColumn("price", F.col("price") + F.col("event_ts") % 1000), [cut])
    assert leaky.leaking == (cut,)


def test_period_and_gates(spark, tmp_path):
    from marketloom.operators import period

    for day, rows in (("2024-01-01", [(1, 0), (2, 1)]), ("2024-01-02", [(3, 1), (4, 2)])):
        spark.createDataFrame(rows, "availability_ts bigint, vp_liquidity_session int").write.parquet(str(tmp_path / "ok" / day / "blended.parquet"))
        spark.createDataFrame([(1, 0)], "availability_ts bigint, vp_liquidity_session int").write.parquet(str(tmp_path / "twice" / day / "blended.parquet"))
    runs = period.story_runs(period.read_days(spark, str(tmp_path / "ok"))).orderBy("availability_ts").collect()
    assert [(r.liquidity_run, r.behavior_story_run) for r in runs] == [(0, 0), (1, 0), (2, 1), (3, 2)]
    with pytest.raises(Exception, match="stands in two days"):
        period.read_days(spark, str(tmp_path / "twice")).collect()
    with pytest.raises(ValueError, match="raw events"):
        period.refuse_raw_events(mbo.events_as_mbo(spark, SF))
    assert period.peel("a__depth__sign", ["a", "b"]) == ("a", "depth__sign") and period.peel("a", ["a"]) is None
    held = period.FrozenHoldout(spark.range(3))
    assert held.evaluate(lambda d: d.count()) == 3
    with pytest.raises(RuntimeError):
        held.evaluate(lambda d: d.count())


def test_symbolic_programs_agree_with_sql(spark):
    from marketloom.operators import symbolic

    rng = np.random.default_rng(4)
    x = {n: rng.normal(size=50) for n in "ab"}
    df = spark.createDataFrame(pd.DataFrame(x).assign(k=range(50)))
    trees = [symbolic.grow(rng, ["a", "b"], 3) for _ in range(20)]
    got = symbolic.materialize(df, {f"p{i}": symbolic.to_sql(t) for i, t in enumerate(trees)}).orderBy("k").toPandas()
    for i, t in enumerate(trees):
        assert np.allclose(got[f"p{i}"], symbolic.evaluate(t, x, 50))
    y = x["a"] * x["b"]
    best = symbolic.evolve(x, y, ["a", "b"], 0)[0]
    assert abs(research.ic(symbolic.evaluate(best[0], x, 50), y)) > 0.7


def test_regimes(spark):
    from marketloom.operators import regimes
    from marketloom.operators.ticks import FEATURES

    x = np.zeros((4, len(FEATURES)))
    at = {n: i for i, n in enumerate(FEATURES)}
    assert regimes.structural_mask(x, True, 0).sum() == 16 and regimes.structural_mask(x, False, 1).sum() == 2 and regimes.structural_mask(x, False, 2).sum() == 1
    x[2, at["near_vah"]] = 1
    assert regimes.structural_mask(x, False, 0)[:, at["size_at_vah"]].all() and regimes.structural_mask(x, False, 0).sum() == 4
    df = spark.createDataFrame([(1, i, float(i % 2) * 10 + i * 0.01) for i in range(200)], "instrument_id bigint, availability_ts bigint, v double")
    rows = regimes.causal_regimes(df, ["v"], k=2, every=20).orderBy("availability_ts").collect()
    assert {r.regime for r in rows[:19]} == {-1} and all(r.regime == r.availability_ts % 2 for r in rows[20:])
    s = regimes.silhouette(df.withColumn("y", F.col("availability_ts") % 2), ["v"], "y", "availability_ts").first()
    assert s.n == 200 and s.silhouette > 0.8


def test_silhouette_of_many_rows(spark):
    from marketloom.operators import regimes

    few = [(i, i % 3, float(i % 3) * 4 + (i * 37 % 101) * 0.05, float(i * 53 % 97)) for i in range(300)]
    x, y = np.array([r[2:] for r in few]), np.array([r[1] for r in few])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    mean = np.array([[gap[i, y == k].sum() / ((y == k).sum() - (y[i] == k)) for k in range(3)] for i in range(300)])
    a, b = mean[np.arange(300), y], np.where(np.arange(3) == y[:, None], np.inf, mean).min(axis=1)
    got = regimes.silhouette(spark.createDataFrame(few, "id long, y int, a double, b double"), ["a", "b"], "y", "id", block_rows=64).first()
    assert got.n == 300 and got.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)
    many = spark.range(20_500).select("id", (F.col("id") % 2).alias("y"), ((F.col("id") % 2) * 100 + F.col("id") % 7).cast("double").alias("v"))
    s = regimes.silhouette(many, ["v"], "y", "id").first()
    assert s.n == 20_500 and s.silhouette > 0.9


def test_unified_run_and_command_line(spark, tmp_path, capsys):
    from marketloom import cli
    from marketloom.plans import unified

    mbo.events_as_mbo(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "events"))
    (tmp_path / "run.toml").write_text(f"[research]\ninterval_ns = {tape.HOUR}\nprofile_interval_ns = {4 * tape.HOUR}\nn_permutations = 20\nlead_lag_window = 5\n[temporal]\ninterval_ns = 1\n")
    assert unified.RunConfig.read(tmp_path / "run.toml").interval_ns == tape.HOUR
    assert cli.main(["research", str(tmp_path / "events"), "--lead", "1", "--follow", "2", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "run.toml")]) == 0
    features = spark.read.parquet(str(tmp_path / "out/features.parquet"))
    assert features.count() == features.select("availability_ts").distinct().count() > 100
    assert features.where("vp_fsm_break IS NULL").isEmpty() and spark.read.parquet(str(tmp_path / "out/coverage.parquet")).count() == 6
    assert "# Unified research report" in spark.read.text(str(tmp_path / "out/report.md")).first()[0]
    assert cli.main(["list"]) == 0 and "footprint_summary" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "events")]) == 0
