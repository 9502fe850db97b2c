"""Market queries pass over the events once for each of their frames; what saves a pass changes no row."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.operators import auction, behavior, ordered, quality, tape
from marketloom.plans import behavior_queries, book_queries
from marketloom.sources import mbo

from .conftest import SF
from .test_replay import SCHEMA, P, deception_rows, rows_of

AT = ("instrument_id", "bucket_start")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def scans(df):
    return sum("Relation [" in line for line in plan_of(df))


def machines(df):
    return sum("MapInArrow" in line for line in plan_of(df))


class Count(ordered.Machine):
    def __init__(self):
        self.n = 0

    def feed(self, rows):
        assert set(rows) == {"v", "event_ts", "sequence"}
        self.n += len(rows["v"])
        return {"seen": list(range(self.n - len(rows["v"]) + 1, self.n + 1))}


class Short(ordered.Machine):
    def feed(self, rows):
        return {"seen": rows["event_ts"][1:]}


def test_replay_puts_columns_beside_the_rows(spark):
    rows = [(k, ts, 0, ts * 10, [(ts, "x"), (ts + 1, None)], None if ts % 2 else "odd") for k in ("a", "b") for ts in range(3)]
    df = spark.createDataFrame(rows, "k string, event_ts bigint, sequence bigint, v bigint, pairs array<struct<p: bigint, s: string>>, note string")
    made = ordered.replay(df, ["k"], Count, "seen bigint", reads=["v"])
    assert rows_of(made, "k", "event_ts") == [(*r, r[1] + 1) for r in rows_of(df, "k", "event_ts")]
    with pytest.raises(Exception, match="rows made of"):
        ordered.replay(df, ["k"], Short, "seen bigint", reads=["v"]).collect()


def test_market_truth_passes_over_the_events_once_a_frame(spark):
    truth = book_queries._truth(mbo.events_as_mbo(spark, SF))
    assert scans(truth) == 3 and machines(truth) == 3  # profile bars, signal bars, deception


def test_trades_inside_value_are_those_of_the_tape(spark):
    m = mbo.events_as_mbo(spark, SF)
    states = auction.auction_states(m, 4 * tape.HOUR)
    inside = tape.add_time_bucket(m.where("action = 'T'"), 4 * tape.HOUR).select(*AT, "price", "size").join(states.select(*AT, "decision_val", "decision_vah"), list(AT)).where("price BETWEEN decision_val AND decision_vah")
    want = states.select(*AT).join(inside.groupBy(*AT).agg(F.sum("size").alias("v")), list(AT), "left").select(*AT, F.coalesce("v", F.lit(0)))
    got = rows_of(states.select(*AT, "in_value_volume"), *AT)
    assert got == rows_of(want, *AT) and any(r[2] for r in got)


@pytest.mark.parametrize("rules", [quality.DeceptionRules(), quality.DeceptionRules(drop_score=0.3)])
def test_deception_summed_where_it_is_scored(spark, rules):
    m = mbo.events_as_mbo(spark, SF)
    want = quality.deceptive_buckets(quality.deceptive_scores(m, rules), tape.HOUR)
    got = quality.bucketed_deception(m, tape.HOUR, rules=rules)
    assert got.dtypes == want.dtypes and rows_of(got, *AT) == rows_of(want, *AT)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_buckets_go_on_over_batches(size):
    rows = deception_rows(4, 300)
    names = ("event_ts", "sequence", "action", "side", "price", "size", "order_id")
    columns = {c: pa.array(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)}
    interval = (rows[-1][0] - rows[0][0]) // 9 + 1
    whole = quality._Columns(quality.DeceptionRules()).feed(columns)
    want: dict = {}
    for ts, z, a, s in zip(columns["event_ts"].to_pylist(), columns["size"].to_pylist(), columns["action"].to_pylist(), whole["deceptive_score"].tolist(), strict=True):
        n, score, bad, every, cancels = want.get(ts - ts % interval, (0, 0.0, 0, 0, 0))
        want[ts - ts % interval] = n + 1, score + s, bad + z * (s >= 0.5), every + z, cancels + (s >= 0.5 and a == "C")
    machine = quality._Buckets(quality._Columns(quality.DeceptionRules()), interval, 0.5)
    parts = [machine.feed({c: v.slice(i, size) for c, v in columns.items()}) for i in range(0, len(rows), size)] + [machine.finish()]
    got = [r for p in parts for r in zip(*(p[c] for c in ("bucket_start", "_n", "_score", "_bad", "_all", "_cancels")), strict=True)]
    assert got == [(k, *v) for k, v in sorted(want.items())] and len(got) > 5


def test_edge_trades_compute_their_gates_once(spark):
    m = mbo.events_as_mbo(spark, SF)
    trades = auction.edge_trades(book_queries._truth(m), m)
    assert sum("MapInArrow" in line and "spoof_flag" in line for line in plan_of(trades)) == 1 and scans(trades) == 4
    r = auction.TradeRules()
    joined = auction.trades_of(book_queries._truth(m), m, [("", r.reward_to_risk, r.stop_buffer)], r.max_hold_ns, r.cost).drop("name")
    assert trades.dtypes == joined.dtypes and rows_of(trades, "instrument_id", "entry_ts") == rows_of(joined, "instrument_id", "entry_ts")


def test_realized_paths_score_no_deception(spark):
    m = mbo.events_as_mbo(spark, SF)
    got = behavior.realized_paths(behavior_queries.paths(m), behavior_queries.STORY)
    assert not any("deceptive_score" in line for line in plan_of(got)) and scans(got) == 3 and machines(got) == 4  # profile bars, signal bars, projection; ranges and signals run on bars
    registered = plan_of(behavior_queries.QUERIES["realized_paths"](spark, SF))
    assert not any("deceptive_score" in line for line in registered)
    at = (*behavior_queries.STORY, "setup_availability_ts")
    assert rows_of(got, *at) == rows_of(behavior.realized_paths(behavior_queries.blended(m), behavior_queries.STORY), *at)


def test_level_flow_as_plain_sums(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3 * tape.HOUR), i, rng.choice("ACMTFN"), rng.choice("BA"), (100 + rng.randrange(-12, 12)) * P, rng.randrange(9), i, 1) for i in range(400)]
    states = spark.createDataFrame([(1, b * tape.HOUR, (100 + b) * P, (96 - b) * P, 98 * P, "kept") for b in range(4)], "instrument_id bigint, bucket_start bigint, decision_vah bigint, decision_val bigint, decision_poc bigint, note string")
    m = spark.createDataFrame(rows, SCHEMA)
    got = {r.bucket_start // tape.HOUR: r for r in behavior.with_level_flow(states, m, tape.HOUR).collect()}
    for b in range(3):
        total = lambda a, level=None: sum(z for ts, _, x, _, p, z, *_ in rows if ts // tape.HOUR == b and x in a and (level is None or abs(p - level) <= 4 * P))  # noqa: B023, E731
        vah, val = (100 + b) * P, (96 - b) * P
        assert got[b].lf_near_vah_add_intensity == total("A", vah) / total("A") and got[b].lf_near_val_trade_intensity == total("TF", val) / total("TF")
        assert got[b].lf_near_val_cancel_ratio == total("C", val) / (total("A", val) + 1) and got[b].lf_liquidity_withdrawal == total("C") / (total("A") + total("C") + 1)
        assert got[b].lf_events == sum(ts // tape.HOUR == b and a != "N" for ts, _, a, *_ in rows) and got[b].note == "kept"
    assert got[3].lf_events is None and got[3].lf_liquidity_withdrawal is None  # no event
    alone = behavior.level_flow(m, states, tape.HOUR)
    assert alone.columns[:2] == list(AT) and "note" not in alone.columns and alone.count() == 3


def test_path_binaries_and_confirmation_score_no_deception(spark):
    m = mbo.events_as_mbo(spark, SF)
    for name, passes in (("path_binaries", 3), ("path_confirmation", 4)):  # the second needs flow near levels
        plan = plan_of(behavior_queries.QUERIES[name](spark, SF))
        assert not any("deceptive_score" in line for line in plan) and sum("Relation [" in line for line in plan) == passes
    story = behavior_queries.STORY
    at = (*story, "setup_availability_ts", "outcome_name")
    want = behavior.path_binaries(behavior.realized_paths(behavior_queries.blended(m), story), story)
    assert rows_of(behavior.path_binaries(behavior.realized_paths(behavior_queries.paths(m), story), story), *at) == rows_of(want, *at)


def test_a_projection_bucket_over_two_sessions(spark):
    open_ns = 1_704_268_800_000_000_000  # 3 January 2024, 03:00 in New York: London opens
    rows = [(open_ns + t * 60_000_000_000, i, "T", "B", p * P, z, i, 1) for i, (t, p, z) in enumerate([(-90, 100, 5), (-50, 101, 3), (-10, 100, 2), (10, 100, 4), (20, 103, 1), (50, 102, 9)])]
    rules = behavior.ProjectionRules(interval_ns=tape.HOUR)
    projected = behavior.overnight_projection(spark.createDataFrame(rows, SCHEMA), rules)
    assert scans(behavior.overnight_projection(mbo.events_as_mbo(spark, SF), rules)) == 1
    wide = behavior.overnight_projection(spark.createDataFrame(rows, SCHEMA), behavior.ProjectionRules(interval_ns=3 * tape.HOUR))
    assert [(r.stage, r.close // P, r.composite_total_volume) for r in projected.orderBy("bucket_start").collect()] == [("asia_build", 100, 5), ("asia_build", 100, 10), ("london_extend", 102, 24)]
    # three hours from 01:00 on hold both sessions and count as Asia, with all of their volume
    assert [(r.stage, r.close // P, r.composite_total_volume) for r in wide.orderBy("bucket_start").collect()] == [("asia_build", 102, 24)]


def test_movements_carry_no_flow(spark):
    for name in ("realized_paths", "path_binaries"):
        analysed = behavior_queries.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "path_beyond_asia_ticks" in analysed and "lf_" not in analysed and "path_depth_confirm" not in analysed


def test_projection_knows_sessions_of_slots_and_not_of_events(spark):
    plan = plan_of(behavior.overnight_projection(mbo.events_as_mbo(spark, SF)))
    deepest = max(i for i, line in enumerate(plan) if "Aggregate [" in line)
    assert not any("from_utc_timestamp" in line for line in plan[deepest:]) and any("from_utc_timestamp" in line for line in plan[:deepest])


@pytest.mark.parametrize("minutes", [7, 45, 60, 180])
def test_projection_buckets_as_sessions_of_events(spark, minutes):
    rng, ns, new_york = random.Random(minutes), minutes * 60_000_000_000, ZoneInfo("America/New_York")
    begin = 1_709_953_200_000_000_000  # 8 March 2024, 22:00 in New York; clocks change on the 10th
    rows = [(begin + rng.randrange(60 * tape.HOUR), i, "T", "B", (100 + rng.randrange(12)) * P, rng.randrange(1, 9), i, 1) for i in range(500)]
    rows += [(begin + h * tape.HOUR + d, 1000 + 3 * h + d, "T", "A", (105 + d) * P, 2, 0, 1) for h in range(0, 60, 2) for d in (-1, 0, 1)]
    bars, want = {}, []
    for ts, i, *_, p, z, _, _ in sorted(rows):
        local = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=ts // 1000)).astimezone(new_york)
        m = local.hour * 60 + local.minute
        session = 0 if m >= 1080 or m < 180 else 1 if m < 570 else 2
        if session < 2:
            bars.setdefault((str((local + timedelta(hours=6)).date() if local.hour >= 18 else local.date()), ts - ts % ns), []).append((session, p, z))
    total, seen = {}, set()
    for (story, start), own in sorted(bars.items()):
        total[story] = total.get(story, 0) + sum(z for *_, z in own)
        if own[0][0] == 0:
            seen.add(story)
        if story in seen:
            want.append((story, start, "london_extend" if own[0][0] else "asia_build", own[-1][1], total[story]))
    got = behavior.overnight_projection(spark.createDataFrame(rows, SCHEMA).repartition(3), behavior.ProjectionRules(interval_ns=ns))
    assert sorted((r.story_date, r.bucket_start, r.stage, r.close, r.composite_total_volume) for r in got.collect()) == want


def test_bars_and_projection_of_movements_share_one_pass(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reused exchanges then stand in the plan before it runs
    try:
        for name in ("realized_paths", "path_binaries"):
            plan = behavior_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_bars_of_slots_as_plain_bars(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(30 * tape.HOUR), i, rng.choice("TTA"), rng.choice("BAN"), (100 + rng.randrange(9)) * P, rng.randrange(9), i, 1 + i % 2) for i in range(900)]
    m = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for interval in (tape.HOUR // 6, 7 * tape.HOUR // 4, 3 * tape.HOUR):  # 10 and 105 minutes hold no whole half hours
        want = {}
        for ts, _, a, side, p, z, _, k in sorted(rows):
            if a == "T":
                want.setdefault((k, ts - ts % interval), []).append((side, p, z))
        got = auction._bar_stats(auction._cells(m, interval)).collect()
        assert len(got) == len(want)
        for r in got:
            own = want[r.instrument_id, r.bucket_start]
            levels = {p: sum(z for _, q, z in own if q == p) for _, p, _ in own}
            assert {p: sum(v for q, v in zip(r.prices, r.volumes, strict=True) if q == p) for p in r.prices} == levels
            assert (r.high, r.low, r.close, r.bucket_volume) == (max(levels), min(levels), own[-1][1], sum(levels.values()))
            assert (r.buy_volume, r.sell_volume) == tuple(sum(z for s, _, z in own if s == side) for side in "BA")
