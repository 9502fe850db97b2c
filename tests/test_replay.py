"""State machines against plain replays, hand cases, causality and partition invariance."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.operators import auction, behavior, book, edges, ordered, quality, tape, ticks
from marketloom.sources import mbo

from .conftest import SF

NAMES = ("event_ts", "sequence", "action", "side", "price", "size", "order_id", "instrument_id")
SCHEMA = "event_ts bigint, sequence bigint, action string, side string, price bigint, size bigint, order_id bigint, instrument_id bigint"
P = 250_000_000


def stream(spark, events, instrument=1):
    return spark.createDataFrame([(i * 1_000_000_000, i + 1, a, s, p * P, z, o, instrument) for i, (a, s, p, z, o) in enumerate(events)], SCHEMA)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def random_events(n=400, seed=3, trades=True):
    rng = random.Random(seed)
    out, live = [], []
    for k in range(n):
        x = rng.random()
        if x < 0.5 or not live:
            side = rng.choice("BA")
            out.append(("A", side, (100 - rng.randrange(1, 8)) if side == "B" else 100 + rng.randrange(1, 8), rng.randrange(1, 9), k))
            live.append(k)
        elif x < 0.7:
            out.append(("C", "N", 0, rng.choice((0, 1, 3)), rng.choice(live)))
        elif x < 0.8:
            out.append(("M", "N", 100 + rng.choice((-5, -3, 4, 6)), rng.randrange(1, 9), rng.choice(live)))
        elif trades:
            out.append((rng.choice("TF"), rng.choice("BAN"), 100 + rng.randrange(-6, 6), rng.randrange(1, 5), rng.choice([*live, 10_000])))
        else:
            out.append(("R", "N", 0, 0, 0) if rng.random() < 0.05 else ("N", "N", 0, 0, 0))
    return out


def plain_top(events):
    orders, out = {}, []
    for a, s, p, z, o in events:
        if a == "A":
            orders[o] = [s == "B", p * P, z]
        elif a == "R":
            orders = {}
        elif a == "C" and o in orders:
            left = orders[o][2] - z if z > 0 else 0
            orders[o][2] = left
            if left <= 0:
                del orders[o]
        elif a == "M" and o in orders:
            orders[o] = [orders[o][0], p * P, z]
        sides = {}
        for bid, price, size in orders.values():
            sides.setdefault(bid, {}).setdefault(price, 0)
            sides[bid][price] += size
        bid, ask = (max(sides[True]) if sides.get(True) else None), (min(sides[False]) if sides.get(False) else None)
        out.append((bid, sides[True][bid] if bid is not None else None, ask, sides[False][ask] if ask is not None else None))
    return out


def test_top_of_book_as_a_plain_replay(spark):
    for seed, trades in ((1, True), (2, False)):
        events = random_events(seed=seed, trades=trades)
        got = [r[3:7] for r in rows_of(book.top_of_book(stream(spark, events)), "sequence")]
        assert got == plain_top(events)


def test_hand_cases_of_the_book(spark):
    events = [("A", "B", 99, 5, 1), ("A", "B", 99, 3, 2), ("C", "N", 0, 2, 1), ("F", "B", 99, 1, 77), ("M", "A", 98, 4, 2), ("A", "A", 97, 2, 3), ("A", "A", 101, 6, 3), ("C", "N", 0, 0, 1), ("C", "N", 0, 1, 55), ("R", "N", 0, 0, 0)]
    top = rows_of(book.top_of_book(stream(spark, events)), "sequence")
    sizes = [(r.best_bid and r.best_bid // P, r.bid_size, r.best_ask and r.best_ask // P) for r in book.top_of_book(stream(spark, events)).orderBy("sequence").collect()]
    assert sizes == [(99, 5, None), (99, 8, None), (99, 6, None), (99, 6, None), (99, 3, None), (99, 3, 97), (99, 3, 101), (98, 4, 101), (98, 4, 101), (None, None, None)]
    assert top[-1][7:] == (2, 1)
    c = book.crossed_events(book.top_of_book(stream(spark, events))).first()
    assert (c.crossed, c.unknown_refs, c.duplicate_adds) == (1, 2, 1)


def test_depth_bars_are_the_last_ladder_of_each_bucket(spark):
    events = random_events(300, 5)
    df = stream(spark, events)
    iv = 7_000_000_000
    bars = {(r.interval_ns, r.bucket_start): r for r in book.depth_bars(df, [iv, 3 * iv]).collect()}
    single = {r.bucket_start: r for r in book.depth_bars(df, [iv]).collect()}
    assert all(bars[iv, k] == r for k, r in single.items())
    top = plain_top(events)
    for (interval, start), r in bars.items():
        inside = [i for i in range(len(events)) if start <= i * 1_000_000_000 < start + interval]
        bid, bid_size, ask, _ = top[inside[-1]]
        assert r.n_events == len(inside) and r.availability_ts == start + interval
        assert (r.bid_px[0] if r.bid_px else None, r.bid_sz[0] if r.bid_sz else None, r.ask_px[0] if r.ask_px else None) == (bid, bid_size, ask)
        assert r.bid_px == sorted(r.bid_px, reverse=True) and r.ask_px == sorted(r.ask_px) and len(r.bid_px) <= 5


def test_icebergs_by_price(spark):
    events = [("A", "A", 101, 5, 1), ("T", "B", 101, 5, 1), ("A", "A", 101, 5, 2), ("T", "B", 101, 5, 2), ("A", "A", 101, 5, 3), ("A", "A", 102, 5, 4), ("T", "B", 103, 5, 9)]
    assert [(r.price // P, r.peak_display, r.executed, r.replenish_count, r.is_iceberg) for r in book.icebergs(stream(spark, events)).orderBy("price").collect()] == [(101, 5, 10, 2, True), (102, 5, 0, 0, False)]


def test_sweeps(spark):
    df = spark.createDataFrame([([100 * 10**9, 101 * 10**9], [3, 5])], "p array<bigint>, s array<bigint>")
    assert df.select(book.sweep_vwap(F.col("p"), F.col("s"), 5)).first()[0] == pytest.approx((300 + 202) / 5)
    assert df.select(book.sweep_vwap(F.col("p"), F.col("s"), 9)).first()[0] is None


def test_value_area_ties_and_growth():
    assert auction.value_area_of({}) is None
    assert auction.value_area_of({10: 5, 20: 1, 30: 5})[0] == 10  # equally far from the centre and the middle: the lower price
    assert auction.value_area_of({1: 1, 2: 5, 3: 3, 4: 2, 5: 1}) == (2, 4, 2, 12)
    poc, vah, val, total = auction.value_area_of({k: 1 + k % 3 for k in range(50)})
    assert val <= poc <= vah and sum(1 + k % 3 for k in range(val, vah + 1)) >= 0.7 * total


def test_noise_and_deception(spark):
    quick = [("A", "B", 99, 9, 1), ("A", "A", 101, 9, 2), ("A", "B", 90, 9, 3)]
    df = spark.createDataFrame([(0, 1, *quick[0][:2], 99 * P, 9, 1, 1), (1, 2, "A", "A", 101 * P, 9, 2, 1), (2, 3, "A", "B", 90 * P, 9, 3, 1), (20_000_000, 4, "C", "N", 0, 0, 3, 1), (30_000_000, 5, "T", "B", 101 * P, 1, 2, 1), (900_000_000, 6, "C", "N", 0, 0, 1, 1)], SCHEMA)
    assert [r.sequence for r in quality.filter_noise(df).orderBy("sequence").collect()] == [1, 2, 3, 5, 6]
    scored = {r.sequence: r for r in quality.deceptive_scores(df).collect()}
    assert (scored[4].spoof_flag, scored[4].flicker_flag) == (1.0, 1.0) and scored[4].deceptive_score == pytest.approx(0.55) and not scored[4].deceptive_drop
    strict = quality.deceptive_scores(df, quality.DeceptionRules(drop_score=0.5))
    assert {r.sequence for r in quality.filter_deceptive(strict).collect()} == {1, 2, 5, 6}
    assert quality.deceptive_buckets(strict, 10**9).first().deceptive_volume_share == pytest.approx(0 / 37 + 0)


CAUSAL = {
    "top_of_book": (book.top_of_book, "event_ts"),
    "depth_bars": (lambda m: book.depth_bars(m, [tape.HOUR]), "availability_ts"),
    "deception": (lambda m: quality.deceptive_scores(m), "event_ts"),
    "noise": (lambda m: quality.noise_marks(m), "event_ts"),
    "ohlcv": (lambda m: tape.ohlcv_bars(m, tape.HOUR), "availability_ts"),
    "footprint": (lambda m: tape.footprint_summary(m, tape.HOUR), "availability_ts"),
    "auction_states": (lambda m: auction.auction_states(m, tape.HOUR), "availability_ts"),
    "signals": (lambda m: auction.signal_columns(auction.action_states(m, 4 * tape.HOUR, tape.HOUR)), "availability_ts"),
    "projection": (lambda m: behavior.overnight_projection(m, behavior.ProjectionRules(interval_ns=tape.HOUR, min_coverage=0.1)), "availability_ts"),
    "ticks": (lambda m: ticks.tick_stream(m, 1, 2, tape.HOUR), "availability_ts"),
    "gaps": (lambda m: tape.fair_value_gaps(tape.ohlcv_bars(m, tape.HOUR)), "availability_ts"),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_the_future_never_changes_the_past(spark, name):
    f, known = CAUSAL[name]
    events = mbo.events_as_mbo(spark, SF).cache()
    cut = events.agg(F.percentile("event_ts", 0.6)).first()[0]
    cut = int(cut) - int(cut) % (4 * tape.HOUR)
    changed = events.withColumns({"size": F.when(F.col("event_ts") >= cut, F.col("size") + 7).otherwise(F.col("size")), "price": F.when(F.col("event_ts") >= cut, F.col("price") - 3 * P).otherwise(F.col("price"))})
    a, b, short = (f(x).where(F.col(known) <= cut - (known == "event_ts")) for x in (events, changed, events.where(F.col("event_ts") < cut)))
    assert a.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    if name not in ("ticks",):
        assert a.exceptAll(short).isEmpty()


@pytest.mark.parametrize("name", ["top_of_book", "signals", "projection", "ticks"])
def test_partitioning_changes_nothing(spark, name):
    f, _ = CAUSAL[name]
    events = mbo.events_as_mbo(spark, SF)
    a = f(events.repartition(17, "order_id"))
    b = f(events.coalesce(1))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_out_of_order_input_raises():
    from marketloom.operators.ordered import Machine

    with pytest.raises(NotImplementedError):
        Machine().feed({})
    assert Machine().finish() is None


def test_realized_paths_and_events(spark):
    bars = [(1, "d", i, b, s, False) for i, (b, s) in enumerate([(0.0, 0), (3.0, 1), (6.0, 0), (0.0, 0), (0.0, 0)])]
    df = spark.createDataFrame(bars, "instrument_id bigint, story_date string, availability_ts bigint, path_beyond_asia_ticks double, vp_fsm_break int, close_in_value boolean")
    r = behavior.realized_paths(df, ["instrument_id", "story_date"], window=2).collect()
    assert [(x.setup_availability_ts, x.next_path, x.horizon_bars, x.label_status) for x in r] == [(1, "further_beyond_asia", 1, "resolved")]
    assert behavior.path_binaries(behavior.realized_paths(df, ["instrument_id", "story_date"], window=2), ["instrument_id"]).count() == 6
    events = behavior.behavior_events(df, ["instrument_id", "story_date"], window=1).orderBy("availability_ts").collect()
    assert [e.evt_breakout for e in events] == [0, 1, 0, 0, 0] and [e.evt_failed_breakout for e in events] == [0, 0, 0, 1, 0]


def plain_deception(events):
    """Scores by visiting every resting order at each trade; (score, passed over) of each event."""
    r = quality.DeceptionRules()
    live, at, done, out = {}, {}, set(), []
    for i, (a, _, p, _, o) in enumerate(events):
        known, passed, moves, life = live.get(o), False, 0, None
        if a in "TF":
            done.add(o)
            for other in at.get(p, ()):
                if other in live and other not in done:
                    live[other][3] = True
        elif a == "A":
            live[o] = [i, p, 0, False]
            at.setdefault(p, set()).add(o)
        elif a == "M" and known:
            at[known[1]].discard(o)
            live[o] = [known[0], p, known[2] + 1, known[3]]
            at.setdefault(p, set()).add(o)
            moves = known[2] + 1 if o not in done else 0
        elif a == "C" and known:
            at[known[1]].discard(o)
            del live[o]
            if o not in done:
                life, moves, passed = i - known[0], known[2], known[3]
        w = r.weights
        out.append(((0.0 if life is None else w[3] * passed) + w[2] * (moves >= r.bait_modifies), float(passed)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_deception_as_a_plain_replay(spark, seed):
    # orders are added again at other prices while they live; sizes stay small and lives long, so only baits and passed-over orders score
    rng = random.Random(seed)
    events = [(rng.choice("AAMMCTF"), rng.choice("BA"), 100 + rng.randrange(5), 1 + rng.randrange(3), rng.randrange(25)) for _ in range(500)]
    got = quality.deceptive_scores(stream(spark, events)).orderBy("sequence").collect()
    assert [(pytest.approx(s), p) for s, p in plain_deception(events)] == [(r.deceptive_score, r.nonparticipate_flag) for r in got]


def test_a_trade_does_not_visit_the_orders_at_its_price():
    n = 30_000
    rows = {"event_ts": list(range(0, 2 * n * 10**9, 10**9)), "sequence": list(range(2 * n)), "action": ["A"] * n + ["T"] * n, "side": ["B"] * 2 * n, "price": [P] * 2 * n, "size": [1] * 2 * n, "order_id": [*range(n), *[n] * n]}
    began = time.process_time()
    out = quality._Deception(quality.DeceptionRules()).feed(rows)
    assert not any(out["deceptive_score"]) and time.process_time() - began < 10  # 900 million visits take over a minute


def deception_rows(seed, n):
    """Events with equal times, storms, short lives, orders added again while they live, and every side and action."""
    rng = random.Random(seed)
    step, orders, actions = rng.choice([10**6, 10**8, 10**9]), rng.choice([3, 25, 10**5]), rng.choice(["AAMMCTF", "ACCCC", "AAAMCTNR", "ACMMMM"])
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, step, 3 * step])
        action = rng.choice(actions)
        out.append((t, i + 1, action, rng.choice("BBAAN"), P * (100 + rng.randrange(rng.choice([5, 40]))), rng.randrange(9), -1 if action in "TF" and seed % 2 else rng.randrange(orders)))
    return out


KINDS = dict(zip(quality.EVENT, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True))


def columns_of(rows):
    return dict(zip(quality.EVENT, map(list, zip(*rows, strict=True)), strict=True))


@pytest.mark.parametrize("seed", range(24))
def test_deception_on_batches_is_that_event_by_event(seed):
    rng = random.Random(seed)
    rows = deception_rows(seed, 900)
    rules = quality.DeceptionRules(spoof_size=rng.choice([5, 2]), bait_modifies=rng.choice([3, 1]), storm_events=rng.choice([10, 3, 0]), storm_share=rng.choice([0.7, 0.3]), window_ns=rng.choice([500_000_000, 0]))
    plain, machine = quality._Deception(rules).feed(columns_of(rows)), quality._Columns(rules)
    got = {c: [] for c in plain}
    while rows:
        k = rng.choice([1, 7, 100, 400])
        for c, v in machine.feed({c: pa.array(x, KINDS[c]) for c, x in columns_of(rows[:k]).items()}).items():
            got[c] += v.tolist()
        rows = rows[k:]
    assert got == plain


def test_deception_on_batches_forgets_orders_and_takes_nulls():
    machine = quality._Columns(quality.DeceptionRules())
    rows = [(2 * i + j, 2 * i + j + 1, a, "B", P, 1, i) for i in range(500) for j, a in enumerate("AC")]
    machine.feed({c: pa.array(x, KINDS[c]) for c, x in columns_of(rows).items()})
    assert not machine.slots and not machine.left and machine.sides[0].best() is None
    more = [(9999, 9999, "T", None, None, None, None), (10**4, 10**4, None, "B", None, 1, 7)]
    assert machine.feed({c: pa.array(x, KINDS[c]) for c, x in columns_of(more).items()})["deceptive_score"].tolist() == [0, 0]
    with pytest.raises(ValueError, match="without a price"):
        machine.feed({c: pa.array(x, KINDS[c]) for c, x in columns_of([(10**5, 10**5, "A", "B", None, 1, 8)]).items()})


def test_deceptive_scores_run_on_batches(spark):
    # 60,000 events cost the machine of single events 0.3 s of CPU time or more
    rows = [(t, s, a, d, p, 1 + i % 3, i % 700) for i, (t, s, a, d, p, *_) in enumerate(deception_rows(0, 60_000))]
    took = []
    for kind, convert in ((quality._Deception, lambda c, x: x), (quality._Columns, lambda c, x: pa.array(x, KINDS[c]))):
        fed = [{c: convert(c, x) for c, x in columns_of(rows).items()} for _ in range(2)]
        kind(quality.DeceptionRules()).feed(fed[0])
        began = time.process_time()
        kind(quality.DeceptionRules()).feed(fed[1])
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2
    assert quality.machine_for(quality.DeceptionRules()) is quality._Columns
    assert quality.machine_for(quality.DeceptionRules(drop_score=0.4)) is quality._Deception


def test_arrow_machines_check_order_and_get_long_runs(spark):
    seen = []

    class Sizes(ordered.Machine):
        arrow = True

        def feed(self, rows):
            seen.append(len(rows["event_ts"]))
            return {"event_ts": rows["event_ts"]}

    assert ordered._arrow_ordered([pa.array([1, 1, 2]), pa.array([1, 2, 0])], (1, 1))
    assert not ordered._arrow_ordered([pa.array([1, 1, 2]), pa.array([2, 1, 0])], None)
    assert not ordered._arrow_ordered([pa.array([1, 2]), pa.array([1, 1])], (1, 2))
    assert not ordered._arrow_ordered([pa.array([1, None]), pa.array([1, 1])], None)
    many = [pa.record_batch({"k": pa.array([1] * 10)}) for _ in range(3)]
    assert [b.num_rows for b in ordered._runs(iter(many))] == [30]
    df = spark.range(70_000).selectExpr("id % 3 AS k", "id AS event_ts", "id AS sequence")
    assert ordered.replay(df, ["k"], Sizes, "k bigint, event_ts bigint").groupBy("k").count().count() == 3


def test_blended_bars_score_events_once(spark):
    from marketloom.plans import behavior_queries

    plan = behavior_queries.blended(mbo.events_as_mbo(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line and "deceptive_score" in line for line in plan.splitlines()) == 1


def test_evidence_is_both_frames(spark):
    scored = quality.deceptive_scores(mbo.events_as_mbo(spark, SF))
    at = ["instrument_id", "bucket_start"]
    both = quality.deceptive_buckets(scored, tape.HOUR).select(*at, "deceptive_score", "real_liquidity_ratio").join(behavior.reliability(scored, tape.HOUR).drop("availability_ts"), at)
    assert rows_of(behavior.evidence(scored, tape.HOUR), *at) == rows_of(both, *at)


def test_edge_search_judges_all_holds_on_one_set_of_bars(spark):
    m = mbo.events_as_mbo(spark, SF)
    states = auction.action_states(m, 4 * tape.HOUR, tape.HOUR)
    deceptive = quality.deceptive_buckets(quality.deceptive_scores(m), tape.HOUR)
    table, _ = edges.search_edges(states, deceptive, m, edges.edge_grid())
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    # trades are joined with the chosen ones among them, so what they come from stands twice; no hold adds to that
    assert sum("MapInArrow" in line and "deceptive_score" in line for line in plan.splitlines()) == 2
    columns = ["instrument_id", "bucket_end", "thesis_dir", "close", "decision_val", "decision_vah", "entry_gate"]
    got = auction.entry_gates(states, deceptive, [2, 3, 5])
    for hold in (2, 3, 5):
        own = auction.market_truth(states, deceptive, auction.TruthRules(hold=hold)).select(*columns)
        assert rows_of(got.where(F.col("hold_name") == f"h{hold}_").select(*columns), *columns) == rows_of(own, *columns)


def test_edge_search_without_bars(spark):
    m = mbo.events_as_mbo(spark, SF).where("false")
    deceptive = quality.deceptive_buckets(quality.deceptive_scores(m), tape.HOUR)
    table, outer = edges.search_edges(auction.action_states(m, 4 * tape.HOUR, tape.HOUR), deceptive, m, edges.edge_grid())
    assert table.count() == 0 and outer.count() == 0


def test_replay_converts_every_kind_of_column(spark):
    class Echo(ordered.Machine):
        def feed(self, rows):
            return {c: v for c, v in rows.items() if c != "k"}

    schema = "k bigint, event_ts bigint, sequence bigint, x double, s string, l array<bigint>, b boolean"
    rows = [(1, 1, 1, 0.5, "a", [1], True), (1, 1, 2, None, None, None, None), (1, 2, 1, -1.0, "b", [], False), (2, 0, 9, 2.5, "", [2, 3], True)]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(ordered.replay(df, ["k"], Echo, schema), "k", "event_ts", "sequence") == rows
