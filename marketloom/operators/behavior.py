"""Auction behaviour: the overnight projection, structure, flow near levels, reliability, path, events, quality and base rates.

Frames are bars keyed by instrument and availability_ts; `story` groups (trade
date with the Asian and London sessions) bound every window.  Nothing here
looks ahead except realized_paths, which labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import ASIA, LONDON, liquidity_session, trade_date
from ..functions.windows import clip
from .auction import SLOT, slot_cells, value_area_of
from .ordered import Machine, Rows, replay
from .quality import SCORES, TICK, deceptive_buckets
from .tape import KEY, add_time_bucket

TS = "availability_ts"


def value(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A column as a double with a default for null or absent ones."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(float(default))


def active(df: DataFrame, name: str, over: float = 0.0) -> Column:
    return F.abs(value(df, name)) > over


@dataclass(frozen=True)
class ProjectionRules:
    interval_ns: int = 180_000_000_000
    value_fraction: float = 0.7
    overlap_high: float = 0.60
    overlap_low: float = 0.35
    min_coverage: float = 0.80
    anchor_stable_ticks: float = 4.0
    hvn_tolerance_ticks: float = 8.0
    acceptance_ticks: float = 8.0
    outside_share: float = 0.35
    repricing_ticks: float = 16.0
    repricing_buckets: int = 2
    stability_window: int = 5


PROJECTION = {
    "bucket_start": "bigint", "stage": "string", "phase": "string", "close": "bigint", "asia_poc": "bigint", "asia_vah": "bigint", "asia_val": "bigint", "asia_primary_hvn": "bigint",
    "composite_poc": "bigint", "composite_vah": "bigint", "composite_val": "bigint", "composite_primary_hvn": "bigint", "composite_total_volume": "bigint",
    "proj_poc_shift_ticks": "double", "proj_hvn_shift_ticks": "double", "proj_poc_step_ticks": "double", "proj_hvn_step_ticks": "double", "proj_hvn_retention_ratio": "double", "proj_migration_speed_ticks": "double",
    "proj_va_overlap": "double", "proj_va_center_shift_ticks": "double", "proj_va_width_ratio": "double", "proj_break_level_distance_ticks": "double", "proj_asia_coverage_ratio": "double", "proj_anchor_complete": "double",
    "proj_outside_volume_share": "double", "proj_anchor_stable": "double", "proj_expansion_testing": "double", "proj_expansion_accepting": "double", "proj_repriced_balance": "double", "proj_value_transferred": "double", "proj_rejection_to_asia": "double", "proj_break_direction": "double",
}


def _nodes(levels: dict[int, int], poc: int) -> tuple[int, list[int]]:
    """Primary node (most volume, then nearest the point of control, then lowest) and all high-volume nodes with it."""
    prices = sorted(levels)
    primary = min(prices, key=lambda p: (-levels[p], abs(p - poc), p))
    inner = {p for a, p, b in zip(prices, prices[1:], prices[2:], strict=False) if levels[p] > levels[a] and levels[p] > levels[b]}
    return primary, sorted(inner | {primary})


class _Projection(Machine):
    """One story: an Asian profile that freezes as the anchor at the first London bucket and goes on as the composite."""

    def __init__(self, rules: ProjectionRules) -> None:
        self.r = rules
        self.levels: dict[int, int] = {}
        self.anchor = self.last = None
        self.latched = self.complete = False
        self.first = None
        self.seen = self.way = self.stable = 0
        self.coverage = 0.0
        self.volume = [0, 0, 0]  # London: all, above, below
        self.steps: list[float] = []

    def _latch(self, start: int) -> None:
        self.latched = True
        if self.first is not None:
            self.coverage = min(1.0, self.seen / max(1, (start - self.first) // self.r.interval_ns))
            self.complete = self.coverage >= self.r.min_coverage
        area = value_area_of(self.levels, self.r.value_fraction)
        if area is not None:
            self.anchor = (*area[:3], *_nodes(self.levels, area[0]))

    def _breaks(self, high: int, low: int, close: int) -> int:
        _, vah, val, *_ = self.anchor
        if high > vah and low < val:
            return 1 if close > vah or (close >= val and high - vah >= val - low) else -1
        return 1 if high > vah else -1 if low < val else 0

    def _phase(self, close: int, area: tuple, calm: bool, accepting: bool, moved: bool) -> str:
        _, vah, val, *_ = self.anchor
        if not self.complete:
            return "incomplete_asia_anchor"
        if not self.way:
            return "london_prebreak"
        if val <= close <= vah and calm:
            return "rejection_return_to_asia"
        if moved and area[2] <= close <= area[1]:
            return "repriced_balance"
        return "expansion_accepting" if accepting else "expansion_testing"

    def _one(self, bar: dict) -> dict | None:
        r, london = self.r, bar["session"] == LONDON
        if london and not self.latched:
            self._latch(bar["bucket_start"])
        for p, v in zip(bar["prices"], bar["volumes"], strict=True):
            self.levels[p] = self.levels.get(p, 0) + v
            if london and self.anchor:
                self.volume[0] += v
                self.volume[1] += v * (p > self.anchor[1])
                self.volume[2] += v * (p < self.anchor[2])
        area = value_area_of(self.levels, r.value_fraction)
        poc, vah, val, total = area
        primary, nodes = _nodes(self.levels, poc)
        close = bar["close"]
        out = dict.fromkeys(PROJECTION, 0.0) | {"bucket_start": bar["bucket_start"], "close": close, "composite_poc": poc, "composite_vah": vah, "composite_val": val, "composite_primary_hvn": primary, "composite_total_volume": total}
        before, self.last = self.last, (poc, primary)
        if not london:
            self.first = bar["bucket_start"] if self.first is None else self.first
            self.seen += 1
            return out | {"stage": "asia_build", "phase": "asia_build"} | dict.fromkeys(("asia_poc", "asia_vah", "asia_val", "asia_primary_hvn"))
        if self.anchor is None:
            self.last = before
            return None
        a_poc, a_vah, a_val, a_primary, a_nodes = self.anchor
        if not self.way and self.complete:
            self.way = self._breaks(bar["high"], bar["low"], close)
        shift, node_shift = (poc - a_poc) / TICK, (primary - a_primary) / TICK
        step, node_step = ((poc - before[0]) / TICK, (primary - before[1]) / TICK) if before else (0.0, 0.0)
        self.steps = [*self.steps, abs(step)][-r.stability_window :]
        union = max(a_vah, vah) - min(a_val, val)
        overlap = 1.0 if union <= 0 else max(0, min(a_vah, vah) - max(a_val, val)) / union
        outside = self.volume[1 if self.way > 0 else 2] / self.volume[0] if self.way and self.volume[0] else 0.0
        kept = sum(any(abs(n - a) <= r.hvn_tolerance_ticks * TICK for n in nodes) for a in a_nodes) / max(1, len(a_nodes))
        calm = abs(shift) <= r.anchor_stable_ticks and abs(node_shift) <= r.anchor_stable_ticks and overlap >= r.overlap_high
        ahead, node_ahead = shift * self.way, node_shift * self.way
        accepting = self.way != 0 and ahead >= r.acceptance_ticks and node_ahead >= 0 and outside >= r.outside_share
        shifted = self.way != 0 and ahead >= r.repricing_ticks and node_ahead >= r.acceptance_ticks and overlap <= r.overlap_low
        quiet = abs(step) <= r.anchor_stable_ticks and abs(node_step) <= r.anchor_stable_ticks
        self.stable = self.stable + 1 if shifted and quiet else 0
        moved = self.stable >= r.repricing_buckets
        phase = self._phase(close, area, calm, accepting, moved)
        level = a_vah if self.way > 0 else a_val
        return out | {
            "stage": "london_extend", "phase": phase, "asia_poc": a_poc, "asia_vah": a_vah, "asia_val": a_val, "asia_primary_hvn": a_primary,
            "proj_poc_shift_ticks": shift, "proj_hvn_shift_ticks": node_shift, "proj_poc_step_ticks": step, "proj_hvn_step_ticks": node_step, "proj_hvn_retention_ratio": kept, "proj_migration_speed_ticks": sum(self.steps) / len(self.steps),
            "proj_va_overlap": float(overlap), "proj_va_center_shift_ticks": ((vah + val) - (a_vah + a_val)) * 0.5 / TICK, "proj_va_width_ratio": (vah - val) / max(a_vah - a_val, TICK), "proj_break_level_distance_ticks": (close - level) * self.way / TICK,
            "proj_asia_coverage_ratio": self.coverage, "proj_anchor_complete": float(self.complete), "proj_outside_volume_share": outside, "proj_anchor_stable": float(calm), "proj_expansion_testing": float(phase == "expansion_testing"),
            "proj_expansion_accepting": float(phase == "expansion_accepting"), "proj_repriced_balance": float(phase == "repriced_balance"), "proj_value_transferred": float(moved), "proj_rejection_to_asia": float(phase == "rejection_return_to_asia"), "proj_break_direction": float(self.way),
        }

    def feed(self, rows: Rows) -> Rows:
        made = [m for m in (self._one(dict(zip(rows, v, strict=True))) for v in zip(*rows.values(), strict=True)) if m]
        return {c: [m[c] for m in made] for c in PROJECTION}


def overnight_projection(df: DataFrame, rules: ProjectionRules | None = None) -> DataFrame:
    """Asian anchor and London composite of every story; stories are independent, so they run in parallel."""
    r = rules or ProjectionRules()
    # sessions and dates change on half hours of a zone that is whole hours off (since 1883), so a slot of trades has one of each:
    # its last trade's, which is known after the sum (the slot's start would carry the filter back to every event)
    last = F.col("_last.event_ts")
    cells = slot_cells(df, r.interval_ns, math.gcd(r.interval_ns, SLOT))
    cells = cells.withColumns({"story_date": trade_date(last), "session": liquidity_session(last).cast("int")}).where(F.col("session").isin(ASIA, LONDON))
    # a bucket that straddles two sessions counts for the session of its first trade; a price has a level in each slot
    bars = cells.groupBy(KEY, "story_date", "bucket_start").agg(F.min_by("session", "slot").alias("session"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_last").alias("close"), F.array_sort(F.collect_list(F.struct("price", "volume"))).alias("x"))
    bars = bars.withColumns({"prices": F.col("x.price"), "volumes": F.col("x.volume")}).drop("x")
    schema = f"{KEY} {df.schema[KEY].dataType.simpleString()}, story_date string, " + ", ".join(f"{c} {k}" for c, k in PROJECTION.items())
    out = replay(bars, [KEY, "story_date"], lambda: _Projection(r), schema, ("bucket_start",))
    end = F.col("bucket_start") + r.interval_ns
    return out.withColumns({"bucket_end": end, TS: end})


def structure(df: DataFrame, tick: float = TICK) -> DataFrame:
    """Distances in ticks from the decision levels, and flags around them; 0 where unknown."""
    level = {k: F.col(f"decision_{k}").cast("double") for k in ("vah", "val", "poc")}
    close = F.col("close").cast("double")
    width = F.greatest(level["vah"] - level["val"], F.lit(float(tick)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {f"struct_dist_{k}_ticks": zero((close - v) / tick) for k, v in level.items()}
    made |= {"struct_va_width_ticks": zero(width / tick), "struct_close_in_value": flag(close.between(level["val"], level["vah"])), "struct_above_vah": flag(close > level["vah"]), "struct_below_val": flag(close < level["val"])}
    made |= {f"struct_near_{k}": flag(F.abs(close - v) <= 0.15 * width) for k, v in level.items()}
    for name, column in (("asia_vah", "asia_vah"), ("asia_val", "asia_val"), ("asia_poc", "asia_poc"), ("asia_hvn", "asia_primary_hvn"), ("composite_hvn", "composite_primary_hvn")):
        made[f"struct_dist_{name}_ticks"] = zero((close - F.col(column).cast("double")) / tick) if column in df.columns else F.lit(0.0)
    pull = lambda pulse, v: zero(F.abs(value(df, pulse)) / (1 + F.abs(close - v) / (width + 1e-9)))
    return df.withColumns(made | {"struct_break_pressure": pull("vp_fsm_break", level["vah"]), "struct_retest_pressure": pull("vp_fsm_retest", level["poc"])})


def _rates() -> list[Column]:
    share = lambda *a: F.avg(F.col("action").isin(*a).cast("double"))
    names = dict(zip(SCORES, ("mean_deceptive_score", "spoof_rate", "flicker_rate", "bait_rate", "nonparticipate_rate", "storm_rate"), strict=True))
    return [*[F.avg(c).alias(f"rel_{n}") for c, n in names.items()], share("T", "F").alias("rel_trade_share"), share("C").alias("rel_cancel_share"), share("A").alias("rel_add_share")]


def _credible(b: DataFrame) -> DataFrame:
    return b.withColumns({"rel_credibility": clip(1 - F.col("rel_mean_deceptive_score"), 0, 1), "rel_evidence_strength": F.abs(2 * F.col("rel_mean_deceptive_score") - 1)})


def reliability(scored: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket: mean deception score and flags, shares of actions, credibility; no event is dropped."""
    return _credible(add_time_bucket(scored, interval_ns).groupBy(KEY, "bucket_start", TS).agg(*_rates()))


def evidence(scored: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket, from one pass over scored events: deception, the share of real liquidity and the columns of reliability."""
    b = _credible(deceptive_buckets(scored, interval_ns, also=_rates()))
    return b.select(KEY, "bucket_start", "deceptive_score", "real_liquidity_ratio", *[c for c in b.columns if c.startswith("rel_")])


LEVELS = ("vah", "val", "poc")


def with_level_flow(states: DataFrame, df: DataFrame, interval_ns: int, near_ticks: int = 4) -> DataFrame:
    """States with the adds, cancels and trades of each bar within a few ticks of its decision levels, as shares of the bar's flow.

    Events are combined by bucket, price and action, and a bar meets its own as
    one array; a bar without events has nulls.
    """
    flow = add_time_bucket(df.where("action IN ('A', 'C', 'M', 'T', 'F')"), interval_ns).groupBy(KEY, "bucket_start", "price", "action").agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"))
    packed = flow.groupBy(KEY, "bucket_start").agg(F.collect_list(F.struct("price", "action", "volume")).alias("_flow"), F.sum("n").cast("double").alias("_events"))
    j = states.join(packed, [KEY, "bucket_start"], "left")
    near = lambda x, k: F.abs(x["price"] - F.col(f"decision_{k}")) <= near_ticks * TICK
    kinds = {"add": ("A",), "cancel": ("C",), "modify": ("M",), "trade": ("T", "F")}

    def total(actions: tuple[str, ...], level: str | None = None) -> Column:
        here = lambda x: x["action"].isin(*actions) if level is None else x["action"].isin(*actions) & near(x, level)
        return F.aggregate("_flow", F.lit(0).cast("bigint"), lambda a, x: a + F.when(here(x), F.coalesce(x["volume"], F.lit(0))).otherwise(F.lit(0))).cast("double")

    sums = {f"_{a}_{k}": total(c, k) for a, c in kinds.items() for k in LEVELS} | {f"_{a}_all": total(c) for a, c in kinds.items()}
    ratio = lambda a, c: F.when(F.col(c) > 0, F.col(a) / F.col(c)).otherwise(0.0)
    made = {f"lf_near_{k}_{a}_intensity": ratio(f"_{a}_{k}", f"_{a}_all") for a in kinds for k in LEVELS}
    made |= {f"lf_near_{k}_cancel_ratio": F.col(f"_cancel_{k}") / (F.col(f"_add_{k}") + 1) for k in LEVELS}
    made |= {"lf_liquidity_withdrawal": F.col("_cancel_all") / (F.col("_add_all") + F.col("_cancel_all") + 1), "lf_absorption_proxy": F.col("_trade_all") / (F.col("_trade_all") + F.col("_cancel_all") + 1), "lf_break_level_trade_intensity": ratio("_trade_vah", "_trade_all") + ratio("_trade_val", "_trade_all"), "lf_events": F.col("_events")}
    known = F.col("_events").isNotNull()
    return j.withColumns(sums).withColumns({n: F.when(known, c) for n, c in made.items()}).drop(*sums, "_flow", "_events")


def level_flow(df: DataFrame, states: DataFrame, interval_ns: int, near_ticks: int = 4) -> DataFrame:
    """The flow columns of with_level_flow, of bars with events."""
    b = with_level_flow(states.select(KEY, "bucket_start", *[f"decision_{k}" for k in LEVELS]), df, interval_ns, near_ticks)
    return b.where("lf_events IS NOT NULL").drop(*[f"decision_{k}" for k in LEVELS])


class _Lifecycle(Machine):
    """Order lives, reported in the bucket in which they end."""

    def __init__(self, interval_ns: int) -> None:
        self.iv, self.live, self.start = interval_ns, {}, None
        self.now: dict = {}
        self.out: Rows = {c: [] for c in ("bucket_start", "ended", "lifetime_ns", "survived", "partial", "refills")}

    def _close(self) -> None:
        n = self.now
        values = (self.start, n["ended"], n["life"] / n["ended"] if n["ended"] else 0.0, sum(born < self.start for born, *_ in self.live.values()), n["partial"], n["refills"])
        for c, v in zip(self.out, values, strict=True):
            self.out[c].append(v)

    def feed(self, rows: Rows) -> Rows:
        for ts, action, size, oid in zip(rows["event_ts"], rows["action"], rows["size"], rows["order_id"], strict=True):
            start = ts - ts % self.iv
            if start != self.start:
                if self.start is not None:
                    self._close()
                self.start, self.now = start, {"ended": 0, "life": 0.0, "partial": 0, "refills": 0}
            live = self.live.get(oid)
            if action == "A":
                self.now["refills"] += live is not None
                self.live[oid] = [ts, size, False]
            elif live is not None and action in ("T", "F"):
                live[2] = True
                self.now["partial"] += size < live[1]
            elif live is not None and action == "C":
                left = live[1] - size if size > 0 else 0
                if left > 0:
                    live[1] = left
                else:
                    self.now["ended"] += 1
                    self.now["life"] += ts - live[0]
                    del self.live[oid]
            elif live is not None and action == "M":
                live[1] = size
        done, self.out = self.out, {c: [] for c in self.out}
        return done

    def finish(self) -> Rows:
        if self.start is not None:
            self._close()
        return self.out


def order_lifecycle(df: DataFrame, interval_ns: int) -> DataFrame:
    """Per bucket: orders that ended and their mean life, orders that survived from earlier buckets, partial executions, refills."""
    rows = df.where("action IN ('A', 'C', 'M', 'T', 'F')").select(KEY, "event_ts", "sequence", "action", "size", "order_id")
    return replay(rows, [KEY], lambda: _Lifecycle(interval_ns), f"{KEY} {df.schema[KEY].dataType.simpleString()}, bucket_start bigint, ended bigint, lifetime_ns double, survived bigint, partial bigint, refills bigint")


def _extremes(df: DataFrame, run: list[str], tick: float) -> tuple[DataFrame, Column]:
    """df with the close's distance beyond and inside the Asian value area, running extremes within `run`, and whether a bar is London's."""
    w = Window.partitionBy(*run).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    london = (value(df, "vp_liquidity_session", -1) == LONDON).cast("double")
    close, vah, val = value(df, "close"), value(df, "asia_vah"), value(df, "asia_val")
    width = F.greatest(vah - val, F.lit(float(tick)))
    relu = lambda c: F.greatest(F.lit(0.0), c)
    df = df.withColumns({"_up": london * relu((close - vah) / tick), "_down": london * relu((val - close) / tick), "path_inside_asia_va": london * clip(F.least(vah - close, close - val) / (0.5 * width), 0, 1)})
    df = df.withColumns({"_xu": F.max("_up").over(w), "_xd": F.max("_down").over(w)})
    up, down = _sides()
    return df.withColumns({"path_beyond_asia_ticks": F.col("_up") * up + F.col("_down") * down, "path_extreme_ticks": F.col("_xu") * up + F.col("_xd") * down}), london


def _sides() -> tuple[Column, Column]:
    """Shares of the running extremes above and below."""
    mass = F.col("_xu") + F.col("_xd") + 1e-9
    return F.col("_xu") / mass, F.col("_xd") / mass


EXTREMES = ("_up", "_down", "_xu", "_xd")


def path_position(df: DataFrame, run: list[str], tick: float = TICK) -> DataFrame:
    """Where each bar stands to the Asian value area: the columns of path_confirmation that need no flow."""
    return _extremes(df, run, tick)[0].drop(*EXTREMES)


def path_confirmation(df: DataFrame, run: list[str], tick: float = TICK) -> DataFrame:
    """Continuous evidence of London leaving or keeping the Asian value area; running extremes within `run`."""
    df, london = _extremes(df, run, tick)
    up, down = _sides()
    beyond, inside = F.col("path_beyond_asia_ticks"), F.col("path_inside_asia_va")
    share = beyond / (beyond + 1)
    df = df.withColumns({"path_held_frac": clip(beyond / (F.col("path_extreme_ticks") + 1e-9), 0, 1), "path_correction_ticks": F.greatest(F.lit(0.0), F.col("path_extreme_ticks") - beyond)})
    follow = value(df, "lf_break_level_trade_intensity") + value(df, "lf_liquidity_withdrawal") * share + value(df, "lf_near_vah_cancel_ratio") * up + value(df, "lf_near_val_cancel_ratio") * down
    defend = (F.abs(value(df, "lf_absorption_proxy")) + value(df, "lf_near_vah_add_intensity") * up + value(df, "lf_near_val_add_intensity") * down + value(df, "lf_near_poc_add_intensity")) * inside
    df = df.withColumns({"path_depth_follow": follow, "path_depth_defend": defend})
    df = df.withColumn("path_depth_confirm", clip(0.5 + 0.5 * F.tanh(F.col("path_depth_follow") - F.col("path_depth_defend")), 0, 1) * london)
    moved = 0.5 * F.tanh(F.abs(value(df, "proj_poc_shift_ticks"))) + 0.5 * clip(value(df, "proj_outside_volume_share"), 0, 1)
    return df.withColumns({"path_change_progress": clip(london * F.col("path_depth_confirm") * F.col("path_held_frac") * moved, 0, 1), "path_change_fail": clip(london * inside * (1 - F.col("path_depth_confirm")) * clip(value(df, "proj_va_overlap"), 0, 1), 0, 1)}).drop(*EXTREMES)


class _Pending(Machine):
    """Breaks and retests that wait for acceptance or failure; results stand where they became known."""

    def __init__(self, window: int) -> None:
        self.window, self.i = window, -1
        self.open: dict[str, int] = {}

    def _settle(self, name: str, accepted: bool, failed: bool) -> tuple[float, float]:
        if name not in self.open:
            return 0.0, 0.0
        age = self.i - self.open[name]
        if accepted:
            del self.open[name]
            return 1.0, 0.0
        if failed or age > self.window:
            del self.open[name]
            return 0.0, 1.0
        return 0.0, 0.0

    def feed(self, rows: Rows) -> Rows:
        out: Rows = {c: [] for c in (TS, "evt_true_break", "evt_failed_breakout", "evt_retest_success", "evt_retest_fail")}
        for ts, brk, retest, ranged, expand, fail in zip(*(rows[c] for c in (TS, "brk", "retest", "ranged", "expand", "fail")), strict=True):
            self.i += 1
            good, bad = self._settle("break", ranged or expand, fail)
            kept, lost = self._settle("retest", ranged or expand, fail)
            good = max(good, float(ranged))
            if brk and not good:
                self.open["break"] = self.i
            if retest:
                self.open["retest"] = self.i
            for c, v in zip(out, (ts, good, bad, kept, lost), strict=True):
                out[c].append(v)
        return out


def behavior_events(df: DataFrame, story: list[str], window: int = 8) -> DataFrame:
    """Pulses of what happened at each bar, from signal and projection columns; stories do not share state."""
    w = Window.partitionBy(*story).orderBy(TS)
    rise = lambda c: (active(df, c, 0.5) & ~F.coalesce(F.lag(active(df, c, 0.5)).over(w), F.lit(False))).cast("double")
    ranged = active(df, "vp_fr_accepted_expansion") | active(df, "vp_fr_exit")
    rows = df.select(*story, TS, active(df, "vp_fsm_break").alias("brk"), active(df, "vp_fsm_retest").alias("retest"), ranged.alias("ranged"), active(df, "vp_fsm_expand").alias("expand"), active(df, "look_fail").alias("fail"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in story)
    settled = replay(rows, story, lambda: _Pending(window), f"{kinds}, {TS} bigint, evt_true_break double, evt_failed_breakout double, evt_retest_success double, evt_retest_fail double", (TS,))
    inside = value(df, "close_in_value") > 0.5 if "close_in_value" in df.columns and dict(df.dtypes)["close_in_value"] != "boolean" else F.coalesce(F.col("close_in_value"), F.lit(False))
    absorb, reject = value(df, "absorb"), active(df, "look_fail") & inside
    pulses = {
        "evt_breakout": active(df, "vp_fsm_break"), "evt_accept_expansion": ranged, "evt_reject_value": reject, "evt_absorb_buy": absorb > 0, "evt_absorb_sell": absorb < 0,
        "evt_reload_bid": (absorb > 0) & inside, "evt_reload_ask": (absorb < 0) & inside,
    }
    rising = {"evt_asia_anchor_hold": "proj_anchor_stable", "evt_expansion_accepting": "proj_expansion_accepting", "evt_value_transfer": "proj_value_transferred", "evt_rejection_to_asia": "proj_rejection_to_asia"}
    made = df.select(*story, TS, *[c.cast("double").alias(n) for n, c in pulses.items()], *[rise(c).alias(n) for n, c in rising.items()])
    made = made.withColumns({"evt_expansion_continue": F.greatest("evt_accept_expansion", "evt_expansion_accepting"), "evt_return_to_value": F.greatest("evt_reject_value", "evt_rejection_to_asia")})
    return made.join(settled, [*story, TS])


def signal_quality(df: DataFrame) -> DataFrame:
    """Evidence in [0, 1] weighted by the liquidity's reliability; not a calibrated probability."""
    on = lambda c, weight, over=0.0: active(df, c, over).cast("double") * weight
    level = lambda c, weight: value(df, c) * weight
    evidence = (
        on("vp_fsm_break", 0.35) + on("vp_imbalance", 0.15, 0.5) + on("vp_expansion", 0.10, 0.5) + on("vp_fsm_retest", 0.20) + on("absorb", 0.10) + on("vp_pullback_defense", 0.05, 0.5) + on("early_imbalance", 0.15) + on("look_fail", 0.15)
        + level("proj_expansion_testing", 0.05) + level("proj_expansion_accepting", 0.12) + level("proj_value_transferred", 0.15) + level("proj_rejection_to_asia", 0.10) + level("path_depth_confirm", 0.22) + level("path_change_progress", 0.18)
    )
    trust = clip(value(df, "real_liquidity_ratio", 0.5), 0, 1) * 0.5 + (1 - clip(value(df, "deceptive_score", 0.5), 0, 1)) * 0.5
    if "rel_credibility" in df.columns:
        trust = 0.7 * trust + 0.3 * clip(value(df, "rel_credibility", 0.5), 0, 1)
    return df.withColumn("signal_evidence", clip(evidence, 0, 1)).withColumn("signal_quality", clip(F.col("signal_evidence") * (0.5 + 0.5 * trust), 0, 1))


PATHS = ("further_beyond_asia", "return_inside_asia_va", "reverse_path", "value_migrated", "continue_direction", "value_built")


def realized_paths(df: DataFrame, story: list[str], window: int = 8, further: float = 2.0, moved: float = 2.0) -> DataFrame:
    """For each onset of leaving value, a break or a retest: which of six movements came first, and which came at all.

    The window's rows are a bounded array, so no row is joined with others.
    """
    names = {"beyond": value(df, "path_beyond_asia_ticks"), "inside": value(df, "path_inside_asia_va"), "step": value(df, "proj_poc_step_ticks"), "fail": active(df, "look_fail", 0.5), "expand": active(df, "vp_fsm_expand", 0.5), "brk": active(df, "vp_fsm_break", 0.5), "retest": active(df, "vp_fsm_retest", 0.5)}
    built = active(df, "is_balanced", 0.5) if dict(df.dtypes).get("is_balanced") not in (None, "boolean") else F.coalesce(F.col("is_balanced"), F.lit(False)) if "is_balanced" in df.columns else F.lit(False)
    rows = df.select(*story, TS, *[c.alias(n) for n, c in names.items()], (built | active(df, "absorb", 0.5)).alias("built"))
    w = Window.partitionBy(*story).orderBy(TS)
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    out, brk, retest = F.col("beyond") > 0.5, F.col("brk"), F.col("retest")
    rows = rows.withColumn("out", out)
    stays = (out & was("out") & ~brk & ~retest) | (brk & was("brk")) | (retest & was("retest") & ~out & ~brk)
    ahead = F.collect_list(F.struct(TS, "beyond", "inside", "step", "fail", "expand", "built")).over(w.rowsBetween(1, window))
    rows = rows.withColumns({"onset": (out | brk | retest) & ~stays, "ahead": ahead}).where("onset")

    def hits(x: Column) -> Column:
        back = F.col("out") & (x["inside"] > 0.5)
        jump = F.abs(x["step"]) >= moved
        tests = (
            x["beyond"] >= F.col("beyond") + further, back, (F.col("out") & (x["beyond"] <= F.col("beyond") - further) & ~back) | x["fail"], jump, x["expand"],
            ~F.col("out") & (x["inside"] > 0.5) & ~jump & (F.abs(x["beyond"] - F.col("beyond")) < further) & x["built"],
        )
        return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, PATHS, strict=True)]))

    rows = rows.withColumn("hit", F.transform("ahead", hits))
    first = F.array_position(F.transform("hit", lambda h: F.size(h) > 0), True)
    rows = rows.withColumns({"at": first.cast("int"), "seen": F.array_sort(F.array_distinct(F.flatten("hit"))), "n": F.size("ahead")})
    own = F.get("hit", F.col("at") - 1)
    status = F.when(F.size(own) > 1, "ambiguous").when((F.col("at") > 0) | (F.col("n") >= window), "resolved").otherwise("censored")
    name = F.when(F.size(own) > 1, None).when(F.col("at") > 0, F.get(own, F.lit(0))).when(F.col("n") >= window, F.lit("no_path"))
    steps = F.when(F.col("at") > 0, F.col("at")).otherwise(F.col("n"))
    return rows.select(*story, F.col(TS).alias("setup_availability_ts"), F.coalesce(F.get(f"ahead.{TS}", steps - 1), F.col(TS)).alias("outcome_available_ts"), name.alias("next_path"), steps.cast("bigint").alias("horizon_bars"), status.alias("label_status"), F.array_join("seen", ",").alias("seen_paths"))


def path_binaries(paths: DataFrame, story: list[str]) -> DataFrame:
    """Six 0/1 labels of each setup: whether a movement came in its window; the status is authoritative for censored ones."""
    seen = F.split("seen_paths", ",")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("outcome_name"), F.array_contains(seen, p).cast("double").alias("y")) for p in PATHS])).alias("x")
    return paths.select(*story, "setup_availability_ts", "outcome_available_ts", F.when(F.col("label_status") == "censored", "censored").otherwise("resolved").alias("label_status"), each).select("*", "x.*").drop("x")


def base_rates(folded: DataFrame, targets: list[str]) -> DataFrame:
    """Per fold and target: the training rate as the forecast, the test rate, and the forecast's Brier score."""
    long = folded.unpivot(["fold", "role"], targets, "target", "value").withColumn("y", (F.col("value") > 0.5).cast("double"))
    is_test = F.col("role") == "test"
    g = long.groupBy("fold", "target").agg(F.avg(F.when(~is_test, F.col("y"))).alias("train_rate"), F.avg(F.when(is_test, F.col("y"))).alias("test_rate"), F.count_if(~is_test).alias("train_n"), F.count_if(is_test).alias("test_n"))
    return g.withColumn("brier", F.col("test_rate") * (1 - F.col("train_rate")) ** 2 + (1 - F.col("test_rate")) * F.col("train_rate") ** 2)
