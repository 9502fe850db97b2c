"""Liquidity quality: storm, flicker and spoof filters, deceptive scores, and their buckets."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product, repeat
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .book import EVENT, Side
from .ordered import Machine, Rows, _values, replay
from .tape import KEY, add_time_bucket

#: A quarter point in fixed-point prices (fixed value).
TICK = 250_000_000


@dataclass(frozen=True)
class NoiseRules:
    window_ns: int = 500_000_000
    storm_share: float = 0.75
    storm_events: int = 8
    flicker_ns: int = 50_000_000
    spoof_ticks: int = 4
    spoof_size: int = 5
    spoof_ns: int = 250_000_000


@dataclass(frozen=True)
class DeceptionRules:
    short_ns: int = 80_000_000
    spoof_ticks: int = 4
    spoof_size: int = 5
    spoof_ns: int = 300_000_000
    bait_modifies: int = 3
    window_ns: int = 500_000_000
    storm_share: float = 0.7
    storm_events: int = 10
    drop_score: float = 0.65
    #: short life, spoof, bait, non-participation, storm; scaled to sum to 1
    weights: tuple[float, float, float, float, float] = (0.25, 0.30, 0.15, 0.15, 0.15)


class _Recent:
    """Events and cancels of the last window, before the current event."""

    def __init__(self, window_ns: int) -> None:
        self.window, self.seen, self.cancels = window_ns, deque(), 0

    def storm(self, ts: int, least: int, share: float) -> bool:
        while self.seen and self.seen[0][0] < ts - self.window:
            self.cancels -= self.seen.popleft()[1]
        return len(self.seen) >= max(least, 1) and self.cancels / len(self.seen) >= share

    def push(self, ts: int, cancel: bool) -> None:
        self.seen.append((ts, cancel))
        self.cancels += cancel


class _Noise(Machine):
    """Keeps trades and fills; drops cancels in a storm, of flickers and of far short-lived size, and far adds in a storm.

    The best bid and ask here only ever improve, as the rule defines them.
    """

    def __init__(self, rules: NoiseRules) -> None:
        self.r, self.recent, self.live, self.done = rules, _Recent(rules.window_ns), {}, set()
        self.bid = self.ask = None

    def _far(self, price: int) -> bool:
        return self.bid is not None and self.ask is not None and abs(price - (self.bid + self.ask) / 2) / TICK >= self.r.spoof_ticks

    def _keeps(self, ts: int, action: str, side: str, price: int, size: int, oid: int) -> bool:
        r = self.r
        storm = self.recent.storm(ts, r.storm_events, r.storm_share)
        self.recent.push(ts, action == "C")
        if action in ("T", "F"):
            self.done.add(oid)
        elif action == "A":
            drop = storm and size >= r.spoof_size and self._far(price)
            if side == "B":
                self.bid = price if self.bid is None else max(self.bid, price)
            elif side == "A":
                self.ask = price if self.ask is None else min(self.ask, price)
            if drop:
                self.live.pop(oid, None)
            else:
                self.live[oid] = (ts, price, size)
            return not drop
        elif action == "M" and oid in self.live:
            self.live[oid] = (ts, price, size)
        elif action == "C":
            known = self.live.pop(oid, None)
            if known is not None and oid not in self.done:
                age = ts - known[0]
                storm = storm or age <= r.flicker_ns or (known[2] >= r.spoof_size and age <= r.spoof_ns and self._far(known[1]))
            return not storm
        return True

    def feed(self, rows: Rows) -> Rows:
        return {"event_ts": rows["event_ts"], "sequence": rows["sequence"], "keep": [self._keeps(ts, *e) for ts, _, *e in zip(*(rows[c] for c in EVENT), strict=True)]}


def noise_marks(df: DataFrame, rules: NoiseRules | None = None) -> DataFrame:
    """Per event: whether the noise filter keeps it."""
    rules = rules or NoiseRules()
    return replay(df.select(KEY, *EVENT), [KEY], lambda: _Noise(rules), f"{KEY} {df.schema[KEY].dataType.simpleString()}, event_ts bigint, sequence bigint, keep boolean")


def filter_noise(df: DataFrame, rules: NoiseRules | None = None) -> DataFrame:
    """Events that the noise filter keeps; (event_ts, sequence) identifies an instrument's event."""
    return df.join(noise_marks(df, rules).where("keep").drop("keep"), [KEY, "event_ts", "sequence"], "left_semi").select(*df.columns)


SCORES = ("deceptive_score", "spoof_flag", "flicker_flag", "bait_modify_flag", "nonparticipate_flag", "storm_flag")


def _weights(rules: DeceptionRules) -> list[float]:
    total = sum(rules.weights)
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    return [x / total for x in rules.weights]


class _Deception(Machine):
    """Event by event, under any rules."""

    def __init__(self, rules: DeceptionRules) -> None:
        self.r, self.w = rules, _weights(rules)
        self.recent = _Recent(rules.window_ns)
        self.live: dict[int, list] = {}  # added at, price, side, size, modifies, touched before, trades seen on entering
        #: Prices that a live order was added at before it was added again elsewhere; trades there still touch it.
        self.left: dict[int, set[int]] = {}
        self.trades, self.traded = 0, {}  # trades so far, and the number of the last one at each price
        self.done: set[int] = set()
        self.sides = {"B": Side(-1), "A": Side(1)}  # live orders by price, best first

    def _far(self, price: int) -> bool:
        bid, ask = (self.sides[s].best() for s in "BA")
        return bid is not None and ask is not None and abs(price - (bid[0] + ask[0]) / 2) / TICK >= self.r.spoof_ticks

    def _touched(self, oid: int, known: list) -> bool:
        """Whether a trade came at a price of the order's while it was live: asked on leaving, so a trade visits no order."""
        last, since = self.traded.get, known[6]
        return known[5] or last(known[1], 0) > since or any(last(p, 0) > since for p in self.left.get(oid, ()))

    def _leave(self, oid: int) -> list | None:
        known = self.live.pop(oid, None)
        if known is not None and known[2] in self.sides:
            self.sides[known[2]].take(known[1], 1)
        return known

    def _enter(self, oid: int, record: list) -> None:
        known, price = self.live.get(oid), record[1]
        if known is not None:
            self.left.setdefault(oid, set()).add(known[1])
        if oid in self.left:
            self.left[oid].discard(price)
        self.live[oid] = [*record, self.trades]
        if record[2] in self.sides:
            self.sides[record[2]].add(price, 1)

    def _withdrawn(self, ts: int, oid: int) -> tuple[float, float, float, float]:
        """What a cancel says of its order: gone at once, large and far and gone soon, moved often, passed over by trades at its price."""
        if oid not in self.live or oid in self.done:
            return 0.0, 0.0, 0.0, 0.0
        r, known = self.r, self.live[oid]
        added, price, _, size, moves, *_ = known
        life = ts - added
        large_far = size >= r.spoof_size and life <= r.spoof_ns and self._far(price)
        return float(life <= r.short_ns), float(large_far), float(moves >= r.bait_modifies), float(self._touched(oid, known))

    def _score(self, ts: int, action: str, side: str, price: int, size: int, oid: int) -> tuple | None:
        """Score, its flags and whether the event is dropped; None for an event that scores nothing."""
        r, w = self.r, self.w
        storm = self.recent.storm(ts, r.storm_events, r.storm_share)
        self.recent.push(ts, action == "C")
        if action in ("T", "F"):
            self.done.add(oid)
            self.trades += 1
            self.traded[price] = self.trades
        elif action == "A":
            self._enter(oid, [ts, price, side, size, 0, False])
            if storm and size >= r.spoof_size and self._far(price):
                score = min(1.0, w[1] + w[4])
                if score >= r.drop_score:
                    self._leave(oid)
                return score, 1.0, 0.0, 0.0, 0.0, 1.0, score >= r.drop_score
        elif action == "M" and oid in self.live:
            touched = self._touched(oid, self.live[oid])
            known = self._leave(oid)
            self._enter(oid, [known[0], price, known[2], size, known[4] + 1, touched])
            if known[4] + 1 >= r.bait_modifies and oid not in self.done:
                return w[2], 0.0, 0.0, 1.0, 0.0, 0.0, False
        elif action == "C":
            signs = (*self._withdrawn(ts, oid), float(storm))
            self._leave(oid)
            score = min(1.0, sum(map(mul, w, signs)))
            short, spoof, bait, idle, _ = signs
            return score, spoof, short, bait, idle, float(storm), score >= r.drop_score
        return None

    def feed(self, rows: Rows) -> Rows:
        nothing = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
        scored = [self._score(ts, *e) or nothing for ts, _, *e in zip(*(rows[c] for c in EVENT), strict=True)]
        columns = dict(zip((*SCORES, "deceptive_drop"), map(list, zip(*scored, strict=True)), strict=True))
        return {c: rows[c] for c in EVENT} | columns


def _before(marked: np.ndarray) -> np.ndarray:
    """For each place, and the end, the last marked place before it (-1: none)."""
    return np.concatenate(([-1], np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))))


def _counted(marked: np.ndarray) -> np.ndarray:
    """For each place, and the end, the marked places before it."""
    return np.concatenate(([0], np.cumsum(marked)))


class _Columns(Machine):
    """_Deception on whole batches, for rules under which no add is dropped at once.

    An order's life then depends on its own events alone.  They are sorted by
    order, and what an event finds (the last add, price, moves and trades of
    its order) are running maxima and counts, with the order's state of earlier
    batches before them.  Trades at a price are searched by position.  Only
    prices that orders left, and the book where a question hangs on it, are
    stepped through.
    """

    arrow = True
    KINDS = {"live": bool, "done": bool, "touched": bool, "side": np.int8, "added": np.int64, "since": np.int64, "moves": np.int64}

    def __init__(self, rules: DeceptionRules) -> None:
        self.r, self.w = rules, _weights(rules)
        self.scores = np.array([min(1.0, sum(map(mul, self.w, map(float, signs)))) for signs in product((0, 1), repeat=5)])
        self.rows = 0
        self.recent = np.empty(0, np.int64), np.empty(0, bool)  # times and cancel marks of the last window
        self.slots: dict = {}  # places in the state of orders that live, have traded or left prices
        self.free: list[int] = []
        self.state: dict[str, np.ndarray] = {}
        self.left: dict[int, set] = {}  # as in _Deception, by place
        self.traded: dict = {}  # position of the last trade at each price
        self.sides = Side(-1), Side(1)

    def _storms(self, ts: np.ndarray, cancel: np.ndarray) -> np.ndarray:
        times, marks = np.concatenate((self.recent[0], ts)), np.concatenate((self.recent[1], cancel))
        here = np.arange(len(times) - len(ts), len(times))
        first = np.minimum(np.searchsorted(times, ts - self.r.window_ns), here)
        cancels, n = _counted(marks), here - first
        self.recent = times[first[-1] :], marks[first[-1] :]
        return (n >= max(self.r.storm_events, 1)) & ((cancels[here] - cancels[first]) / np.maximum(n, 1) >= self.r.storm_share)

    def _places(self, names: list, **values: np.ndarray) -> np.ndarray:
        """Places of orders in the state; new ones are not live and have not traded."""
        if not self.state:
            self.state = {c: np.zeros(0, kind) for c, kind in self.KINDS.items()} | {c: np.zeros(0, np.float64 if v.dtype.kind == "f" else np.int64) for c, v in values.items()}
        found = list(map(self.slots.get, names, repeat(-1)))
        fresh = [i for i, at in enumerate(found) if at < 0]
        if len(fresh) > len(self.free):
            size = len(self.state["live"])
            more = max(size, len(fresh))
            self.free += range(size, size + more)
            self.state = {c: np.concatenate((v, np.zeros(more, v.dtype))) for c, v in self.state.items()}
        for i in fresh:
            found[i] = self.slots[names[i]] = self.free.pop()
        return np.array(found, dtype=np.int64)

    def _last_trades(self, at: np.ndarray, prices: np.ndarray, asked_at: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Position of the last trade at each asked price before its row; trades are given by row and price, and kept."""
        n = len(at)
        values, code = np.unique(np.concatenate((prices, asked)), return_inverse=True)
        names = values.tolist()
        old = np.array(list(map(self.traded.get, names, repeat(-1))), dtype=np.int64)
        width = 1 + max(at.max(initial=0), asked_at.max(initial=0))
        keys = np.sort(code[:n] * width + at)
        own = keys // width
        final = np.flatnonzero(np.diff(own, append=-1))
        self.traded.update(zip(map(names.__getitem__, own[final].tolist()), (self.rows + keys[final] % width).tolist(), strict=True))
        j = np.searchsorted(keys, code[n:] * width + asked_at) - 1
        if not n:
            return old[code]
        return np.where((j >= 0) & (own[j] == code[n:]), self.rows + keys[j] % width, old[code[n:]])

    def _leaving(self, place: np.ndarray, rows: np.ndarray, add: np.ndarray, enter: np.ndarray, lives: np.ndarray, known: np.ndarray, price: np.ndarray) -> tuple[list[int], list]:
        """(rows, prices) at which a trade touches an order that moves or leaves, beside its own price."""
        at, asked, now, left = [], [], None, set()
        for i, order, adds, enters, live, old, new in zip(rows.tolist(), *(x[rows].tolist() for x in (place, add, enter, lives, known, price)), strict=True):
            if order != now:
                now, left = order, self.left.setdefault(order, set())
            if not adds:
                at += [i] * len(left)
                asked += left
            elif live:
                left.add(old)
            if enters:
                left.discard(new)
        return at, asked

    def _step(self, side: int, price: int, step: int) -> None:
        if step > 0:
            self.sides[side].add(price, step)
        elif step < 0:
            self.sides[side].take(price, -step)

    def _far(self, when: np.ndarray, side: np.ndarray, price: np.ndarray, step: np.ndarray, asked_when: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Applies steps to the book; whether each asked price was far from its middle."""
        n, m = len(when), len(asked)
        if not m:
            for s in (0, 1):
                values, code = np.unique(price[side == s], return_inverse=True)
                for p, k in zip(values.tolist(), np.bincount(code, step[side == s], len(values)).astype(np.int64).tolist(), strict=True):
                    self._step(s, p, k)
            return np.zeros(0, bool)
        far = np.zeros(m, bool)
        sides, prices, steps = side.tolist(), [*price.tolist(), *asked.tolist()], step.tolist()
        for i in np.argsort(np.concatenate((when, asked_when)), kind="stable").tolist():
            if i < n:
                self._step(sides[i], prices[i], steps[i])
            else:
                bid, ask = (s.best() for s in self.sides)
                far[i - n] = bid is not None and ask is not None and abs(prices[i] - (bid[0] + ask[0]) / 2) / TICK >= self.r.spoof_ticks
        return far

    def feed(self, rows: Rows) -> Rows:
        r, n = self.r, len(rows["event_ts"])
        lowest = lambda c: -np.inf if pa.types.is_floating(c.type) else np.iinfo(c.type.to_pandas_dtype()).min
        number = lambda name: pc.fill_null(rows[name], lowest(rows[name])).to_numpy(zero_copy_only=False)
        one_of = lambda name, *of: pc.is_in(rows[name], pa.array(of, rows[name].type)).to_numpy(zero_copy_only=False)
        coded = rows["order_id"].dictionary_encode(null_encoding="encode")
        names = coded.dictionary.to_pylist()
        group = coded.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        cancels, times = one_of("action", "C"), number("event_ts").astype(np.int64)
        storm = self._storms(times, cancels)[order]

        # from here on rows stand order by order, each order's in time
        group, ts, price, size, cancel = group[order], times[order], number("price")[order], number("size")[order], cancels[order]
        add, move, trade = one_of("action", "A")[order], one_of("action", "M")[order], one_of("action", "T", "F")[order]
        side = np.where(one_of("side", "B"), 0, np.where(one_of("side", "A"), 1, 2))[order]
        cuts = np.searchsorted(group, np.arange(len(names) + 1))
        place = self._places(names, price=price, size=size)
        state = {c: v[place] for c, v in self.state.items()}
        # each row finds what stands before it; `ends` are what each order's last row leaves
        here, ends = np.arange(n), cuts[1:]
        both = np.concatenate((here, ends))
        begin = np.concatenate((cuts[group], cuts[:-1]))
        of = np.concatenate((group, np.arange(len(names))))

        def found(last: np.ndarray, values: np.ndarray, name: str) -> np.ndarray:
            return np.where(last >= begin, values[np.maximum(last, 0)], state[name][of])

        def since(marked: np.ndarray, name: str) -> np.ndarray:
            """Marked rows since the last add, with those of earlier batches."""
            count = _counted(marked)
            return np.where(added >= begin, count[both] - count[np.maximum(added, 0)], state[name][of] + count[both] - count[begin])

        added = _before(add | cancel)[both]
        lives = found(added, add, "live")
        moved, gone = move & lives[:n], cancel & lives[:n]
        enter, close = add | moved, moved | gone
        entered = _before(enter)[both]
        known_price, known_size = found(entered, price, "price"), found(entered, size, "size")
        known_since = found(entered, self.rows + order, "since")
        known_added, known_side = found(added, ts, "added"), found(added, side, "side")
        moves = since(moved, "moves")
        count = _counted(trade)
        traded = state["done"][of] | (count[both] > count[begin])
        done = traded[:n]

        own = np.flatnonzero(close & ~done)
        again = np.zeros(len(names), bool)
        again[group[add & lives[:n] & ~done]] = True
        if self.left:
            again |= np.fromiter(map(self.left.__contains__, place.tolist()), bool, len(place))
        beside = np.flatnonzero(again[group] & ~done & (enter | close))
        at, asked = self._leaving(place[group], beside, add, enter, lives, known_price, price)
        at = np.concatenate((own, np.array(at, dtype=np.int64)))
        asked = np.concatenate((known_price[own], np.array(asked, dtype=price.dtype)))
        hit = np.zeros(n, bool)
        tape = np.flatnonzero(trade)
        hit[at[self._last_trades(order[tape], price[tape], order[at], asked) > known_since[at]]] = True
        touched = since(hit & moved, "touched") > 0

        out = {c: np.zeros(n) for c in SCORES}
        judged = gone & ~done
        life = ts - known_added[:n]
        large = np.flatnonzero(judged & (known_size[:n] >= r.spoof_size) & (life <= r.spoof_ns))
        risen = np.flatnonzero(add & storm & (size >= r.spoof_size))
        booked, left = np.flatnonzero(enter), np.flatnonzero(close)
        sides = np.where(add, side, known_side[:n])
        if np.any((sides[booked] < 2) & (price[booked] == lowest(rows["price"]))):
            raise ValueError("an add or a move without a price")
        # at one event an add enters before it is asked about, and a cancelled order leaves after
        when = np.concatenate((3 * order[left] + 2 * cancel[left], 3 * order[booked]))
        steps = np.repeat(np.array([-1, 1]), [len(left), len(booked)])
        books, levels = np.concatenate((sides[left], sides[booked])), np.concatenate((known_price[left], price[booked]))
        real = books < 2
        questions = np.concatenate((large, risen))
        far = self._far(when[real], books[real], levels[real], steps[real], 3 * order[questions] + 1, np.concatenate((known_price[large], price[risen])))

        spoof = np.zeros(n, bool)
        spoof[large] = far[: len(large)]
        signs = judged & (life <= r.short_ns), spoof, judged & (moves[:n] >= r.bait_modifies), judged & (touched[:n] | hit), cancel & storm
        short, spoof, bait, idle, stormy = signs
        bits = sum(sign.astype(np.int64) << k for sign, k in zip(signs, range(4, -1, -1), strict=True))
        score = np.where(cancel, self.scores[bits], 0.0)
        baits = moved & ~done & (moves[:n] + 1 >= r.bait_modifies)
        score[baits] = self.w[2]
        rise = np.zeros(n, bool)
        rise[risen] = far[len(large) :]
        score[rise] = min(1.0, self.w[1] + self.w[4])
        for c, v in zip(SCORES, (score, spoof | rise, short, bait | baits, idle, stormy | rise), strict=True):
            out[c][order] = v
        drop = np.zeros(n, bool)
        drop[order] = cancel & (score >= r.drop_score)

        after = {"live": lives, "done": traded, "touched": touched, "side": known_side, "added": known_added, "since": known_since, "size": known_size, "moves": moves, "price": known_price}
        for c, v in after.items():
            self.state[c][place] = v[n:]
        for i in np.flatnonzero(traded[n:] & again).tolist():
            self.left.pop(place[i], None)
        for i in np.flatnonzero(~lives[n:] & ~traded[n:]).tolist():
            at = int(place[i])
            if not self.left.get(at):
                self.left.pop(at, None)
                self.free.append(self.slots.pop(names[i]))
        self.rows += n
        return {c: rows[c] for c in EVENT} | out | {"deceptive_drop": drop}


def machine_for(rules: DeceptionRules) -> type[Machine]:
    """_Columns, unless a storm add that is far away scores enough to be dropped from the book."""
    weights = _weights(rules)
    return _Deception if min(1.0, weights[1] + weights[4]) >= rules.drop_score else _Columns


def deceptive_scores(df: DataFrame, rules: DeceptionRules | None = None) -> DataFrame:
    """Events with their deception score, its flags and whether the event is dropped; trades score 0."""
    rules = rules or DeceptionRules()
    events = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (KEY, *EVENT))
    machine = machine_for(rules)
    return replay(df.select(KEY, *EVENT), [KEY], lambda: machine(rules), f"{events}, " + ", ".join(f"{c} double" for c in SCORES) + ", deceptive_drop boolean")


def filter_deceptive(scored: DataFrame) -> DataFrame:
    """Events without the whole life of any order that has a dropped event; trades and fills stay."""
    bad = scored.where("deceptive_drop AND action NOT IN ('T', 'F')").select(KEY, "order_id").distinct()
    kept = scored.where("action NOT IN ('T', 'F')").join(bad, [KEY, "order_id"], "left_anti")
    return kept.select(KEY, *EVENT).unionByName(scored.where("action IN ('T', 'F')").select(KEY, *EVENT))


def deceptive_buckets(scored: DataFrame, interval_ns: int, high: float = 0.5, also: Sequence[Column] = ()) -> DataFrame:
    """Per bucket: mean score, flags, deceptive share of size and of cancels, and the running mean score; `also` are further aggregates."""
    is_high = F.col("deceptive_score") >= high
    flags = [F.max(c).alias(c) for c in SCORES[1:]]
    b = add_time_bucket(scored, interval_ns).groupBy(KEY, "bucket_start", "bucket_end", "availability_ts").agg(
        F.avg("deceptive_score").alias("deceptive_score"), *flags, F.sum(F.when(is_high, F.col("size")).otherwise(0)).alias("_bad"), F.sum("size").alias("_all"), F.avg((is_high & (F.col("action") == "C")).cast("double")).alias("deceptive_cancel_rate"), *also
    )
    return _shares(b)


def _shares(b: DataFrame) -> DataFrame:
    share = F.when(F.col("_all") > 0, F.col("_bad") / F.col("_all")).otherwise(0.0)
    running = Window.partitionBy(KEY).orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumns({"deceptive_volume_share": share, "real_liquidity_ratio": 1 - share, "noise_instant": F.col("deceptive_score"), "noise_cum": F.avg("deceptive_score").over(running)}).drop("_bad", "_all")


class _Buckets(Machine):
    """The sums of deceptive_buckets over a scoring machine's events; a bucket is one row, made when it ends.

    A bucket that goes on in the next rows is carried as one row before them,
    so its sums run over its events in order.
    """

    arrow = True

    def __init__(self, own: Machine, interval_ns: int, high: float) -> None:
        self.own, self.interval, self.high = own, interval_ns, high
        self.start = None
        self.carried: Rows = {}

    def feed(self, rows: Rows) -> Rows:
        scored = self.own.feed(rows if self.own.arrow else {c: _values(v) for c, v in rows.items()})
        ts = rows["event_ts"].to_numpy(zero_copy_only=False)
        n = len(ts)
        start = ts - ts % self.interval
        high = np.asarray(scored["deceptive_score"]) >= self.high
        cancel, unknown = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (pc.equal(rows["action"], "C"), rows["action"].is_null()))
        size = pc.fill_null(rows["size"], 0).to_numpy(zero_copy_only=False)
        sums = {"_n": np.ones(n, np.int64), "_score": scored["deceptive_score"], "_bad": size * high, "_all": size, "_cancels": high & cancel, "_known": ~(high & unknown)}
        first = np.concatenate(([True], start[1:] != start[:-1]))
        cuts = np.flatnonzero(first)
        code = np.cumsum(first) - 1
        goes_on = self.start is not None and self.start == start[0]
        done = {} if goes_on or self.start is None else {"bucket_start": [self.start]} | {c: [v] for c, v in self.carried.items()}
        made: Rows = {}
        for c, v in sums.items():
            v = np.asarray(v)
            if v.dtype.kind == "f":  # added one by one, from what is carried on
                code_on, v_on = (np.concatenate(([0], code)), np.concatenate(([self.carried[c]], v))) if goes_on else (code, v)
                made[c] = np.bincount(code_on, v_on, len(cuts)).tolist()
            else:
                made[c] = np.add.reduceat(v.astype(np.int64), cuts).tolist()
                made[c][0] += self.carried[c] if goes_on else 0
        for c in SCORES[1:]:
            made[c] = np.maximum.reduceat(np.asarray(scored[c]), cuts).tolist()
            made[c][0] = max(made[c][0], self.carried[c]) if goes_on else made[c][0]
        made["bucket_start"] = start[cuts].tolist()
        self.start = made["bucket_start"][-1]
        self.carried = {c: v.pop() for c, v in made.items() if c != "bucket_start"}
        made["bucket_start"].pop()
        return {c: done.get(c, []) + v for c, v in made.items()}

    def finish(self) -> Rows | None:
        return None if self.start is None else {"bucket_start": [self.start]} | {c: [v] for c, v in self.carried.items()}


def bucketed_deception(df: DataFrame, interval_ns: int, high: float = 0.5, rules: DeceptionRules | None = None) -> DataFrame:
    """deceptive_buckets(deceptive_scores(df)), whose sums are made where events are scored, so that scored events go nowhere."""
    rules = rules or DeceptionRules()
    machine = machine_for(rules)
    volume = "double" if df.schema["size"].dataType.simpleString() in ("double", "float") else "bigint"
    schema = f"{KEY} {df.schema[KEY].dataType.simpleString()}, bucket_start bigint, _n bigint, _score double, {', '.join(f'{c} double' for c in SCORES[1:])}, _bad {volume}, _all {volume}, _cancels bigint, _known bigint"
    b = replay(df.select(KEY, *EVENT), [KEY], lambda: _Buckets(machine(rules), interval_ns, high), schema)
    end = F.col("bucket_start") + interval_ns
    score, rate = F.col("_score") / F.col("_n"), F.when(F.col("_known") > 0, F.col("_cancels") / F.col("_known"))
    return _shares(b.select(KEY, "bucket_start", end.alias("bucket_end"), end.alias("availability_ts"), score.alias("deceptive_score"), *SCORES[1:], "_bad", "_all", rate.alias("deceptive_cancel_rate")))
