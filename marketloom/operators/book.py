"""Order-book replay: top of book, depth bars, paths inside bars, the lower book, icebergs.

A book is sequential for one instrument, so replays run one key at a time (see
ordered.replay); pass keys=["instrument_id", "trade_date"] only where every day
starts from an empty book.  One replay serves several intervals.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Machine, Rows, replay
from .tape import KEY, SCALE, add_time_bucket

EVENT = ("event_ts", "sequence", "action", "side", "price", "size", "order_id")


class Side:
    """Sizes by price with prices kept best first (sign -1 for bids)."""

    def __init__(self, sign: int) -> None:
        self.sign, self.sizes, self.order, self.total = sign, {}, [], 0

    def add(self, price: int, size: int) -> None:
        if price not in self.sizes:
            insort(self.order, self.sign * price)
            self.sizes[price] = 0
        self.sizes[price] += size
        self.total += size

    def take(self, price: int, size: int) -> None:
        if price in self.sizes:
            gone = min(size, self.sizes[price])
            self.sizes[price] -= gone
            self.total -= gone
            if self.sizes[price] <= 0:
                del self.sizes[price]
                del self.order[bisect_left(self.order, self.sign * price)]

    def best(self) -> tuple[int, int] | None:
        if not self.order:
            return None
        price = self.sign * self.order[0]
        return price, self.sizes[price]

    def top(self, n: int) -> list[tuple[int, int]]:
        return [(self.sign * p, self.sizes[self.sign * p]) for p in self.order[:n]]


class Book:
    """Both sides, live orders and counters.

    Adds replace a live id; cancels take min(live, size), all for a size of 0 or
    less; modifies move a known id and keep its side; clears empty the book;
    trades, fills and no-ops change nothing (a fill of an unknown id is counted).
    """

    def __init__(self) -> None:
        self.unknown = self.duplicates = 0
        self.clear()

    def clear(self) -> None:
        self.bids, self.asks, self.orders = Side(-1), Side(1), {}

    def side(self, bid: bool) -> Side:
        return self.bids if bid else self.asks

    def apply(self, action: str, side: str, price: int, size: int, order_id: int) -> None:
        live = self.orders.get(order_id)
        if action == "A":
            if live is not None:
                self.duplicates += 1
                self.side(live[0]).take(live[1], live[2])
            self.orders[order_id] = (side == "B", price, size)
            self.side(side == "B").add(price, size)
        elif action == "R":
            self.clear()
        elif action in ("C", "M") and live is None:
            self.unknown += 1
        elif action == "C":
            bid, at, left = live
            gone = min(left, size) if size > 0 else left
            self.side(bid).take(at, gone)
            if left > gone:
                self.orders[order_id] = (bid, at, left - gone)
            else:
                del self.orders[order_id]
        elif action == "M":
            bid, at, left = live
            self.side(bid).take(at, left)
            self.side(bid).add(price, size)
            self.orders[order_id] = (bid, price, size)
        elif action == "F" and live is None and order_id:
            self.unknown += 1

    def depth(self, n: int) -> tuple[int, int, float]:
        """Size of the top n of each side, and their imbalance."""
        b, a = (sum(s for _, s in side.top(n)) for side in (self.bids, self.asks))
        return b, a, (b - a) / (b + a) if b + a else 0.0

    def lower(self, n: int) -> tuple[int, int]:
        """Size of levels 2 to n of each side."""
        return tuple(sum(s for _, s in side.top(n)[1:]) for side in (self.bids, self.asks))


def _events(rows: Rows):  # noqa: ANN202
    return zip(*(rows[c] for c in EVENT), strict=True)


class _Top(Machine):
    def __init__(self) -> None:
        self.book = Book()

    def feed(self, rows: Rows) -> Rows:
        out: Rows = {c: [] for c in ("event_ts", "sequence", "best_bid", "bid_size", "best_ask", "ask_size", "unknown_refs", "duplicate_adds")}
        add = [v.append for v in out.values()]
        for ts, seq, *event in _events(rows):
            self.book.apply(*event)
            bid, ask = self.book.bids.best() or (None, None), self.book.asks.best() or (None, None)
            for put, v in zip(add, (ts, seq, *bid, *ask, self.book.unknown, self.book.duplicates), strict=True):
                put(v)
        return out


def top_of_book(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best prices and sizes after every event (null for an empty side), with running counters."""
    keys = keys or [KEY]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return replay(df.select(*keys, *EVENT), keys, _Top, f"{kinds}, event_ts bigint, sequence bigint, best_bid bigint, bid_size bigint, best_ask bigint, ask_size bigint, unknown_refs bigint, duplicate_adds bigint")


def crossed_events(tob: DataFrame) -> DataFrame:
    """Per instrument: events, states with a bid at or above the ask, and reference counters."""
    return tob.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("best_bid") >= F.col("best_ask")).alias("crossed"), F.max("unknown_refs").alias("unknown_refs"), F.max("duplicate_adds").alias("duplicate_adds"))


class _Bars(Machine):
    """Ladders, paths and lower-book figures of every bar, for several intervals in one replay."""

    def __init__(self, intervals: list[int], levels: int) -> None:
        self.book, self.levels = Book(), levels
        self.open: dict[int, dict | None] = dict.fromkeys(intervals)
        self.out: Rows = {c: [] for c in BAR_COLUMNS}

    def _close(self, interval: int) -> None:
        bar = self.open[interval]
        book, n = self.book, self.levels
        bid, ask, imbalance = book.depth(n)
        low_bid, low_ask = book.lower(n)
        tops = [book.bids.top(n), book.asks.top(n)]
        drain = lambda before, after: max(0.0, (before - after) / max(before, 1.0))
        bid_drain, ask_drain = drain(bar["bid"], bid), drain(bar["ask"], ask)
        low_bid_drain, low_ask_drain = drain(bar["low_bid"], low_bid), drain(bar["low_ask"], low_ask)
        held = lambda traded, before, after: traded / max(before, 1.0) if after >= before * 0.9 else 0.0
        values = (
            interval, bar["start"], bar["start"] + interval, bar["start"] + interval, bar["last"], bar["n"],
            [p for p, _ in tops[0]], [s for _, s in tops[0]], [p for p, _ in tops[1]], [s for _, s in tops[1]],
            float(imbalance), float(imbalance - bar["imbalance"]), bid_drain, ask_drain, ask_drain - bid_drain, float(bar["most"]), float(bar["least"]), low_bid_drain, low_ask_drain,
            float(low_bid), float(low_ask), (low_bid - low_ask) / (low_bid + low_ask) if low_bid + low_ask else 0.0,
            held(bar["bid_traded"], bar["low_bid"], low_bid), held(bar["ask_traded"], bar["low_ask"], low_ask), low_ask_drain - low_bid_drain, float(bar["ice"].any()),
        )
        for c, v in zip(BAR_COLUMNS, values, strict=True):
            self.out[c].append(v)

    def feed(self, rows: Rows) -> Rows:
        for ts, _, action, side, price, size, order_id in _events(rows):
            for interval, bar in self.open.items():
                if bar is not None and ts - ts % interval != bar["start"]:
                    self._close(interval)
                    self.open[interval] = None
            self.book.apply(action, side, price, size, order_id)
            bid, ask, imbalance = self.book.depth(self.levels)
            for interval, bar in self.open.items():
                if bar is None:
                    low_bid, low_ask = self.book.lower(self.levels)
                    bar = self.open[interval] = {"start": ts - ts % interval, "bid": bid, "ask": ask, "imbalance": imbalance, "most": imbalance, "least": imbalance, "low_bid": low_bid, "low_ask": low_ask, "n": 0, "bid_traded": 0.0, "ask_traded": 0.0, "ice": Icebergs()}
                bar["most"], bar["least"] = max(bar["most"], imbalance), min(bar["least"], imbalance)
                bar["last"] = ts
                bar["n"] += 1
                bar["ice"].see(action, price, size)
                if action in ("T", "F") and side in ("A", "B"):
                    bar["ask_traded" if side == "B" else "bid_traded"] += size
        done, self.out = self.out, {c: [] for c in BAR_COLUMNS}
        return done

    def finish(self) -> Rows:
        for interval, bar in self.open.items():
            if bar is not None:
                self._close(interval)
        return self.out


BAR_COLUMNS = {
    "interval_ns": "bigint", "bucket_start": "bigint", "bucket_end": "bigint", "availability_ts": "bigint", "event_ts": "bigint", "n_events": "bigint",
    "bid_px": "array<bigint>", "bid_sz": "array<bigint>", "ask_px": "array<bigint>", "ask_sz": "array<bigint>",
    "path_imbalance": "double", "path_imbalance_delta": "double", "path_bid_drain": "double", "path_ask_drain": "double", "path_pressure": "double", "path_imbalance_max": "double", "path_imbalance_min": "double", "path_low_bid_drain": "double", "path_low_ask_drain": "double",
    "low_bid": "double", "low_ask": "double", "low_imbalance": "double", "low_absorption_bid": "double", "low_absorption_ask": "double", "queue_pressure": "double", "iceberg_hit": "double",
}


def depth_bars(df: DataFrame, intervals: list[int], levels: int = 5) -> DataFrame:
    """Per interval and bucket, known at its end: the closing ladder (arrays, best first), the path of the
    imbalance and drains from the bucket's first event to its last, and the lower book (levels 2 on)."""
    schema = f"{KEY} {df.schema[KEY].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in BAR_COLUMNS.items())
    return replay(df.select(KEY, *EVENT), [KEY], lambda: _Bars(intervals, levels), schema)


def ladder_columns(bars: DataFrame, levels: int = 5) -> DataFrame:
    """depth_{bid,ask}_{px,sz}_k columns; null where the ladder is shorter."""
    return bars.withColumns({f"depth_{side}_{what}_{k + 1}": F.get(f"{side}_{what}", F.lit(k)) for side in ("bid", "ask") for what in ("px", "sz") for k in range(levels)})


class Icebergs:
    """Refills of a price after executions, per price."""

    def __init__(self, min_refills: int = 2, min_hidden_ratio: float = 2.0) -> None:
        self.at: dict[int, list[int]] = {}  # resting, peak, executed, executed at the last add, refills
        self.min_refills, self.ratio = min_refills, min_hidden_ratio

    def see(self, action: str, price: int, size: int) -> None:
        if action not in ("A", "C", "T", "F"):
            return
        s = self.at.setdefault(price, [0, 0, 0, 0, 0])
        if action == "A":
            s[0] += size
            s[1] = max(s[1], s[0])
            s[4] += s[2] > s[3]
            s[3] = s[2]
        else:
            s[2] += size if action != "C" else 0
            s[0] = max(0, s[0] - size)

    def _is(self, s: list[int]) -> bool:
        return s[1] > 0 and s[4] >= self.min_refills and s[2] >= self.ratio * s[1]

    def any(self) -> bool:
        return any(map(self._is, self.at.values()))

    def rows(self) -> Rows:
        seen = [(p, s) for p, s in sorted(self.at.items()) if s[1] > 0]
        return {"peak_display": [s[1] for _, s in seen], "executed": [s[2] for _, s in seen], "replenish_count": [s[4] for _, s in seen], "is_iceberg": [self._is(s) for _, s in seen]}


class _PriceIceberg(Machine):
    def __init__(self, min_refills: int, ratio: float) -> None:
        self.state = Icebergs(min_refills, ratio)

    def feed(self, rows: Rows) -> None:
        for action, size in zip(rows["action"], rows["size"], strict=True):
            self.state.see(action, 0, size)

    def finish(self) -> Rows:
        return self.state.rows()


def icebergs(df: DataFrame, min_refills: int = 2, min_hidden_ratio: float = 2.0) -> DataFrame:
    """Per price: peak display, executed size, refills after executions and the iceberg flag.

    State is independent by price, so keys are (instrument, price).
    """
    if min_refills < 1 or min_hidden_ratio <= 0:
        raise ValueError("min_refills must be at least 1 and min_hidden_ratio above 0")
    kind = df.schema[KEY].dataType.simpleString()
    rows = df.where("action IN ('A', 'C', 'T', 'F')").select(KEY, "price", "event_ts", "sequence", "action", "size")
    return replay(rows, [KEY, "price"], lambda: _PriceIceberg(min_refills, min_hidden_ratio), f"{KEY} {kind}, price bigint, peak_display bigint, executed bigint, replenish_count bigint, is_iceberg boolean")


def order_flow_imbalance(tob: DataFrame) -> DataFrame:
    """Signed change of the best queues at each event, and its running sum by day offset.

    The running sum is taken inside days, and each day's opening value comes
    from a table of day totals, so no window spans an instrument's whole history.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(KEY).orderBy("event_ts", "sequence")
    before = {c: F.lag(c).over(w) for c in ("best_bid", "bid_size", "best_ask", "ask_size")}
    part = lambda cond, v: F.when(cond, v).otherwise(0)
    bid = part(F.col("best_bid") >= before["best_bid"], F.col("bid_size")) - part(F.col("best_bid") <= before["best_bid"], before["bid_size"])
    ask = part(F.col("best_ask") >= before["best_ask"], before["ask_size"]) - part(F.col("best_ask") <= before["best_ask"], F.col("ask_size"))
    day = 86_400_000_000_000
    rows = tob.withColumns({"ofi": F.coalesce(bid + ask, F.lit(0)), "availability_ts": F.col("event_ts"), "_day": F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(day))})
    inside = F.sum("ofi").over(Window.partitionBy(KEY, "_day").orderBy("event_ts", "sequence").rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(KEY, "_day").agg(F.sum("ofi").alias("_sum"))
    opening = totals.select(KEY, "_day", F.coalesce(F.sum("_sum").over(Window.partitionBy(KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"))
    return rows.withColumn("_in", inside).join(opening, [KEY, "_day"]).withColumn("ofi_cumulative", F.col("_in") + F.col("_open")).drop("_in", "_open", "_day")


def ofi_by_bucket(tob: DataFrame, interval_ns: int) -> DataFrame:
    """Sum of the imbalance in each bucket, and its running sum."""
    from pyspark.sql import Window

    rows = add_time_bucket(order_flow_imbalance(tob).select(KEY, "event_ts", "ofi"), interval_ns)
    b = rows.groupBy(KEY, "bucket_start", "bucket_end", "availability_ts").agg(F.sum("ofi").alias("ofi"))
    return b.withColumn("ofi_cumulative", F.sum("ofi").over(Window.partitionBy(KEY).orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, 0)))


def sweep_vwap(prices: Column, sizes: Column, quantity: float, scale: float = SCALE) -> Column:
    """Average price of taking `quantity` from a ladder (best first); null where it holds less."""
    start = F.struct(F.lit(float(quantity)).alias("left"), F.lit(0.0).alias("cost"))

    def step(acc: Column, level: Column) -> Column:
        take = F.least(acc["left"], level["s"].cast("double"))
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * level["p"].cast("double")).alias("cost"))

    levels = F.arrays_zip(prices.alias("p"), sizes.alias("s"))
    levels = F.filter(levels, lambda x: (x["p"] > 0) & (x["s"] > 0))
    done = F.aggregate(levels, start, step)
    return F.when(done["left"] <= 0, done["cost"] / quantity * scale)
