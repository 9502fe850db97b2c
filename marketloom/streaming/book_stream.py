"""Structured Streaming: bucketed flow with watermarks, and a stateful order book.

Event time is microseconds derived from the nanosecond columns.  The stateful
operators keep one pickled machine for each instrument; rows of a micro-batch
come unordered, so they are sorted first.  A row before the last processed
(event_ts, sequence) is late: it is not applied and is counted, where the batch
replay raises.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.book import EVENT, Book
from ..operators.ordered import Machine
from ..operators.tape import KEY, extract_trades

STATE = "machine binary, event_ts bigint, sequence bigint, late bigint"


def event_time(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Adds event_time (microseconds) for watermarks and windows."""
    return df.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col(ts), F.lit(1000))))


def order_flow(stream: DataFrame, interval_ns: int, delay: str = "0 seconds") -> DataFrame:
    """order_flow_summary's volumes of each bucket, emitted when the watermark passes its end."""
    t = event_time(extract_trades(stream)).withWatermark("event_time", delay)
    b = t.groupBy(KEY, F.window("event_time", f"{interval_ns // 1000} microseconds").alias("w")).agg(
        F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"), F.count_if(F.col("buy_volume") > 0).alias("buy_trades"), F.count_if(F.col("sell_volume") > 0).alias("sell_trades")
    )
    start = F.unix_micros("w.start") * 1000
    return b.select(KEY, start.alias("bucket_start"), (start + interval_ns).alias("availability_ts"), "buy_volume", "sell_volume", "buy_trades", "sell_trades")


def stateful(stream: DataFrame, machine: Callable[[], Machine], columns: list[str], schema: str, output: list[str]) -> DataFrame:
    """Runs an ordered machine over a stream, one state for each instrument; late rows are counted in the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, ts, seq, late = state.get if state.exists else (pickle.dumps(machine()), -(1 << 62), -(1 << 62), 0)
        own: Machine = pickle.loads(packed)
        rows = pd.concat(list(batches)).sort_values(["event_ts", "sequence"], kind="stable")
        marks = list(zip(rows["event_ts"].tolist(), rows["sequence"].tolist(), strict=True))
        fresh = [m >= (ts, seq) for m in marks]
        late += len(fresh) - sum(fresh)
        rows = rows[fresh]
        made = None
        if len(rows):
            ts, seq = int(rows["event_ts"].iloc[-1]), int(rows["sequence"].iloc[-1])
            made = own.feed({c: rows[c].tolist() for c in columns})
        state.update((pickle.dumps(own), ts, seq, late))
        if made and len(next(iter(made.values()))):
            out = pd.DataFrame({c: pd.array(made[c], dtype="object") for c in output if c != KEY})
            out[KEY] = key[0]
            yield out[output]

    return stream.select(KEY, *columns).groupBy(KEY).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


class TopOfBook(Machine):
    """Best prices and sizes after every event."""

    def __init__(self) -> None:
        self.book = Book()

    def feed(self, rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("event_ts", "sequence", "best_bid", "bid_size", "best_ask", "ask_size")}
        for ts, seq, *event in zip(*(rows[c] for c in EVENT), strict=True):
            self.book.apply(*event)
            bid, ask = self.book.bids.best() or (None, None), self.book.asks.best() or (None, None)
            for c, v in zip(out, (ts, seq, *bid, *ask), strict=True):
                out[c].append(v)
        return out


def top_of_book(stream: DataFrame) -> DataFrame:
    """The batch replay's top of book, as a stream."""
    schema = f"{KEY} bigint, event_ts bigint, sequence bigint, best_bid bigint, bid_size bigint, best_ask bigint, ask_size bigint"
    return stateful(stream, TopOfBook, list(EVENT), schema, [KEY, "event_ts", "sequence", "best_bid", "bid_size", "best_ask", "ask_size"])


class LastBook(Machine):
    """The last state of each bucket, emitted when an event of the next one comes."""

    def __init__(self, interval_ns: int) -> None:
        self.book, self.iv, self.start, self.last = Book(), interval_ns, None, None

    def feed(self, rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("bucket_start", "availability_ts", "event_ts", "mid", "imbalance")}
        for ts, _, *event in zip(*(rows[c] for c in EVENT), strict=True):
            start = ts - ts % self.iv
            if self.start is not None and start != self.start:
                bid, ask = self.book.bids.best(), self.book.asks.best()
                mid = (bid[0] + ask[0]) / 2 if bid and ask else None
                for c, v in zip(out, (self.start, self.start + self.iv, self.last, mid, self.book.depth(5)[2]), strict=True):
                    out[c].append(v)
            self.book.apply(*event)
            self.start, self.last = start, ts
        return out


def book_bars(stream: DataFrame, interval_ns: int) -> DataFrame:
    """Mid price and depth imbalance at the close of each bucket."""
    schema = f"{KEY} bigint, bucket_start bigint, availability_ts bigint, event_ts bigint, mid double, imbalance double"
    return stateful(stream, lambda: LastBook(interval_ns), list(EVENT), schema, [KEY, "bucket_start", "availability_ts", "event_ts", "mid", "imbalance"])
