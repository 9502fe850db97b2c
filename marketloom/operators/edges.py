"""Search over hold, reward-to-risk, stop buffer and playbook: inner walk-forward on the past, one sealed test of the winner."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import auction
from .tape import KEY


@dataclass(frozen=True)
class EdgeSpec:
    hold: int
    reward_to_risk: float
    stop_buffer: float

    def name(self) -> str:
        return f"h{self.hold}_rr{self.reward_to_risk:g}_b{self.stop_buffer:g}"


def edge_grid() -> list[EdgeSpec]:
    return [EdgeSpec(h, r, b) for h, r, b in itertools.product((2, 3, 5), (1.0, 1.5, 2.0, 3.0), (0.25, 0.5, 1.0))]


def search_edges(states: DataFrame, deceptive: DataFrame, events: DataFrame, grid: list[EdgeSpec], train_share: float = 0.6, folds: int = 3, least_trades: int = 3, cost: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(table of specs by inner folds, outer test of the best spec or no row).

    Specs are ranked by the share of folds with a gain, expectancy, trades and
    name.  The last part of the time is used once, for the winner.  All holds
    are judged on the same bars.
    """
    truth = auction.entry_gates(states, deceptive, sorted({s.hold for s in grid}))
    # one row beside the trades: fetched first, it would compute all states twice
    div = lambda a, b: F.call_function("div", a, b)
    first, cut = F.col("_first"), F.col("_cut")
    span = states.agg(F.min("bucket_start").alias("_first"), F.max("bucket_end").alias("_end")).select("_first", (first + ((F.col("_end") - first) * F.lit(train_share)).cast("bigint")).alias("_cut"))
    every = auction.trades_of(truth, events, [(s.name(), s.reward_to_risk, s.stop_buffer) for s in grid], auction.TradeRules().max_hold_ns, cost).crossJoin(F.broadcast(span))
    fold = F.least(F.lit(folds - 1), div(F.col("entry_ts") - first, F.greatest(F.lit(1), div(cut - first, F.lit(folds)))))
    inner = every.where(F.col("exit_ts") <= cut).withColumn("fold", fold).groupBy("name", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))
    table = inner.groupBy("name").agg(F.sum("n").alias("n_trades"), (F.sum("pnl") / F.sum("n")).alias("expectancy"), F.avg((F.col("pnl") > 0).cast("double")).alias("positive_folds"))
    ranked = table.withColumn("rank", F.row_number().over(Window.orderBy((F.col("n_trades") < least_trades).cast("int"), F.desc("positive_folds"), F.desc("expectancy"), F.desc("n_trades"), "name")))
    best = ranked.where((F.col("rank") == 1) & (F.col("n_trades") >= least_trades)).select("name")
    outer = every.where(F.col("entry_ts") > cut).join(best, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("expectancy"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return ranked, outer
