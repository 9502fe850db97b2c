"""Fills against the visible ladder of a frame that carries depth columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .book import sweep_vwap

#: Side of the book and the prefix of its depth columns (fixed names).
SIDES = {"B": "bid", "A": "ask"}


def stacked(df: DataFrame, side: str, what: str, n: int = 5) -> Column:
    """`depth_<side>_<px|sz>_1..n` as an array of doubles; an absent column counts as 0."""
    names = [f"depth_{SIDES[side]}_{what}_{k}" for k in range(1, n + 1)]
    return F.array(*[F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in names])


def matrices(df: DataFrame, n: int = 5) -> dict[str, Column]:
    """The four arrays of a ladder: bid_px, bid_sz, ask_px, ask_sz."""
    return {f"{name}_{what}": stacked(df, side, what, n) for side, name in SIDES.items() for what in ("px", "sz")}


def levels(prices: Column, sizes: Column) -> Column:
    """array<struct<p, s>> of the finite levels that hold something, best first."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.filter(F.arrays_zip(prices.alias("p"), F.transform(sizes, lambda v: F.floor(v)).alias("s")), lambda x: finite(x["p"]) & finite(x["s"].cast("double")) & (x["s"] > 0))


def size_at(ladder: Column, price: Column) -> Column:
    """Size of the level at a price; 0 where the ladder has none."""
    return F.coalesce(F.get(F.filter(ladder, lambda x: x["p"] == price), F.lit(0))["s"], F.lit(0)).cast("bigint")


def depth_returns(
    df: DataFrame, horizon: int, quantity: int, group: list[str], order: list[str], n: int = 5, bid: str | None = None, ask: str | None = None, slippage_ticks: float = 0.5, tick: float = 0.25, commission_bps: float = 0.0
) -> DataFrame:
    """Adds long_return and short_return of sweeping the ladder for `quantity` now and `horizon` rows later.

    A ladder that holds less falls back on the best price of column `bid` or
    `ask` less or plus slippage; without one the return is null (depth is never
    made up), as it is where no row stands `horizon` later.
    """
    if horizon < 1 or quantity < 1:
        raise ValueError("horizon and quantity must be at least 1")
    w = Window.partitionBy(*group).orderBy(*order)
    m, slip, fee = matrices(df, n), slippage_ticks * tick, commission_bps / 10_000

    def price(side: str, worse: float, top: str | None) -> Column:
        own = levels(m[f"{side}_px"], m[f"{side}_sz"])
        swept = sweep_vwap(own["p"], own["s"], quantity, 1.0)
        return F.coalesce(swept, F.col(top).cast("double") + worse) if top else swept

    rows = df.withColumns({"_buy": price("ask", slip, ask), "_sell": price("bid", -slip, bid)})
    later = lambda c: F.lead(c, horizon).over(w)
    rows = rows.withColumns(
        {
            "long_return": F.when(F.col("_buy") > 0, (later("_sell") - F.col("_buy")) / F.col("_buy") - fee),
            "short_return": F.when(F.col("_sell") > 0, (F.col("_sell") - later("_buy")) / F.col("_sell") - fee),
        }
    )
    return rows.drop("_buy", "_sell")
