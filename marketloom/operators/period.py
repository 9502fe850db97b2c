"""Pooled periods and diagnosis of a selected signal: pooling of days, lead and sequence classes, gates, ablation by layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.session import trade_date
from ..functions.windows import past_quantile_nearest, run_ids
from . import models
from .behavior import value
from .research import ic

TS = "availability_ts"
LEADS = ("both_already", "volume_lead", "price_lead", "neither")
SEQUENCES = ("balance_imbalance_expansion", "balance_then_expansion", "imbalance_then_expansion", "already_expanding", "still_balanced", "unclassified")


def refuse_raw_events(df: DataFrame) -> DataFrame:
    """Phase two works on bars, not on events."""
    if {"order_id", "action", "sequence"} <= set(df.columns):
        raise ValueError("raw events given where a feature frame is needed")
    return df


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Feature frames of all day folders below `path` by column name, with period_day_id from the folder.

    A time that stands twice raises when the rows are read.
    """
    df = refuse_raw_events(spark.read.option("mergeSchema", "true").parquet(f"{path}/*/blended.parquet"))
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/blended\.parquet", 1)
    df = df.withColumn("period_day_id", day)
    twice = F.count(F.lit(1)).over(Window.partitionBy(TS)) > 1
    return df.withColumn(TS, F.when(twice, F.raise_error(F.lit("a time stands in two days"))).otherwise(F.col(TS)))


def story_runs(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """New run ids over a pooled period: by day and session, and by day, trade date and merged Asian and London sessions."""
    keys = keys or []
    s = F.coalesce(F.col("vp_liquidity_session").cast("int"), F.lit(-1))
    rows = df.withColumns({"_liq": F.concat_ws(":", "period_day_id", s), "_story": F.concat_ws(":", "period_day_id", trade_date(F.col(TS)), F.when(s.isin(0, 1), "asia_london").otherwise(s.cast("string")))})
    rows = run_ids(rows, keys, [TS], "_liq", "liquidity_run")
    return run_ids(rows, keys, [TS], "_story", "behavior_story_run").drop("_liq", "_story")


def _lead(first: Column, price: Column, name: str) -> Column:
    return F.when(first & price, "both_already").when(first, name).when(price, "price_lead").otherwise("neither")


def volume_price_lead(df: DataFrame, lag: int = 5, volume: float = 0.35, beyond: float = 4.0) -> DataFrame:
    """Whether volume outside or price beyond led, from lagged columns (absent or null: 0)."""
    return df.withColumn("lead_class", _lead(value(df, f"proj_outside_volume_share__lag{lag}") >= volume, value(df, f"path_beyond_asia_ticks__lag{lag}") >= beyond, "volume_lead"))


def depth_price_lead(df: DataFrame, lag: int = 5, follow: float = 1.0, beyond: float = 4.0) -> DataFrame:
    return df.withColumn("depth_lead_class", _lead(value(df, f"path_depth_follow__lag{lag}") >= follow, value(df, f"path_beyond_asia_ticks__lag{lag}") >= beyond, "depth_lead"))


def auction_sequence(df: DataFrame, balance_lag: int = 5, imbalance_lag: int = 3) -> DataFrame:
    """Balance, imbalance and expansion in order, from lags and the present state."""
    on = lambda c: value(df, c) > 0.5
    expanding = on("path_beyond_asia_ticks") | on("proj_expansion_accepting") | on("proj_expansion_testing") | on("vp_fsm_expand")
    out_before = on(f"path_beyond_asia_ticks__lag{balance_lag}")
    balanced = on(f"vp_balance__lag{balance_lag}") & ~out_before
    imbalanced = on(f"vp_imbalance__lag{imbalance_lag}") | on(f"vp_fsm_break__lag{imbalance_lag}") | on(f"proj_expansion_testing__lag{imbalance_lag}")
    kind = (
        F.when(expanding & out_before, "already_expanding").when(expanding & balanced & imbalanced, "balance_imbalance_expansion").when(expanding & balanced, "balance_then_expansion")
        .when(expanding & imbalanced, "imbalance_then_expansion").when(expanding, "already_expanding").when(balanced | on("vp_balance"), "still_balanced").otherwise("unclassified")
    )
    return df.withColumn("sequence_class", kind)


def class_table(df: DataFrame, column: str, classes: tuple[str, ...], y: str = "y", means: list[str] | None = None) -> DataFrame:
    """Counts, rates and shares of successes and failures of every class, absent ones with zeros."""
    means = means or []
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("double").alias("n_pos"), (F.count(F.lit(1)) - F.sum(y)).cast("double").alias("n_neg"), F.avg(y).alias("pos_rate"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    g = every.join(g, column, "left").fillna(0).fillna(0.0)
    w = Window.partitionBy()
    share = lambda c: F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(0.0)
    return g.withColumns({"share_of_successes": share("n_pos"), "share_of_failures": share("n_neg")})


def depth_gates(df: DataFrame, signals: list[str], q: float = 0.7, window: int = 50, least: int = 10, key: str = "instrument_id") -> DataFrame:
    """Signals kept where depth agrees: large pressure, large imbalance change, large queue pressure, an iceberg, or equal sign."""
    w = Window.partitionBy(key).orderBy(TS)
    rules = {"pressure": "path_pressure", "imb_delta": "path_imbalance_delta", "queue": "queue_pressure"}
    made: dict[str, Column] = {}
    for name, column in rules.items():
        if column in df.columns:
            df = df.withColumn(f"_a_{name}", F.abs(F.coalesce(F.col(column), F.lit(0.0))))
            made[f"{name}_q{q:g}".replace(".", "p")] = F.coalesce(F.col(f"_a_{name}") >= past_quantile_nearest(f"_a_{name}", q, w, window, least), F.lit(False)).cast("double")
    if "iceberg_hit" in df.columns:
        made["iceberg"] = (value(df, "iceberg_hit") > 0).cast("double")
    gated = {f"{s}__depth__{n}": value(df, s) * g for s in signals for n, g in made.items()}
    if "path_pressure" in df.columns:
        gated |= {f"{s}__depth__sign": value(df, s) * (F.signum(value(df, s)) == F.signum(value(df, "path_pressure"))).cast("double") for s in signals}
    return df.withColumns(gated).drop(*[f"_a_{n}" for n in rules])


def peel(name: str, columns: list[str]) -> tuple[str, str] | None:
    """The signal inside the outermost gate of a name, and that gate."""
    parts = name.split("__")
    for k in range(len(parts) - 1, 0, -1):
        inner = "__".join(parts[:k])
        if inner in columns:
            return inner, "__".join(parts[k:])
    return None


def layers(df: DataFrame, selected: str, forward: str, n: int = 100, seed: int = 0, order: str = TS) -> DataFrame:
    """For each gate around a signal: IC with and without it, a block-permutation p-value of the inner one, pass rate, and Benjamini-Hochberg.

    The frame is a research clock (bars out of sample).
    """
    spark = df.sparkSession
    names = [selected]
    while (inner := peel(names[-1], df.columns)) is not None:
        names.append(inner[0])
    rows: pd.DataFrame = df.select(order, forward, *names).orderBy(order).toPandas()
    y = rows[forward].to_numpy(float)
    out = []
    for outer, inner in zip(names[:-1], names[1:], strict=True):
        a, b = rows[outer].to_numpy(float), rows[inner].to_numpy(float)
        observed = ic(b, y)
        null = models.resample(spark, n, lambda rng, b=b: ic(models.block_permutation(b, rng), y), seed)
        p = null.agg(((F.count_if(F.abs("value") >= abs(observed)) + 1) / (n + 1)).alias("p")).first()[0]
        fired = np.isfinite(b) & (b != 0)
        out.append((outer[len(inner) + 2 :], inner, ic(a, y), observed, ic(a, y) - observed, float(p), float((a[fired] != 0).mean()) if fired.any() else 0.0))
    table = spark.createDataFrame(out, "layer string, ablated_column string, ic_full double, ic_ablated double, delta_ic double, p double, pass_rate double")
    return stats.adjust(table, "p", "bh") if out else table.withColumns({"adjusted": F.lit(None).cast("double"), "reject": F.lit(None).cast("boolean")})


def depth_counterfactual(df: DataFrame, selected: str, forward: str, n: int = 100, seed: int = 0, order: str = TS) -> DataFrame | None:
    """One row: IC of a signal with and without its depth gate on the same rows, their difference, and its p-value when the gate is permuted in blocks; None without a depth gate."""
    parts = selected.split("__depth__")
    if len(parts) != 2 or parts[0] not in df.columns or selected not in df.columns:
        return None
    rows: pd.DataFrame = df.select(order, forward, selected, parts[0]).orderBy(order).toPandas()  # a clock of bars out of sample
    y, gated, plain = (rows[c].to_numpy(float) for c in (forward, selected, parts[0]))
    gate = (gated != 0).astype(float)
    observed = ic(gated, y) - ic(plain, y)
    null = models.resample(df.sparkSession, n, lambda rng: ic(plain * models.block_permutation(gate, rng), y) - ic(plain, y), seed)
    p = null.agg(((F.count_if(F.abs("value") >= abs(observed)) + 1) / (n + 1)).alias("p")).first()[0]
    return df.sparkSession.createDataFrame([(ic(gated, y), ic(plain, y), observed, float(p))], "ic_with double, ic_without double, delta_ic double, p double")


def state_link(df: DataFrame, signal: str, states: list[str]) -> DataFrame:
    """Per state column: rank correlation of its size with the signal's size over complete rows."""
    long = df.select(F.abs(F.col(signal).cast("double")).alias("_s"), *[F.abs(F.col(c).cast("double")).alias(c) for c in states]).unpivot(["_s"], states, "state", "z")
    return stats.spearman(long, "z", "_s", ["state"])


def out_of_sample(folded: DataFrame, ts: str = TS) -> DataFrame:
    """Times that stand in a test block of some fold."""
    return folded.where("role = 'test'").select(ts).distinct()


class FrozenHoldout:
    """A holdout that may be scored once."""

    def __init__(self, rows: DataFrame) -> None:
        self._rows, self.touched = rows, False

    def evaluate(self, score, again: bool = False):  # noqa: ANN001, ANN201
        if self.touched and not again:
            raise RuntimeError("the holdout has been scored already")
        self.touched = True
        return score(self._rows)
