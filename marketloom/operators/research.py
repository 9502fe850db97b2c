"""Research over feature frames: hypothesis grids, signal screens, walk-forward selection, coverage, self-supervision, evidence.

Folds, signals and permutations are tasks: each task gets the rows of its
signals (a clock of bars, thousands of rows) as arrays and returns one row.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.lineage import settled
from . import models, tape
from .auction import failed_gaps

MINUTE = 60_000_000_000


@dataclass(frozen=True)
class GapSpec:
    higher_ns: int
    signal_ns: int
    window_ns: int
    range_cap: float
    volume_floor: float

    def name(self) -> str:
        return f"fvg_h{self.higher_ns // MINUTE}_s{self.signal_ns // MINUTE}_w{self.window_ns // MINUTE}_r{self.range_cap:g}_v{self.volume_floor:g}".replace(".", "p")


@dataclass(frozen=True)
class BreakoutSpec:
    signal_ns: int
    trend_ns: int
    lookback: int
    vol_mult: float
    vol_mode: str
    priority: str = "volume_first"
    hold: str = "none"

    def name(self) -> str:
        return f"fb_s{self.signal_ns // MINUTE}_l{self.lookback}_v{self.vol_mult:g}_{self.vol_mode}_{self.priority}_{self.hold}".replace(".", "p")


def gap_grid(full: bool = True) -> list[GapSpec]:
    """72 specs in full; a lean grid otherwise."""
    axes = ((60, 240), (15, 30), (1440, 2880, 4320), (1.0, 1.2, 1.4), (1.2, 1.5)) if full else ((60,), (15, 30), (1440, 2880), (1.2,), (1.2, 1.3, 1.5))
    return [GapSpec(h * MINUTE, s * MINUTE, w * MINUTE, r, v) for h, s, w, r, v in itertools.product(*axes)]


def breakout_grid(full: bool = True) -> list[BreakoutSpec]:
    """144 volume-first specs in full; a lean grid otherwise."""
    if full:
        return [BreakoutSpec(s * MINUTE, 240 * MINUTE, k, v, m, p) for s, k, m, v, p in itertools.product((15, 30), (5, 10, 20), ("bar", "cum", "delta", "effort_result"), (1.1, 1.2, 1.5), ("structure_first", "volume_first"))]
    return [BreakoutSpec(30 * MINUTE, 240 * MINUTE, k, 1.2, m) for k, m in itertools.product((5, 10), ("bar", "cum"))]


def hold_grid() -> list[BreakoutSpec]:
    return [BreakoutSpec(30 * MINUTE, 240 * MINUTE, 5, 1.2, m, "volume_first", h) for m, h in itertools.product(("bar", "cum", "delta"), ("none", "persist", "absorption", "imbalance"))]


def materialize(df: DataFrame, specs: list[GapSpec | BreakoutSpec]) -> DataFrame:
    """Long pulses (instrument_id, availability_ts, signal, value) of every spec; bars and scans shared between specs are built once."""
    bars: dict[int, DataFrame] = {}
    scans: dict[tuple, DataFrame] = {}

    def of(interval: int) -> DataFrame:
        if interval not in bars:
            bars[interval] = tape.ohlcv_bars(df, interval)
        return bars[interval]

    parts = []
    for spec in specs:
        if isinstance(spec, GapSpec):
            found = failed_gaps(of(spec.higher_ns), of(spec.signal_ns), spec.window_ns, spec.range_cap, spec.volume_floor).where("fail_fvg <> 0").withColumn("value", F.col("fail_fvg"))
        else:
            key = (spec.signal_ns, spec.trend_ns, spec.lookback, spec.vol_mult, spec.vol_mode, spec.priority)
            if key not in scans:
                scans[key] = tape.failed_breakout_candidates(of(spec.signal_ns), of(spec.trend_ns), spec.lookback, vol_mult=spec.vol_mult, vol_mode=spec.vol_mode, priority=spec.priority, rth_only=False)
            found = tape.hold_filter(scans[key], spec.hold).withColumn("value", F.col("fail_breakout"))
        parts.append(found.select("instrument_id", "availability_ts", F.lit(spec.name()).alias("signal"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def on_clock(clock: DataFrame, pulses: DataFrame, names: list[str]) -> DataFrame:
    """Clock rows with a column for each signal: exact matches, 0 elsewhere."""
    wide = pulses.groupBy("instrument_id", "availability_ts").pivot("signal", names).agg(F.max_by("value", F.abs("value")))
    return clock.join(wide, ["instrument_id", "availability_ts"], "left").withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def causal_gate(df: DataFrame, signals: list[str], gate: str, q: float = 0.7, window: int = 50, least: int = 10) -> DataFrame:
    """signal x [|gate| at or above its past rolling quantile], as new columns."""
    from ..functions.windows import past_quantile_nearest

    w = Window.partitionBy("instrument_id").orderBy("availability_ts")
    rows = df.withColumn("_g", F.abs(gate)).withColumn("_q", past_quantile_nearest("_g", q, w, window, least))
    passes = F.coalesce(F.col("_g") >= F.col("_q"), F.lit(False)).cast("double")
    return rows.withColumns({f"{s}__gated": F.col(s) * passes for s in signals}).drop("_g", "_q")


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def ic(x: np.ndarray, y: np.ndarray, least: int = 8) -> float:
    """Rank correlation over finite pairs; 0 where there are too few or one side is constant."""
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < least or np.ptp(x[ok]) == 0 or np.ptp(y[ok]) == 0:
        return 0.0
    return float(np.corrcoef(_ranks(x[ok]), _ranks(y[ok]))[0, 1])


def screen(frame: DataFrame, signals: list[str], forward: str, order: str = "availability_ts", n: int = 200, alpha: float = 0.05, seed: int = 0, sparse: bool = True) -> DataFrame:
    """Per signal: IC, block-permutation p-value, Sharpe of signal times return, and Benjamini-Hochberg selection.

    A sparse signal (values in -1, 0, 1, mostly 0) is judged where it is active.
    """
    long = frame.select(order, forward, *[F.col(s).cast("double").alias(s) for s in signals]).unpivot([order, forward], signals, "signal", "value")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x, y = rows["value"].to_numpy(float), rows[forward].to_numpy(float)
        if sparse and np.isin(x, (-1, 0, 1)).all() and (x != 0).mean() < 0.5:
            x, y = x[x != 0], y[x != 0]
        ok = np.isfinite(x) & np.isfinite(y)
        x, y = x[ok], y[ok]
        observed = ic(x, y)
        rng = np.random.default_rng((seed, zlib.crc32(str(rows["signal"].iloc[0]).encode())))
        null = np.array([ic(models.block_permutation(x, rng), y) for _ in range(n)]) if len(x) >= 8 else np.zeros(n)
        pnl = x * y
        sharpe = float(pnl.mean() / pnl.std(ddof=1)) if len(pnl) > 1 and pnl.std(ddof=1) > 0 else 0.0
        return pd.DataFrame({"signal": [rows["signal"].iloc[0]], "n": [len(x)], "ic": [observed], "p": [(float((np.abs(null) >= abs(observed)).sum()) + 1) / (n + 1)], "sharpe": [sharpe], "mean_return": [float(pnl.mean()) if len(pnl) else 0.0]})

    rows = long.groupBy("signal").applyInPandas(one, "signal string, n bigint, ic double, p double, sharpe double, mean_return double")
    return stats.adjust(settled(rows), "p", "bh", alpha).withColumnRenamed("reject", "selected")


def walk_forward_select(frame: DataFrame, signals: list[str], forward: str, order: str = "availability_ts", splits: int = 3, purge: int = 0, n: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(fold table, summary): each fold employs the signal of largest |train IC| with its train sign on the test block.

    The null permutes returns in blocks and repeats the whole selection, in one
    task for each permutation.  The matrix is a clock of bars, bounded by the
    research frame (the caller's capacity), not by events.
    """
    spark = frame.sparkSession
    rows = frame.select(order, forward, *signals).orderBy(order).toPandas()
    x, y, ts = rows[signals].to_numpy(float), rows[forward].to_numpy(float), rows[order].to_numpy()
    size = len(ts) // (splits + 1)
    if size < 1:
        raise ValueError("too few rows for the splits")
    blocks = [(np.flatnonzero((np.arange(len(ts)) < k * size - purge) & (ts < ts[k * size])), np.arange(k * size, len(ts) if k == splits else (k + 1) * size)) for k in range(1, splits + 1)]

    def select(r: np.ndarray) -> tuple[list[tuple], float]:
        folds, used, real = [], [], []
        for train, test in blocks:
            scores = [ic(x[train, j], r[train]) for j in range(x.shape[1])]
            best = int(np.argmax(np.abs(scores)))
            sign = float(np.sign(scores[best]) or 1.0)
            folds.append((signals[best], scores[best], ic(x[test, best] * sign, r[test]), sign))
            used.append(x[test, best] * sign)
            real.append(r[test])
        return folds, ic(np.concatenate(used), np.concatenate(real))

    folds, observed = select(y)
    null = models.resample(spark, n, lambda rng: select(models.block_permutation(y, rng))[1], seed)
    table = spark.createDataFrame([(k, *f, int(ts[b[0][-1]]) if len(b[0]) else 0, int(ts[b[1][0]]), int(ts[b[1][-1]])) for k, (f, b) in enumerate(zip(folds, blocks, strict=True))], "fold int, selected string, train_ic double, test_ic double, employed_sign double, train_end_ts bigint, test_start_ts bigint, test_end_ts bigint")
    summary = null.agg(F.lit(observed).alias("oos_ic"), ((F.count_if(F.abs("value") >= abs(observed)) + 1) / (n + 1)).alias("pvalue"))
    return table, summary


# ---- coverage of event-level information by features


def information_gap(features: np.ndarray, descriptors: np.ndarray, returns: np.ndarray, axes: int = 16, points: int = 256) -> float:
    """Largest distance correlation of a descriptor with returns less that of a feature, over the axes of most spread and evenly spaced points (both bounds are parameters)."""

    def best(m: np.ndarray) -> float:
        order = np.sort(np.argsort(-m.std(axis=0))[:axes])
        return max((models.distance_correlation(m[:, j], returns, points) for j in order), default=0.0)

    return best(descriptors) - best(features)


def coverage(spark: SparkSession, features: pd.DataFrame, descriptors: pd.DataFrame, price: np.ndarray, n: int = 100, seed: int = 0) -> DataFrame:
    """Six structural metrics with their triggers: information gap, change ratio, surprise, reconstruction, regimes, unexplained share.

    Frames are research clocks of equal length; the last quarter is the test part.
    """
    f, d = features.fillna(0).to_numpy(float), descriptors.fillna(0).to_numpy(float)
    r = np.diff(price, append=price[-1:]) / np.where(price == 0, 1, price)
    cut = len(r) * 3 // 4
    rows: list[tuple] = []
    gap = information_gap(f, d, r)
    null = models.resample(spark, n, lambda rng: information_gap(f, d, models.block_permutation(r, rng)), seed)
    p = null.agg(((F.count_if(F.col("value") >= gap) + 1) / (n + 1)).alias("p")).first()[0]
    rows.append(("mfig", gap, p, bool(p <= 0.05 and gap > 0)))
    step = np.linalg.norm(np.diff(f, axis=0, prepend=f[:1]), axis=1)
    ratio = np.abs(np.diff(price, prepend=price[:1])) / (step + 1e-9)
    change = float(np.median(ratio[cut:]) / max(np.median(ratio[:cut]), 1e-9))
    rows.append(("cer", change, None, change > 1.5))
    mean, std = f[:cut].mean(axis=0), np.where(f[:cut].std(axis=0) <= 1e-8, 1, f[:cut].std(axis=0))
    z = (f - mean) / std
    _, _, axes = np.linalg.svd(z[:cut], full_matrices=False)
    latent = z @ axes[:4].T
    design = np.column_stack((latent[:-1], np.ones(len(latent) - 1)))
    w = np.linalg.lstsq(design[: cut - 1].T @ design[: cut - 1] + np.eye(design.shape[1]), design[: cut - 1].T @ latent[1:cut], rcond=None)[0]
    error = ((latent[1:] - design @ w) ** 2).mean(axis=1)
    surprise = float(error[cut:].mean() / max(error[: cut - 1].mean(), 1e-12))
    rows.append(("psg", surprise, None, surprise > 1.5))
    back = ((z - latent @ axes[:4]) ** 2).mean(axis=1)
    loss = float(back[cut:].mean() / max(back[:cut].mean(), 1e-12))
    rows.append(("crs", loss, None, loss > 1.25))
    rng = np.random.default_rng(seed)
    centers = latent[rng.choice(cut, min(4, cut), replace=False)]
    for _ in range(20):
        own = ((latent[:cut, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([latent[:cut][own == k].mean(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
    gaps = ((latent[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
    orphan = float((gaps[cut:] > np.quantile(gaps[:cut], 0.95)).mean())
    rows.append(("lori", orphan, None, orphan > 0.15))

    def fitted(m: np.ndarray) -> float:
        own = np.column_stack(((m - m[:cut].mean(axis=0)) / np.where(m[:cut].std(axis=0) <= 1e-8, 1, m[:cut].std(axis=0)), np.ones(len(m))))
        b = np.linalg.lstsq(own[:cut].T @ own[:cut] + np.eye(own.shape[1]), own[:cut].T @ r[:cut], rcond=None)[0]
        return 1 - float(((r[cut:] - own[cut:] @ b) ** 2).sum() / max(((r[cut:] - r[:cut].mean()) ** 2).sum(), 1e-12))

    have, most = fitted(f), fitted(d)
    share = 1 - have / most if most > 0 else 0.0
    rows.append(("qduf", share, None, share > 0.1))
    severity = {"mfig": "high", "qduf": "high", "cer": "high"}
    return spark.createDataFrame([(a, float(v), p, bool(t), severity.get(a, "medium")) for a, v, p, t in rows], "metric string, value double, pvalue double, triggered boolean, severity string")


#: Named blocks of feature columns (fixed names).
BLOCKS = {
    "price": ("c", "range", "forward_return"), "flow": ("volume", "delta", "buy_volume", "sell_volume"), "depth": ("path_imbalance", "path_imbalance_delta", "path_pressure", "low_imbalance", "queue_pressure", "iceberg_hit"),
    "auction": ("is_balanced", "is_expansion", "in_value_fraction", "decision_poc", "decision_vah", "decision_val"), "signals": ("vp_fsm_break", "vp_fsm_retest", "vp_fsm_expand", "absorb", "look_fail", "early_imbalance", "fail_breakout"),
    "cross_market": ("lead_lag", "trap_setup", "divergence", "confirmation_failure"),
}


def block_columns(columns: list[str], blocks: dict[str, tuple[str, ...]] = BLOCKS) -> dict[str, list[str]]:
    """Columns of each block that a frame has; blocks without one are left out."""
    found = {name: [c for c in own if c in columns] for name, own in blocks.items()}
    return {name: own for name, own in found.items() if own}


# ---- self-supervision over windows


def ssl_folds(windows: DataFrame, column: str, order: str, splits: int = 3, components: int = 4, mask: float = 0.3, seed: int = 0) -> DataFrame:
    """Per fold, in its own task: masked reconstruction error, next-state R2 against the training mean, and a contrastive loss."""
    rows = windows.select(order, F.flatten(column).alias("x")).orderBy(order).toPandas()
    x = np.stack(rows["x"].map(np.asarray).to_list()) if len(rows) else np.zeros((0, 1))
    size = len(x) // (splits + 1)
    spark = windows.sparkSession
    schema = "fold int, masked_mse double, world_r2 double, info_nce double"
    if size < 2:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fold in batch["id"].tolist():
                k = fold + 1
                train, test = x[: k * size], x[k * size : (k + 1) * size]
                mean, std = train.mean(axis=0), np.where(train.std(axis=0) <= 1e-8, 1, train.std(axis=0))
                a, b = (train - mean) / std, (test - mean) / std
                _, _, axes = np.linalg.svd(a, full_matrices=False)
                axes = axes[:components]
                rng = np.random.default_rng((seed, k))
                hidden = rng.random(b.shape) < mask
                back = (np.where(hidden, 0, b) @ axes.T) @ axes
                mse = float(((back - b) ** 2)[hidden].mean()) if hidden.any() else 0.0
                za, zb = a @ axes.T, b @ axes.T
                design = np.column_stack((za[:-1], np.ones(len(za) - 1)))
                w = np.linalg.lstsq(design.T @ design + np.eye(design.shape[1]), design.T @ za[1:], rcond=None)[0]
                error = ((zb[1:] - np.column_stack((zb[:-1], np.ones(len(zb) - 1))) @ w) ** 2).sum()
                r2 = 1 - float(error / max(((zb[1:] - za.mean(axis=0)) ** 2).sum(), 1e-12))
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                views = [unit((b + rng.normal(0, 0.1, b.shape)) @ axes.T) for _ in range(2)]
                logits = views[0] @ views[1].T / 0.2
                nce = float((np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)) + logits.max(axis=1) - np.diag(logits)).mean())
                out.append((fold, mse, r2, nce))
            yield pd.DataFrame(out, columns=["fold", "masked_mse", "world_r2", "info_nce"])

    return spark.range(splits).mapInPandas(run, schema)


# ---- evidence and reports


@dataclass(frozen=True)
class Evidence:
    id: str
    metric: str
    value: float
    pvalue: float | None = None
    version: str = "v1"

    def significant(self, alpha: float = 0.05) -> bool:
        return self.pvalue is not None and self.pvalue <= alpha


@dataclass(frozen=True)
class Finding:
    claim: str
    evidence: tuple[str, ...]
    needs_significance: bool = True


@dataclass
class EvidenceStore:
    items: dict[str, Evidence] = field(default_factory=dict)

    def add(self, e: Evidence) -> None:
        if e.id in self.items:
            raise ValueError(f"evidence {e.id!r} exists")
        self.items[e.id] = e

    def verify(self, finding: Finding, alpha: float = 0.05) -> bool:
        """All evidence exists, and is significant where the finding needs it."""
        own = [self.items.get(i) for i in finding.evidence]
        return bool(own) and all(e is not None and (not finding.needs_significance or e.significant(alpha)) for e in own)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(e).values()) for e in self.items.values()], "id string, metric string, value double, pvalue double, version string")


def report(title: str, store: EvidenceStore, findings: list[Finding], alpha: float = 0.05) -> str:
    """Markdown with verified and rejected findings and their evidence."""
    good = [f for f in findings if store.verify(f, alpha)]
    bad = [f for f in findings if f not in good]
    lines = [f"# {title}", ""]
    for head, group in (("Verified", good), ("Rejected", bad)):
        lines += [f"## {head}", "", *[f"- {f.claim} ({', '.join(f.evidence)})" for f in group], ""]
    lines += ["## Evidence", "", "| id | metric | value | p |", "|-|-|-|-|", *[f"| {e.id} | {e.metric} | {e.value:.6g} | {'' if e.pvalue is None else f'{e.pvalue:.4f}'} |" for e in store.items.values()]]
    return "\n".join(lines) + "\n"


def day_seed(seed: int, day: str) -> int:
    """A seed for a day's tasks: the checksum of both."""
    return zlib.crc32(f"{day}/{seed}".encode())


class Assistant:
    """Turns tests into evidence and claims; `write` may pass the verified claims to a caller's own text function."""

    def __init__(self, spark: SparkSession, store: EvidenceStore | None = None, alpha: float = 0.05, narrate: Callable[[str], str] | None = None) -> None:
        self.spark, self.store, self.alpha, self.narrate = spark, store or EvidenceStore(), alpha, narrate

    def _register(self, metric: str, value: float, pvalue: float | None, version: str) -> str:
        name = f"{metric}:{len(self.store.items)}"
        self.store.add(Evidence(name, metric, float(value), pvalue, version))
        return name

    def compare_regimes(self, values: np.ndarray, labels: np.ndarray, metric: str = "value", n: int = 200, seed: int = 0, version: str = "v1") -> Finding:
        """Whether a metric differs between regimes, by the F statistic under block-permuted labels."""
        from .evaluation import regime_difference

        r = regime_difference(self.spark, values, labels, n, seed).first()
        return Finding(f"{metric} differs between regimes", (self._register(f"f_{metric}", r.f_stat, float(r.pvalue), version),))

    def assess_signal(self, returns: np.ndarray, name: str, n: int = 200, seed: int = 0, version: str = "v1") -> Finding:
        """Whether a signal's returns have a mean, by random signs; the evidence is the Sharpe ratio."""
        r = np.asarray(returns, float)
        observed = abs(r.mean())
        null = models.resample(self.spark, n, lambda rng: float((rng.choice((-1.0, 1.0), len(r)) * r).mean()), seed)
        p = (null.agg(F.count_if(F.abs("value") >= observed)).first()[0] + 1) / (n + 1)
        sharpe = float(r.mean() / r.std(ddof=1)) if len(r) > 1 and r.std(ddof=1) > 0 else 0.0
        return Finding(f"{name} has returns of its own", (self._register(f"sharpe_{name}", sharpe, float(p), version),))

    def hypothesis(self, claim: str, evidence: list[Evidence], needs_significance: bool = True) -> Finding:
        """A claim on evidence, which is registered once."""
        for e in evidence:
            if e.id not in self.store.items:
                self.store.add(e)
        return Finding(claim, tuple(e.id for e in evidence), needs_significance)

    def write(self, findings: list[Finding], title: str = "Research report") -> str:
        text = report(title, self.store, findings, self.alpha)
        if self.narrate is None:
            return text
        good = "\n".join(f.claim for f in findings if self.store.verify(f, self.alpha))
        return f"{text}\n## Narrative\n\n{self.narrate(good)}\n"
