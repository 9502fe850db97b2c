"""Regimes: causal refits in order, phases, structural masks of tick windows, and silhouettes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import vector_sum
from .ordered import Machine, Rows, replay
from .ticks import FEATURES

BALANCE, EXPANSION, NEUTRAL = range(3)


def heuristic_phase(in_value: Column, trail_bid: Column, trail_ask: Column) -> Column:
    """Balance inside value, expansion outside it with one-sided depth behind, else neutral."""
    return F.when(in_value > 0.5, BALANCE).when(F.abs(trail_bid - trail_ask) > 0.5, EXPANSION).otherwise(NEUTRAL)


def phase_map(centers: np.ndarray, in_value: int = 2, trail_bid: int = 6, trail_ask: int = 7) -> dict[int, int]:
    """Phase of each k-means centre: balance where most time is inside value, expansion where most depth trails among the others, else neutral."""
    phases = dict.fromkeys(range(len(centers)), NEUTRAL)
    calm = int(np.argmax(centers[:, in_value]))
    phases[calm] = BALANCE
    trailing = np.delete(np.arange(len(centers)), calm)
    if len(trailing):
        phases[int(trailing[np.argmax(centers[trailing, trail_bid] + centers[trailing, trail_ask])])] = EXPANSION
    return phases


def masked_error(back: np.ndarray, windows: np.ndarray, masks: np.ndarray) -> float:
    """Mean over windows of the mean squared error on their hidden cells; windows without one do not count."""
    errors = [float(((b - x)[m] ** 2).mean()) for b, x, m in zip(back, windows, masks, strict=True) if m.any()]
    return float(np.mean(errors)) if errors else 0.0


class _Tracker(Machine):
    """k-means on the last `window` rows, fitted every `every` rows and used from then on."""

    def __init__(self, columns: list[str], k: int, every: int, window: int, least: int, seed: int) -> None:
        self.columns, self.k, self.every, self.window, self.least, self.seed = columns, k, every, window, least, seed
        self.past: deque[list[float]] = deque(maxlen=window)
        self.seen, self.centers = 0, None

    def _fit(self) -> np.ndarray:
        x, rng = np.array(self.past), np.random.default_rng(self.seed)
        centers = x[rng.choice(len(x), self.k, replace=False)]
        for _ in range(20):
            own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.array([x[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(self.k)])
        return centers[np.lexsort(centers.T[::-1])]

    def feed(self, rows: Rows) -> Rows:
        out = []
        for row in zip(*(rows[c] for c in self.columns), strict=True):
            v = [0.0 if x is None or not np.isfinite(x) else float(x) for x in row]
            self.past.append(v)
            self.seen += 1
            if self.seen >= max(self.least, self.k) and self.seen % self.every == 0:
                self.centers = self._fit()
            out.append(-1 if self.centers is None else int(((self.centers - np.array(v)) ** 2).sum(axis=1).argmin()))
        return {"availability_ts": rows["availability_ts"], "regime": out}


def causal_regimes(df: DataFrame, columns: list[str], key: str = "instrument_id", k: int = 3, every: int = 50, window: int = 2048, least: int = 12, seed: int = 0) -> DataFrame:
    """Regime of each row from the past only; -1 before the first fit."""
    rows = df.select(key, "availability_ts", *columns)
    return replay(rows, [key], lambda: _Tracker(columns, k, every, window, least, seed), f"{key} {df.schema[key].dataType.simpleString()}, availability_ts bigint, regime int", ("availability_ts",))


LIQUIDITY = ("a_bid_sz", "a_ask_sz")
BOUNDARY = ("size_at_vah", "size_at_val")
TRAILING = ("trail_bid", "trail_ask")


def structural_mask(window: np.ndarray, trap: bool, phase: int, names: tuple[str, ...] = FEATURES) -> np.ndarray:
    """Cells of a (time, feature) window to hide: book sizes in a trap, resting size at near levels in balance,
    trailing depth at the last time in expansion, else the last spread."""
    at = {n: i for i, n in enumerate(names)}
    mask = np.zeros(window.shape, dtype=bool)
    if trap:
        mask[:, [at[n] for n in (*LIQUIDITY, *BOUNDARY)]] = True
    elif phase == BALANCE:
        if (window[:, at["near_vah"]] > 0).any() or (window[:, at["in_value"]] > 0).any():
            mask[:, at["size_at_vah"]] = True
        if (window[:, at["near_val"]] > 0).any() or (window[:, at["in_value"]] > 0).any():
            mask[:, at["size_at_val"]] = True
    elif phase == EXPANSION:
        mask[-1, [at[n] for n in TRAILING]] = True
    else:
        mask[-1, at["a_spread"]] = True
    return mask


def tick_folds(windows: DataFrame, order: str = "availability_ts", splits: int = 3, components: int = 4, purge: int = 0) -> DataFrame:
    """Per fold: error on structurally masked cells of test windows, rebuilt from the training windows' axes.

    windows: order, window, trap, phase.  Moments of the training part are sums
    over rows, and test windows are scored where they lie: no task holds a fold.
    """
    from ..plans.folds import purged_walk_forward

    flat = windows.select(order, "trap", "phase", F.col("window").alias("w"))
    folded = purged_walk_forward(flat.withColumn("id", F.xxhash64("w", "trap", "phase")), order, splits, purge=purge, order=["id"]).drop("id")
    spark, out = windows.sparkSession, []
    for fold in range(1, splits + 1):
        own = folded.where(F.col("fold") == fold)
        rows = own.where("role = 'train'").select(F.flatten("w").alias("x"))
        got = vector_sum(rows, "x", lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel())))
        if got is None:
            continue
        d = int(round((-1 + (1 + 4 * (len(got) - 1)) ** 0.5) / 2))
        n, mean = got[0], got[1 : d + 1] / got[0]
        cov = got[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
        std = np.where(np.diag(cov) <= 1e-16, 1.0, np.sqrt(np.maximum(np.diag(cov), 0)))
        axes = np.linalg.eigh(cov / np.outer(std, std))[1][:, ::-1][:, :components].T

        def run(batches: Iterator[pd.DataFrame], mean: np.ndarray = mean, std: np.ndarray = std, axes: np.ndarray = axes) -> Iterator[pd.DataFrame]:
            total, count = 0.0, 0
            for batch in batches:
                for w, trap, phase in zip(batch["w"], batch["trap"], batch["phase"], strict=True):
                    x = np.array([np.asarray(r, dtype=float) for r in w])
                    mask = structural_mask(x, bool(trap), int(phase))
                    if mask.any():
                        z = (x.ravel() - mean) / std
                        back = (np.where(mask.ravel(), 0.0, z) @ axes.T) @ axes
                        total, count = total + float(((back - z)[mask.ravel()] ** 2).mean()), count + 1
            yield pd.DataFrame({"total": [total], "n": [count]})

        out.append(own.where("role = 'test'").select("w", "trap", "phase").mapInPandas(run, "total double, n bigint").agg(F.lit(fold).alias("fold"), F.sum("n").alias("n_windows"), F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).otherwise(0.0).alias("masked_mse")))
    table = out[0] if out else spark.createDataFrame([], "fold int, n_windows bigint, masked_mse double")
    for part in out[1:]:
        table = table.unionByName(part)
    return table


def masked_windows(windows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds masked_window and n_masked to rows with window, trap and phase columns."""
    kept = windows.columns
    schema = T.StructType([*windows.schema.fields, T.StructField("masked_window", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("n_masked", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, counts = [], []
            for w, trap, phase in zip(batch["window"], batch["trap"], batch["phase"], strict=True):
                x = np.array([np.asarray(r, dtype=float) for r in w])
                mask = structural_mask(x, bool(trap), int(phase), names)
                out.append(np.where(mask, 0.0, x).tolist())
                counts.append(int(mask.sum()))
            yield batch[kept].assign(masked_window=out, n_masked=np.array(counts, dtype=np.int32))

    return windows.mapInPandas(run, schema)


def silhouette(df: DataFrame, columns: list[str], label: str, key: str, block_rows: int = 512) -> DataFrame:
    """Mean silhouette over all rows, exact: every block of rows meets every other, and its sums of
    distances by label are added up.  A task holds two blocks; work grows with the square of the rows."""
    rows = df.select(label, key, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    kinds = rows.groupBy(label).count().collect()
    code = {r[0]: i for i, r in enumerate(kinds)}
    counts = np.array([r[1] for r in kinds], dtype=float)
    size = max(1, min(block_rows, (1 << 22) // max(len(kinds), 1)))
    tasks = max(1, -(-int(counts.sum()) // size))
    # blocks are cut from rows in an order of their own, so that a repeated task cuts the same ones
    dealt = rows.withColumn("h", F.xxhash64(*rows.columns)).repartition(-(-tasks // 8), "h").sortWithinPartitions("h", *rows.columns).drop("h", key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            y = np.array([code[v] for v in batch.column(0).to_pylist()], dtype="<i8")
            x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in batch.columns[1:]]))
            for i in range(0, len(y), size):
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([x[i : i + size].tobytes()], pa.binary()), pa.array([y[i : i + size].tobytes()], pa.binary())], names=["block", "x", "y"])
                n += 1

    blocks = dealt.mapInArrow(pack, "block bigint, x binary, y binary")
    pairs = blocks.crossJoin(F.broadcast(blocks.select(F.col("block").alias("own"))))
    ordered = pairs.repartition(tasks, "own").sortWithinPartitions("own", F.col("block") != F.col("own"), "block")

    def scores(sums: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        at, n = np.arange(len(y)), counts[y]
        a = sums[at, y] / np.maximum(n - 1, 1)
        others = sums / counts
        others[at, y] = np.inf
        b = others.min(axis=1)
        s = np.where(n > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0) if len(counts) > 1 else np.zeros(len(y))
        return pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, x, y, now = (c[i].as_py() for c in batch.columns)
                x, y = np.frombuffer(x, "<f8").reshape(-1, len(columns)), np.frombuffer(y, "<i8")
                if now != own:  # a block meets itself first
                    if own is not None:
                        yield scores(sums, mine)
                    own, left, mine, sums = now, x, y, np.zeros((len(y), len(counts)))
                gap = np.sqrt(np.maximum((left**2).sum(axis=1)[:, None] - 2 * left @ x.T + (x**2).sum(axis=1), 0))
                if block == own:
                    np.fill_diagonal(gap, 0)
                order = np.argsort(y, kind="stable")
                found, first = np.unique(y[order], return_index=True)
                sums[:, found] += np.add.reduceat(gap[:, order], first, axis=1)
        if own is not None:
            yield scores(sums, mine)

    return ordered.mapInArrow(run, "s double").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
