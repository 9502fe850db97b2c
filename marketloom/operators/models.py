"""Dense models whose data stays distributed.

Fits reduce to sums of fixed-size vectors over rows (moments, gradients,
Hessians), taken batch by batch in every task and added in two levels, so the
driver solves systems of the size of the features only.  Predictions are plain
column expressions.  Resampling fans out over Spark tasks with a seed for each.

Null or non-finite features count as 0, as the callers' design matrices define.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as one array of doubles; null and non-finite become 0."""
    clean = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) for c in columns]
    return df.select(F.array(*clean).alias("x"))


def vector_sum(rows: DataFrame, column: str, work: Callable[[np.ndarray], np.ndarray], fan_in: int = 16) -> np.ndarray | None:
    """Sum over batches of work(matrix of rows); None without rows.  `column` holds arrays of one length."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = work(np.asarray(x, dtype=np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v, dtype=np.float64) for batch in batches for v in batch.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["v"])

    parts = rows.select(column).mapInArrow(first, "v binary").repartition(fan_in).mapInArrow(again, "v binary").collect()
    return np.sum([np.frombuffer(r[0], dtype=np.float64) for r in parts], axis=0) if parts else None


def moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products)."""
    d = len(columns)
    got = vector_sum(matrix(df, columns), "x", lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel())))
    if got is None:
        return 0.0, np.zeros(d), np.zeros((d, d))
    return got[0], got[1 : d + 1], got[d + 1 :].reshape(d, d)


def dot(columns: list[str], weights: np.ndarray, offset: float = 0.0) -> Column:
    """offset + sum of weight times column, null or non-finite columns as 0."""
    out = F.lit(float(offset))
    for c, w in zip(columns, weights, strict=True):
        out = out + F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) * float(w)
    return out


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of training rows; deviations up to 1e-8 count as 1."""

    columns: list[str]
    mean: np.ndarray
    std: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    n, s, q = moments(df, columns)
    mean = s / max(n, 1)
    std = np.sqrt(np.maximum(np.diag(q) / max(n, 1) - mean**2, 0))
    return Scaler(columns, mean, np.where(std <= 1e-8, 1.0, std))


@dataclass(frozen=True)
class Pca:
    columns: list[str]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "z") -> DataFrame:
        return df.withColumns({f"{prefix}{i}": dot(self.columns, c, -float(c @ self.mean)) for i, c in enumerate(self.components)})

    def reconstruct(self, df: DataFrame, prefix: str = "z", out: str = "r_") -> DataFrame:
        names = [f"{prefix}{i}" for i in range(len(self.components))]
        return df.withColumns({f"{out}{c}": dot(names, self.components[:, k], float(self.mean[k])) for k, c in enumerate(self.columns)})


def fit_pca(df: DataFrame, columns: list[str], k: int) -> Pca:
    """Principal axes of the covariance, largest first, each with its largest entry positive."""
    n, s, q = moments(df, columns)
    mean = s / max(n, 1)
    values, axes = np.linalg.eigh(q / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(-values)[: min(k, len(columns))]
    found = axes[:, order].T
    signs = np.sign(found[np.arange(len(order)), np.abs(found).argmax(axis=1)])
    return Pca(columns, mean, found * signs[:, None], np.maximum(values[order], 0))


@dataclass(frozen=True)
class Ridge:
    """Linear map with an unpenalised intercept: targets = [x, 1] @ weights."""

    columns: list[str]
    targets: list[str]
    weights: np.ndarray

    def transform(self, df: DataFrame, suffix: str = "_hat") -> DataFrame:
        return df.withColumns({f"{t}{suffix}": dot(self.columns, self.weights[:-1, j], self.weights[-1, j]) for j, t in enumerate(self.targets)})


def fit_ridge(df: DataFrame, columns: list[str], targets: list[str], alpha: float = 1.0) -> Ridge:
    n, s, q = moments(df, [*columns, *targets])
    d = len(columns)
    a = np.block([[q[:d, :d], s[:d, None]], [s[None, :d], np.array([[n]])]]) + np.diag([alpha] * d + [0.0])
    b = np.vstack([q[:d, d:], s[None, d:]])
    return Ridge(columns, targets, np.linalg.lstsq(a, b, rcond=None)[0])


def r2(df: DataFrame, y: str, predicted: str, train_mean: float) -> DataFrame:
    """Out-of-sample R2 against the training mean."""
    return df.agg((1 - F.sum((F.col(y) - F.col(predicted)) ** 2) / F.sum((F.col(y) - float(train_mean)) ** 2)).alias("r2"))


@dataclass(frozen=True)
class KMeans:
    columns: list[str]
    centers: np.ndarray

    def distances(self) -> list[Column]:
        return [sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(v)) ** 2 for c, v in zip(self.columns, center, strict=True)), F.lit(0.0)) for center in self.centers]

    def transform(self, df: DataFrame, out: str = "regime") -> DataFrame:
        d = F.array(*self.distances())
        return df.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _seed_centers(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centers)


def fit_kmeans(df: DataFrame, columns: list[str], k: int, key: str, seed: int = 0, starts: int = 4, rounds: int = 30, sample: int = 5000) -> KMeans:
    """Lloyd over all rows from the best of several k-means++ starts on a hash-chosen sample of `sample` rows.

    A cluster that loses its rows keeps its centre.
    """
    taken = matrix(df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample), columns).collect()
    x = np.array([r[0] for r in taken], dtype=np.float64).reshape(len(taken), len(columns))
    if len(x) < k:
        raise ValueError(f"{len(x)} rows for {k} clusters")
    rng = np.random.default_rng(seed)

    def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(axis=1), 0)
        return gap.argmin(axis=1), gap.min(axis=1)

    tried = []
    for _ in range(starts):
        centers = _seed_centers(x, k, rng)
        for _ in range(rounds):
            own, _gap = nearest(x, centers)
            centers = np.array([x[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(k)])
        tried.append((nearest(x, centers)[1].sum(), centers))
    centers = min(tried, key=lambda t: t[0])[1]
    rows = matrix(df, columns)
    for _ in range(rounds):
        now = centers

        def part(batch: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            own, _gap = nearest(batch, now)
            hot = np.eye(k)[own]
            return np.concatenate((hot.sum(axis=0), (hot.T @ batch).ravel()))

        total = vector_sum(rows, "x", part)
        counts, sums = total[:k], total[k:].reshape(k, -1)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now)
        if np.abs(centers - now).max() < 1e-9:
            break
    return KMeans(columns, centers[np.lexsort(centers.T[::-1])])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Logistic:
    """Class weights over standardised features and an intercept; the last class is the reference."""

    columns: list[str]
    classes: list
    scaler: Scaler
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self) -> list[Column]:
        scaled = self.weights[:, :-1] / self.scaler.std
        offset = self.weights[:, -1] - scaled @ self.scaler.mean
        return [dot(self.columns, w, o) / self.temperature for w, o in zip(scaled, offset, strict=True)] + [F.lit(0.0)]

    def transform(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        rows = df.withColumn("_z", F.array(*self.logits()))
        rows = rows.withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.array_max("_z")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
        return rows.withColumns({f"{prefix}{c}": F.get("_e", F.lit(i)) / F.col("_s") for i, c in enumerate(self.classes)}).drop("_z", "_e", "_s")


def fit_logistic(df: DataFrame, columns: list[str], label: str, classes: list, l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> Logistic:
    """Multinomial (binary with two classes) L2 Newton over all rows; the intercept is not penalised.

    Rows with other labels are left out.  Each round is one pass of sums.
    """
    kept = df.where(F.col(label).isin(classes))
    scaler = fit_scaler(kept, columns)
    code = F.lit(len(classes) - 1)
    for i, c in enumerate(classes[:-1]):
        code = F.when(F.col(label) == c, F.lit(i)).otherwise(code)
    rows = matrix(kept.withColumn("_y", code), [*columns, "_y"]).cache()
    d, k = len(columns) + 1, len(classes) - 1
    w = np.zeros((k, d))
    mean, std = scaler.mean, scaler.std
    try:
        for _ in range(rounds):

            def part(batch: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                x = np.column_stack(((batch[:, :-1] - mean) / std, np.ones(len(batch))))
                p = _softmax(np.column_stack((x @ w.T, np.zeros(len(x)))))[:, :k]
                y = np.eye(k + 1)[batch[:, -1].astype(int)][:, :k]
                hessian = np.einsum("na,nb,ni,nj->aibj", p, p, x, x, optimize=True) * -1
                for a in range(k):
                    hessian[a, :, a, :] += (x * p[:, a : a + 1]).T @ x
                return np.concatenate((((p - y).T @ x).ravel(), hessian.ravel()))

            total = vector_sum(rows, "x", part)
            if total is None:
                break
            penalty = np.tile(np.r_[np.full(d - 1, l2), 0.0], k)
            gradient = total[: k * d] + penalty * w.ravel()
            step = np.linalg.lstsq(total[k * d :].reshape(k * d, k * d) + np.diag(penalty + 1e-9), gradient, rcond=None)[0]
            w = w - np.clip(step, -5, 5).reshape(k, d)
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return Logistic(columns, classes, scaler, w)


def _logit(c: Column) -> Column:
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return F.log(clipped / (1 - clipped))


def fit_platt_line(df: DataFrame, p: str, y: str, l2: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of a logistic recalibration of a probability's logit."""
    model = fit_logistic(df.withColumn("_logit", _logit(F.col(p))).withColumn("_label", (F.col(y) >= 0.5).cast("int")), ["_logit"], "_label", [1, 0], l2)
    slope = float(model.weights[0, 0] / model.scaler.std[0])
    return slope, float(model.weights[0, 1] - slope * model.scaler.mean[0])


def fit_platt(df: DataFrame, p: str, y: str, l2: float = 1e-3) -> Callable[[Column], Column]:
    """Logistic recalibration of a probability; returns a column function."""
    slope, offset = fit_platt_line(df, p, y, l2)
    return lambda c: 1 / (1 + F.exp(-(_logit(c) * slope + offset)))


def fit_temperature(df: DataFrame, model: Logistic, label: str, grid: np.ndarray | None = None) -> Logistic:
    """The same model with the temperature of least negative log likelihood on `df`, from a grid of 76 in [0.25, 4]."""
    grid = np.linspace(0.25, 4.0, 76) if grid is None else grid
    code = F.lit(len(model.classes) - 1)
    for i, c in enumerate(model.classes[:-1]):
        code = F.when(F.col(label) == c, F.lit(i)).otherwise(code)
    named = df.where(F.col(label).isin(model.classes)).select(F.array(*[z.cast("double") for z in model.logits()], code.cast("double")).alias("x"))

    def part(batch: np.ndarray) -> np.ndarray:
        y = batch[:, -1].astype(int)
        return np.array([-np.log(np.maximum(_softmax(batch[:, :-1] / t)[np.arange(len(y)), y], 1e-300)).sum() for t in grid])

    losses = vector_sum(named, "x", part)
    best = 1.0 if losses is None else float(grid[int(np.argmin(losses))])
    return Logistic(model.columns, model.classes, model.scaler, model.weights, best)


@dataclass(frozen=True)
class GroupedLogistic:
    """One binary model a group: weights over raw features with the intercept last; groups without both classes have none."""

    columns: list[str]
    group: str
    weights: dict[str, np.ndarray]

    def transform(self, df: DataFrame, out: str = "p_hat") -> DataFrame:
        """Adds the probability of each row's group; null where the group has no model."""
        spark = df.sparkSession
        table = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in sorted(self.weights.items())], f"{self.group} string, _w array<double>")
        x = F.array(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) for c in self.columns], F.lit(1.0))
        rows = df.join(F.broadcast(table), self.group, "left")  # a row a model
        z = F.aggregate(F.zip_with(x, F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return rows.withColumn(out, 1 / (1 + F.exp(-z))).drop("_w")


def fit_logistic_groups(df: DataFrame, group: str, columns: list[str], label: str, l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-8, least: int = 8) -> GroupedLogistic:
    """A binary L2 Newton fit for every group at once: each round is one pass over all rows, whatever the number of groups.

    Groups (folds by outcomes) are listed on the driver.  Features are scaled by
    each group's own rows; the intercept is not penalised.  Groups of fewer than
    `least` rows or with one class get no model.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0.5).alias("k")).where((F.col("n") >= least) & (F.col("k") > 0) & (F.col("k") < F.col("n"))).collect()
    names = sorted(r[group] for r in counts)
    if not names or not columns:
        return GroupedLogistic(columns, group, {})
    spark = df.sparkSession
    codes = spark.createDataFrame(list(zip(names, map(float, range(len(names))), strict=True)), f"{group} string, _g double")
    data = matrix(rows.join(F.broadcast(codes), group).withColumn("_y", (F.col(label) > 0.5).cast("double")), [*columns, "_y", "_g"]).cache()
    d, size = len(columns), len(names)

    def each(batch: np.ndarray, width: int, work: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        out = np.zeros((size, width))
        code = batch[:, -1].astype(int)
        for g in np.unique(code):
            own = batch[code == g]
            out[g] = work(int(g), own[:, :d], own[:, d])
        return out.ravel()

    try:
        total = vector_sum(data, "x", lambda b: each(b, 2 * d + 1, lambda _, x, y: np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)])).reshape(size, -1)
        mean = total[:, 1 : d + 1] / total[:, :1]
        std = np.sqrt(np.maximum(total[:, d + 1 :] / total[:, :1] - mean**2, 0))
        std[std <= 1e-8] = 1.0
        w = np.zeros((size, d + 1))
        live = np.ones(size, dtype=bool)
        for _ in range(rounds):

            def part(g: int, x: np.ndarray, y: np.ndarray, w: np.ndarray = w, live: np.ndarray = live) -> np.ndarray:
                if not live[g]:
                    return np.zeros((d + 1) * (d + 2))
                z = np.column_stack(((x - mean[g]) / std[g], np.ones(len(x))))
                p = 1 / (1 + np.exp(-np.clip(z @ w[g], -60, 60)))
                return np.concatenate((z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))

            total = vector_sum(data, "x", lambda b, part=part: each(b, (d + 1) * (d + 2), part)).reshape(size, -1)
            w, live = w.copy(), live.copy()
            penalty = np.r_[np.full(d, l2), 0.0]
            for g in np.flatnonzero(live):
                step = np.linalg.lstsq(total[g, d + 1 :].reshape(d + 1, d + 1) + np.diag(penalty + 1e-9), total[g, : d + 1] + penalty * w[g], rcond=None)[0]
                w[g] -= np.clip(step, -5, 5)
                live[g] = np.abs(step).max() >= tolerance
            if not live.any():
                break
    finally:
        data.unpersist()
    slope = w[:, :-1] / std
    return GroupedLogistic(columns, group, {n: np.r_[slope[g], w[g, -1] - slope[g] @ mean[g]] for g, n in enumerate(names)})


# ---- resampling


def block_permutation(x: np.ndarray, rng: np.random.Generator, size: int | None = None) -> np.ndarray:
    """Adjacent blocks of about the root of the length, in random order."""
    n = len(x)
    if n < 2:
        return x.copy()
    size = min(max(int(size or max(2, int(n**0.5))), 1), n)
    blocks = [x[a : a + size] for a in range(0, n, size)]
    return np.concatenate([blocks[i] for i in rng.permutation(len(blocks))])


def resample(spark: SparkSession, n: int, draw: Callable[[np.random.Generator], float], seed: int = 0) -> DataFrame:
    """(draw, value) of n independent draws, each with the generator of (seed, draw); data are held by `draw`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(draw(np.random.default_rng((seed, i)))) for i in ids])], names=["draw", "value"])

    return spark.range(n).select(F.col("id").alias("draw")).mapInArrow(run, "draw bigint, value double")


def mean_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.mean() - b.mean())


def permutation_test(spark: SparkSession, a: np.ndarray, b: np.ndarray, n: int = 1000, seed: int = 0, alternative: str = "two-sided", statistic: Callable[[np.ndarray, np.ndarray], float] = mean_difference) -> DataFrame:
    """Observed statistic and (hits + 1) / (n + 1) under block permutation of the pooled series."""
    pooled, observed = np.concatenate((a, b)), statistic(a, b)

    def draw(rng: np.random.Generator) -> float:
        own = block_permutation(pooled, rng)
        return statistic(own[: len(a)], own[len(a) :])

    hit = {"greater": F.col("value") >= observed, "less": F.col("value") <= observed, "two-sided": F.abs("value") >= abs(observed)}[alternative]
    return resample(spark, n, draw, seed).agg(F.lit(float(observed)).alias("statistic"), ((F.count_if(hit) + 1) / (n + 1)).alias("pvalue"), F.count(F.lit(1)).alias("n_resamples"))


def bootstrap_ci(spark: SparkSession, x: np.ndarray, n: int = 1000, ci: float = 0.95, seed: int = 0, block: int | None = None, statistic: Callable[[np.ndarray], float] = lambda v: float(v.mean())) -> DataFrame:
    """Percentile interval of independent draws, or of moving blocks."""

    def draw(rng: np.random.Generator) -> float:
        if block is None:
            return statistic(x[rng.integers(0, len(x), len(x))])
        starts = rng.integers(0, len(x) - block + 1, -(-len(x) // block))
        return statistic(np.concatenate([x[s : s + block] for s in starts])[: len(x)])

    q = F.percentile("value", F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))
    return resample(spark, n, draw, seed).agg(q.alias("q")).select(F.get("q", F.lit(0)).alias("low"), F.lit(float(statistic(x))).alias("point"), F.get("q", F.lit(1)).alias("high"))


def _distance_means(v: np.ndarray) -> np.ndarray:
    """Mean distance of each value to all, by sorting."""
    order = np.argsort(v, kind="stable")
    w = v[order]
    sums, i, n = np.concatenate(([0.0], np.cumsum(w))), np.arange(len(w)), len(w)
    out = np.empty(n)
    out[order] = (w * i - sums[i] + (sums[n] - sums[i + 1]) - w * (n - i - 1)) / n
    return out


def distance_correlation(x: np.ndarray, y: np.ndarray, most: int | None = None, block: int = 512) -> float:
    """Distance correlation of two series, over all pairs in blocks of rows; with `most`, of that many evenly spaced points."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if most and len(x) > most:
        at = np.linspace(0, len(x) - 1, most).astype(int)
        x, y = x[at], y[at]
    if not len(x):
        return 0.0
    rows_x, rows_y = _distance_means(x), _distance_means(y)
    xy = xx = yy = 0.0
    for at in range(0, len(x), block):
        own = slice(at, at + block)
        a = np.abs(x[own, None] - x[None, :]) - rows_x[own, None] - rows_x[None, :] + rows_x.mean()
        b = np.abs(y[own, None] - y[None, :]) - rows_y[own, None] - rows_y[None, :] + rows_y.mean()
        xy, xx, yy = xy + float((a * b).sum()), xx + float((a * a).sum()), yy + float((b * b).sum())
    spread = np.sqrt(xx * yy)
    return float(np.sqrt(max(xy, 0.0) / spread)) if spread > 0 else 0.0
