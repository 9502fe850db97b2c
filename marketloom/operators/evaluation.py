"""Scoring by outcome, per-outcome calibration, competing classes, drift, stability and feature choice.

Scored frames have outcome_name, y and p_hat (baseline_p where a training rate
is known).  Everything is an aggregate by outcome or feature, so rows are
combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import models

EPS = 1e-12
TS, SETUP = "availability_ts", "setup_availability_ts"


# ---- binary outcomes


def metrics_by_outcome(scored: DataFrame, n_bins: int = 10, p: str = "p_hat", key: str = "outcome_name") -> DataFrame:
    """Per outcome: n, brier, ece, mae, base_rate, brier_skill, log_loss and auc over rows with finite y and p.

    Skill is against baseline_p where the frame has it, else against the
    outcome's own rate; a forecast as good as a perfect baseline has skill 0, a
    worse one -1.  Bins of the calibration error are at most a fifth of the rows.
    """
    rows = stats.scored(scored, "y", p)
    base = F.col("baseline_p").cast("double") if "baseline_p" in scored.columns else F.avg("y").over(Window.partitionBy(key))
    rows = rows.withColumn("_base", base)
    known = F.col("_base").isNotNull() & ~F.isnan("_base")
    whole = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), stats.brier().alias("brier"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.avg("y").alias("base_rate"), stats.log_loss().alias("log_loss"),
        F.avg(F.when(known, (F.col("y") - F.col("p")) ** 2)).alias("_own"), F.avg(F.when(known, (F.col("y") - F.col("_base")) ** 2)).alias("_ref"),
    )
    skill = F.when(F.col("_ref").isNull(), 0.0).when(F.col("_ref") < EPS, F.when(F.col("_own") < EPS, 0.0).otherwise(-1.0)).otherwise(1 - F.col("_own") / F.col("_ref"))
    bins = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.call_function("div", F.col("n"), F.lit(5)))).cast("int")
    binned = rows.join(F.broadcast(whole.select(key, "n", bins.alias("_bins"))), key)
    at = F.least(F.col("_bins") - 1, F.floor(F.col("p") * F.col("_bins")))
    cells = binned.groupBy(key, "n", at.alias("_bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    ece = cells.groupBy(key).agg(F.sum(F.col("k") / F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))
    auc = stats.roc_auc(rows, [key])
    return whole.withColumn("brier_skill", skill).join(ece, key).join(auc, key).select(key, "n", "brier", "ece", "mae", "base_rate", "brier_skill", "log_loss", "auc")


Calibrator = tuple[float, float]


def fit_calibrators(scored: DataFrame, least: int = 20, p: str = "p_hat", key: str = "outcome_name", l2: float = 1e-3) -> dict[str, Calibrator]:
    """(slope, offset) of a logistic recalibration of each outcome with at least `least` rows and both classes."""
    rows = stats.scored(scored, "y", p)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") >= 0.5).alias("k")).where((F.col("n") >= least) & (F.col("k") > 0) & (F.col("k") < F.col("n"))).orderBy(key)
    return {r[key]: models.fit_platt_line(rows.where(F.col(key) == r[key]), "p", "y", l2) for r in counts.collect()}


def _recalibrated(p: Column, line: Calibrator) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) * line[0] + line[1])))


def apply_calibrators(scored: DataFrame, lines: dict[str, Calibrator], p: str = "p_hat", out: str = "p_cal", key: str = "outcome_name") -> DataFrame:
    """Adds the recalibrated probability by each row's outcome; others and non-finite ones keep theirs."""
    value = F.col(p).cast("double")
    made = value
    for name, line in sorted(lines.items()):
        made = F.when((F.col(key) == name) & ~F.isnan(value), _recalibrated(value, line)).otherwise(made)
    return scored.withColumn(out, made)


def apply_to_states(predictions: DataFrame, lines: dict[str, Calibrator]) -> DataFrame:
    """Recalibrates the wide columns p_<outcome>, each by its own line."""
    own = {f"p_{name}": line for name, line in lines.items() if f"p_{name}" in predictions.columns}
    return predictions.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), _recalibrated(F.col(c).cast("double"), line)) for c, line in own.items()})


def rate(column: str) -> Column:
    """Share of rows above one half, as an aggregate; 0 without rows."""
    return F.coalesce(F.avg((F.coalesce(F.col(column).cast("double"), F.lit(0.0)) > 0.5).cast("double")), F.lit(0.0))


def constant_brier(column: str, prediction: Column | float) -> Column:
    """Brier score of one forecast for all rows, as an aggregate."""
    y = (F.coalesce(F.col(column).cast("double"), F.lit(0.0)) > 0.5).cast("double")
    return F.coalesce(F.avg((y - prediction) ** 2), F.lit(0.0))


def weighted_mean(value: str, weight: str) -> Column:
    return F.when(F.sum(weight) > 0, F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).otherwise(0.0)


def descriptive_rates(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Rates over the whole frame as p_<name>: a description without confidence, not a forecast; absent columns are 0."""
    made = [(rate(c) if c in df.columns else F.lit(0.0)).alias(f"p_{n}") for n, c in targets.items()]
    return df.agg(*made, F.lit(0.0).alias("confidence"), F.count(F.lit(1)).alias("n_samples"))


def absolute_calibration(folds: DataFrame, predicted: str, realized: str) -> DataFrame:
    """Mean absolute difference of predicted and realised rates over folds; 0 without folds."""
    return folds.agg(F.coalesce(F.avg(F.abs(F.col(predicted) - F.col(realized))), F.lit(0.0)).alias("mean_absolute_calibration"))


# ---- competing classes


def competing_scores(scored: DataFrame, classes: list[str], label: str = "first_transition_class", prefix: str = "p_first_") -> DataFrame:
    """One row: n, multi-class brier, log loss and accuracy over rows of a known class with finite probabilities."""
    p = [F.col(f"{prefix}{c}").cast("double") for c in classes]
    finite = F.lit(True)
    for c in p:
        finite = finite & c.isNotNull() & ~F.isnan(c)
    square, own = F.lit(0.0), F.lit(None).cast("double")
    for name, c in zip(classes, p, strict=True):
        square = square + (c - (F.col(label) == name).cast("double")) ** 2
        own = F.when(F.col(label) == name, c).otherwise(own)
    top = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position(F.array(*p), F.greatest(*p)).cast("int") - 1)
    rows = scored.where(F.col(label).isin(classes) & finite).select(square.alias("b"), (-F.log(F.greatest(F.lit(EPS), F.least(F.lit(1.0), own)))).alias("l"), (top == F.col(label)).cast("double").alias("a"))
    zero = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return rows.agg(F.count(F.lit(1)).alias("n"), zero("b", "brier"), zero("l", "log_loss"), zero("a", "accuracy"))


# ---- drift and stability


def outcome_rates(labeled: DataFrame, key: str = "outcome_name") -> DataFrame:
    return labeled.groupBy(key).agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("rate"))


def drift(reference: DataFrame, other: DataFrame, features: list[str], reference_labels: DataFrame | None = None, other_labels: DataFrame | None = None, reference_ece: float = 0.0, other_ece: float = 0.0) -> DataFrame:
    """One row: counts, mean and largest stability index over features, mean differences of outcome rates and of feature means, and the change of calibration error."""
    spark = reference.sparkSession
    features = [c for c in features if c in reference.columns and c in other.columns]
    zero = lambda df: df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    a, b = zero(reference), zero(other)
    parts = [stats.psi(a, b, c).select(F.lit(c).alias("feature"), "psi") for c in features]
    table = parts[0] if parts else spark.createDataFrame([], "feature string, psi double")
    for p in parts[1:]:
        table = table.unionByName(p)
    means = a.agg(*[F.avg(c).alias(f"a_{i}") for i, c in enumerate(features)], F.count(F.lit(1)).alias("n_ref")).crossJoin(b.agg(*[F.avg(c).alias(f"b_{i}") for i, c in enumerate(features)], F.count(F.lit(1)).alias("n_cmp")))
    apart = F.lit(0.0)
    for i in range(len(features)):
        apart = apart + F.abs(F.col(f"a_{i}") - F.col(f"b_{i}"))
    means = means.select("n_ref", "n_cmp", (apart / max(len(features), 1)).alias("feature_mean_l1"))
    index = table.agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("mean_psi"), F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"))
    if reference_labels is None or other_labels is None:
        rates = spark.range(1).select(F.lit(0.0).alias("outcome_rate_l1"))
    else:
        both = outcome_rates(reference_labels).join(outcome_rates(other_labels).withColumnRenamed("rate", "other"), "outcome_name", "full")
        rates = both.agg(F.coalesce(F.avg(F.abs(F.coalesce("rate", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))), F.lit(0.0)).alias("outcome_rate_l1"))
    # each side is one row
    return means.crossJoin(index).crossJoin(rates).withColumn("calibration_delta", F.lit(abs(other_ece - reference_ece)))


def stability(folds: DataFrame, column: str = "ece") -> DataFrame:
    """One row: n, mean, population deviation and their ratio of a metric over folds (null: 0)."""
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    a = folds.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"))
    return a.withColumn("cv", F.when(F.col("n") > 0, F.col("std") / F.greatest(F.abs("mean"), F.lit(EPS))).otherwise(0.0))


def selection_stability(folds: DataFrame) -> DataFrame:
    """One row over selected folds: mean and sample deviation of the test IC, and the share of folds above 0."""
    return folds.agg(F.count(F.lit(1)).cast("int").alias("n_folds"), F.avg("test_ic").alias("mean_ic"), F.coalesce(F.stddev_samp("test_ic"), F.lit(0.0)).alias("std_ic"), F.avg((F.col("test_ic") > 0).cast("double")).alias("positive_fold_rate"))


def sign_stability(folded: DataFrame, value: str, forward: str, active_only: bool = False, least: int = 8, least_folds: int = 2, consistent: float = 2 / 3) -> DataFrame:
    """One row over test folds (column fold): folds with a rank correlation, the share that has the mean's sign, and whether that is enough."""
    rows = folded.where("role = 'test'").where(F.col(value).isNotNull() & F.col(forward).isNotNull() & ~F.isnan(F.col(value).cast("double")) & ~F.isnan(F.col(forward).cast("double")))
    if active_only:
        rows = rows.where(F.col(value) != 0)
    spread = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("k"), F.stddev_pop(value).alias("sv"), F.stddev_pop(forward).alias("sf")).where((F.col("k") >= least) & (F.col("sv") > 0) & (F.col("sf") > 0))
    ics = stats.spearman(rows.join(F.broadcast(spread.select("fold")), "fold", "left_semi"), value, forward, ["fold"])
    a = ics.agg(F.count(F.lit(1)).alias("n_folds"), F.collect_list("ic").alias("ics"), F.avg("ic").alias("mean"))
    sign = F.when(F.col("mean") >= 0, 1.0).otherwise(-1.0)
    share = F.size(F.filter("ics", lambda v: F.signum(v) == sign)) / F.col("n_folds")
    enough = F.col("n_folds") >= least_folds
    return a.select("n_folds", F.when(enough, share).otherwise(0.0).alias("consistency"), F.when(enough, share >= consistent).otherwise(False).alias("stable"))


def regime_ics(df: DataFrame, signal: str, forward: str, phase: str, least: int = 20) -> DataFrame:
    """Rank correlation of a signal with returns within each phase of at least `least` complete rows."""
    return stats.spearman(df.where(F.col(phase).isNotNull()), signal, forward, [phase]).where(F.col("n") >= least)


def attribution(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row of a gate: share of the inner signal's pulses that pass, and the rank correlation of both sizes."""
    rows = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).select(F.abs(outer).alias("a"), F.abs(inner).alias("b"), F.lit(1).alias("one"))
    fired = rows.where("b <> 0").agg(F.coalesce(F.avg((F.col("a") != 0).cast("double")), F.lit(0.0)).alias("pass_rate"))
    return stats.spearman(rows, "a", "b", ["one"]).select("n", F.col("ic").alias("abs_spearman")).crossJoin(fired)  # one row each


# ---- features


def dense_columns(df: DataFrame, exclude: tuple[str, ...] = (), most_null: float = 0.05) -> list[str]:
    """Numeric columns of which at most a share of `most_null` is null."""
    from pyspark.sql.types import NumericType

    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]
    if not names:
        return []
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names]).first()
    return [c for c in names if row[c] is not None and row[c] <= most_null]


def varying(df: DataFrame, names: list[str], least: int = 2) -> list[str]:
    """Names whose population deviation (null: 0) is above 1e-12, in order; one pass over the rows."""
    own = [c for c in dict.fromkeys(names) if c in df.columns]
    if not own:
        return []
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(x(c)).alias(f"s{i}") for i, c in enumerate(own)]).first()
    return [c for i, c in enumerate(own) if row["_n"] >= least and row[f"s{i}"] is not None and row[f"s{i}"] > EPS]


def preferred_features(df: DataFrame, preferred: list[str], most: int = 64) -> list[str]:
    return varying(df, preferred)[: max(0, most)]


def in_turns(pools: list[list[str]], most: int, quotas: list[int] | None = None) -> list[str]:
    """One name from each pool in turn, without repeats, until `most` names or the quotas are reached; what is left is filled in order."""
    left = list(quotas) if quotas is not None else [len(p) for p in pools]
    waiting = [list(p) for p in pools]
    chosen: list[str] = []

    def draw(k: int) -> bool:
        while waiting[k]:
            name = waiting[k].pop(0)
            if name not in chosen:
                chosen.append(name)
                return True
        return False

    moving = True
    while moving and len(chosen) < most:
        moving = False
        for k in range(len(pools)):
            if left[k] > 0 and len(chosen) < most:
                took = draw(k)
                left[k] = left[k] - 1 if took else 0
                moving = moving or took
    for k in range(len(pools)):
        while len(chosen) < most and draw(k):
            pass
    return chosen


#: Families of behaviour features by the start of their names, and how many of each are taken first (fixed values).
FAMILIES = {
    "projection": ("proj_",), "path": ("path_",), "structure": ("struct_",), "sequence": ("seq_", "since_"), "level_flow": ("lf_",), "reliability": ("rel_",),
    "memory_roll": ("mem_",), "state": ("vp_",), "quality": ("signal_quality", "signal_evidence", "deceptive_score", "real_liquidity_ratio"),
}
QUOTAS = {"projection": 10, "path": 8, "structure": 8, "sequence": 8, "level_flow": 10, "reliability": 6, "memory_roll": 8, "state": 8, "quality": 2}


def features_by_family(df: DataFrame, most: int = 64, quotas: dict[str, int] | None = None) -> list[str]:
    """Varying features, families in turns up to their quotas, then the rest in order."""
    memory = memory_columns(df)
    pools = [[c for c in df.columns if (c in memory if f == "memory_roll" else c.startswith(starts) and c not in memory)] for f, starts in FAMILIES.items()]
    good = set(varying(df, [c for p in pools for c in p]))
    own = QUOTAS | (quotas or {})
    return in_turns([[c for c in p if c in good] for p in pools], max(0, most), [max(0, own.get(f, 0)) for f in FAMILIES])


def memory_columns(df: DataFrame) -> list[str]:
    """Columns that causal memory makes, by name."""
    marks = ("__lag", "__rmean", "__rsum", "__ecount")
    return [c for c in df.columns if c.startswith("mem_") or any(m in c for m in marks)]


def matrix_of(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys and `x`, an array of the columns as doubles (null: 0): a matrix that stays distributed."""
    return df.select(*keys, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if c in df.columns]).alias("x"))


def stack_columns(groups: list[list[str]], level: int) -> list[str]:
    """Columns of the cumulative feature stack up to a level, without repeats."""
    return list(dict.fromkeys(c for g in groups[: level + 1] for c in g))


def signal_hits(df: DataFrame, signals: list[str]) -> DataFrame:
    """One row: rows where any signal is not 0, and whether all are 0 everywhere."""
    own = [c for c in signals if c in df.columns]
    hit = F.exists(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in own]), lambda v: v != 0) if own else F.lit(False)
    return df.agg(F.count_if(hit).alias("hits")).withColumn("all_zero", F.col("hits") == 0)


def by_outcome(labeled: DataFrame, name: str) -> DataFrame:
    """Resolved rows of one outcome."""
    rows = labeled.where(F.col("outcome_name") == name)
    if "label_status" in labeled.columns:
        rows = rows.where("label_status = 'resolved'")
    return rows.where("y IS NOT NULL")


def developed(labeled: DataFrame, cut_ts: int | None) -> DataFrame:
    """Rows set up by the holdout's cut (all, where there is none): the holdout is never measured here."""
    return labeled if cut_ts is None or cut_ts < 0 else labeled.where(F.col(SETUP) <= cut_ts)


def scoped(rows: DataFrame, out_of_fold: DataFrame | None, ts: str = TS) -> DataFrame:
    """Rows whose setup time is out of fold, with scope 'oof_develop'; all as 'develop' where none is."""
    if out_of_fold is None:
        return rows.withColumn("scope", F.lit("develop"))
    times = out_of_fold.select(F.col(ts).alias("_t")).distinct()
    hit = rows.join(times, rows[SETUP] == times["_t"], "left").withColumn("_hit", F.col("_t").isNotNull())
    any_hit = hit.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any"))
    return hit.crossJoin(F.broadcast(any_hit)).where("_hit OR NOT _any").withColumn("scope", F.when(F.col("_any"), "oof_develop").otherwise("develop")).drop("_t", "_hit", "_any")  # one row


def means_by_label(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count and means of columns (null: 0) by label."""
    return rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns if c in rows.columns])


def first_model(rows: DataFrame, scores: DataFrame, score: str, group: list[str], threshold: float, order: list[str]) -> DataFrame:
    """Each group's first row whose finite model score reaches the threshold; a setup's first score counts."""
    one = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(SETUP).agg(F.min(score).cast("double").alias("model_p"))
    good = rows.join(one, SETUP).where(F.col("model_p") >= threshold)
    w = Window.partitionBy(*group).orderBy(*order)
    return good.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_success(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Each group's first row with a label above one half."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.where("y > 0.5").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def permutation_difference(spark, x, y, n: int = 200, seed: int = 0):  # noqa: ANN001, ANN201
    """(difference of the means at y = 1 and y = 0, p-value under block-permuted labels); (0, 1) for fewer than five of either."""
    import numpy as np

    from .models import block_permutation, resample

    x, y = np.asarray(x, float), np.asarray(y, float) > 0.5
    if min(y.sum(), (~y).sum()) < 5:
        return 0.0, 1.0
    gap: Callable = lambda m: float(x[m].mean() - x[~m].mean()) if 0 < m.sum() < len(m) else 0.0
    observed = gap(y)
    null = resample(spark, n, lambda rng: gap(block_permutation(y, rng)), seed)
    hits = null.agg(F.count_if(F.abs("value") >= abs(observed) - 1e-15)).first()[0]
    return observed, (hits + 1) / (n + 1)


def regime_difference(spark, values, labels, n: int = 200, seed: int = 0) -> DataFrame:  # noqa: ANN001
    """One row: the F statistic of values over labels, and its one-sided p-value under block-permuted labels."""
    import numpy as np

    from .models import block_permutation, resample

    v, c = np.asarray(values, float), np.asarray(labels)

    def f(own: np.ndarray) -> float:
        groups = [v[own == k] for k in np.unique(own)]
        if len(groups) < 2 or len(v) <= len(groups):
            return 0.0
        between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(v) - len(groups))
        return float(between / within) if within > 0 else 0.0

    observed = f(c)
    null = resample(spark, n, lambda rng: f(block_permutation(c, rng)), seed)
    return null.agg(F.lit(observed).alias("f_stat"), ((F.count_if(F.col("value") >= observed) + 1) / (n + 1)).alias("pvalue"))
