"""Statistics as aggregates: ranks, correlations, tests, multiple testing, calibration and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank


def sharpe(x: str, periods: float = 1.0) -> Column:
    """Mean over sample deviation, times the root of periods; 0 without deviation."""
    return F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * periods**0.5).otherwise(0.0)


def t_statistic(x: str) -> Column:
    return F.when(F.stddev_samp(x) > 0, F.avg(x) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).otherwise(0.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Rank correlation with average ranks per key over complete pairs; 0 where it is undefined."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = pairs.select(*keys, average_rank(x, *keys).alias("_x"), average_rank(y, *keys).alias("_y"))
    value = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # corr() itself fails on constant ranks
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), F.lit(0.0)).alias("ic"))


def anova_f(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F statistic over groups, from sums alone."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return a.select(F.col("k").alias("groups"), "n", F.when((F.col("k") > 1) & (within > 0), between / within).otherwise(0.0).alias("f_stat"))


def adjust(df: DataFrame, p: str = "p", method: str = "bh", alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Adds adjusted and reject by Bonferroni, Holm or Benjamini-Hochberg, within keys; p is at least 0.

    Equal values get equal results whatever their order, so windows run over
    counts of distinct values, forward only, and rows join those.
    """
    keys = keys or []
    counts = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    through = w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_m": F.sum("_n").over(w), "_rank": F.sum("_n").over(through)})
    value = F.col(p) * F.col("_m")
    if method == "holm":
        value = F.max(F.col(p) * (F.col("_m") - F.col("_rank") + F.col("_n"))).over(through)
    elif method == "bh":
        value = F.min(value / F.col("_rank")).over(w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    elif method != "bonferroni":
        raise ValueError(f"unknown method {method!r}")
    at = [*keys, p]
    table = counts.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(at)], F.least(F.lit(1.0), value).alias("adjusted"))
    same = [df[c].eqNullSafe(table[f"_at{i}"]) for i, c in enumerate(at)]
    return df.join(table, same).select(*[df[c] for c in df.columns], "adjusted").withColumn("reject", F.col("adjusted") <= alpha)


def scored(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows with finite y and p, p within [0, 1], as doubles y and p."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.where(ok(y) & ok(p)).withColumns({"y": F.col(y).cast("double"), "p": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p).cast("double")))})


def brier() -> Column:
    return F.avg((F.col("y") - F.col("p")) ** 2)


def log_loss(eps: float = 1e-12) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
    return -F.avg(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))


def brier_skill(base: float | Column) -> Column:
    b = base if isinstance(base, Column) else F.lit(float(base))
    return F.lit(1.0) - brier() / F.avg((F.col("y") - b) ** 2)


def roc_auc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the curve by average ranks; null where one class is missing.

    Ranks come from counts by distinct score, so the sort is over scores, not rows.
    """
    keys = keys or []
    by = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") >= 0.5).alias("pos"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    a = by.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("n"))
    n_neg = F.col("n") - F.col("np")
    return a.select(*keys, F.when((F.col("np") > 0) & (n_neg > 0), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * n_neg)).alias("auc"))


def _bin(n_bins: int | Column) -> Column:
    n = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    return F.least(n - 1, F.floor(F.col("p") * n)).cast("int")


def calibration_error(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, fewer for small samples (a fifth of the rows at most)."""
    n = rows.agg(F.count(F.lit(1)).alias("n_all"))
    bins = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.call_function("div", F.col("n_all"), F.lit(5)))).cast("int")
    by = rows.crossJoin(F.broadcast(n)).groupBy(_bin(bins).alias("bin"), "n_all").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    return by.agg(F.sum(F.col("n") / F.col("n_all") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def reliability(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean prediction, mean outcome and count of every bin, empty ones included."""
    by = rows.groupBy(_bin(n_bins).alias("bin")).agg(F.avg("p").alias("p_mean"), F.avg("y").alias("y_mean"), F.count(F.lit(1)).alias("count"))
    every = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return every.join(by, "bin", "left").select("bin", zero("p_mean", 0.0), zero("y_mean", 0.0), zero("count", 0))


def psi(reference: DataFrame, other: DataFrame, column: str, n_bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index with open-ended bins at the reference's inner quantiles."""
    cuts = reference.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)]))).alias("cuts"))
    def shares(df: DataFrame, out: str) -> DataFrame:  # noqa: E306
        rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col(column))))
        return rows.groupBy("bin").agg(F.count(F.lit(1)).alias(out))
    bins = cuts.select(F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("bin"))  # noqa: E305
    both = bins.join(shares(reference, "r"), "bin", "left").join(shares(other, "c"), "bin", "left").fillna(0, ["r", "c"])
    whole = both.agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    q = both.crossJoin(F.broadcast(whole)).select(F.greatest(F.col("r") / F.col("rn"), F.lit(eps)).alias("r"), F.greatest(F.col("c") / F.col("cn"), F.lit(eps)).alias("c"))
    sums = q.agg(F.sum("r").alias("rs"), F.sum("c").alias("cs"))
    z = q.crossJoin(F.broadcast(sums)).select((F.col("r") / F.col("rs")).alias("r"), (F.col("c") / F.col("cs")).alias("c"))
    return z.agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def transition_matrix(df: DataFrame, label: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(from, to, n, share of from) of consecutive labels."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = df.select(*keys, F.col(label).alias("from_state"), F.lead(label).over(w).alias("to_state")).where("to_state IS NOT NULL")
    n = steps.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))
