"""Time folds: purged walk-forward splits, month folds and frozen holdouts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Time slices that running counts are taken in.
SLICES = 1024


def running_counts(counts: DataFrame, ts: str, n: str = "_n") -> DataFrame:
    """ts, n, `until` (running sum of n by time) and `all`, from distinct times.

    Times fall into at most SLICES equal slices; sums of slices are added up
    first, then times inside their own slice, so no task sorts all times.
    """
    span = counts.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    # one row, and at most SLICES + 1 rows
    placed = counts.crossJoin(F.broadcast(span)).withColumn("_slice", F.floor((F.col(ts) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / SLICES))).drop("_lo", "_hi")
    sums = placed.groupBy("_slice").agg(F.sum(n).alias("_own"))
    offsets = sums.select("_slice", (F.sum("_own").over(Window.orderBy("_slice")) - F.col("_own")).alias("_offset"), F.sum("_own").over(Window.partitionBy()).alias("all"))
    inside = placed.join(F.broadcast(offsets), "_slice")
    return inside.select(ts, n, (F.col("_offset") + F.sum(n).over(Window.partitionBy("_slice").orderBy(ts))).alias("until"), "all")


def purged_walk_forward(df: DataFrame, ts: str, n_splits: int, embargo: int = 0, purge: int = 0, least_train: int = 1, order: list[str] | None = None) -> DataFrame:
    """df's rows for each fold that they are in, with fold and role.

    Rows are cut in time order into n_splits + 1 blocks; fold k tests block k
    (the last takes the rest) and trains on rows before it that are earlier than
    its first time, at least `embargo` earlier, and not among the last `purge`
    rows.  Rows of one time never stand on both sides.  Positions come from
    running counts by time slice plus an offset inside a time, not from one global sort.
    """
    if n_splits < 1 or embargo < 0 or purge < 0:
        raise ValueError("n_splits must be at least 1; embargo and purge not negative")
    order = order or [c for c in df.columns if c != ts]
    counts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    starts = running_counts(counts, ts).select(ts, (F.col("until") - F.col("_n")).alias("_first"), F.col("all").alias("_all"))
    rows = df.join(starts, ts).withColumn("_i", F.col("_first") + F.row_number().over(Window.partitionBy(ts).orderBy(*order)) - 1)
    block = F.call_function("div", F.col("_all"), F.lit(n_splits + 1))
    rows = rows.withColumn("_size", block).where("_size >= 1")
    heads = starts.withColumn("_size", block).where("_size >= 1").select(F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold"), F.col(ts).alias("_t"), "_first", "_size", "_all")
    last = Window.partitionBy("fold").orderBy(F.col("_first").desc())
    heads = heads.where(F.col("_first") <= F.col("fold") * F.col("_size")).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("fold", F.col("_t").alias("_test_ts"), (F.col("fold") * F.col("_size")).alias("_from"), F.when(F.col("fold") == n_splits, F.col("_all")).otherwise((F.col("fold") + 1) * F.col("_size")).alias("_to"))
    tagged = rows.crossJoin(F.broadcast(heads))
    test = (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to"))
    train = (F.col("_i") < F.col("_from") - purge) & (F.col(ts) < F.col("_test_ts")) & (F.col(ts) <= F.col("_test_ts") - embargo)
    tagged = tagged.withColumn("role", F.when(test, "test").when(train, "train")).where("role IS NOT NULL")
    good = tagged.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least_train).select("fold")
    return tagged.join(F.broadcast(good), "fold").select(*df.columns, "fold", "role")


def month_of(ts: str):  # noqa: ANN201
    """UTC year and month of a nanosecond column."""
    return F.date_format(F.timestamp_seconds(F.call_function("div", F.col(ts), F.lit(1_000_000_000))), "yyyy-MM")


def month_folds(df: DataFrame, ts: str, least_months: int = 4, embargo: int = 0) -> DataFrame:
    """Each month after the first `least_months` is a test fold; earlier months train, less the embargo."""
    rows = df.withColumn("month", month_of(ts))
    months = rows.groupBy("month").agg(F.min(ts).alias("_first")).withColumn("_k", F.row_number().over(Window.orderBy("month")))
    folds = months.where(F.col("_k") > least_months).select(F.col("month").alias("test_month"), F.col("_first").alias("_test_ts"), (F.col("_k") - least_months).cast("int").alias("fold"))
    role = F.when(F.col("month") == F.col("test_month"), "test").when((F.col("month") < F.col("test_month")) & (F.col(ts) <= F.col("_test_ts") - embargo), "train")
    return rows.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL").select(*df.columns, "fold", "test_month", "role")


def frozen_holdout(df: DataFrame, ts: str, share: float = 0.2) -> DataFrame:
    """Adds cut_ts and is_holdout: the last share of rows by time, never splitting one time."""
    counts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.least(F.greatest(F.floor(F.col("all") * (1 - share)), F.lit(1)), F.col("all") - 1)
    first = running_counts(counts, ts).where(F.col("until") >= cut).agg(F.min(ts).alias("_x"))
    around = counts.crossJoin(F.broadcast(first)).groupBy("_x").agg(F.max(F.when(F.col(ts) < F.col("_x"), F.col(ts))).alias("before"), F.max(ts).alias("last"))
    cut_ts = around.select(F.when(F.col("last") > F.col("_x"), F.col("_x")).otherwise(F.coalesce("before", "_x")).alias("cut_ts"))
    return df.crossJoin(F.broadcast(cut_ts)).withColumn("is_holdout", F.col(ts) > F.col("cut_ts"))


def segment_keys(df: DataFrame, ts: str, instrument: str | None = "instrument_id") -> DataFrame:
    """Adds segment_month and segment_contract (SINGLE without an instrument)."""
    contract = F.col(instrument).cast("string") if instrument and instrument in df.columns else F.lit("SINGLE")
    return df.withColumns({"segment_month": month_of(ts), "segment_contract": contract})


def holdout_by_months(df: DataFrame, ts: str, months: int) -> DataFrame:
    """Adds cut_ts (the last time before the holdout) and is_holdout: the last `months` calendar months that occur."""
    if months < 1:
        raise ValueError("a holdout has at least one month")
    rows = df.withColumn("_month", month_of(ts))
    known = rows.groupBy("_month").agg(F.max(ts).alias("_last")).withColumn("_k", F.row_number().over(Window.orderBy(F.col("_month").desc())))  # one row a month
    if known.where(F.col("_k") > months).limit(1).count() == 0:
        raise ValueError(f"fewer than {months + 1} months")
    cut = known.where(F.col("_k") > months).agg(F.max("_last").alias("cut_ts"))
    return rows.drop("_month").crossJoin(F.broadcast(cut)).withColumn("is_holdout", F.col(ts) > F.col("cut_ts"))


def setup_folds(df: DataFrame, ts: str, n_splits: int = 3, embargo: int = 0, purge: int = 1, least_train: int = 12) -> DataFrame:
    """df's rows for each fold that their setup time is in: folds are cut over distinct times, so all rows of one time share a side."""
    times = purged_walk_forward(df.select(ts).distinct(), ts, n_splits, embargo, purge, least_train, order=[ts])
    return df.join(times, ts).select(*df.columns, "fold", "role")


def contract_aware(df: DataFrame, ts: str, instrument: str = "instrument_id", **options: int) -> DataFrame:
    """setup_folds with `segment`: time stays what separates the sides; several contracts are only named, not left out in turn."""
    n = df.agg(F.count_distinct(instrument).alias("_n"))
    rows = setup_folds(df, ts, **options).crossJoin(F.broadcast(n))  # one row
    return rows.withColumn("segment", F.when(F.col("_n") > 1, F.concat(F.lit("time_multi_instrument("), F.col("_n"), F.lit(")"))).otherwise("time")).drop("_n")


def fold_table(folded: DataFrame, ts: str) -> DataFrame:
    """One row a fold: rows and times of both sides."""
    of = lambda role: F.when(F.col("role") == role, F.col(ts))
    return folded.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train_n"), F.count_if(F.col("role") == "test").alias("test_n"), F.max(of("train")).alias("train_end_ts"), F.min(of("test")).alias("test_start_ts"), F.max(of("test")).alias("test_end_ts"))


def calibration_tail(train: DataFrame, ts: str, share: float = 0.2, least_train: int = 10, least_tail: int = 5) -> DataFrame:
    """Adds part: 'cal' for the last share of distinct times (a third at most), else 'fit'; all 'fit' where either would be too small."""
    counts = train.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_counts(counts.withColumn("_one", F.lit(1)), ts, "_one").join(counts, ts)
    size = F.least(F.greatest(F.lit(1), F.round(F.col("all") * share)), F.call_function("div", F.col("all"), F.lit(3)))
    tail = ranked.withColumn("_cal", F.col("until") > F.col("all") - size)
    whole = tail.agg(F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_cal"), F.col("_n"))).alias("_tail"))
    use = F.col("_cal") & (F.col("_rows") >= least_train) & (F.coalesce("_tail", F.lit(0)) >= least_tail) & F.lit(share > 0)
    parts = tail.crossJoin(F.broadcast(whole)).select(ts, F.when(use, "cal").otherwise("fit").alias("part"))  # one row
    return train.join(parts, ts).select(*train.columns, "part")
