"""Point-in-time feature store: long rows (feature, instrument_id, value, event_ts, availability_ts, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.asof import asof_backward

KEYS = ["feature", "instrument_id"]
COLUMNS = ["feature", "instrument_id", "value", "event_ts", "availability_ts", "version"]


def to_long(df: DataFrame, values: list[str], version: str, event: str = "event_ts", known: str = "availability_ts", instrument: str = "instrument_id") -> DataFrame:
    """Wide to long; null values stay as rows."""
    wide = df.select(F.col(instrument).alias("instrument_id"), F.col(event).alias("event_ts"), F.col(known).alias("availability_ts"), *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(["instrument_id", "event_ts", "availability_ts"], values, "feature", "value").withColumn("version", F.lit(version)).select(*COLUMNS)


class FeatureStore:
    """A Parquet table partitioned by version; rows known before their event are refused."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def ingest(self, rows: DataFrame) -> None:
        missing = set(COLUMNS) - set(rows.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        checked = rows.select(*COLUMNS).withColumn("availability_ts", F.when(F.col("availability_ts") < F.col("event_ts"), F.raise_error(F.lit("availability before event"))).otherwise(F.col("availability_ts")))
        checked.write.mode("append").partitionBy("version").parquet(self.path)

    def data(self, version: str | None = None, instrument_id: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        if version is not None:
            df = df.where(F.col("version") == version)
        return df if instrument_id is None else df.where(F.col("instrument_id") == instrument_id)

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("version").distinct().orderBy("version")


def as_of(rows: DataFrame, ts: int) -> DataFrame:
    """Latest value of each feature and instrument known at ts; equal times go to the later event, then the larger value."""
    last = F.max_by(F.struct("value", "event_ts", "availability_ts", "version"), F.struct("availability_ts", "event_ts", F.coalesce("value", F.lit(float("-inf")))))
    return rows.where(F.col("availability_ts") <= ts).groupBy(*KEYS).agg(last.alias("x")).select(*KEYS, "x.*")


def snapshots(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row for each instrument and time with the last known value of every feature."""
    wide = rows.groupBy("instrument_id", "availability_ts").pivot("feature", features).agg(F.max_by("value", F.struct("event_ts", F.coalesce("value", F.lit(float("-inf"))))))
    w = Window.partitionBy("instrument_id").orderBy("availability_ts").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("instrument_id", "availability_ts", *[F.last(f, ignorenulls=True).over(w).alias(f) for f in features])


def point_in_time_join(query: DataFrame, rows: DataFrame, features: list[str], ts: str = "ts") -> DataFrame:
    """Query rows with each feature as known at their time."""
    return asof_backward(query, snapshots(rows, features).withColumnRenamed("availability_ts", "_known"), ts, "_known", by=["instrument_id"], columns=features)


def sample_last(df: DataFrame, interval_ns: int, columns: list[str], key: str = "instrument_id") -> DataFrame:
    """Last state of each interval, stamped with the interval's end."""
    start = F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(interval_ns))
    last = F.max_by(F.struct(*columns), F.struct("event_ts", "sequence"))
    return df.groupBy(key, start.alias("bucket_start")).agg(last.alias("x")).select(key, "bucket_start", (F.col("bucket_start") + interval_ns).alias("availability_ts"), "x.*")


def differences(df: DataFrame, column: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """Step of a running column inside its group; the first row keeps its value."""
    return df.withColumn(out, F.col(column) - F.coalesce(F.lag(column).over(Window.partitionBy(*group).orderBy(*order)), F.lit(0)))
