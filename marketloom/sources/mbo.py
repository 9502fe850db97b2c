"""Order-level event sources: contract, readers, vendor normalisation, and adapters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCALE = 1e-9
ACTIONS = ("A", "C", "M", "R", "T", "F", "N")
SIDES = ("B", "A", "N")

#: The event contract (fixed values): columns in order, with their types.
CONTRACT = T.StructType(
    [
        T.StructField("event_ts", T.LongType()),
        T.StructField("ingest_ts", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("instrument_id", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("flags", T.ShortType()),
    ]
)


@dataclass(frozen=True)
class Event:
    """One event for fixtures and single checks; frames are checked by `validate`."""

    event_ts: int
    ingest_ts: int
    sequence: int
    instrument_id: int
    symbol: str
    action: str
    side: str
    price: int
    size: int
    order_id: int
    flags: int = 0

    def __post_init__(self) -> None:
        if self.ingest_ts < self.event_ts:
            raise ValueError("known before it happened")
        if self.size < 0 or self.action not in ACTIONS or self.side not in SIDES:
            raise ValueError(f"no such event: {self.action!r}, {self.side!r}, {self.size}")


def contract_counts(df: DataFrame) -> DataFrame:
    """One row of contract breaches by kind, and the number of rows."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad(F.col("ingest_ts") < F.col("event_ts")).alias("ingest_before_event"),
        bad(~F.col("action").isin(*ACTIONS)).alias("bad_action"),
        bad(~F.col("side").isin(*SIDES)).alias("bad_side"),
        bad(F.col("size") < 0).alias("negative_size"),
        F.count_if(F.col("price").isNull()).alias("null_price"),
    )


def validate(df: DataFrame) -> DataFrame:
    """df itself, if it has the contract's columns and types and no breach; else ValueError.  Runs one aggregate."""
    names, wanted = set(df.columns), {f.name: f.dataType for f in CONTRACT}
    if missing := sorted(wanted.keys() - names):
        raise ValueError(f"missing columns: {missing}")
    if extra := sorted(names - wanted.keys()):
        raise ValueError(f"unexpected columns: {extra}")
    if wrong := [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema if f.dataType != wanted[f.name]]:
        raise ValueError(f"wrong types: {wrong}")
    counts = contract_counts(df).first().asDict()
    if broken := {k: v for k, v in counts.items() if k != "n_rows" and v}:
        raise ValueError(f"contract breaches: {broken}")
    return df


def sanitize(df: DataFrame) -> DataFrame:
    """Null prices become 0 on clears and no-ops; other rows without a price go."""
    free = F.upper("action").isin("R", "N")
    return df.withColumn("price", F.when(F.col("price").isNull() & free, F.lit(0)).otherwise(F.col("price"))).where("price IS NOT NULL")


_WORDS = {"add": "A", "cancel": "C", "modify": "M", "clear": "R", "reset": "R", "trade": "T", "fill": "F", "none": "N"}
_SIDE_WORDS = {"bid": "B", "buy": "B", "ask": "A", "sell": "A", "none": "N"}


def _mapped(c: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.upper(c))


def normalize_vendor(df: DataFrame) -> DataFrame:
    """Vendor layout (ts_event, ts_recv, word actions, real prices) to the contract; extra columns go."""
    for old, new in (("ts_event", "event_ts"), ("ts_recv", "ingest_ts")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "ingest_ts" not in df.columns:
        df = df.withColumn("ingest_ts", F.col("event_ts"))
    if "sequence" not in df.columns:  # numbered in time order for each instrument; a single file's order is not kept by the engine
        df = df.withColumn("sequence", F.row_number().over(Window.partitionBy("instrument_id").orderBy("event_ts", "ingest_ts", "order_id")))
    if "flags" not in df.columns:
        df = df.withColumn("flags", F.lit(0))
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.col("instrument_id").cast("string"))
    if isinstance(df.schema["price"].dataType, T.FractionalType):
        df = df.withColumn("price", F.round(F.when(F.isnan("price"), None).otherwise(F.col("price")) / PRICE_SCALE).cast("bigint"))
    return df.withColumns({"action": _mapped(F.col("action"), _WORDS), "side": _mapped(F.col("side"), _SIDE_WORDS)})


def prepare(df: DataFrame) -> DataFrame:
    """Vendor names, contract columns, prices and strict types; unsorted."""
    if {"ts_event", "ts_recv"} & set(df.columns):
        df = normalize_vendor(df)
    return sanitize(df).select(*[F.col(f.name).cast(f.dataType) for f in CONTRACT])


def read(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Events from Parquet, CSV, Arrow IPC (file or stream), or zstd-wrapped Parquet or CSV, by suffix.

    `max_rows` keeps the earliest rows in causal order (a bounded top-k).
    """
    low = path.lower().rstrip("/")
    if low.endswith((".arrow", ".ipc", ".feather")):
        df = read_arrow(spark, path)
    elif low.endswith(".parquet.zst"):
        df = read_arrow(spark, path)
    elif low.endswith((".csv", ".csv.zst", ".csv.gz")):
        df = spark.read.csv(path, header=True, schema=CONTRACT, enforceSchema=False)
    else:
        df = spark.read.parquet(path)
    df = prepare(df)
    return df.orderBy("event_ts", "sequence", "instrument_id").limit(max_rows) if max_rows is not None else df


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams, and zstd-wrapped Parquet, one file a task (read whole by its format)."""
    import pyarrow as pa

    fields = [(f.name, f.dataType) for f in CONTRACT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import pyarrow.parquet as pq
        import zstandard

        target = pa.schema([(n, pa.int16() if isinstance(t, T.ShortType) else pa.string() if isinstance(t, T.StringType) else pa.int64()) for n, t in fields])
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if content[:4] == b"\x28\xb5\x2f\xfd":
                    content = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)).read()
                if content[:4] == b"PAR1":
                    table = pq.read_table(io.BytesIO(content))
                elif content[:6] == b"ARROW1":
                    table = pa.ipc.open_file(io.BytesIO(content)).read_all()
                else:
                    table = pa.ipc.open_stream(io.BytesIO(content)).read_all()
                yield from table.select(target.names).cast(target).to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CONTRACT)


def integrity(df: DataFrame, reset_drop: int = 1000) -> DataFrame:
    """Per instrument in arrival order (ingest_ts, sequence): disorder, repeats, skips and session resets."""
    w = Window.partitionBy("instrument_id").orderBy("event_ts", "sequence")
    rows = df.select("instrument_id", "event_ts", "sequence", F.lag("sequence").over(w).alias("before"))
    step = F.col("sequence") - F.col("before")
    return rows.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(step <= -reset_drop).alias("n_resets"),
        F.count_if((step <= 0) & (step > -reset_drop)).alias("n_non_monotonic"),
        F.count_if(step > 1).alias("n_gaps"),
        F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0)).alias("n_skipped"),
    )


def events_as_mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's `events` in the event contract."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sign = "CASE WHEN (CASE WHEN event_type = 'purchase' THEN event_id % 2 ELSE (user_id div 2) % 2 END) = 0 THEN -1 ELSE 1 END"
    e = e.withColumn("sgn", F.expr(sign)).withColumn("t", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) * 1000"))
    return e.selectExpr(
        "t AS event_ts",
        "t + 1000 AS ingest_ts",
        "event_id + 1 AS sequence",
        "1 + user_id % 2 AS instrument_id",
        "CASE WHEN user_id % 2 = 0 THEN 'C1' ELSE 'C2' END AS symbol",
        "CASE event_type WHEN 'view' THEN 'A' WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'T' ELSE 'N' END AS action",
        "CASE WHEN sgn < 0 THEN 'B' ELSE 'A' END AS side",
        "(80000 + sgn * (1 + CAST(floor(value) AS BIGINT) % 20)) * 250000000 AS price",
        "1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 9 AS size",
        "user_id AS order_id",
        "CAST(0 AS SMALLINT) AS flags",
    )


def lineitem_as_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's `lineitem` as a trade tape in the event contract."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("instrument_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("instrument_id", F.col("l_suppkey") % 4)
    return li.select(
        F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000").alias("event_ts"),
        F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000").alias("ingest_ts"),
        F.row_number().over(order).cast("bigint").alias("sequence"),
        "instrument_id",
        F.concat(F.lit("L"), F.col("instrument_id").cast("string")).alias("symbol"),
        F.lit("T").alias("action"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'B' WHEN 'A' THEN 'A' ELSE 'N' END").alias("side"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("bigint") * 1_000_000_000).alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_orderkey").alias("order_id"),
        F.lit(0).cast("smallint").alias("flags"),
    )
