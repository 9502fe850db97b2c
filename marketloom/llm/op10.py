"""op10_license_scan: licence phrases and rule detections of every whole document (see licenses.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = F.array().cast("array<string>")
    found = F.transform(F.col("scan.detections"), lambda d: d["label"])
    base = F.coalesce(F.col("scan.base_labels"), empty)
    best = F.array_max(F.transform(F.col("scan.detections"), lambda d: d["percent"]))
    return scan(docs, ["doc_id"]).select(
        "doc_id",
        "n_words",
        F.coalesce("scan.n_base", F.lit(0).cast("bigint")).alias("n_base"),
        F.col("scan.first_word").alias("first_word"),
        F.col("scan.last_word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(found, empty))), ",").alias("labels"),
        (F.coalesce(F.greatest(best, F.when(F.size(base) > 0, F.lit(50))), F.lit(0)) / F.lit(100.0)).alias("score"),
    )
