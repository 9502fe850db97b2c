"""op5_minhash: classes of near-duplicate documents, exact at a Jaccard similarity of 0.8 (see minhash.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .minhash import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
