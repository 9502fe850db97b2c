"""op2_embedding_dedup: near-duplicate vectors of equal labels at a cosine of 0.93 (see vectors.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .vectors import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)
