"""op8_media_columns: every whole document stored in an ISO media file and read back (see media.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .media import describe


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
