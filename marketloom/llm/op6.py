"""op6_substring_dedup: repeated 13-word windows removed from every whole document (see substrings.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .substrings import digests_of, remove_repeats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=13, derive=digests_of, schema="kept_sha256 string")
