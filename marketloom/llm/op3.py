"""op3_url_filter: every page's URL judged by rules and trees (see urls.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .urls import judge

#: Fixed values of the query: rule and verdict.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
