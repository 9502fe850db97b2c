"""op9_language_id: the language of every whole document (see langid.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import identify, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
