"""op7_lm_score: base and attention-model scores of every whole document (see lm.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import read_ranks
from .lm import score_documents


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks)
