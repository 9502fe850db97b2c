"""op4_byte_bpe: every whole document encoded and decoded (see bpe.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import digests, encode


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(
        docs,
        ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        derive=digests,
        schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        keep=["doc_id"],
    )
