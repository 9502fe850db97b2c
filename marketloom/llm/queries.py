"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that has query(spark, sf_dir) and, where SQL can express it, ORACLE.
MODULES = {
    "op1_mixing": "op1",
    "op2_embedding_dedup": "op2",
    "op3_url_filter": "op3",
    "op4_byte_bpe": "op4",
    "op5_minhash": "op5",
    "op6_substring_dedup": "op6",
    "op7_lm_score": "op7",
    "op8_media_columns": "op8",
    "op9_language_id": "op9",
    "op10_license_scan": "op10",
}


def _lazy(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return importlib.import_module(f"{__package__}.{module}").query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
