"""Cutting the lineage of a frame that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the shared folder of spark.checkpoint.dir, or cached where none is set."""
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    return df.checkpoint() if folder.isDefined() else df.persist()
