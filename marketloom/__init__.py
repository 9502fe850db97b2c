"""Order-level market event analytics on Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch on its way to a Python worker, where the session keeps Spark's own default of 64 MB.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds batches by bytes.

    On a cluster without a shared installation, install the package on the
    workers or pass it with --py-files; this path then does no harm.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    name, default, wanted = BATCH
    if spark.conf.get(name, f"{default}b") == f"{default}b":
        spark.conf.set(name, str(wanted))  # long texts: a worker and its task hold a few batches each
    return spark
