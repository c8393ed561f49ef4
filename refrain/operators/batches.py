"""Bounded Arrow batches for stages that see wide rows: whole texts, files or chunks of samples."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_ROWS = 2000
MOST_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batch limits to 2,000 rows and 16 MB; smaller limits of the session stay."""
    for key, most in ((_ROWS, MOST_ROWS), (_BYTES, MOST_BYTES)):
        now = spark.conf.get(key, None)
        value = int(now) if now is not None and now.lstrip("-").isdigit() else -1
        if not 0 < value <= most:
            spark.conf.set(key, str(most))
