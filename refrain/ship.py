"""Send the package to the executors, for sessions whose workers don't find it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of all workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="refrain-ship-")  # on the driver; Spark serves the file to the executors
    path = os.path.join(folder, "refrain.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("refrain", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
