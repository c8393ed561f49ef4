"""Materialised intermediate tables.

A block scan reads its input twice, so stacking several scans multiplies the plan.  Where
an intermediate result feeds many branches it is written once, as Parquet, to a shared
folder (see ``shared_dir``); readers survive lost executors and still prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Marks the name of a bucketed table among the paths to remove.
_TABLE = "table "
#: Wide rows (a chunk of samples, a file) that Spark's Parquet reader may decode at once; otherwise 4,096, whatever their width.
WIDE_ROWS = 64
_local_dirs: dict[str, str] = {}
_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for settled tables: the context's checkpoint folder, else the configured one, else the warehouse.

    These are shared by driver and executors.  As for Spark's own checkpoints, a folder set on
    the context overrides the configured one; a path without a scheme belongs to the cluster's
    default file system.  Only a session whose executor is the driver (``local``, ``local[n]``)
    may use a temporary folder of its own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get(_KEY, None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="refrain-")
    return _local_dirs[app]


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/refrain/{uuid.uuid4().hex}"
    for paths in _open_scopes:
        paths.append(path)
    return path


def settle(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    With ``wide``, for rows of tens of kilobytes, row groups hold ``WIDE_ROWS`` rows, as a
    batch of Spark's reader never reaches beyond its row group.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    (df.write.option("parquet.block.row.count.limit", WIDE_ROWS) if wide else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``settle``, bucketed and sorted by ``keys``: joins on exactly these keys don't shuffle the table again."""
    spark = df.sparkSession
    name = f"refrain_{uuid.uuid4().hex}"
    for paths in _open_scopes:
        paths.append(f"{_TABLE}{name}")
    path = _new_path(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out as the buckets are, so that each bucket is one file.
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables settled inside the block when it ends; results that read them must be written before."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield
    finally:
        _open_scopes.remove(paths)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            if path.startswith(_TABLE):
                spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix(_TABLE)}")
                continue
            at = hadoop(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
