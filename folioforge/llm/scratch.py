"""Lineage cuts: tables written to the folder that all executors share.

``written`` stores an intermediate result as Parquet below ``spark.checkpoint.dir`` and reads it back, so
that a lost executor costs one task instead of a chain of stages, and so that later steps plan with real
sizes.  The setting is read from the session; only where it is unset (tests, a local shell) a folder in the
warehouse is used.  A lazy result reads the tables of its steps, so they stay; ``owned`` names the tables of a
caller who stores his results, and ``release`` deletes the tables of that caller and of nobody else.
"""

from __future__ import annotations

import contextlib
import gc
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)
_TABLES: dict[str, list[str]] = defaultdict(list)


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """What ``written`` stores in here can be released by this name."""
    before = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(before)


def written(frame: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Store ``frame`` in the shared folder and read it back; the columns keep their types.

    ``sweep``: let go of the shuffle files of finished steps at once.  Spark deletes them when the driver collects its
    garbage, which it may not do for long while executors' disks fill.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if owner := _OWNER.get():
        _TABLES[owner].append(path)
    for _ in range(2 * sweep):  # the first pass finds the plans, the second one the shuffles that only they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)
    return spark.read.schema(frame.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store that Spark can write to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, owner: str) -> None:
    """Delete what was stored under ``owner`` so far."""
    for path in _TABLES.pop(owner, []):
        delete(spark, path)


def numbered(frame: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1 and so on, which clash with no other."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))
