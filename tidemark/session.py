"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every tidemark job expects. Zone-free timestamps are used
#: throughout; UTC keeps the few zoned built-ins (``date_format``) exact.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_made: list[str] = []
#: The folder each result of ``stored`` is read from.
_folder: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the cluster's shared checkpoint folder, ``spark.checkpoint.dir`` of the session.

    Where that is unset, it lies in the warehouse, which driver and executors share as well; never in a
    temporary folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    path = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor
    repeats no work before it. The files stay until ``release_scratch``."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _folder[back] = path
    return back


def discard(*results: DataFrame) -> None:
    """Delete the files of ``results``, each as ``stored`` returned it, once nothing will read them any more."""
    for df in results:
        delete(df.sparkSession, _folder.pop(df))


#: Settings of jobs that end in stored results: no shuffle is read after its job, and batches of long texts for
#: Python are bounded by their bytes, not by 10,000 rows alone.
LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs run with ``LEAN``; the session's own values come back after it."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    try:
        for key, value in LEAN.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch folders that this driver made (from the ``since``-th on); returns how many.
    Results that were read from them are gone then."""
    mine = _made[since:]
    for path in mine:
        delete(spark, path)
    del _made[since:]
    return len(mine)


def scratch_made() -> int:
    """How many scratch folders there are: the ``since`` of a later release."""
    return len(_made)
