"""What a target consists of: an append-only log of its parts, beside its data.

Data files are written into folders of their own first, which no reader sees.
One entry per part then makes them the table's, all entries of a change in one
file: readers see the change whole or not at all, and a write that dies
half-way leaves the old table. A later entry for the same part replaces the
earlier one. The log is read with a window over its own rows; its size grows
with the number of changes, never with the data.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import keep_first
from tidemark.session import delete

MANIFEST_DDL = (
    "seq bigint, key string, folder string, live boolean, row_count bigint, "
    "pipeline_id string, mark_from string, mark_to string, detail string"
)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files with a declared schema; no rows before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_manifest"
        self._last: int | None = None

    def log(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, T.StructType.fromDDL(MANIFEST_DDL))

    def live(self) -> DataFrame:
        """The current entry of each part that is not dropped."""
        latest = keep_first(self.log(), [F.col("key")], [F.col("seq").desc(), F.col("folder")])
        return latest.where("live").drop("live")

    def _next(self) -> int:
        """Above every entry, and the clock in microseconds where that is higher. The log is asked once;
        a manifest has one writer at a time."""
        if self._last is None:
            self._last = self.log().agg(F.max("seq")).first()[0] or 0
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return self._last

    def commit(self, entries: list[dict]) -> None:
        """Make parts (key, folder, …) current, in one file."""
        self.commit_rows(self.spark.createDataFrame(
            [tuple(e.get(c) for c in ("key", "folder", "row_count", "pipeline_id", "mark_from", "mark_to", "detail"))
             for e in entries],
            "key string, folder string, row_count bigint, pipeline_id string, mark_from string, "
            "mark_to string, detail string"), True)

    def commit_rows(self, entries: DataFrame, live: bool) -> None:
        """The same for entries as rows; columns that are missing are NULL."""
        given = {"seq": F.lit(self._next()), "live": F.lit(live)}
        fields = T.StructType.fromDDL(MANIFEST_DDL).fields
        entries.select(*[
            (given.get(f.name) if f.name in given else F.col(f.name) if f.name in entries.columns else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in fields
        ]).coalesce(1).write.mode("append").parquet(self.path)

    def compact(self) -> None:
        """Nothing but the current entries, as one more file that stands above all others; entries that it
        repeats win over nothing else, so a reader at any moment sees the same table."""
        self.commit_rows(self.live(), True)

    def unused(self, before: int) -> list[str]:
        """Folders named by entries older than ``before`` (microseconds) that no current entry names."""
        used = self.live().select("folder")
        old = self.log().where((F.col("seq") < before) & F.col("folder").isNotNull()).select("folder").distinct()
        return [r[0] for r in old.join(used, "folder", "left_anti").collect()]


def new_folder() -> str:
    """A name that no id, mark or character can break."""
    return uuid.uuid4().hex


def vacuum(spark: SparkSession, manifest: Manifest, root: str, prefix: str, keep_hours: float) -> int:
    """Delete the files of replaced and dropped parts, except those of the last hours, which readers
    that started earlier may still use. Returns how many folders went."""
    gone = manifest.unused(int((time.time() - keep_hours * 3600) * 1e6) if keep_hours else 1 << 62)
    for folder in gone:
        delete(spark, f"{root}/{prefix}={folder}")
    return len(gone)
