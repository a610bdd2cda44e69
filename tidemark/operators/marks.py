"""High-water marks, kept as an append-only log.

Each change of a mark is a new row; the current table is the latest row per
pipeline. Nothing is updated in place, so a job that is retried or that dies
half-way leaves no half-written mark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import now_lit, ntz, typed_lit
from tidemark.operators.dedup import keep_first
from tidemark.operators.filters import newer_than
from tidemark.operators.joins import absent
from tidemark.schema import field

MARKS_DDL = (
    "pipeline_id string, watermark_col string, last_value string, "
    "last_value_ts timestamp_ntz, last_value_num decimal(38,10), "
    "last_run_at timestamp_ntz, last_run_status string, rows_loaded decimal(18,0), "
    "updated_at timestamp_ntz"
)
#: The log adds an order, a tombstone and the batch a mark row belongs to.
LOG_DDL = MARKS_DDL + ", seq bigint, removed boolean, load_key string"
_COLUMNS = [part.split()[0] for part in MARKS_DDL.split(", ")]


_NUMBER = r"^\s*[+-]?\d+(\.\d+)?\s*$"


def is_number(text: str) -> bool:
    """Whether a mark given as text is a number; any other text is a date or a time."""
    return re.match(_NUMBER, str(text)) is not None


def _typed(text: Column) -> tuple[Column, Column]:
    """A mark given as text as a time and as a number, one of them NULL."""
    number = text.rlike(_NUMBER)
    return (F.when(~number, text).cast("timestamp_ntz"),
            F.when(number, F.trim(text)).cast("decimal(38,10)"))


@dataclass(frozen=True)
class MarkType:
    """Which typed column of the mark table holds values of a column."""

    dtype: T.DataType

    @property
    def numeric(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def column(self) -> str:
        return "last_value_num" if self.numeric else "last_value_ts"

    def literal(self, value) -> Column:
        return typed_lit(value, self.dtype)


def mark_type(schema: T.StructType, col: str) -> MarkType:
    """Timestamp, date and numeric columns can carry a mark."""
    dtype = field(schema, col).dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType, T.NumericType)):
        return MarkType(dtype)
    raise TypeError(f"{col} is {dtype.simpleString()}, not a timestamp, date or number")


def current_marks(log: DataFrame) -> DataFrame:
    """The mark table: latest log row per pipeline, removed pipelines left out."""
    latest = keep_first(log, [F.col("pipeline_id")], [F.col("seq").desc()])
    return latest.where(~F.coalesce("removed", F.lit(False))).select(*_COLUMNS)


def read_mark(marks: DataFrame, pipeline_id: str, initial: str, column: str = "last_value_ts"):
    """One row, one column ``mark``: the stored value, or the initial one when
    there is no row or the row holds no value."""
    dtype = marks.schema[column].dataType
    return marks.where(F.col("pipeline_id") == pipeline_id).agg(
        F.coalesce(F.max(column), F.lit(initial).cast(dtype)).alias("mark")
    )


def read_marks(configs: DataFrame, marks: DataFrame, numbers: bool = False) -> DataFrame:
    """The same for all pipelines: ``configs`` has ``pipeline_id`` and ``watermark_initial``. ``mark`` is
    a time; with ``numbers`` pipelines with a numeric mark have it as ``mark_num`` instead."""
    known = marks.groupBy("pipeline_id").agg(
        F.max("last_value_ts").alias("value"), F.max("last_value_num").alias("number"))
    time, number = _typed(F.col("watermark_initial"))
    held = F.col("value").isNotNull() | F.col("number").isNotNull()
    out = configs.join(known, "pipeline_id", "left").select(
        "pipeline_id",
        F.when(held, F.col("value")).otherwise(time).alias("mark"),
        F.when(held, F.col("number")).otherwise(number).alias("mark_num"),
    )
    return out if numbers else out.drop("mark_num")


def next_mark(df: DataFrame, col: str, from_) -> DataFrame:
    """One row ``mark``: highest value above the old mark in the *unfiltered*
    source. Reads one column. Taken before the load, which it then bounds, so
    that rows landing in between wait for the next run."""
    return newer_than(df, col, from_).agg(F.max(col).alias("mark"))


def _log_rows(rows: DataFrame, now, status: Column | str, seq: Column | int, **replace) -> DataFrame:
    """Log rows from mark rows with a few columns replaced."""
    values = {
        "last_run_status": F.lit(status) if isinstance(status, str) else status,
        "updated_at": now_lit(now),
        "seq": F.lit(seq).cast("long") if isinstance(seq, int) else seq,
        "removed": F.lit(False),
        "load_key": F.lit(None).cast("string"),
        **replace,
    }
    names = [f.name for f in T.StructType.fromDDL(LOG_DDL).fields]
    types = {f.name: f.dataType for f in T.StructType.fromDDL(LOG_DDL).fields}
    return rows.select(
        *[(values[n] if n in values else F.col(n)).cast(types[n]).alias(n) for n in names]
    )


def seed_marks(marks: DataFrame, configs: DataFrame, now, seq: int = 0) -> DataFrame:
    """Log rows for pipelines that have no mark yet. ``configs`` has
    ``pipeline_id``, ``watermark_col`` and ``watermark_initial``, a date, a time or a number."""
    time, number = _typed(F.col("watermark_initial"))
    new = absent(configs, marks, ["pipeline_id"]).select(
        "pipeline_id", "watermark_col",
        F.col("watermark_initial").alias("last_value"),
        time.alias("last_value_ts"), number.alias("last_value_num"),
        now_lit(now).alias("last_run_at"),
        F.lit(0).alias("rows_loaded"),
    )
    return _log_rows(new, now, "INIT", seq)


def advance_marks(marks: DataFrame, loads: DataFrame, now, seq: int = 0) -> DataFrame:
    """Log rows after successful loads. ``loads`` has ``pipeline_id``,
    ``watermark_col``, ``new_ts``, ``new_num``, ``rows_loaded`` and optionally
    ``load_key``. A mark never moves back: a load that found nothing keeps it."""
    old = marks.select(
        "pipeline_id", F.col("last_value_ts").alias("_ts"), F.col("last_value_num").alias("_num")
    )
    joined = loads.join(old, "pipeline_id", "left")
    ts = F.greatest("new_ts", "_ts")
    num = F.greatest(F.col("new_num").cast("decimal(38,10)"), "_num")
    rows = joined.select(
        "pipeline_id", "watermark_col",
        F.coalesce(ts.cast("string"), num.cast("string")).alias("last_value"),
        ts.alias("last_value_ts"), num.alias("last_value_num"),
        now_lit(now).alias("last_run_at"), "rows_loaded",
        (F.col("load_key") if "load_key" in loads.columns else F.lit(None).cast("string")).alias("_k"),
    )
    return _log_rows(rows, now, "SUCCESS", seq, load_key=F.col("_k"))


def advance_mark(marks: DataFrame, pipeline_id: str, watermark_col: str, value, rows: int, now,
                 seq: int = 0, numeric: bool = False, load_key: str | None = None) -> DataFrame:
    """One pipeline's log row after a load."""
    spark = marks.sparkSession
    number = F.lit(str(value)).cast("decimal(38,10)") if numeric and value is not None else F.lit(None)
    time = ntz(value) if not numeric and value is not None else F.lit(None)
    loads = spark.range(0, 1, 1, 1).select(
        F.lit(pipeline_id).alias("pipeline_id"), F.lit(watermark_col).alias("watermark_col"),
        time.cast("timestamp_ntz").alias("new_ts"), number.cast("decimal(38,10)").alias("new_num"),
        F.lit(rows).alias("rows_loaded"), F.lit(load_key).cast("string").alias("load_key"),
    )
    return advance_marks(marks, loads, now, seq)


def reset_mark(marks: DataFrame, which: Column | str, to: str, now, seq: int = 0) -> DataFrame:
    """Log rows that set a mark to a backfill date, time or number, status RESET."""
    hit = marks.where(F.col("pipeline_id") == which if isinstance(which, str) else which)
    time, number = _typed(F.lit(to))
    return _log_rows(hit, now, "RESET", seq, last_value=F.lit(to), last_value_ts=time, last_value_num=number)


def fail_mark(marks: DataFrame, which: Column | str, now, seq: int = 0) -> DataFrame:
    """Log rows after a failed run: only the status changes."""
    hit = marks.where(F.col("pipeline_id") == which if isinstance(which, str) else which)
    return _log_rows(hit, now, "FAILED", seq)


def drop_mark(marks: DataFrame, which: Column | str, now, seq: int = 0) -> DataFrame:
    """Tombstones for decommissioned pipelines."""
    hit = marks.where(F.col("pipeline_id") == which if isinstance(which, str) else which)
    return _log_rows(hit, now, F.col("last_run_status"), seq, removed=F.lit(True))
