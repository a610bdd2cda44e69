"""Scalar column builders shared by rules, views and control tables.

Everything here is a composition of built-in Spark functions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value: str | dt.datetime | dt.date) -> Column:
    """A zone-free timestamp literal. ``F.lit(datetime)`` would be zoned, which
    makes the comparison cast every row and hides the filter from Parquet."""
    return F.lit(str(value)).cast("timestamp_ntz")


def typed_lit(value, dtype: T.DataType) -> Column:
    """A literal of the column's own type, so that the filter reaches the scan."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, Decimal):
        return F.lit(str(value)).cast("decimal(38,10)").cast(dtype)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return F.lit(str(value)).cast(dtype)
    return F.lit(value).cast(dtype)


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp or date."""
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01"), column(c).cast("timestamp_ntz"))


def boundary_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of unit boundaries crossed from start to end.

    10:59 to 11:01 is one hour boundary although only two minutes pass.
    ``timestampdiff`` counts whole units instead and would give zero.
    """
    size = F.lit(_MICROS[unit.lower()])

    def ticks(c: Column | str) -> Column:
        micros = epoch_micros(c)
        return ((micros - F.pmod(micros, size)) / size).cast("long")

    return ticks(end) - ticks(start)


def shift(c: Column | str, amount: int, unit: str) -> Column:
    """Add a signed number of units: ``shift("ts", -24, "hour")``."""
    return F.timestamp_add(unit.upper(), F.lit(amount), column(c))


def from_epoch_millis(c: Column | str) -> Column:
    """Epoch milliseconds to a zone-free timestamp, milliseconds kept."""
    return F.timestamp_add("MILLISECOND", column(c).cast("long"), ntz("1970-01-01"))


def json_path(c: Column | str, path: str, dtype: str = "string", is_variant: bool = False) -> Column:
    """``a.b`` below a JSON document, cast at the end; NULL when absent or invalid."""
    document = column(c) if is_variant else F.try_parse_json(column(c))
    return F.try_variant_get(document, path if path.startswith("$") else f"$.{path}", dtype)


def json_array(c: Column | str) -> Column:
    return F.from_json(column(c), T.ArrayType(T.StringType()))


def json_array_size(c: Column | str) -> Column:
    """Elements of a JSON array held as text; NULL when it is not an array."""
    return F.array_size(json_array(c))


def json_array_get(c: Column | str, index: int) -> Column:
    """Element at a zero-based index; NULL outside the array."""
    return F.get(json_array(c), F.lit(index))


def slug(c: Column | str, max_len: int = 24) -> Column:
    """Upper case, everything but letters and digits to ``_``, cut to ``max_len``."""
    return F.substring(F.regexp_replace(F.upper(column(c)), r"[^\p{L}\p{N}]", "_"), 1, max_len)


def pipeline_id(name: Column | str, stamp: Column, prefix: str = "ETL") -> Column:
    """``<prefix>_<slug>_<yyyyMMddHHmmss>``."""
    return F.concat_ws(
        "_", F.lit(prefix), slug(name), F.date_format(stamp, "yyyyMMddHHmmss")
    )


def task_name(c: Column | str, max_len: int = 50) -> Column:
    """``TASK_`` and the upper-case name, blanks and hyphens to ``_``."""
    return F.substring(
        F.concat(F.lit("TASK_"), F.translate(F.upper(column(c)), " -", "__")), 1, max_len
    )


def last_segment(c: Column | str) -> Column:
    """Last dotted part of a qualified name."""
    return F.substring_index(column(c), ".", -1)


def prefix(c: Column | str, n: int = 16) -> Column:
    """First ``n`` characters of the text form."""
    return F.substring(column(c).cast("string"), 1, n)


def strategy_label(c: Column | str) -> Column:
    """Short label of a load strategy; unknown names stay, NULL shows a dash."""
    c = column(c)
    return (
        F.when(c == "FULL_LOAD", "Full")
        .when(c == "INCREMENTAL", "Incr")
        .when(c == "CDC", "CDC")
        .otherwise(F.coalesce(c, F.lit("—")))
    )


def concat(*cols: Column | str) -> Column:
    """``a || b``: NULL when any part is NULL."""
    return F.concat(*[column(c) for c in cols])


def now_lit(now: str | dt.datetime | None) -> Column:
    """The injected clock of a run, or the current time."""
    return F.current_timestamp().cast("timestamp_ntz") if now is None else ntz(now)


def user_lit(user: str | None) -> Column:
    return F.current_user() if user is None else F.lit(user)
