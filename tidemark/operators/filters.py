"""Row filters. All of them are plain predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import RowRule
from tidemark.functions.scalars import ntz, typed_lit
from tidemark.schema import field


def source_filter(df: DataFrame, predicate: str | None) -> DataFrame:
    """Permanent filter of a pipeline, a SQL predicate over ``src``. Three-valued
    logic applies: a NULL never passes ``NOT IN`` or ``!=``."""
    return df.where(F.expr(predicate)) if predicate and predicate.strip() else df


def newer_than(df: DataFrame, col: str, value, upto=None) -> DataFrame:
    """Strictly above the mark, and not above ``upto`` when given. NULL marks
    in the data never pass."""
    dtype = field(df.schema, col).dataType
    out = df.where(F.col(col).isNotNull() & (F.col(col) > typed_lit(value, dtype)))
    return out if upto is None else out.where(F.col(col) <= typed_lit(upto, dtype))


def row_rules(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    for rule in rules:
        df = df.where(rule.keep())
    return df


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def since(df: DataFrame, col: str, now: str, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before a fixed clock."""
    return df.where(F.col(col) >= ntz(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def delete_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """What is left after DELETE: rows where the condition is NULL stay."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(cond, F.lit(False)))
