"""Aggregates: all of them combine on the map side, so hot groups are cheap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per dataset."""
    parts = [
        row_count(df).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in frames.items()
    ]
    return union_all(*parts)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def max_of(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.max(col).alias("max_value"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))


def having(df: DataFrame, condition: Column | str) -> DataFrame:
    """Filter on aggregated columns."""
    return df.where(condition)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per column with the total, all columns in one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    return counts.unpivot(["total_rows"], list(cols), "column_name", "null_count").select(
        "column_name", "null_count", "total_rows"
    )
