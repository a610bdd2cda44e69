"""Plain sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import absent
from tidemark.schema import plain_schema


def read(spark: SparkSession, ref: str) -> DataFrame:
    """A table by name, or Parquet files by path. Sources are only ever read."""
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """An inline relation. For fixtures and configuration, not for data."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(list(rows), plain_schema(shape))


def with_variant(df: DataFrame, col: str, strict: bool = True) -> DataFrame:
    """JSON text to a semi-structured column. Strict parsing fails the load on
    bad text, the other form makes it NULL."""
    parse = F.parse_json if strict else F.try_parse_json
    return df.withColumn(col, parse(F.col(col)))


def append(df: DataFrame, ref: str) -> None:
    """Append to a table by name, where Spark enforces declared widths, or to
    Parquet files by path. Tables take the columns in their own order."""
    if "/" in ref:
        df.write.mode("append").parquet(ref)
    else:
        df.write.insertInto(ref)


def overwrite(df: DataFrame, ref: str) -> None:
    """Replace all rows. A table that is also the source is refused by Spark."""
    if "/" in ref:
        df.write.mode("overwrite").parquet(ref)
    else:
        df.write.insertInto(ref, overwrite=True)


def append_absent(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Submit rows once: keys the table already holds are skipped."""
    target = new.sparkSession.read.schema(new.schema).parquet(path)
    append(absent(new, target, keys), path)
