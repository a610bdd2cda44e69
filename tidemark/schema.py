"""Declared table schemas: DDL, column widths and the bulk ``columns`` table.

A target schema is declared as DDL and keeps its column order, which is the
output order of every load. Widths come from ``varchar(n)`` in the DDL or, for
frames read from a catalog table, from the field metadata Spark attaches.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_WIDTH_METADATA = "__CHAR_VARCHAR_TYPE_STRING"


def ddl(text: str) -> T.StructType:
    """``ddl("id varchar(64) not null, amount decimal(18,2)")``."""
    return T.StructType.fromDDL(text)


def storage_type(dtype: T.DataType) -> T.DataType:
    """The DataFrame type of a declared type: varchar(n) and char(n) are strings."""
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return T.StringType()
    return dtype


def declared_width(field: T.StructField) -> int | None:
    """Declared width of a string column, ``None`` when there is no limit."""
    if isinstance(field.dataType, (T.VarcharType, T.CharType)):
        return field.dataType.length
    found = re.search(r"\((\d+)\)", str(field.metadata.get(_WIDTH_METADATA, "")))
    return int(found.group(1)) if found else None


def widths(schema: T.StructType) -> dict[str, int]:
    return {f.name: w for f in schema.fields if (w := declared_width(f)) is not None}


def required(schema: T.StructType) -> list[str]:
    """Columns declared NOT NULL."""
    return [f.name for f in schema.fields if not f.nullable]


def plain_schema(schema: T.StructType) -> T.StructType:
    """Same columns with storage types, usable for reads and empty frames."""
    return T.StructType(
        [T.StructField(f.name, storage_type(f.dataType), True, f.metadata) for f in schema.fields]
    )


def field(schema: T.StructType, name: str) -> T.StructField | None:
    """Case-insensitive lookup, the way Spark resolves column names."""
    return next((f for f in schema.fields if f.name.lower() == name.lower()), None)


COLUMNS_DDL = (
    "table_name string, column_name string, data_type string, width int, "
    "ordinal int, nullable boolean, has_default boolean"
)


def columns_table(
    spark: SparkSession,
    schemas: Mapping[str, T.StructType],
    defaults: Mapping[str, set[str]] | None = None,
) -> DataFrame:
    """One row per declared column, the input of the bulk validation job."""
    defaults = defaults or {}
    rows = [
        (
            table,
            f.name,
            storage_type(f.dataType).simpleString(),
            declared_width(f),
            i,
            f.nullable,
            f.name.lower() in {d.lower() for d in defaults.get(table, set())},
        )
        for table, schema in schemas.items()
        for i, f in enumerate(schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, COLUMNS_DDL)
