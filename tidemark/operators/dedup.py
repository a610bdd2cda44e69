"""Latest row per key.

The window keeps ``row_number() = 1``, which Spark turns into a group limit on
both sides of the shuffle: every map task forwards at most one row per key, so
a key that holds a third of the table costs one row per task, not a full sort
of the key in a single task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = re.compile(
    r"^(?P<what>.+?)(?:\s+(?P<dir>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?$", re.I | re.S
)


def _top_level_parts(text: str) -> list[str]:
    """Parts between the commas that stand outside brackets and quotes."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c in "([") - (c in ")]")
        if c == "," and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def order_items(spec: str | None) -> list[tuple[str, bool, bool]]:
    """``"UPDATED_AT DESC, ID"`` to (expression, descending, nulls last).

    NULLs go last in both directions unless the text says otherwise: a row
    without a change time never wins over one that has it.
    """
    items = []
    for part in _top_level_parts(spec or ""):
        if part.strip():
            m = _ITEM.match(part.strip())
            items.append(
                (
                    m["what"],
                    (m["dir"] or "asc").lower() == "desc",
                    (m["nulls"] or "last").lower() == "last",
                )
            )
    return items


def ordering(c: Column, descending: bool, nulls_last: bool) -> Column:
    if descending:
        return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if nulls_last else c.asc_nulls_first()


def tie_break(schema: T.StructType, skip: Sequence[str] = ()) -> list[Column]:
    """Remaining columns in order, so that equal change times have one winner.
    Columns that cannot be ordered take part as their JSON text."""
    out = []
    for f in schema.fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.VariantType, T.MapType)):
            c = F.to_json(c)
        out.append(c.asc_nulls_last())
    return out


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def dedup(df: DataFrame, keys: Sequence[str], order_by: str | None) -> DataFrame:
    """First row per key by ``order_by``; ties fall to the remaining columns."""
    order = [ordering(F.expr(e), d, n) for e, d, n in order_items(order_by)]
    return keep_first(df, [F.col(k) for k in keys], order + tie_break(df.schema, list(keys)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of versions."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("versions"))
        .where(F.col("versions") > 1)
    )
