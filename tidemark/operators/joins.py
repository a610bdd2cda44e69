"""Joins, ordering and small set operations.

No join carries a broadcast hint: control tables are small in most
installations and Spark broadcasts them after it has checked their size; where
they are not, the same plan sorts and merges, and splits hot keys at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.dedup import order_items, ordering


#: Rows up to which a code table is written into the expression.
LITERAL_CODES = 200


def join_configs(df: DataFrame, configs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on the pipeline id, adding only the named config columns."""
    return df.join(configs.select("pipeline_id", *cols), "pipeline_id", "inner")


def absent(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the target does not hold, one per key.

    Of several new rows with one key the one with the least hash stays, whatever the partitioning.
    A key that is NULL in part equals no other, so such rows are all absent and all stay, as in SQL.
    """
    hashed = [f.name for f in new.schema.fields if "map<" not in f.dataType.simpleString()]
    first = W.partitionBy(*keys).orderBy(F.xxhash64(*hashed))
    number = "_n" + "_" * max(len(c) for c in new.columns)  # longer than any column's name
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    once = new.where(complete).withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number)
    return once.join(target.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(new.where(~complete))


def insert_absent(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the absent rows added: submitting twice changes nothing."""
    return target.unionByName(absent(new, target, keys))


def missing_columns(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """References (``table_name``, ``column_name``, …) without such a column."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_t", F.upper("table_name")).withColumn("_c", F.upper("column_name"))

    known = keyed(columns).select("_t", "_c")
    return keyed(refs).join(known, ["_t", "_c"], "left_anti").drop("_t", "_c")


def decode_by_table(df: DataFrame, col: str, codes: DataFrame, code: str, label: str,
                    out: str) -> DataFrame:
    """Decode through a code table with unique codes; unmapped gives NULL.

    A table of at most ``LITERAL_CODES`` rows, counted by fetching no more than one row beyond, becomes a map
    in the expression, so that ``df`` is neither joined nor shuffled. A larger one is joined.
    """
    same = codes.schema[code].dataType == df.schema[col].dataType
    few = codes.select(code, label).where(F.col(code).isNotNull()).limit(LITERAL_CODES + 1).collect() if same else None
    if few and len(few) <= LITERAL_CODES and len({r[0] for r in few}) == len(few):
        pairs = [F.lit(v).cast(codes.schema[c].dataType) for r in few for c, v in ((code, r[0]), (label, r[1]))]
        return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(col)))
    lookup = codes.select(F.col(code).alias("_code"), F.col(label).alias(out))
    return df.join(lookup, F.col(col) == F.col("_code"), "left").drop("_code")


def order(df: DataFrame, spec: str) -> DataFrame:
    """``order(df, "hours_behind DESC, pipeline_id")``; NULLs last by default."""
    return df.orderBy(*[ordering(F.expr(e), d, n) for e, d, n in order_items(spec)])


def top_k(df: DataFrame, spec: str, k: int) -> DataFrame:
    """First ``k`` rows of an order: each task keeps k rows, no global sort."""
    return order(df, spec).limit(k)
