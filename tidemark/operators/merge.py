"""Change-data merge: match changes with a target by key, then delete, update
or insert.

The target is always the streamed side of a left join (outer, semi or anti)
against changes with unique keys. A small change set is broadcast once Spark
has checked its size, and then the target is not shuffled at all; a large one
leads to a sort-merge join whose hot partitions Spark may split, because the
target side is never buffered. A full outer join would allow neither.

Keys compare with ``=``: a row with a NULL in its key never matches, so it
stays in the target or is inserted. Such rows all hash alike, so the joins add
a salt for them that spreads them over the tasks without changing any match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import duplicate_keys, order_items

#: Hidden columns travel with the changes and are dropped at the write.
DELETED = "_deleted"
ORDER = "_order"
CHANGE = "_change"
MATCHED = "_matched"
_SALT = "_null_salt"


class DuplicateChangeKeys(ValueError):
    """The changes hold several rows for one key; the outcome would be undefined."""


def null_key_salt(df: DataFrame, keys: Sequence[str]) -> Column:
    """0 for complete keys; for the rest a value derived from the whole row, so
    that it is the same when a task is repeated."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    hashable = [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("variant", "map")]
    return F.when(any_null, F.xxhash64(*hashable)).otherwise(F.lit(0).cast("long"))


def require_unique(changes: DataFrame, keys: Sequence[str], show: int = 20) -> None:
    """Runs one job. Raises with a few of the offending keys."""
    complete = changes.dropna(subset=list(keys))
    found = duplicate_keys(complete, keys).limit(show).collect()
    if found:
        raise DuplicateChangeKeys(f"several changes per key, for example {found}")


def _salted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(_SALT, null_key_salt(df, keys))


def _deleted(changes: DataFrame) -> Column:
    if DELETED not in changes.columns:
        return F.lit(False)
    return F.coalesce(F.col(DELETED), F.lit(False))


def change_order(spec: str | None) -> Column:
    """The change order of a row, as one comparable value: a struct with a field per item of an ORDER BY
    text, named by its direction (``d`` descending, ``a`` ascending; ``n`` follows where NULLs come first)."""
    items = order_items(spec)
    if not items:
        return F.lit(None).cast("timestamp_ntz")
    return F.struct(*[F.expr(e).alias(f"{'d' if down else 'a'}{'' if last else 'n'}{i}") for i, (e, down, last) in enumerate(items)])


def _before(a: Column, b: Column, ascending: bool, nulls_last: bool = True) -> tuple[Column, Column]:
    """(tied, first): whether ``a`` equals ``b``, and whether it comes before it."""
    tied = a.eqNullSafe(b)
    first = F.coalesce((a < b) if ascending else (a > b), F.lit(False))
    beside_null = a.isNotNull() & b.isNull() if nulls_last else a.isNull() & b.isNotNull()
    return tied, ~tied & (first | beside_null)


def newer(new: Column, old: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(tied, newer) of two change orders of one type; a single value counts as descending."""
    fields = [(new[f.name], old[f.name], f.name[0] == "a", f.name[1] != "n") for f in dtype.fields] \
        if isinstance(dtype, T.StructType) else [(new, old, False, True)]
    tied, later = F.lit(True), F.lit(False)
    for a, b, ascending, nulls_last in reversed(fields):
        same, first = _before(a, b, ascending, nulls_last)
        tied, later = same & tied, first | (same & later)
    return tied, later


def earlier(new: Column, old: Column, fields: Sequence[T.StructField]) -> Column:
    """Whether a row comes before another in the order of its columns, ascending, NULLs last."""
    out = F.lit(False)
    for f in reversed(fields):
        a, b = new[f.name], old[f.name]
        if isinstance(f.dataType, (T.VariantType, T.MapType)):
            a, b = F.to_json(a), F.to_json(b)
        same, first = _before(a, b, True)
        out = first | (same & out)
    return out


def match(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows with their change, if any, as the struct ``_change``;
    ``_matched`` tells whether there is one."""
    right = _salted(changes, keys).select(
        *keys, _SALT, F.struct(*changes.columns).alias(CHANGE), F.lit(True).alias(MATCHED)
    )
    joined = _salted(target, keys).join(right, [*keys, _SALT], "left")
    found = F.coalesce(MATCHED, F.lit(False)).alias(MATCHED)
    return joined.select(*target.columns, CHANGE, found)


def not_matched(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes without a target row. The target's keys are first reduced to
    those that do have a change, so its size does not matter for the rest."""
    wanted = _salted(changes, keys).select(*keys, _SALT)
    held = _salted(target, keys).select(*keys, _SALT).join(wanted, [*keys, _SALT], "left_semi")
    return _salted(changes, keys).join(held.distinct(), [*keys, _SALT], "left_anti").select(
        *changes.columns
    )


def _compared(target: DataFrame, keys: Sequence[str], audit: Sequence[str]) -> list[str]:
    quiet = {a.lower() for a in audit} | {k.lower() for k in keys}
    return [c for c in target.columns if c.lower() not in quiet and not c.startswith("_")]


def _same(names: Sequence[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{CHANGE}.{n}"))
    return same


AUDIT = ("loaded_at",)


def _target_op(target: DataFrame, changes: DataFrame, keys: Sequence[str], skip_unchanged: bool,
               audit: Sequence[str]) -> Column:
    """What happens to a target row: the delete branch comes first."""
    gone = F.lit(False)
    if DELETED in changes.columns:
        gone = F.coalesce(F.col(f"{CHANGE}.{DELETED}"), F.lit(False))
    op = F.when(~F.col(MATCHED), "unchanged").when(gone, "delete")
    if skip_unchanged:
        op = op.when(_same(_compared(target, keys, audit)), "unchanged")
    return op.otherwise("update")


def merge_cdc(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    insert_deleted: bool = False,
    skip_unchanged: bool = False,
    audit: Sequence[str] = AUDIT,
) -> DataFrame:
    """The target after the merge, in the target's columns.

    A deleted change for an absent key does nothing; ``insert_deleted`` inserts
    it instead, the literal reading of a merge whose insert branch has no
    guard. ``skip_unchanged`` leaves matched rows alone when nothing but an
    audit column differs.
    """
    columns = target.columns
    if not skip_unchanged:
        merged = anti_merge(target, changes, keys)
        if insert_deleted and DELETED in changes.columns:
            dead = not_matched(target, changes.where(_deleted(changes)), keys)
            merged = merged.unionByName(dead.select(*columns))
        return merged
    op = _target_op(target, changes, keys, skip_unchanged, audit)
    held = match(target, changes, keys).withColumn("_op", op).where(F.col("_op") != "delete")
    kept = held.select(*[
        F.when(F.col("_op") == "update", F.col(f"{CHANGE}.{c}")).otherwise(F.col(c)).alias(c)
        for c in columns
    ])
    new = not_matched(target, changes, keys)
    if not insert_deleted:
        new = new.where(~_deleted(changes))
    return kept.unionByName(new.select(*columns))


def anti_merge(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], keep_deleted: bool = False
) -> DataFrame:
    """Untouched target rows are those without a change; every other row comes
    whole from the changes. Only the keys of the changes enter the join.
    ``keep_deleted`` keeps deleted changes as rows, for stores with tombstones.
    """
    changed = _salted(changes, keys).select(*keys, _SALT)
    untouched = _salted(target, keys).join(changed, [*keys, _SALT], "left_anti")
    live = changes if keep_deleted else changes.where(~_deleted(changes))
    return untouched.select(*target.columns).unionByName(live.select(*target.columns))


def merge_summary(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    insert_deleted: bool = False,
    skip_unchanged: bool = False,
    audit: Sequence[str] = AUDIT,
) -> DataFrame:
    """Rows per operation: insert, update, delete, unchanged, and ignored for
    deletes of absent keys. Without ``skip_unchanged`` only keys are read."""
    t = target if skip_unchanged else target.select(*keys)
    hidden = [DELETED] if DELETED in changes.columns else []
    c = changes if skip_unchanged else changes.select(*keys, *hidden)
    held = match(t, c, keys).select(_target_op(t, c, keys, skip_unchanged, audit).alias("operation"))
    absent = F.lit("insert")
    if not insert_deleted:
        absent = F.when(_deleted(c), "ignored").otherwise("insert")
    new = not_matched(t, c, keys).select(absent.alias("operation"))
    return held.unionByName(new).groupBy("operation").agg(F.count(F.lit(1)).alias("row_count"))
