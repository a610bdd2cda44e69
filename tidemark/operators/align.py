"""Projection onto a declared target: every target column, in DDL order."""

from __future__ import annotations

import re
from collections.abc import Mapping as MappingType
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Mapping
from tidemark.functions.rules import Rule, src
from tidemark.schema import field, storage_type, widths


@dataclass(frozen=True)
class Warn:
    column: str
    kind: str
    detail: str


def _plain(name: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", name.upper())


def _tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^A-Z0-9]+", name.upper()) if t]


def similar_name(wanted: str, available: Sequence[str]) -> str | None:
    """The one available name that means the same: equal without punctuation
    and case, else equal up to leading or trailing words. Ambiguity is no match."""
    exact = [a for a in available if _plain(a) == _plain(wanted)]
    if len(exact) == 1:
        return exact[0]
    if exact:
        return None
    want = _tokens(wanted)

    def extends(long: list[str], short: list[str]) -> bool:
        n = len(short)
        return 0 < n < len(long) and (long[:n] == short or long[-n:] == short)

    near = [a for a in available if extends(_tokens(a), want) or extends(want, _tokens(a))]
    return near[0] if len(near) == 1 else None


@dataclass(frozen=True)
class Projection:
    """The resolved select list of one load."""

    columns: list[Column]
    warnings: list[Warn]
    cast_checks: dict[str, Column]


def resolve(
    source: T.StructType,
    target: T.StructType,
    mappings: Sequence[Mapping] = (),
    rules: Sequence[Rule] = (),
    defaults: MappingType[str, Column] | None = None,
) -> Projection:
    """Choose an expression per target column.

    Order of preference: explicit mapping, rule, source column of the same
    name, default of an audit column, source column of a similar name, typed
    NULL with a warning. Text copied into a column of another type is cast
    tolerantly and counts as a cast error where it fails. Works on schemas
    only, no data is read.
    """
    mapped = {m.target_col.lower(): m for m in mappings}
    ruled = {r.target.lower(): r for r in rules}
    defaulted = {k.lower(): v for k, v in (defaults or {}).items()}
    # A source column that already has a namesake in the target is not a
    # candidate for a merely similar one.
    free = [f.name for f in source.fields if field(target, f.name) is None]
    known = {f.name.lower() for f in source.fields}
    source_widths = widths(source)

    columns: list[Column] = []
    warnings: list[Warn] = []
    checks: dict[str, Column] = {}
    for f in target.fields:
        key = f.name.lower()
        dtype = storage_type(f.dataType)
        rule = None
        copied = None
        if key in mapped:
            m = mapped[key]
            if m.expression:
                expr = F.expr(m.expression)
            else:
                copied, expr = field(source, m.source_col), src(m.source_col)
        elif key in ruled:
            rule = ruled[key]
            expr = rule.column()
            for name in rule.inputs:
                if name.lower() not in known:
                    warnings.append(Warn(f.name, "UNKNOWN_COLUMN", f"rule reads {name}"))
            if rule.casts:
                checks[f.name] = rule.failed()
        elif (copied := field(source, f.name)) is not None:
            expr = src(copied.name)
        elif key in defaulted:
            expr = defaulted[key]
        elif (near := similar_name(f.name, free)) is not None:
            copied, expr = field(source, near), src(near)
        else:
            expr = F.lit(None)
            warnings.append(Warn(f.name, "UNMAPPED", "no source, loads NULL"))
        if rule is not None:
            made, allowed = rule.output_width(source_widths), widths(target).get(f.name)
            if made is not None and allowed is not None and made > allowed:
                warnings.append(Warn(
                    f.name, "WIDTH", f"varchar({allowed}) receives {made} characters; "
                    f"MODIFY COLUMN {f.name} VARCHAR({made})",
                ))
        if copied is not None and isinstance(copied.dataType, T.StringType) and not isinstance(
            dtype, T.StringType
        ):
            # Text is not trusted: what does not read as the target type is NULL.
            value = expr.try_cast(dtype)
            checks[f.name] = expr.isNotNull() & value.isNull()
            columns.append(value.alias(f.name))
        else:
            columns.append(expr.cast(dtype).alias(f.name))
    return Projection(columns, warnings, checks)


def align(
    df: DataFrame,
    target: T.StructType,
    mappings: Sequence[Mapping] = (),
    rules: Sequence[Rule] = (),
    defaults: MappingType[str, Column] | None = None,
) -> tuple[DataFrame, list[Warn]]:
    """``df`` in the shape of ``target``; columns the target lacks are dropped."""
    plan = resolve(df.schema, target, mappings, rules, defaults)
    return df.alias("src").select(*plan.columns), plan.warnings
