"""The three load strategies as DataFrame plans.

Order of the steps is fixed: mark and source filters, row rules, projection,
dedup. Filters come first because an older row may win the dedup once a newer
one is filtered out. The projection precedes the dedup window so that only
columns the target needs are read and shuffled: documents are parsed and
values hashed where the data is scanned. Dedup keys, order and delete flag
travel as hidden ``_`` columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import PipelineConfig
from tidemark.functions.rules import Rule, RowRule, src
from tidemark.functions.scalars import now_lit
from tidemark.operators.align import Warn, resolve
from tidemark.operators.dedup import keep_first, order_items, ordering, tie_break
from tidemark.operators.filters import newer_than, row_rules, source_filter
from tidemark.operators.merge import DELETED, ORDER, change_order, merge_cdc, require_unique
from tidemark.schema import field

#: Audit column that takes the run's clock when the target declares it.
LOADED_AT = "loaded_at"


@dataclass(frozen=True)
class Prepared:
    """A batch in target shape. ``hidden`` are extra columns to drop at the
    write; ``cast_flags`` those that are true where a cast lost the value."""

    df: DataFrame
    warnings: list[Warn]
    columns: list[str]
    cast_flags: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.df.select(*self.columns)


def prepare(
    cfg: PipelineConfig,
    source: DataFrame,
    target: T.StructType,
    now: str | None = None,
    since=None,
    upto=None,
    defaults: Mapping[str, Column] | None = None,
    flag_casts: bool = False,
    hidden: Sequence[Column] = (),
) -> Prepared:
    """Filter, project and deduplicate one batch of a pipeline."""
    rules = [r for r in cfg.rules if isinstance(r, Rule)]
    drops = [r for r in cfg.rules if isinstance(r, RowRule)]
    defaults = dict(defaults or {})
    if field(target, LOADED_AT) is not None:
        defaults.setdefault(LOADED_AT, now_lit(now))

    df = source if since is None else newer_than(source, cfg.watermark_col, since, upto)
    df = row_rules(source_filter(df.alias("src"), cfg.source_filter), drops)
    plan = resolve(source.schema, target, cfg.mappings, rules, defaults)
    warnings = list(plan.warnings)
    if cfg.mode_warning:
        warnings.append(Warn("*", "MODE", cfg.mode_warning))

    flags = {f"_cast_{n}": c for n, c in plan.cast_checks.items()} if flag_casts else {}
    extra = list(hidden) + [c.alias(n) for n, c in flags.items()]
    if not cfg.deduplicate:
        out = df.select(*plan.columns, *extra)
    else:
        keys = {f"_key{i}": src(k) for i, k in enumerate(cfg.dedup_keys)}
        spec = order_items(cfg.dedup_order_by)
        ranks = {f"_rank{i}": F.expr(e) for i, (e, _, _) in enumerate(spec)}
        wide = df.select(
            *plan.columns, *extra, *[c.alias(n) for n, c in {**keys, **ranks}.items()]
        )
        by = [ordering(F.col(f"_rank{i}"), d, n) for i, (_, d, n) in enumerate(spec)]
        by += tie_break(wide.schema, [*keys, *ranks, LOADED_AT])
        out = keep_first(wide, [F.col(k) for k in keys], by).drop(*keys, *ranks)
    return Prepared(out, warnings, [f.name for f in target.fields], list(flags))


def load_incremental(
    cfg: PipelineConfig, source: DataFrame, target: T.StructType, since, upto=None,
    now: str | None = None, **options,
) -> Prepared:
    """Rows above the mark and, when given, up to the new mark taken before."""
    return prepare(cfg, source, target, now, since, upto, **options)


def load_full(
    cfg: PipelineConfig, source: DataFrame, target: T.StructType, now: str | None = None, **options
) -> Prepared:
    """All rows that pass the filters; replaces the target."""
    return prepare(cfg, source, target, now, **options)


def cdc_changes(
    cfg: PipelineConfig, source: DataFrame, target: T.StructType, now: str | None = None,
    since=None, upto=None, **options,
) -> Prepared:
    """Changes with the delete flag and the change order as hidden columns.
    A ``watermark_col`` narrows the changes when ``since`` is given."""
    deleted = F.lit(False)
    if cfg.delete_flag_col:
        deleted = F.coalesce(src(cfg.delete_flag_col).cast("boolean"), F.lit(False))
    order = change_order(cfg.dedup_order_by)
    return prepare(
        cfg, source, target, now, since, upto, hidden=[deleted.alias(DELETED), order.alias(ORDER)],
        **options,
    )


def unique_by_dedup(cfg: PipelineConfig) -> bool:
    """Whether the dedup already makes the merge keys unique."""
    merge = {k.lower() for k in cfg.merge_keys}
    return cfg.deduplicate and bool(cfg.dedup_keys) and {k.lower() for k in cfg.dedup_keys} <= merge


def load_cdc(
    cfg: PipelineConfig, target_rows: DataFrame, source: DataFrame, target: T.StructType,
    now: str | None = None, insert_deleted: bool = False, skip_unchanged: bool = False, **options,
) -> DataFrame:
    """The target after merging the changes. Without a dedup on the merge keys
    a job checks first that no key changes twice."""
    changes = cdc_changes(cfg, source, target, now, **options)
    if not unique_by_dedup(cfg):
        require_unique(changes.df, cfg.merge_keys)
    return merge_cdc(target_rows, changes.df, list(cfg.merge_keys), insert_deleted, skip_unchanged)


def load(
    cfg: PipelineConfig, source: DataFrame, target: T.StructType, target_rows: DataFrame,
    since=None, upto=None, now: str | None = None,
) -> DataFrame:
    """The target after one run of the pipeline, whatever its strategy. The
    strategy decides, not the declared write mode."""
    if cfg.strategy == "INCREMENTAL":
        start = cfg.watermark_initial if since is None else since
        batch = load_incremental(cfg, source, target, start, upto, now)
        return target_rows.unionByName(batch.rows)
    if cfg.strategy == "FULL_LOAD":
        return load_full(cfg, source, target, now).rows
    return load_cdc(cfg, target_rows, source, target, now, since=since)
