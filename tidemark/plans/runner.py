"""One run of a pipeline: hooks, load, quality gate, mark and run log.

The driver only sequences Spark jobs and reads one row of metrics. A batch is
written once, where no reader sees it, and audited from the metrics observed
during that write; only when it passes do exactly those files become part of
the target (``gate_order="pre"``). With ``gate_order="post"`` they do at once and
the audit follows. The source is read once.

Metrics are observed in the task that writes the files, never before a
shuffle, so a stage repeated after an executor is lost cannot count twice.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import PipelineConfig
from tidemark.operators import marks as M
from tidemark.operators.align import Warn
from tidemark.operators.merge import DELETED, require_unique
from tidemark.operators.quality import Declared, QualityError, gate, metrics, verdict
from tidemark.plans.loads import (
    Prepared, cdc_changes, load_full, load_incremental, unique_by_dedup,
)
from tidemark.session import delete, scratch_folder
from tidemark.sources.control_tables import ControlTables
from tidemark.sources.tables import read
from tidemark.sources.targets import AppendTarget, MergeTarget, ReplaceTarget

Target = AppendTarget | ReplaceTarget | MergeTarget


@dataclass(frozen=True)
class RunResult:
    run_id: str
    status: str
    rows: int
    detail: str
    mark_from: object = None
    mark_to: object = None
    warnings: tuple[Warn, ...] = ()


def run_hook(spark: SparkSession, sql: str | None) -> str:
    """Status of a pre- or post-load statement; a failure goes to the caller."""
    if sql is None or sql == "":
        return "SKIPPED"
    result = spark.sql(sql)
    if result.columns:
        # Commands have run by now; a query runs here, its rows go nowhere.
        result.write.format("noop").mode("overwrite").save()
    return "SUCCESS"


class RunLog:
    """Entries of one run: one is appended at the start, one at the end with
    all that was learned in between."""

    def __init__(self, control: ControlTables, run_id: str):
        self.control, self.run_id, self._fields = control, run_id, {}

    def set(self, **fields) -> None:
        self._fields.update(fields)

    def flush(self, **fields) -> None:
        self.control.log_run(self.run_id, **{**self._fields, **fields})
        self._fields = {}


def _hook(log: RunLog, which: str, sql: str | None) -> None:
    try:
        status = run_hook(log.control.spark, sql)
    except Exception as e:
        log.set(**{f"{which}_hook_status": f"FAILED: {str(e)}"})
        raise
    log.set(**{f"{which}_hook_status": status})


def _observed(df: DataFrame, cfg: PipelineConfig, flags: list[str], declared: Declared, write,
              gather: bool = False) -> tuple[dict, str]:
    """Write; returns the metrics of exactly the written rows, and what ``write`` returns.

    Batches after the first are usually a thin slice of a wide scan, so they
    are gathered into files of the advisory size before they are observed and
    written; a first or full load is written where it was read.
    """
    seen = Observation()
    df = df.hint("rebalance") if gather else df
    live = ~F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else None
    where = write(df.observe(seen, *metrics(cfg.null_check_cols, flags, declared, live)))
    return dict(seen.get), where


def _verdict(spark: SparkSession, cfg: PipelineConfig, found: dict, flags: list[str],
             declared: Declared, rows: int, check_casts: bool) -> tuple[str, str]:
    counts = spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in found.items()])
    row = verdict(
        counts, cfg.null_check_cols, cfg.error_tolerance_pct, cfg.min_rows_expected,
        flags if check_casts else (), rows_loaded=rows, declared=declared,
    ).first()
    return row["status"], row["detail"]


def run_pipeline(
    spark: SparkSession,
    cfg: PipelineConfig,
    target_schema: T.StructType,
    target: Target,
    control: ControlTables,
    now: dt.datetime | str | None = None,
    source: DataFrame | None = None,
    gate_order: str = "pre",
    check_casts: bool = False,
    skip_unchanged: bool = False,
    batch_id: str | None = None,
) -> RunResult:
    """Run once. Raises what went wrong after logging it; a missed threshold
    raises ``QualityError`` with the run logged as QUALITY_FAIL. So does a row that
    breaks what ``target_schema`` declares: a NULL in a NOT NULL column, a text wider
    than its column; they are counted in the same pass.

    ``batch_id`` names a change set: a merge that is run again under it gives the same rows, those
    with incomplete keys included. By default it is the pipeline with its mark, or with ``now``.
    """
    clock = _clock(now)
    stamp = "".join(ch for ch in clock if ch.isdigit()).ljust(17, "0")[:17]
    run_id = f"RUN_{cfg.pipeline_id}_{stamp[:8]}_{stamp[8:14]}_{stamp[14:]}"
    log = RunLog(control, run_id)
    log.flush(
        pipeline_id=cfg.pipeline_id, task_name=cfg.pipeline_name,
        load_strategy=cfg.strategy, run_start_at=clock, status="RUNNING",
    )
    try:
        return _run(spark, cfg, target_schema, target, log, clock,
                    source if source is not None else read(spark, cfg.source_table),
                    gate_order, check_casts, skip_unchanged, batch_id)
    except QualityError as e:
        _close(log, cfg, now, "QUALITY_FAIL", error_message=str(e))
        raise
    except Exception as e:
        _close(log, cfg, now, "FAILED", error_message=str(e))
        raise


class NotDeployed(RuntimeError):
    """A stored configuration is unknown, or its status does not allow a run."""


def run_stored(
    spark: SparkSession,
    control: ControlTables,
    pipeline_id: str,
    target_schema: T.StructType,
    target: Target | None = None,
    now: dt.datetime | str | None = None,
    source: DataFrame | None = None,
    **options,
) -> RunResult:
    """Run a pipeline from its stored configuration, rules included. It must be DEPLOYED; a run that
    breaks moves it to FAILED, from where a reset and a new approval lead back. Without ``target`` it is a
    folder named by the configuration, of the kind that its strategy needs."""
    row = control.config(pipeline_id)
    if row is None or row["status"] != "DEPLOYED":
        raise NotDeployed(f"{pipeline_id} is {'unknown' if row is None else row['status']}")
    cfg = PipelineConfig.from_params(pipeline_id, row["pipeline_params"])
    if target is None:
        target = {
            "INCREMENTAL": lambda: AppendTarget(spark, cfg.target_table, target_schema),
            "FULL_LOAD": lambda: ReplaceTarget(spark, cfg.target_table, target_schema),
            "CDC": lambda: MergeTarget(spark, cfg.target_table, target_schema, cfg.merge_keys),
        }[cfg.strategy]()
    try:
        return run_pipeline(spark, cfg, target_schema, target, control, now, source, **options)
    except QualityError:
        raise  # a stopped batch is logged; the pipeline stays deployed
    except Exception as e:
        control.event(pipeline_id, "fail", _clock(now), message=str(e)[:2000])
        raise


def _clock(now: dt.datetime | str | None) -> str:
    return str(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


def _tracked(cfg: PipelineConfig) -> bool:
    """Incremental loads keep a mark; merges may, to read only new changes."""
    return cfg.strategy == "INCREMENTAL" or (cfg.strategy == "CDC" and bool(cfg.watermark_col))


def _close(log: RunLog, cfg: PipelineConfig, now, status: str, **fields) -> None:
    control, clock = log.control, _clock(now)
    log.flush(status=status, run_end_at=clock, **fields)
    if _tracked(cfg):
        control.append("marks", M.fail_mark(control.marks(), cfg.pipeline_id, clock, control.next_seq()))


def _run(spark, cfg, target_schema, target, log: RunLog, clock, source, gate_order,
         check_casts, skip_unchanged, batch_id) -> RunResult:
    control = log.control
    _hook(log, "pre", cfg.pre_load_sql)
    mark_from = mark_to = kind = None
    incremental = cfg.strategy == "INCREMENTAL"
    if _tracked(cfg):
        kind = M.mark_type(source.schema, cfg.watermark_col)
        mark_from = M.read_mark(
            control.marks(), cfg.pipeline_id, cfg.watermark_initial, kind.column
        ).first()["mark"]
        log.set(watermark_from=mark_from)
        mark_to = M.next_mark(source, cfg.watermark_col, mark_from).first()["mark"]
    upto = mark_from if mark_to is None else mark_to
    nothing_new = kind is not None and mark_to is None
    if incremental:
        batch = load_incremental(cfg, source, target_schema, mark_from, upto, clock,
                                 flag_casts=check_casts)
    elif cfg.strategy == "FULL_LOAD":
        batch = load_full(cfg, source, target_schema, clock, flag_casts=check_casts)
    else:
        batch = cdc_changes(cfg, source, target_schema, clock, mark_from, upto,
                            flag_casts=check_casts)

    start = clock if kind is None else mark_from
    key = AppendTarget.load_key(cfg.pipeline_id, start)
    earlier = (F.col("pipeline_id") == cfg.pipeline_id) & F.col("load_key").isNotNull()
    slice_only = incremental and bool(control.log("marks").where(earlier).take(1))
    span = {"load_key": key, "pipeline_id": cfg.pipeline_id, "mark_from": mark_from, "mark_to": upto}
    rows, status, detail = _load(spark, cfg, batch, Declared.of(target_schema), target, span, gate_order, check_casts,
                                 nothing_new, slice_only, log, skip_unchanged, batch_id or key)

    if kind is not None:
        control.append("marks", M.advance_mark(
            control.marks(), cfg.pipeline_id, cfg.watermark_col, mark_to, rows, clock,
            control.next_seq(), kind.numeric, key if incremental and not nothing_new else None,
        ))
    _hook(log, "post", cfg.post_load_sql)
    log.set(watermark_to=mark_to)
    gate(status, detail)
    log.flush(status="SUCCESS", run_end_at=clock)
    return RunResult(log.run_id, "SUCCESS", rows, detail, mark_from, mark_to, tuple(batch.warnings))


def _load(spark, cfg, batch: Prepared, declared: Declared, target: Target, span: dict, gate_order, check_casts, nothing_new,
          slice_only, log: RunLog, skip_unchanged, batch_id) -> tuple[int, str, str]:
    """Write, audit, publish; returns affected rows and the verdict.

    A change set is staged in the shared folder first, because the merge reads
    it twice; its audit counts its own rows, and the affected ones are counted
    in the tasks that write the merged buckets.
    """
    flags = batch.cast_flags
    first = gate_order == "pre"

    def judge(found: dict, rows: int) -> tuple[str, str]:
        status, detail = _verdict(spark, cfg, found, flags, declared, rows, check_casts)
        log.set(quality_check_status=status, quality_check_detail=detail, rows_processed=rows)
        if first:
            gate(status, detail)
        return status, detail

    def audited(found: dict, rows: int, publish, discard) -> tuple[str, str]:
        if not first:
            publish()
        try:
            out = judge(found, rows)
        except QualityError:
            discard()
            raise
        if first:
            publish()
        return out

    if nothing_new:
        nothing = ["rows_loaded", *[f"nulls__{c}" for c in cfg.null_check_cols],
                   *[f"casts__{c}" for c in flags], *[f"required__{c}" for c in declared.required],
                   *[f"wide__{c}" for c, _ in declared.widths]]
        return 0, *judge(dict.fromkeys(nothing, 0), 0)

    if not isinstance(target, MergeTarget):
        found, folder = _observed(batch.df, cfg, flags, declared, target.stage, slice_only)
        rows = found["rows_loaded"]
        where = span if isinstance(target, AppendTarget) else {}
        return rows, *audited(found, rows, lambda: target.publish(folder, rows=rows, **where),
                              lambda: target.discard(folder))

    staged_at = scratch_folder(spark, f"stage-{cfg.pipeline_id}")
    try:
        found, _ = _observed(batch.df, cfg, flags, declared, lambda df: df.write.parquet(staged_at))
        staged = spark.read.schema(batch.df.schema).parquet(staged_at)
        if not unique_by_dedup(cfg):
            require_unique(staged, cfg.merge_keys)
        merged = target.stage_merge(staged, skip_unchanged=skip_unchanged, batch_id=batch_id)
        return merged.changed, *audited(found, merged.changed, lambda: target.publish(merged),
                                        lambda: merged.folder and target.discard(merged.folder))
    finally:
        delete(spark, staged_at)


def backfill(control: ControlTables, cfg: PipelineConfig, target: AppendTarget, to: str,
             now: str, keep_loaded: bool = False) -> str:
    """Set an incremental pipeline back to a mark (a date, a time or a number); returns the new mark.

    The mark rounds down to the start of the batch that contains it, and that
    batch and all later ones leave the target in one step, so loading again adds
    nothing twice. ``keep_loaded`` only lowers the mark, and the rows will be
    appended again.
    """
    mine = F.col("pipeline_id") == cfg.pipeline_id
    numeric = M.is_number(to)
    kind = "decimal(38,10)" if numeric else "timestamp_ntz"
    start = to
    if not keep_loaded:
        batches = target.batches().where(mine).select(
            "key", F.col("mark_from").cast(kind).alias("a"), F.col("mark_to").cast(kind).alias("b"))
        row = batches.where(F.col("b") > F.lit(to).cast(kind)).agg(
            F.least(F.min("a"), F.lit(to).cast(kind)).cast("string").alias("start")).first()
        start = to if row["start"] is None else row["start"]
        target.drop_batches(batches.where(F.col("b") > F.lit(start).cast(kind)).select("key"))
    control.append("marks", M.reset_mark(control.marks(), cfg.pipeline_id, start, now, control.next_seq()))
    return start
