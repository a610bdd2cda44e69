"""Incremental and change-data loads as streams.

The stream's checkpoint takes the place of the stored mark. It tracks files or
offsets, not values: a late row whose time lies below the mark, which the
batch load skips for good, is picked up here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import PipelineConfig
from tidemark.operators.merge import require_unique
from tidemark.plans.loads import cdc_changes, load_incremental, unique_by_dedup
from tidemark.session import delete, scratch_folder
from tidemark.sources.targets import AppendTarget, MergeTarget, stage


def _start(stream: DataFrame, apply, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _name(df: DataFrame, batch_id: int) -> str:
    """A micro-batch; a new checkpoint is a new query, whose batches must not replace the old one's."""
    query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"stream-{query}-{batch_id:012d}"


def stream_incremental(
    stream: DataFrame, cfg: PipelineConfig, schema: T.StructType, target: AppendTarget,
    checkpoint: str, now: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Append each micro-batch under a key of its own. A micro-batch that is
    repeated after a failure replaces its rows, so rows arrive exactly once.
    Dedup works inside a micro-batch."""
    def apply(df: DataFrame, batch_id: int) -> None:
        batch = load_incremental(cfg, df, schema, cfg.watermark_initial, now=now)
        target.write(batch.rows, AppendTarget.load_key(cfg.pipeline_id, _name(df, batch_id)),
                     pipeline_id=cfg.pipeline_id)

    return _start(stream, apply, checkpoint, trigger)


def stream_cdc(
    stream: DataFrame, cfg: PipelineConfig, schema: T.StructType, target: MergeTarget,
    checkpoint: str, now: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Merge each micro-batch: first change per key in the dedup order inside the batch, and only
    changes that come before what the target holds in that same order, all its items, directions and
    ties included. So the order of arrival does not matter, and a repeated batch changes nothing."""
    def apply(df: DataFrame, batch_id: int) -> None:
        changes = cdc_changes(cfg, df, schema, now)
        where = scratch_folder(df.sparkSession, f"changes-{cfg.pipeline_id}-{batch_id}")
        try:
            stored = stage(changes.df, where)
            if not unique_by_dedup(cfg):
                require_unique(stored, cfg.merge_keys)
            target.merge(stored, newer_only=True, batch_id=f"{cfg.pipeline_id}@{_name(df, batch_id)}")
        finally:
            delete(df.sparkSession, where)

    return _start(stream, apply, checkpoint, trigger)
