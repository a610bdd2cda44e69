"""Monitoring views over configs, marks and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import boundary_diff, json_path, ntz, now_lit
from tidemark.operators.dedup import keep_first
from tidemark.operators.filters import since
from tidemark.operators.joins import join_configs, order, top_k


def pending(configs: DataFrame) -> DataFrame:
    """Queue of submissions, oldest first."""
    waiting = configs.where(F.col("status") == "PENDING").select(
        "pipeline_id", "pipeline_name", "domain", "source_table", "target_table",
        "load_strategy", "pipeline_params", "created_by", "created_at",
    )
    return order(waiting, "created_at, pipeline_id")


def deployed(configs: DataFrame, now: str) -> DataFrame:
    live = configs.where(F.col("status") == "DEPLOYED").select(
        "pipeline_id", "pipeline_name", "domain", "source_table", "target_table",
        "load_strategy", "task_name",
        json_path("pipeline_params", "execution.schedule").alias("schedule"),
        json_path("pipeline_params", "quality.notification_email").alias("alert_email"),
        "approved_by", "approved_at", "deployed_at",
        boundary_diff("hour", "deployed_at", now_lit(now)).alias("hours_since_deploy"),
    )
    return order(live, "deployed_at DESC, pipeline_id")


def summary(configs: DataFrame) -> DataFrame:
    counts = configs.groupBy("status", "domain", "load_strategy").agg(
        F.count(F.lit(1)).alias("pipeline_count"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )
    return order(counts, "status, domain, load_strategy")


def last_run(run_log: DataFrame, configs: DataFrame) -> DataFrame:
    """Latest run per pipeline. The log is reduced before the join: config ids
    are unique, so the order of the two steps does not change the result."""
    latest = keep_first(
        run_log.select(
            "pipeline_id", "run_id", "task_name", "run_start_at", "run_end_at",
            F.col("status").alias("last_run_status"), "rows_processed", "watermark_from",
            "watermark_to", "quality_check_status", "quality_check_detail", "error_message",
        ),
        [F.col("pipeline_id")],
        [F.col("run_start_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()],
    )
    return join_configs(latest, configs, ["pipeline_name", "domain", "load_strategy"]).select(
        "pipeline_id", "pipeline_name", "domain", "load_strategy", "task_name",
        "run_start_at", "run_end_at", "last_run_status", "rows_processed",
        "watermark_from", "watermark_to", "quality_check_status", "quality_check_detail",
        "error_message",
        boundary_diff("second", "run_start_at", "run_end_at").alias("duration_seconds"),
    )


def audit_trail(configs: DataFrame) -> DataFrame:
    trail = configs.select(
        "pipeline_id", "pipeline_name", "domain", "source_table", "target_table",
        "load_strategy", "status", "created_by", "created_at", "approved_by", "approved_at",
        "deployed_at",
        boundary_diff("minute", "created_at", "approved_at").alias("mins_to_approval"),
        boundary_diff("minute", "approved_at", "deployed_at").alias("mins_to_deploy"),
        "error_message", "task_name",
    )
    return order(trail, "created_at DESC, pipeline_id")


def watermark_health(marks: DataFrame, configs: DataFrame, now: str) -> DataFrame:
    joined = join_configs(marks, configs, ["pipeline_name", "domain"]).select(
        "pipeline_id", "pipeline_name", "domain", "watermark_col", "last_value_ts",
        "last_value_num",
        boundary_diff("hour", "last_value_ts", ntz(now)).alias("hours_behind"),
        "last_run_at", "last_run_status", "rows_loaded",
    )
    return order(joined, "hours_behind DESC NULLS LAST, pipeline_id")


def fleet_status(configs: DataFrame, last_runs: DataFrame) -> DataFrame:
    """Deployed pipelines with their last run, if any."""
    runs = last_runs.select(
        "pipeline_id", "last_run_status", F.col("run_start_at").alias("last_run_at"),
        F.col("rows_processed").alias("last_run_rows"), "duration_seconds",
        F.col("watermark_to").alias("current_watermark"), "quality_check_status",
        F.col("error_message").alias("run_error"),
    )
    live = configs.where(F.col("status") == "DEPLOYED")
    joined = live.join(runs, "pipeline_id", "left")
    return order(joined, "deployed_at DESC, pipeline_id").select(
        "pipeline_id", "pipeline_name", "domain", "load_strategy", "task_name",
        json_path("pipeline_params", "execution.schedule").alias("schedule"),
        "last_run_status", "last_run_at", "last_run_rows", "duration_seconds",
        "current_watermark", "quality_check_status", F.col("run_error").alias("error_message"),
    )


def recent_failures(run_log: DataFrame, configs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    failed = since(
        run_log.where(F.col("status").isin("FAILED", "QUALITY_FAIL")), "run_start_at", now, hours
    ).select(
        "pipeline_id", "run_id", "task_name", "status", "run_start_at", "quality_check_status",
        "quality_check_detail", "error_message",
    )
    joined = join_configs(failed, configs, ["pipeline_name", "domain"])
    return order(joined, "run_start_at DESC, run_id")


def run_history(run_log: DataFrame, pipeline_id: str) -> DataFrame:
    mine = run_log.where(F.col("pipeline_id") == pipeline_id).select(
        "run_id", "run_start_at", "run_end_at", "status", "rows_processed", "watermark_from",
        "watermark_to", "pre_hook_status", "post_hook_status", "quality_check_status",
        "quality_check_detail",
        boundary_diff("second", "run_start_at", "run_end_at").alias("duration_seconds"),
        "error_message",
    )
    return order(mine, "run_start_at DESC, run_id")


def recent_outcomes(configs: DataFrame, k: int = 20) -> DataFrame:
    ended = configs.where(F.col("status").isin("DEPLOYED", "FAILED", "REJECTED"))
    return top_k(ended, "updated_at DESC, pipeline_id", k).select(
        "pipeline_id", "pipeline_name", "domain", "load_strategy", "status", "task_name",
        "deployed_at",
    )


def run_durations(run_log: DataFrame, now: str, days: int = 1, k: int | None = 20,
                  task_name: str | None = None) -> DataFrame:
    """Duration of the latest runs of a period, of all tasks or of one; ``k`` is the length of the report."""
    wanted = run_log if task_name is None else run_log.where(F.col("task_name") == task_name)
    recent = since(wanted, "run_start_at", now, 24 * days).select(
        "run_id", "task_name", "status", "run_start_at", "run_end_at", "error_message",
        boundary_diff("second", "run_start_at", "run_end_at").alias("duration_secs"),
    )
    by = "run_start_at DESC, run_id"
    return order(recent, by) if k is None else top_k(recent, by, k)


def resettable(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("status").isin("FAILED", "REJECTED")).select(
        "pipeline_id", "pipeline_name", "status", "error_message"
    )


def outcome_totals(configs: DataFrame) -> DataFrame:
    """Processed, deployed, rejected and failed submissions, in one row."""
    def n(*names: str):
        return F.count_if(F.col("status").isin(*names))

    return configs.agg(
        n("DEPLOYED", "REJECTED", "FAILED").alias("processed"), n("DEPLOYED").alias("deployed"),
        n("REJECTED").alias("rejected"), n("FAILED").alias("failed"),
    )


def queue(configs: DataFrame, k: int = 50) -> DataFrame:
    """The newest submissions."""
    return top_k(configs, "created_at DESC, pipeline_id", k).select(
        "pipeline_id", "pipeline_name", "domain", "source_table", "target_table",
        "load_strategy", "status", "created_at",
    )
