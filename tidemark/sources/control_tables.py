"""Control tables as append-only logs.

Configs, status events, marks and run-log entries are only ever appended; the
current state is computed from them. Appending needs no lock and no update in
place, and a lost job leaves complete rows behind. Entries lie in one folder
per day; ``compact`` gathers the small files of past days.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULT_WATERMARK_INITIAL, parse_params
from tidemark.operators.control import EVENTS_DDL, Applied, apply_events, run_log_view
from tidemark.operators.joins import absent
from tidemark.operators.marks import LOG_DDL, current_marks, drop_mark, seed_marks
from tidemark.sources.manifest import read_or_empty

CONFIGS_DDL = (
    "pipeline_id string, pipeline_name string, domain string, pipeline_params string, "
    "source_table string, target_table string, load_strategy string, generated_sql string, "
    "task_name string, status string, created_by string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, approved_by string, approved_at timestamp_ntz, "
    "deployed_at timestamp_ntz, error_message string"
)
RUNS_DDL = (
    "run_id string, seq bigint, pipeline_id string, task_name string, load_strategy string, "
    "run_start_at timestamp_ntz, run_end_at timestamp_ntz, status string, "
    "rows_processed decimal(18,0), watermark_from string, watermark_to string, "
    "pre_hook_status string, post_hook_status string, quality_check_status string, "
    "quality_check_detail string, error_message string, query_id string"
)
DAY = "_day"
_TABLES = {"configs": CONFIGS_DDL, "events": EVENTS_DDL, "marks": LOG_DDL, "runs": RUNS_DDL}


class ControlTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last_seq = 0

    def next_seq(self) -> int:
        """Increasing order of log entries: the clock in microseconds."""
        self._last_seq = max(self._last_seq + 1, time.time_ns() // 1000)
        return self._last_seq

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(_TABLES[table])

    def _days(self, table: str) -> DataFrame:
        full = T.StructType([*self.schema(table).fields, T.StructField(DAY, T.StringType())])
        return read_or_empty(self.spark, f"{self.root}/{table}", full)

    def log(self, table: str) -> DataFrame:
        return self._days(table).drop(DAY)

    def append(self, table: str, rows: DataFrame) -> None:
        today = dt.datetime.now(dt.timezone.utc).date().isoformat()
        rows.select(
            *[F.col(f.name).cast(f.dataType) for f in self.schema(table).fields]
        ).write.mode("append").parquet(f"{self.root}/{table}/{DAY}={today}")

    def compact(self, table: str, before: str) -> None:
        """Rewrite the entries of each day before a date as one file per day.
        Entries are only appended to the current day, so nothing is missed."""
        past = self._days(table).where(F.col(DAY) < before)
        (
            past.repartition(DAY).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(DAY)
            .parquet(f"{self.root}/{table}")
        )

    # configs and their status
    def submit(self, configs: DataFrame) -> None:
        """Add configs whose id is new; submitting again changes nothing."""
        new = absent(configs, self.log("configs"), ["pipeline_id"])
        self.append("configs", new)

    def event(self, pipeline_id: str, kind: str, at: str, actor: str | None = None,
              generated_sql: str | None = None, task_name: str | None = None,
              message: str | None = None) -> str:
        """Record one status event and return its outcome text."""
        seq = self.next_seq()
        row = self.spark.createDataFrame(
            [(pipeline_id, seq, kind, at, actor, generated_sql, task_name, message)],
            EVENTS_DDL.replace("at timestamp_ntz", "at string"),
        )
        self.append("events", row)
        one = F.col("pipeline_id") == pipeline_id
        applied = apply_events(self.log("configs").where(one), self.log("events").where(one))
        return applied.outcomes.where(F.col("seq") == seq).first()["outcome"]

    def apply(self) -> Applied:
        return apply_events(self.log("configs"), self.log("events"))

    def configs(self) -> DataFrame:
        return self.apply().configs

    def config(self, pipeline_id: str):
        """One pipeline's current row, or None."""
        one = F.col("pipeline_id") == pipeline_id
        return apply_events(self.log("configs").where(one), self.log("events").where(one)).configs.first()

    def decommission(self, pipeline_id: str, at: str) -> str:
        """Close a pipeline and remove its mark."""
        outcome = self.event(pipeline_id, "decommission", at)
        if outcome.startswith("OK"):
            self.append("marks", drop_mark(self.marks(), pipeline_id, at, self.next_seq()))
        return outcome

    # marks and runs
    def seed_marks(self, now: str) -> None:
        """First marks of deployed incremental pipelines that have none."""
        params = parse_params("pipeline_params")
        ready = self.configs().where(
            (F.col("status") == "DEPLOYED") & (F.col("load_strategy") == "INCREMENTAL")
        ).select(
            "pipeline_id", params["strategy"]["watermark_col"].alias("watermark_col"),
            F.coalesce(params["strategy"]["watermark_initial"],
                       F.lit(DEFAULT_WATERMARK_INITIAL)).alias("watermark_initial"),
        )
        self.append("marks", seed_marks(self.marks(), ready, now, self.next_seq()))

    def marks(self) -> DataFrame:
        return current_marks(self.log("marks"))

    def run_log(self) -> DataFrame:
        return run_log_view(self.log("runs"))

    def log_run(self, run_id: str, **fields) -> None:
        """Append one run-log entry; fields left out keep their last value."""
        schema = self.schema("runs")
        given = {"run_id": run_id, "seq": self.next_seq(), **fields}
        row = self.spark.range(0, 1, 1, 1).select(
            *[
                F.lit(None if given.get(f.name) is None else str(given[f.name]))
                .cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        self.append("runs", row)
