"""Registry of queries and the frames several of them derive.

The test tables hold no NULLs and no junk, so queries derive them with the
same deterministic expression in Spark and in SQL. Every query runs over the
whole of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The clock of every query.
NOW = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


# The frames below are written once, in SQL that both engines read; only the
# spelling of the start time differs.
_START = {"spark": "timestamp_ntz'2024-01-01 00:00:00'", "duckdb": "timestamp '2024-01-01 00:00:00'"}

# Pipeline configs, one per customer.
_CONFIGS = ("customer", "true", {
    "pipeline_id": "'P' || c_custkey",
    "pipeline_name": "c_name",
    "domain": "c_mktsegment",
    "pipeline_params": """'{"execution":{"schedule":"' || (c_custkey % 24 + 1)
        || ' HOUR"},"quality":{"notification_email":'
        || case when c_custkey % 3 = 0 then 'null' else '"n' || c_nationkey || '@example.org"' end
        || '}}'""",
    "source_table": "'RAW.T' || c_nationkey",
    "target_table": "'CLEAN.T' || c_nationkey",
    "load_strategy": """case c_custkey % 3 when 0 then 'INCREMENTAL' when 1 then 'FULL_LOAD'
        else 'CDC' end""",
    "generated_sql": "case when c_custkey % 6 in (1, 2) then 'LOAD ' || c_custkey end",
    "task_name": "case when c_custkey % 6 in (1, 2) then 'TASK_' || c_custkey end",
    "status": """case c_custkey % 6 when 0 then 'PENDING' when 1 then 'APPROVED'
        when 2 then 'DEPLOYED' when 3 then 'FAILED' when 4 then 'REJECTED' else 'DEPLOYED' end""",
    "created_by": "'user' || c_nationkey",
    "created_at": "START + c_custkey * interval '1' minute",
    "updated_at": "START + c_custkey * interval '2' minute",
    "approved_by": "case when c_custkey % 6 in (1, 2, 5) then 'boss' || c_nationkey end",
    "approved_at": """case when c_custkey % 6 in (1, 2, 5)
        then START + c_custkey * interval '97' second end""",
    "deployed_at": """case when c_custkey % 6 in (2, 5)
        then START + c_custkey * interval '131' second end""",
    "error_message": "case when c_custkey % 6 = 3 then 'broken ' || c_custkey end",
})

# One run per event, on the pipeline of its user.
_RUNS = ("events", "true", {
    "run_id": "'R' || event_id",
    "pipeline_id": "'P' || user_id",
    "task_name": "'TASK_' || user_id",
    "load_strategy": """case user_id % 3 when 0 then 'INCREMENTAL' when 1 then 'FULL_LOAD'
        else 'CDC' end""",
    "run_start_at": "ts",
    "run_end_at": """case when event_id % 10 <> 0
        then ts + (event_id % 7200) * interval '1' second end""",
    "status": """case event_type when 'error' then 'FAILED' when 'signup' then 'QUALITY_FAIL'
        else 'SUCCESS' end""",
    "rows_processed": "cast(event_id % 1000 as decimal(18,0))",
    "watermark_from": "'F' || event_id",
    "watermark_to": "'T' || event_id",
    "pre_hook_status": "'SKIPPED'",
    "post_hook_status": "'SUCCESS'",
    "quality_check_status": "case event_type when 'signup' then 'FAIL' else 'PASS' end",
    "quality_check_detail": """case event_type when 'signup' then 'NULL_FAIL'
        else 'All checks passed' end""",
    "error_message": "case event_type when 'error' then 'error ' || event_id end",
})

# One stored mark per customer; every ninth holds no value yet.
_MARKS = ("customer", "true", {
    "pipeline_id": "'P' || c_custkey",
    "watermark_col": "'updated_at'",
    "last_value": "case when c_custkey % 9 <> 0 then 'v' || c_custkey end",
    "last_value_ts": """case when c_custkey % 9 <> 0
        then START + c_custkey * interval '1009' second end""",
    "last_value_num": "cast(null as decimal(38,10))",
    "last_run_at": "START + c_custkey * interval '1' minute",
    "last_run_status": "case c_custkey % 2 when 0 then 'SUCCESS' else 'FAILED' end",
    "rows_loaded": "cast(c_custkey as decimal(18,0))",
    "updated_at": "START + c_custkey * interval '1' minute",
})


def _cte(name: str, frame: tuple) -> str:
    base, condition, cols = frame
    items = ", ".join(f"{e} as {n}" for n, e in cols.items())
    text = f"{name} as (select {items} from {base} where {condition})"
    return text.replace("START", _START["duckdb"])


def _frame(spark: SparkSession, sf_dir: str, frame: tuple) -> DataFrame:
    base, condition, cols = frame
    return table(spark, sf_dir, base).where(condition).selectExpr(
        *[f"{e.replace('START', _START['spark'])} as {n}" for n, e in cols.items()]
    )


CONFIGS_SQL = _cte("configs", _CONFIGS)
RUNS_SQL = _cte("runs", _RUNS)
MARKS_SQL = _cte("marks", _MARKS)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, _CONFIGS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, _RUNS)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, _MARKS)
