"""Monitoring views over configs from customers and runs from events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import views as V
from tidemark.operators.joins import join_configs
from workload.base import CONFIGS_SQL, MARKS_SQL, RUNS_SQL, configs, marks, query, runs

_NOW = "2024-02-15 06:30:00"
_TS = f"timestamp '{_NOW}'"


@query("v1_pending", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, domain, source_table, target_table, load_strategy,
  pipeline_params, created_by, created_at from configs where status = 'PENDING'""")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    return V.pending(configs(spark, sf))


@query("v2_d3_deployed", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, domain, source_table, target_table, load_strategy, task_name,
  json_extract_string(pipeline_params, '$.execution.schedule') as schedule,
  json_extract_string(pipeline_params, '$.quality.notification_email') as alert_email,
  approved_by, approved_at, deployed_at, date_diff('hour', deployed_at, {_TS}) as hours_since_deploy
from configs where status = 'DEPLOYED'""")
def deployed(spark: SparkSession, sf: str) -> DataFrame:
    return V.deployed(configs(spark, sf), _NOW)


@query("v3_h1_summary", f"""with {CONFIGS_SQL}
select status, domain, load_strategy, count(*) as pipeline_count, min(created_at) as oldest,
  max(created_at) as newest from configs group by 1, 2, 3""")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return V.summary(configs(spark, sf))


_LAST = """last as (select r.pipeline_id, c.pipeline_name, c.domain, c.load_strategy, r.task_name,
  run_start_at, run_end_at, r.status as last_run_status, rows_processed, watermark_from, watermark_to,
  quality_check_status, quality_check_detail, r.error_message,
  date_diff('second', run_start_at, run_end_at) as duration_seconds
from runs r join configs c on c.pipeline_id = r.pipeline_id
qualify row_number() over (partition by r.pipeline_id
  order by run_start_at desc nulls last, run_id desc) = 1)"""


@query("v4_e2_j1_last_run", f"with {CONFIGS_SQL}, {RUNS_SQL}, {_LAST} select * from last")
def last_run(spark: SparkSession, sf: str) -> DataFrame:
    return V.last_run(runs(spark, sf), configs(spark, sf))


@query("v5_d32_audit_trail", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, domain, source_table, target_table, load_strategy, status,
  created_by, created_at, approved_by, approved_at, deployed_at,
  date_diff('minute', created_at, approved_at) as mins_to_approval,
  date_diff('minute', approved_at, deployed_at) as mins_to_deploy, error_message, task_name
from configs""")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    return V.audit_trail(configs(spark, sf))


@query("v6_watermark_health", f"""with {CONFIGS_SQL}, {MARKS_SQL}
select m.pipeline_id, c.pipeline_name, c.domain, watermark_col, last_value_ts, last_value_num,
  date_diff('hour', last_value_ts, {_TS}) as hours_behind, last_run_at, last_run_status, rows_loaded
from marks m join configs c on c.pipeline_id = m.pipeline_id""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return V.watermark_health(marks(spark, sf), configs(spark, sf), _NOW)


@query("v7_j2_fleet_status", f"""with {CONFIGS_SQL}, {RUNS_SQL}, {_LAST}
select c.pipeline_id, c.pipeline_name, c.domain, c.load_strategy, c.task_name,
  json_extract_string(pipeline_params, '$.execution.schedule') as schedule, l.last_run_status,
  l.run_start_at as last_run_at, l.rows_processed as last_run_rows, l.duration_seconds,
  l.watermark_to as current_watermark, l.quality_check_status, l.error_message
from configs c left join last l on l.pipeline_id = c.pipeline_id where c.status = 'DEPLOYED'""")
def fleet(spark: SparkSession, sf: str) -> DataFrame:
    c = configs(spark, sf)
    return V.fleet_status(c, V.last_run(runs(spark, sf), c))


@query("v8_recent_failures", f"""with {CONFIGS_SQL}, {RUNS_SQL}
select r.pipeline_id, run_id, r.task_name, r.status, run_start_at, quality_check_status,
  quality_check_detail, r.error_message, pipeline_name, domain
from runs r join configs c on c.pipeline_id = r.pipeline_id
where r.status in ('FAILED', 'QUALITY_FAIL')
  and run_start_at >= timestamp '2024-01-30 12:00:00' - interval 24 hours""")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return V.recent_failures(runs(spark, sf), configs(spark, sf), "2024-01-30 12:00:00")


@query("v9_run_history", f"""with {RUNS_SQL}
select run_id, run_start_at, run_end_at, status, rows_processed, watermark_from, watermark_to,
  pre_hook_status, post_hook_status, quality_check_status, quality_check_detail,
  date_diff('second', run_start_at, run_end_at) as duration_seconds, error_message
from runs where pipeline_id = 'P7'""")
def history(spark: SparkSession, sf: str) -> DataFrame:
    return V.run_history(runs(spark, sf), "P7")


@query("v10_n2_recent_outcomes", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, domain, load_strategy, status, task_name, deployed_at
from configs where status in ('DEPLOYED', 'FAILED', 'REJECTED')
order by updated_at desc, pipeline_id limit 20""")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return V.recent_outcomes(configs(spark, sf))


@query("v11_run_durations", f"""with {RUNS_SQL}
select run_id, task_name, status, run_start_at, run_end_at, error_message,
  date_diff('second', run_start_at, run_end_at) as duration_secs
from runs where run_start_at >= timestamp '2024-01-30 12:00:00' - interval 1 day""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return V.run_durations(runs(spark, sf), "2024-01-30 12:00:00", k=None)


@query("v11_run_durations_top", f"""with {RUNS_SQL}
select run_id, task_name, status, run_start_at, run_end_at, error_message,
  date_diff('second', run_start_at, run_end_at) as duration_secs
from runs where run_start_at >= timestamp '2024-01-30 12:00:00' - interval 1 day
order by run_start_at desc, run_id limit 20""")
def durations_top(spark: SparkSession, sf: str) -> DataFrame:
    return V.run_durations(runs(spark, sf), "2024-01-30 12:00:00")


@query("v12_resettable", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, status, error_message from configs
where status in ('FAILED', 'REJECTED')""")
def resettable(spark: SparkSession, sf: str) -> DataFrame:
    return V.resettable(configs(spark, sf))


@query("h7_outcome_totals", f"""with {CONFIGS_SQL}
select count(*) filter (where status in ('DEPLOYED', 'REJECTED', 'FAILED')) as processed,
  count(*) filter (where status = 'DEPLOYED') as deployed,
  count(*) filter (where status = 'REJECTED') as rejected,
  count(*) filter (where status = 'FAILED') as failed from configs""")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return V.outcome_totals(configs(spark, sf))


@query("n2_d36_queue", f"""with {CONFIGS_SQL}
select pipeline_id, pipeline_name, domain, source_table, target_table, load_strategy, status, created_at
from configs order by created_at desc, pipeline_id limit 50""")
def queue(spark: SparkSession, sf: str) -> DataFrame:
    return V.queue(configs(spark, sf))


@query("j1_join_configs", f"""with {CONFIGS_SQL}, {RUNS_SQL}
select r.pipeline_id, run_id, r.status, pipeline_name, domain from runs r
join configs c on c.pipeline_id = r.pipeline_id""")
def joined(spark: SparkSession, sf: str) -> DataFrame:
    return join_configs(runs(spark, sf).select("pipeline_id", "run_id", F.col("status")),
                        configs(spark, sf), ["pipeline_name", "domain"])
