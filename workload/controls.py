"""Status folds, run-log fold and high-water marks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import marks as M
from tidemark.operators.control import EVENTS_DDL, apply_events, run_log_view
from workload.base import CONFIGS_SQL, MARKS_SQL, NOW, configs, marks, query, table

# Status events out of the event table. Some name an id without a config.
_EVENT_COLS = {
    "pipeline_id": "PID",
    "seq": "event_id",
    "kind": """case event_id % 11 when 0 then 'fail' when 1 then 'reject' when 2 then 'reset'
        when 3 then 'decommission' when 4 then 'deploy' when 5 then 'reset' when 6 then 'deploy'
        when 7 then 'deploy' else 'approve' end""",
    "at": "ts",
    "actor": "'u' || user_id % 7",
    "generated_sql": "'sql ' || event_id",
    "task_name": "'TASK_' || event_id",
    "message": "case when event_id % 5 <> 0 then 'why ' || event_id end",
}
_WIDE = "'P' || user_id * 11"
_HOT = "case when event_id % 3 = 0 then 'P1' else 'P' || user_id * 11 end"


def _events(spark: SparkSession, sf: str, pid: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        *[f"{e.replace('PID', pid)} as {n}" for n, e in _EVENT_COLS.items()]
    ).select(*[part.split()[0] for part in EVENTS_DDL.split(", ")])


def _fold_sql(pid: str) -> str:
    cols = ", ".join(f'{e.replace("PID", pid)} as "{n}"' for n, e in _EVENT_COLS.items())
    return f"""with recursive {CONFIGS_SQL},
ev as (select *, row_number() over (partition by pipeline_id order by seq) as rn
  from (select {cols} from events)),
walk as (
  select e.pipeline_id, e.rn, c.status as met, e.kind, e.seq from ev e
    left join configs c on c.pipeline_id = e.pipeline_id where rn = 1
  union all
  select e.pipeline_id, e.rn,
    case when w.met is null then null
      when w.kind = 'approve' and w.met = 'PENDING' then 'APPROVED'
      when w.kind = 'deploy' and w.met = 'APPROVED' then 'DEPLOYED'
      when w.kind = 'reject' and w.met = 'PENDING' then 'REJECTED'
      when w.kind = 'reset' and w.met in ('FAILED', 'REJECTED') then 'PENDING'
      when w.kind = 'fail' then 'FAILED' when w.kind = 'decommission' then 'DECOMMISSIONED'
      else w.met end, e.kind, e.seq
  from walk w join ev e on e.pipeline_id = w.pipeline_id and e.rn = w.rn + 1),
judged as (select e.*, case when w.met is null then false
    when e.kind = 'approve' or e.kind = 'reject' then w.met = 'PENDING'
    when e.kind = 'deploy' then w.met = 'APPROVED'
    when e.kind = 'reset' then w.met in ('FAILED', 'REJECTED') else true end as ok
  from ev e join walk w on w.pipeline_id = e.pipeline_id and w.rn = e.rn)
"""


_OUTCOMES = """
select pipeline_id, seq, kind, ok, case when ok then 'OK: ' || pipeline_id || case kind
    when 'approve' then ' approved by ' || actor when 'deploy' then ' deployed.'
    when 'fail' then ' marked FAILED.' when 'reject' then ' rejected by ' || actor
    when 'reset' then ' reset to PENDING.' else ' decommissioned.' end
  else 'ERROR: ' || pipeline_id || case kind
    when 'approve' then ' not found or not in PENDING status.'
    when 'deploy' then ' not found or not in APPROVED status.'
    when 'reject' then ' not found or not PENDING.' when 'reset' then ' not in FAILED/REJECTED.'
    else ' not found.' end end as outcome
from judged"""

_FINAL = """
, l as (select pipeline_id,
  arg_max(kind, seq) filter (where ok) as k, arg_max("at", seq) filter (where ok) as happened_at,
  arg_max(kind, seq) filter (where ok and kind in ('approve', 'reset')) as ka,
  arg_max(generated_sql, seq) filter (where ok and kind = 'approve') as s,
  arg_max(task_name, seq) filter (where ok and kind = 'approve') as t,
  arg_max(actor, seq) filter (where ok and kind = 'approve') as a,
  arg_max("at", seq) filter (where ok and kind = 'approve') as aa,
  arg_max("at", seq) filter (where ok and kind = 'deploy') as d,
  arg_max(kind, seq) filter (where ok and kind in ('fail', 'reject', 'reset')) as ke,
  arg_max(seq, seq) filter (where ok and kind in ('fail', 'reject', 'reset')) as se
  from judged group by 1)
select c.pipeline_id, c.pipeline_name,
  case k when 'approve' then 'APPROVED' when 'deploy' then 'DEPLOYED' when 'reject' then 'REJECTED'
    when 'reset' then 'PENDING' when 'fail' then 'FAILED' when 'decommission' then 'DECOMMISSIONED'
    else c.status end as status,
  case ka when 'approve' then s when 'reset' then null else c.generated_sql end as generated_sql,
  case ka when 'approve' then t when 'reset' then null else c.task_name end as task_name,
  case ka when 'approve' then a when 'reset' then null else c.approved_by end as approved_by,
  case ka when 'approve' then aa when 'reset' then null else c.approved_at end as approved_at,
  coalesce(d, c.deployed_at) as deployed_at, coalesce(l.happened_at, c.updated_at) as updated_at,
  case ke when 'fail' then e.message when 'reject' then 'Rejected by ' || e.actor || ': ' || e.message
    when 'reset' then null else c.error_message end as error_message
from configs c left join l on l.pipeline_id = c.pipeline_id
left join judged e on e.pipeline_id = l.pipeline_id and e.seq = l.se"""


def _final(df: DataFrame) -> DataFrame:
    return df.select("pipeline_id", "pipeline_name", "status", "generated_sql", "task_name",
                     "approved_by", "approved_at", "deployed_at", "updated_at", "error_message")


@query("k1_k6_status_fold", _fold_sql(_WIDE) + _FINAL)
def status_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _final(apply_events(configs(spark, sf), _events(spark, sf, _WIDE)).configs)


@query("k1_k6_event_outcomes", _fold_sql(_WIDE) + _OUTCOMES)
def event_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return apply_events(configs(spark, sf), _events(spark, sf, _WIDE)).outcomes


@query("k1_k6_hot_pipeline", _fold_sql(_HOT) + _FINAL)
def hot_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all events belong to one pipeline."""
    return _final(apply_events(configs(spark, sf), _events(spark, sf, _HOT), bits=6).configs)


@query("a6_hot_outcomes", _fold_sql(_HOT) + _OUTCOMES)
def hot_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return apply_events(configs(spark, sf), _events(spark, sf, _HOT), bits=6).outcomes


_LOG_COLS = """'R' || (event_id - event_id % 5) as run_id, event_id as seq,
  case event_id % 5 when 0 then 'P' || user_id end as pipeline_id,
  case event_id % 5 when 0 then ts end as run_start_at,
  case event_id % 5 when 4 then ts end as run_end_at,
  case event_id % 5 when 0 then 'RUNNING' when 4 then upper(event_type) end as status,
  case event_id % 5 when 1 then 'SKIPPED' end as pre_hook_status,
  case event_id % 5 when 2 then 'PASS' when 3 then case when user_id % 2 = 0 then 'FAIL' end end
    as quality_check_status,
  case event_id % 5 when 3 then 'detail ' || event_id end as quality_check_detail"""
_LOG_FIELDS = ("pipeline_id", "run_start_at", "run_end_at", "status", "pre_hook_status",
               "quality_check_status", "quality_check_detail")


@query("k7_run_log_fold", f"""with log as (select {_LOG_COLS} from events)
select run_id, {", ".join(f"arg_max({c}, seq) filter (where {c} is not null) as {c}" for c in _LOG_FIELDS)}
from log group by 1""")
def run_log_fold(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    cols = [c.strip() for c in _LOG_COLS.replace("\n", " ").split(", ")]
    return run_log_view(events.selectExpr(*cols))


# Marks. Seeded, advanced, reset, failed and removed on the same table.
_LOADS_SQL = """loads as (select 'P' || user_id as pipeline_id, 'ts' as watermark_col,
  max(ts) filter (where ts >= timestamp '2024-01-20') as new_ts, count(*) as rows_loaded
  from events group by 1)"""


@query("g1_read_marks", f"""with {CONFIGS_SQL}, {MARKS_SQL}
select c.pipeline_id, coalesce(max(m.last_value_ts), timestamp '2020-01-01') as mark
from configs c left join marks m on m.pipeline_id = c.pipeline_id and m.last_run_status = 'SUCCESS'
group by 1""")
def read_marks(spark: SparkSession, sf: str) -> DataFrame:
    c = configs(spark, sf).select("pipeline_id", F.lit("2020-01-01").alias("watermark_initial"))
    return M.read_marks(c, marks(spark, sf).where("last_run_status = 'SUCCESS'"))


@query("g1_read_mark", f"""with {MARKS_SQL}
select coalesce(max(last_value_ts), timestamp '2020-01-01') as mark from marks where pipeline_id = 'P9'""")
def read_mark(spark: SparkSession, sf: str) -> DataFrame:
    return M.read_mark(marks(spark, sf), "P9", "2020-01-01")


@query("g2_next_mark", "select max(ts) as mark from events where ts > timestamp '2024-01-10'")
def next_mark(spark: SparkSession, sf: str) -> DataFrame:
    return M.next_mark(table(spark, sf, "events"), "ts", "2024-01-10")


@query("g8_numeric_mark", """
select max(event_id) as mark, 'last_value_num' as stored_in from events where event_id > 100""")
def numeric_mark(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    kind = M.mark_type(events.schema, "event_id")
    return M.next_mark(events, "event_id", 100).withColumn("stored_in", F.lit(kind.column))


def _as_log(df: DataFrame, seq: int = 1) -> DataFrame:
    """Stored marks as the first entries of a log."""
    return df.withColumn("seq", F.lit(seq).cast("long")).withColumn(
        "removed", F.lit(False)).withColumn("load_key", F.lit(None).cast("string"))


def _loads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.expr("'P' || user_id").alias("pipeline_id")).agg(
        F.lit("ts").alias("watermark_col"),
        F.max(F.expr("case when ts >= timestamp_ntz'2024-01-20' then ts end")).alias("new_ts"),
        F.lit(None).cast("decimal(38,10)").alias("new_num"),
        F.count(F.lit(1)).alias("rows_loaded"))


@query("g3_advance_marks", f"""with {MARKS_SQL}, {_LOADS_SQL}
select coalesce(l.pipeline_id, m.pipeline_id) as pipeline_id,
  coalesce(l.watermark_col, m.watermark_col) as watermark_col,
  case when l.pipeline_id is null then m.last_value_ts else greatest(l.new_ts, m.last_value_ts) end
    as last_value_ts,
  case when l.pipeline_id is null then m.last_run_status else 'SUCCESS' end as last_run_status,
  cast(coalesce(l.rows_loaded, m.rows_loaded) as decimal(18,0)) as rows_loaded
from marks m full join loads l on l.pipeline_id = m.pipeline_id""")
def advance(spark: SparkSession, sf: str) -> DataFrame:
    """Marks that exist move up or stay; the others appear."""
    held = marks(spark, sf)
    log = _as_log(held).unionByName(M.advance_marks(held, _loads(spark, sf), NOW, seq=2))
    return M.current_marks(log).select(
        "pipeline_id", "watermark_col", "last_value_ts", "last_run_status", "rows_loaded")


@query("g4_seed_marks", f"""with {CONFIGS_SQL}, {MARKS_SQL}
select pipeline_id, watermark_col, last_value, last_value_ts, last_run_status, rows_loaded
  from marks where last_run_status = 'FAILED'
union all select pipeline_id, 'changed_at', '2020-01-01', timestamp '2020-01-01', 'INIT', 0
from configs c where not exists (select 1 from marks m
  where m.pipeline_id = c.pipeline_id and m.last_run_status = 'FAILED')""")
def seed(spark: SparkSession, sf: str) -> DataFrame:
    held = marks(spark, sf).where("last_run_status = 'FAILED'")
    c = configs(spark, sf).select(
        "pipeline_id", F.lit("changed_at").alias("watermark_col"),
        F.lit("2020-01-01").alias("watermark_initial"))
    log = _as_log(held).unionByName(M.seed_marks(held, c, NOW, seq=2))
    return M.current_marks(log).select(
        "pipeline_id", "watermark_col", "last_value", "last_value_ts", "last_run_status", "rows_loaded")


@query("g5_g7_mark_changes", f"""with {MARKS_SQL}
select pipeline_id,
  case when last_run_status = 'SUCCESS' then '2023-12-01' else last_value end as last_value,
  case when last_run_status = 'SUCCESS' then timestamp '2023-12-01' else last_value_ts end as last_value_ts,
  case when last_run_status = 'SUCCESS' then 'RESET' when last_value is null then 'FAILED'
    else last_run_status end as last_run_status
from marks where not (rows_loaded >= 1000 and last_run_status = 'FAILED')""")
def mark_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Some marks are reset, some fail, some are removed, the rest stay."""
    held = marks(spark, sf)
    log = _as_log(held).unionByName(
        M.reset_mark(held, F.col("last_run_status") == "SUCCESS", "2023-12-01", NOW, 2)
    ).unionByName(
        M.fail_mark(held, F.expr("last_run_status = 'FAILED' and last_value is null"), NOW, 3)
    ).unionByName(
        M.drop_mark(held, F.expr("rows_loaded >= 1000 and last_run_status = 'FAILED'"), NOW, 4))
    return M.current_marks(log).select("pipeline_id", "last_value", "last_value_ts", "last_run_status")
