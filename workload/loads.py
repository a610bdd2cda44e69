"""The load strategies over the test tables, and full runs through the runner."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Mapping, PipelineConfig
from tidemark.functions import rules as R
from tidemark.operators import filters as C
from tidemark.operators import marks as M
from tidemark.operators.dedup import dedup
from tidemark.operators.merge import merge_cdc, merge_summary
from tidemark.plans.loads import cdc_changes, load, load_full, load_incremental
from tidemark.plans.runner import run_pipeline
from tidemark.schema import ddl, plain_schema
from tidemark.session import scratch_folder
from tidemark.sources.control_tables import ControlTables
from tidemark.sources.targets import AppendTarget, MergeTarget, ReplaceTarget
from tidemark.streaming.streams import stream_cdc, stream_incremental
from workload.base import NOW, query, table

EVENTS_DDL = (
    "event_id bigint, user_hash varchar(64), event_ts timestamp_ntz, event_day date, "
    "event_type varchar(16), amount decimal(18,2), k int, loaded_at timestamp_ntz"
)


def events_config(**extra) -> PipelineConfig:
    return PipelineConfig(
        pipeline_id="ETL_EVENTS_001", pipeline_name="events_raw_to_clean", source_table="events",
        target_table="events_clean", strategy="INCREMENTAL",
        source_filter="src.event_type NOT IN ('error')",
        watermark_col="ts", watermark_initial="2024-01-10",
        mappings=(Mapping("ts", "event_day", "cast(src.ts as date)"),),
        rules=(R.Mask("user_hash", "user_id"), R.Upper("event_type"),
               R.NumToDecimal("amount", "value"), R.JsonField("k", "props", "k", "int")),
        null_check_cols=("event_id", "k"), **extra,
    )


def events_sql(where: str) -> str:
    return f"""
select event_id, sha256(cast(user_id as varchar)) as user_hash, ts as event_ts,
  cast(ts as date) as event_day, upper(event_type) as event_type,
  cast(value as decimal(18,2)) as amount, cast(json_extract_string(props, '$.k') as int) as k,
  timestamp '2024-02-01 00:00:00' as loaded_at
from events where event_type not in ('error') and {where}"""


_AFTER = "ts > timestamp '2024-01-10'"


@query("f1_incr_load_events", events_sql(_AFTER))
def incr_load_events(spark: SparkSession, sf: str) -> DataFrame:
    return load_incremental(events_config(), table(spark, sf, "events"), ddl(EVENTS_DDL),
                            "2024-01-10", now=NOW).df


@query("f1_g3_two_batches", events_sql(_AFTER))
def two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Up to one mark, then from there: the same rows as one load."""
    events, cfg, target = table(spark, sf, "events"), events_config(), ddl(EVENTS_DDL)
    middle = "2024-01-20 12:00:00"
    empty = spark.createDataFrame([], plain_schema(target))
    first = load(cfg, events, target, empty, since="2024-01-10", upto=middle, now=NOW)
    return load(cfg, events, target, first, since=middle, now=NOW)


@query("f1_t3_empty_batch", events_sql("ts > timestamp '2030-01-01'") + """
union all select -1, null, max(ts), null, null, null, null, null from events""")
def empty_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing new: no rows, and the mark stays where it was."""
    events, target = table(spark, sf, "events"), ddl(EVENTS_DDL)
    none = load_incremental(events_config(), events, target, "2030-01-01", now=NOW).df
    highest = events.agg(F.max("ts").alias("mark"))
    kept = highest.unionByName(M.next_mark(events, "ts", "2030-01-01")).agg(
        F.lit(-1).cast("long").alias("event_id"), F.max("mark").alias("event_ts"))
    return none.unionByName(kept, allowMissingColumns=True)


@query("f2_full_load_customer", """
select c_custkey as customer_id, upper(trim(c_name)) as name,
  case c_mktsegment when 'FURNITURE' then 'Home' when 'HOUSEHOLD' then 'Home'
    when 'MACHINERY' then 'Industry' when 'BUILDING' then 'Industry' end as segment,
  cast(c_acctbal as decimal(18,2)) as balance,
  case when c_acctbal <= 0 then 'LOW' when c_acctbal <= 5000 then 'MEDIUM' else 'HIGH' end as band,
  case when c_acctbal > 9000 then 'HIGH' else 'LOW' end as flag,
  c_nationkey as nationkey, timestamp '2024-02-01 00:00:00' as loaded_at
from customer where c_nationkey <> 3""")
def full_load_customer(spark: SparkSession, sf: str) -> DataFrame:
    target = ddl(
        "customer_id bigint, name varchar(32), segment varchar(16), balance decimal(18,2), "
        "band varchar(8), flag varchar(8), nationkey int, loaded_at timestamp_ntz"
    )
    cfg = PipelineConfig(
        pipeline_id="ETL_CUSTOMER_001", pipeline_name="customer", source_table="customer",
        target_table="customer_clean", strategy="FULL_LOAD",
        mappings=(Mapping("c_custkey", "customer_id"),
                  Mapping("c_name", "name", "upper(trim(src.c_name))")),
        rules=(
            R.Decode("segment", "c_mktsegment", (
                ("FURNITURE", "Home"), ("HOUSEHOLD", "Home"), ("MACHINERY", "Industry"),
                ("BUILDING", "Industry"))),
            R.NumToDecimal("balance", "c_acctbal"),
            R.Band("band", "c_acctbal", ((0, "LOW"), (5000, "MEDIUM")), else_="HIGH"),
            R.Flag("flag", "c_acctbal", 9000), R.DropEq("c_nationkey", 3),
        ),
    )
    return load_full(cfg, table(spark, sf, "customer"), target, NOW).df


# A change feed out of orders: keys are customer and priority, some without a
# customer; earlier orders make the target, later ones the changes.
_ORDERS = """
with src as (
  select o_orderkey, case when o_orderkey % 50 = 0 then null else o_custkey end as custkey,
    o_orderpriority as priority, o_orderstatus as status, o_orderdate, o_orderstatus = 'F' as gone
  from orders),
tgt as (select * from src where o_orderdate < timestamp '1998-06-01'
  qualify row_number() over (partition by custkey, priority
    order by o_orderdate desc, status, o_orderkey) = 1),
chg as (select * from src where o_orderdate >= timestamp '1998-06-01'
  qualify row_number() over (partition by custkey, priority
    order by o_orderdate desc, status, o_orderkey) = 1),
old as (select custkey, priority, status, o_orderkey as orderkey, timestamp '2024-01-01 00:00:00' as loaded_at
  from tgt),
new as (select custkey, priority, status, o_orderkey as orderkey, timestamp '2024-02-01 00:00:00' as loaded_at,
  gone from chg)
"""
_MATCH = "o.custkey = n.custkey and o.priority = n.priority"
_UNTOUCHED = f"select * from old o where not exists (select 1 from new n where {_MATCH})"
_ORDERS_DDL = "custkey bigint, priority varchar(16), status varchar(1), orderkey bigint, loaded_at timestamp_ntz"


def orders_feed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    src = table(spark, sf, "orders").selectExpr(
        "o_orderkey as orderkey", "case when o_orderkey % 50 = 0 then null else o_custkey end as custkey",
        "o_orderpriority as priority", "o_orderstatus as status", "o_orderdate as changed_at",
        "o_orderstatus = 'F' as gone")
    cut = "timestamp_ntz'1998-06-01'"
    return src.where(f"changed_at < {cut}"), src.where(f"changed_at >= {cut}")


def orders_config(**extra) -> PipelineConfig:
    return PipelineConfig(
        pipeline_id="ETL_ORDERS_001", pipeline_name="orders", source_table="orders",
        target_table="orders_clean", strategy="CDC", deduplicate=True,
        dedup_keys=("custkey", "priority"), dedup_order_by="changed_at DESC, status, orderkey",
        merge_keys=("custkey", "priority"), delete_flag_col="gone", **extra)


def orders_merge_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    early, late = orders_feed(spark, sf)
    cfg, target = orders_config(), ddl(_ORDERS_DDL)
    return (cdc_changes(cfg, early, target, "2024-01-01 00:00:00").rows,
            cdc_changes(cfg, late, target, NOW).df)


@query("f3_f4_cdc_merge_orders", f"""{_ORDERS}
{_UNTOUCHED} union all select custkey, priority, status, orderkey, loaded_at from new where not gone""")
def cdc_merge_orders(spark: SparkSession, sf: str) -> DataFrame:
    held, changes = orders_merge_inputs(spark, sf)
    return merge_cdc(held, changes, ["custkey", "priority"])


@query("f3_cdc_merge_literal", f"""{_ORDERS}
{_UNTOUCHED} union all select custkey, priority, status, orderkey, loaded_at from new n
where not gone or not exists (select 1 from old o where {_MATCH})""")
def cdc_merge_literal(spark: SparkSession, sf: str) -> DataFrame:
    held, changes = orders_merge_inputs(spark, sf)
    return merge_cdc(held, changes, ["custkey", "priority"], insert_deleted=True)


_EVENT_FEED = """
with tgt as (select user_id, event_id, ts, event_type from events where ts < timestamp '2024-01-16'
  qualify row_number() over (partition by user_id order by ts desc, event_id) = 1),
chg as (select user_id, event_id, ts, event_type from events where ts >= timestamp '2024-01-16'
  qualify row_number() over (partition by user_id order by ts desc, event_id) = 1)
"""
_USERS_DDL = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type varchar(16)"


def users_config() -> PipelineConfig:
    return PipelineConfig(
        pipeline_id="ETL_USERS_001", pipeline_name="users", source_table="events",
        target_table="users", strategy="CDC", deduplicate=True, dedup_keys=("user_id",),
        dedup_order_by="ts DESC, event_id", merge_keys=("user_id",), delete_flag_col="gone")


def users_feed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events").withColumn("gone", F.col("event_type") == "error")
    cut = "timestamp_ntz'2024-01-16'"
    return events.where(f"ts < {cut}"), events.where(f"ts >= {cut}")


@query("f3_f5_cdc_merge_events", f"""{_EVENT_FEED}
select * from tgt t where not exists (select 1 from chg c where c.user_id = t.user_id)
union all select * from chg where event_type <> 'error'""")
def cdc_merge_events(spark: SparkSession, sf: str) -> DataFrame:
    """By way of the strategy dispatch."""
    early, late = users_feed(spark, sf)
    target = ddl(_USERS_DDL)
    held = dedup(early, ["user_id"], "ts DESC, event_id").select(*target.names)
    return load(users_config(), late, target, held, now=NOW)


@query("f6_j3_merge_summary", f"""{_ORDERS}
, j as (select o.priority is not null as in_t, n.priority is not null as in_c, n.gone
  from old o full join new n on {_MATCH})
select case when not in_c then 'unchanged' when in_t and gone then 'delete' when in_t then 'update'
  when gone then 'ignored' else 'insert' end as operation, count(*) as row_count
from j group by 1""")
def summary_of_merge(spark: SparkSession, sf: str) -> DataFrame:
    held, changes = orders_merge_inputs(spark, sf)
    return merge_summary(held, changes, ["custkey", "priority"])


@query("f3_t26_skip_unchanged", """
with old as (select c_custkey as custkey, c_mktsegment as segment, c_nationkey as nation,
    timestamp '2024-01-01 00:00:00' as loaded_at from customer),
new as (select c_custkey as custkey, c_mktsegment as segment,
    cast(case when c_custkey % 4 = 0 then c_nationkey + 1 else c_nationkey end as int) as nation,
    timestamp '2024-02-01 00:00:00' as loaded_at from customer)
select n.custkey, n.segment, n.nation,
  case when o.segment = n.segment and o.nation = n.nation then o.loaded_at else n.loaded_at end as loaded_at
from old o join new n using (custkey)""")
def skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").selectExpr(
        "c_custkey as custkey", "c_mktsegment as segment", "c_nationkey as nation")
    held = customer.withColumn("loaded_at", F.expr("timestamp_ntz'2024-01-01'"))
    changes = customer.withColumn(
        "nation", F.expr("case when custkey % 4 = 0 then nation + 1 else nation end")
    ).withColumn("loaded_at", F.lit(NOW).cast("timestamp_ntz"))
    return merge_cdc(held, changes, ["custkey"], skip_unchanged=True)


# Full runs: hooks, load, gate, mark, run log, into folders below the shared
# checkpoint folder.

@query("f7_f8_run_incremental", events_sql(_AFTER))
def run_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs, the third without new rows."""
    root = scratch_folder(spark, "run-incremental")
    schema, events = ddl(EVENTS_DDL), table(spark, sf, "events")
    control = ControlTables(spark, f"{root}/control")
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    cfg = events_config(pre_load_sql="SELECT 1", post_load_sql="")
    part = events.where("ts <= timestamp_ntz'2024-01-20 12:00:00'")
    for source in (part, events, events):
        run_pipeline(spark, cfg, schema, target, control, NOW, source)
    return target.read()


@query("f8_k7_run_log", f"""
with one as (select max(ts) as top, count(*) as n from events
    where ts <= timestamp '2024-01-20 12:00:00' and {_AFTER} and event_type <> 'error'),
two as (select count(*) as n from events
    where ts > timestamp '2024-01-20 12:00:00' and event_type <> 'error'),
mark as (select max(ts) filter (where ts <= timestamp '2024-01-20 12:00:00') as m1, max(ts) as m2 from events)
select 'SUCCESS' as status, cast(one.n as decimal(18,0)) as rows_processed,
  timestamp '2024-01-10' as mark_from, mark.m1 as mark_to,
  'SUCCESS' as pre_hook_status, 'SKIPPED' as post_hook_status, 'PASS' as quality_check_status,
  'All checks passed' as quality_check_detail from one, mark
union all
select 'SUCCESS', cast(two.n as decimal(18,0)), mark.m1, mark.m2, 'SUCCESS', 'SKIPPED', 'PASS',
  'All checks passed' from two, mark""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_folder(spark, "run-log")
    schema, events = ddl(EVENTS_DDL), table(spark, sf, "events")
    control = ControlTables(spark, f"{root}/control")
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    cfg = events_config(pre_load_sql="SELECT 1")
    part = events.where("ts <= timestamp_ntz'2024-01-20 12:00:00'")
    for hour, source in enumerate((part, events)):
        run_pipeline(spark, cfg, schema, target, control, f"2024-02-01 0{hour}:00:00", source)
    return control.run_log().select(
        "status", "rows_processed", F.col("watermark_from").cast("timestamp_ntz").alias("mark_from"),
        F.col("watermark_to").cast("timestamp_ntz").alias("mark_to"), "pre_hook_status",
        "post_hook_status", "quality_check_status", "quality_check_detail")


@query("f8_run_full_load", """
select p_partkey, upper(p_brand) as p_brand, cast(p_retailprice as decimal(18,2)) as price from part""")
def run_full(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_folder(spark, "run-full")
    schema = ddl("p_partkey bigint, p_brand varchar(16), price decimal(18,2)")
    cfg = PipelineConfig(
        pipeline_id="ETL_PART_001", pipeline_name="part", source_table=f"{sf}/part.parquet",
        target_table="part_clean", strategy="FULL_LOAD", null_check_cols=("p_partkey",),
        min_rows_expected=1,
        rules=(R.Upper("p_brand"), R.NumToDecimal("price", "p_retailprice")))
    control = ControlTables(spark, f"{root}/control")
    target = ReplaceTarget(spark, f"{root}/part_clean", schema)
    for hour in (1, 2):
        run_pipeline(spark, cfg, schema, target, control, f"2024-02-01 0{hour}:00:00")
    return target.read()


@query("a5_f8_run_cdc", f"""{_ORDERS}
, held as (select * from old where true), live as (select o.custkey, o.priority, o.status, o.orderkey
  from tgt t join old o on o.orderkey = t.o_orderkey where not t.gone)
select o.* from live o where not exists (select 1 from new n where {_MATCH})
union all select custkey, priority, status, orderkey from new where not gone""")
def run_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs into a bucketed target: the early feed, then the late one."""
    root = scratch_folder(spark, "run-cdc")
    schema = ddl(_ORDERS_DDL)
    control = ControlTables(spark, f"{root}/control")
    cfg = orders_config(null_check_cols=("orderkey",))
    target = MergeTarget(spark, f"{root}/orders_clean", schema, cfg.merge_keys, 8)
    for hour, feed in enumerate(orders_feed(spark, sf)):
        run_pipeline(spark, cfg, schema, target, control, f"2024-02-01 0{hour}:00:00", feed)
    return target.read().drop("loaded_at")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    shape = table(spark, sf, "events").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("s1_stream_incr_events", events_sql(_AFTER))
def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """Run twice on one checkpoint; the second run finds nothing."""
    root = scratch_folder(spark, "stream-incr")
    schema = ddl(EVENTS_DDL)
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    for _ in range(2):
        stream_incremental(_event_stream(spark, sf), events_config(), schema, target,
                           f"{root}/checkpoint", NOW).awaitTermination()
    return target.read()


@query("s2_stream_cdc_events", """
select user_id, event_id, ts, event_type from (select * from events
  qualify row_number() over (partition by user_id order by ts desc, event_id) = 1)
where event_type <> 'error'""")
def stream_users(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_folder(spark, "stream-cdc")
    schema = ddl(_USERS_DDL)
    target = MergeTarget(spark, f"{root}/users", schema, ["user_id"], 8)
    changes = _event_stream(spark, sf).withColumn("gone", F.col("event_type") == "error")
    stream_cdc(changes, users_config(), schema, target, f"{root}/checkpoint", NOW).awaitTermination()
    return target.read()


@query("t27_backfill", events_sql(_AFTER))
def backfilled(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, back to a date in the first, load again: one clean load."""
    from tidemark.plans.runner import backfill

    root = scratch_folder(spark, "backfill")
    schema, events = ddl(EVENTS_DDL), table(spark, sf, "events")
    control = ControlTables(spark, f"{root}/control")
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    cfg = events_config()
    part = C.newer_than(events, "ts", "1970-01-01", "2024-01-20 12:00:00")
    run_pipeline(spark, cfg, schema, target, control, NOW, part)
    run_pipeline(spark, cfg, schema, target, control, NOW, events)
    backfill(control, cfg, target, "2024-01-15", NOW)
    run_pipeline(spark, cfg, schema, target, control, NOW, events)
    return target.read()


# Gates, keys, retries and orders.

def _quietly(run) -> None:
    """Run a load that the quality gate stops."""
    from tidemark.operators.quality import QualityError

    try:
        run()
    except QualityError:
        return
    raise AssertionError("the gate let a bad batch pass")


@query("f1_t13_gate_blocks", events_sql(f"{_AFTER} and ts <= timestamp '2024-01-20 12:00:00'"))
def gate_blocks_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """A second batch without values in a checked column: nothing of it becomes visible, and the mark stays,
    so the third run is stopped by the same rows."""
    root = scratch_folder(spark, "gate-incremental")
    schema, events = ddl(EVENTS_DDL), table(spark, sf, "events")
    control = ControlTables(spark, f"{root}/control")
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    cut = "ts <= timestamp_ntz'2024-01-20 12:00:00'"
    bad = events.withColumn("props", F.when(F.expr(cut), F.col("props")))
    run_pipeline(spark, events_config(), schema, target, control, NOW, events.where(cut))
    for hour in (1, 2):
        _quietly(lambda: run_pipeline(spark, events_config(), schema, target, control, f"2024-02-01 0{hour}:00:00", bad))
    return target.read()


@query("f2_t13_gate_blocks", "select p_partkey, p_brand, p_size from part")
def gate_blocks_full(spark: SparkSession, sf: str) -> DataFrame:
    """A full load with too few rows leaves the table that it would have replaced."""
    root = scratch_folder(spark, "gate-full")
    schema, part = ddl("p_partkey bigint, p_brand varchar(16), p_size int"), table(spark, sf, "part")
    control = ControlTables(spark, f"{root}/control")
    target = ReplaceTarget(spark, f"{root}/part", schema)
    cfg = PipelineConfig(pipeline_id="ETL_PART_002", pipeline_name="part", source_table="part", target_table="part",
                         strategy="FULL_LOAD", null_check_cols=("p_partkey",), min_rows_expected=10)
    run_pipeline(spark, cfg, schema, target, control, "2024-02-01 01:00:00", part)
    _quietly(lambda: run_pipeline(spark, cfg, schema, target, control, "2024-02-01 02:00:00", part.where("p_partkey < 5")))
    return target.read()


_IDS = {"purchase": "A_B", "view": "A B", "click": "A=5f=B", "signup": "A/B", "error": "A%5FB"}


@query("a3_key_collision", """
select event_id, event_type from events where event_type not in ('view', 'signup')""")
def key_collision(spark: SparkSession, sf: str) -> DataFrame:
    """A batch per event type under ids that differ in special characters only, each written twice; two of
    them are dropped."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    target = AppendTarget(spark, scratch_folder(spark, "collision"), ddl("event_id bigint, event_type varchar(16)"))
    for kind, name in _IDS.items():
        for _ in range(2):
            target.write(events.where(F.col("event_type") == kind), target.load_key(name, "2024-01-01"))
    rest = events.where(~F.col("event_type").isin(*_IDS))
    target.write(rest, target.load_key("AB", "2024-01-01"))
    gone = [target.load_key(_IDS[kind], "2024-01-01") for kind in ("view", "signup")]
    target.drop_batches(spark.createDataFrame([(k,) for k in gone], "load_key string"))
    return target.read()


@query("t27_backfill_numeric", "select event_id, event_type from events where event_id > 100")
def backfilled_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """Marks that are numbers: three batches, back into the second, load again."""
    from tidemark.plans.runner import backfill

    root = scratch_folder(spark, "backfill-number")
    schema, events = ddl("event_id bigint, event_type varchar(16)"), table(spark, sf, "events")
    control = ControlTables(spark, f"{root}/control")
    target = AppendTarget(spark, f"{root}/events", schema)
    cfg = PipelineConfig(pipeline_id="ETL_%_002", pipeline_name="by id", source_table="events", target_table="events",
                         strategy="INCREMENTAL", watermark_col="event_id", watermark_initial="100")
    for i, top in enumerate((300, 600, 1 << 60)):
        run_pipeline(spark, cfg, schema, target, control, f"2024-02-01 0{i}:00:00", events.where(F.col("event_id") <= top))
    backfill(control, cfg, target, "450", NOW)
    run_pipeline(spark, cfg, schema, target, control, "2024-02-01 05:00:00", events)
    return target.read()


@query("a5_null_key_retry", f"""{_ORDERS}
select custkey, priority, status, orderkey from old""")
def null_key_retry(spark: SparkSession, sf: str) -> DataFrame:
    """A change set with incomplete keys, merged three times under one name."""
    early, _ = orders_feed(spark, sf)
    schema = ddl(_ORDERS_DDL)
    target = MergeTarget(spark, scratch_folder(spark, "null-keys"), schema, ["custkey", "priority"], 8)
    for hour in (1, 2, 3):
        changes = cdc_changes(orders_config(), early.withColumn("gone", F.lit(False)), schema, f"2024-01-01 0{hour}:00:00").df
        target.merge(changes, batch_id="orders@1")
    return target.read().drop("loaded_at")


def _small_batches(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """The events as a stream of four micro-batches, in no order of time."""
    events = table(spark, sf, "events").withColumn("gone", F.lit(False))
    events.repartition(4, "event_id").write.parquet(f"{root}/feed")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed")


def _streamed_users(spark: SparkSession, sf: str, order_by: str, name: str) -> DataFrame:
    """Two queries, each with its own checkpoint: the second replays all that the first has merged."""
    from dataclasses import replace

    root = scratch_folder(spark, name)
    schema = ddl(_USERS_DDL)
    target = MergeTarget(spark, f"{root}/users", schema, ["user_id"], 8)
    stream = _small_batches(spark, sf, root)
    for run in (1, 2):
        stream_cdc(stream, replace(users_config(), dedup_order_by=order_by), schema, target,
                   f"{root}/checkpoint{run}", NOW).awaitTermination()
    return target.read()


@query("s2_ties_and_replay", """
select user_id, event_id, ts, event_type from events
qualify row_number() over (partition by user_id order by event_type, event_id) = 1""")
def stream_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """An ascending order of few values: most changes tie, in and between micro-batches."""
    return _streamed_users(spark, sf, "event_type", "stream-ties")


@query("s2_numeric_order", """
select user_id, event_id, ts, event_type from events
qualify row_number() over (partition by user_id order by event_id % 7 desc, floor(value), event_id desc) = 1""")
def stream_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """Three items of an order that is no time, in both directions."""
    return _streamed_users(spark, sf, "event_id % 7 DESC, floor(value), event_id DESC", "stream-number")


@query("f8_submit_to_run", events_sql(_AFTER))
def submit_to_run(spark: SparkSession, sf: str) -> DataFrame:
    """From a submitted configuration to loaded rows: submit, approve, deploy, seed the mark, run twice. All
    that the runs know comes from the stored document."""
    from tidemark.config import config_rows
    from tidemark.plans.runner import NotDeployed, run_stored

    root = scratch_folder(spark, "submit-to-run")
    control = ControlTables(spark, f"{root}/control")
    schema, pid = ddl(EVENTS_DDL), "ETL_EVENTS_001"
    control.submit(config_rows(spark, [events_config()], NOW, "ann"))
    target = AppendTarget(spark, f"{root}/events_clean", schema)
    source = table(spark, sf, "events")
    try:
        run_stored(spark, control, pid, schema, target, NOW, source)
        raise AssertionError("ran before it was deployed")
    except NotDeployed:
        pass
    control.event(pid, "approve", NOW, "bob", "LOAD", "TASK_EVENTS")
    control.event(pid, "deploy", NOW)
    control.seed_marks(NOW)
    for clock in (NOW, "2024-02-01 01:00:00"):
        run_stored(spark, control, pid, schema, target, clock, source)
    return target.read()


def _stopped_run(spark: SparkSession, name: str, schema, source: DataFrame) -> DataFrame:
    """Log of a full load that the target's declarations stop."""
    root = scratch_folder(spark, name)
    control = ControlTables(spark, f"{root}/control")
    target = ReplaceTarget(spark, f"{root}/table", schema)
    cfg = PipelineConfig(pipeline_id="ETL_DECLARED", pipeline_name=name, source_table=name, target_table=name,
                         strategy="FULL_LOAD")
    _quietly(lambda: run_pipeline(spark, cfg, schema, target, control, NOW, source))
    return control.run_log().select("status", "rows_processed", "quality_check_detail",
                                    F.lit(target.read().count()).cast("long").alias("visible"))


@query("q2_not_null_target", """
select 'QUALITY_FAIL' as status, cast(count(*) as decimal(18,0)) as rows_processed,
  'NOT_NULL_FAIL: col=custkey rows=' || count(*) filter (o_orderkey % 40 = 0) || '; ' as quality_check_detail,
  cast(0 as bigint) as visible from orders""")
def not_null_target(spark: SparkSession, sf: str) -> DataFrame:
    """NULLs in a column that the target declares NOT NULL."""
    source = table(spark, sf, "orders").selectExpr(
        "o_orderkey as orderkey", "case when o_orderkey % 40 = 0 then null else o_custkey end as custkey")
    return _stopped_run(spark, "not-null", ddl("orderkey bigint not null, custkey bigint not null"), source)


@query("m9_width_in_run", """
select 'QUALITY_FAIL' as status, cast(count(*) as decimal(18,0)) as rows_processed,
  'WIDTH_FAIL: col=text rows=' || count(*) filter (length(text) > 500) || ' (width=500); WIDTH_FAIL: col=source rows='
  || count(*) filter (length(source) > 4) || ' (width=4); ' as quality_check_detail, cast(0 as bigint) as visible from documents""")
def width_in_run(spark: SparkSession, sf: str) -> DataFrame:
    """Texts wider than their columns, counted over whole texts."""
    source = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    schema = ddl("doc_id bigint not null, text varchar(500), lang varchar(8), source varchar(4)")
    return _stopped_run(spark, "widths", schema, source)
