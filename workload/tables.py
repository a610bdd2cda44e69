"""Sources, sinks, filters, projection, joins, aggregates and ordering."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Mapping, normalise_configs
from tidemark.functions import rules as R
from tidemark.operators import aggregates as A
from tidemark.operators import filters as C
from tidemark.operators import joins as J
from tidemark.operators.align import align
from tidemark.operators.dedup import dedup, duplicate_keys
from tidemark.schema import ddl
from tidemark.session import scratch_folder
from tidemark.sources import tables as T
from tidemark.sources.targets import AppendTarget, ReplaceTarget
from workload.base import NOW, query, table


@query("a1_scan", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a2_values_decode", """
select c_custkey, c_mktsegment, label from customer left join (values
  ('FURNITURE', 'Home'), ('HOUSEHOLD', 'Home'), ('MACHINERY', 'Industry'), ('BUILDING', 'Industry'))
  as v(code, label) on c_mktsegment = code""")
def values_decode(spark: SparkSession, sf: str) -> DataFrame:
    codes = T.values(
        spark,
        [("FURNITURE", "Home"), ("HOUSEHOLD", "Home"), ("MACHINERY", "Industry"),
         ("BUILDING", "Industry")],
        "code varchar(16), label varchar(16)",
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return J.decode_by_table(customers, "c_mktsegment", codes, "code", "label", "label")


@query("a3_append_batches", """
select event_id, ts, event_type from events""")
def append_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches; the second is written twice, as after a crash."""
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    target = AppendTarget(spark, scratch_folder(spark, "append"),
                          ddl("event_id bigint, ts timestamp_ntz, event_type varchar(16)"))
    cut = "2024-01-16 00:00:00"
    early, late = C.newer_than(events, "ts", "1970-01-01", cut), C.newer_than(events, "ts", cut)
    target.write(early, target.load_key("P", "1970-01-01"))
    for _ in range(2):
        target.write(late, target.load_key("P", cut))
    return target.read()


@query("a4_overwrite", """
select p_partkey, p_brand, p_size from part""")
def overwrite(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    target = ReplaceTarget(spark, scratch_folder(spark, "overwrite"),
                           ddl("p_partkey bigint, p_brand varchar(16), p_size int"))
    target.write(part.unionByName(part))
    target.write(part)
    return target.read()


_STATUS = "case when o_orderkey % 8 = 0 then null else o_orderstatus end"


@query("a7_delete_where", f"""
with raw as (select o_orderkey, {_STATUS} as status from orders)
select * from raw where not coalesce(status = 'F', false)""")
def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_STATUS} as status")
    return C.delete_where(raw, "status = 'F'")


@query("a8_j4_insert_absent", """
select o_orderkey, o_orderstatus, cast('old' as varchar) as origin from orders
  where o_orderdate < timestamp '1998-01-01'
union all
select o_orderkey, o_orderstatus, 'new' from orders where o_orderdate >= timestamp '1998-01-01'""")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    held = orders.where("o_orderdate < timestamp_ntz'1998-01-01'").drop("o_orderdate")
    return J.insert_absent(
        orders.drop("o_orderdate").withColumn("origin", F.lit("new")),
        held.withColumn("origin", F.lit("old")), ["o_orderkey"],
    )


@query("a9_variant", """
select event_id, cast(json_extract_string(props, '$.k') as int) as k,
  cast(null as int) as bad from events""")
def variant(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "props", F.lit("{oops").alias("junk"))
    loaded = T.with_variant(T.with_variant(events, "props"), "junk", strict=False)
    return loaded.select(
        "event_id", F.try_variant_get("props", "$.k", "int").alias("k"),
        F.try_variant_get("junk", "$.k", "int").alias("bad"),
    )


@query("a10_normalise_configs", """
with f as (
  select s_suppkey, ' ' || lower(s_name) || ' ' as nm,
    case when s_suppkey % 3 = 0 then ' id , ,updated_at' else ' ' end as ks,
    case when s_suppkey % 2 = 0 then '  ' else ' id > ' || s_suppkey end as flt
  from supplier)
select 'P' || s_suppkey as pipeline_id, trim(nm) as pipeline_name,
  upper(trim(' raw.t' || s_suppkey)) as source_table, upper(trim('clean.t' || s_suppkey || ' ')) as target_table,
  'PENDING' as status, nullif(trim(flt), '') as source_filter,
  case when s_suppkey % 3 = 0 then 'ID|UPDATED_AT' else '' end as merge_keys,
  '2020-01-01' as watermark_initial, cast(1.5 as double) as tolerance, timestamp '2024-02-01 00:00:00' as created_at
from f""")
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    forms = table(spark, sf, "supplier").selectExpr(
        "'P' || s_suppkey as pipeline_id", "' ' || lower(s_name) || ' ' as pipeline_name",
        "'finance' as domain", "'' as owner_email",
        "' raw.t' || s_suppkey as source_table",
        "case when s_suppkey % 2 = 0 then '  ' else ' id > ' || s_suppkey end as source_filter",
        "true as deduplicate", "'id' as dedup_key", "'updated_at desc' as dedup_order_by",
        "'clean.t' || s_suppkey || ' ' as target_table", "'upsert' as write_mode", "'CDC' as strategy",
        "' ' as watermark_col", "'' as watermark_initial",
        "case when s_suppkey % 3 = 0 then ' id , ,updated_at' else ' ' end as merge_keys",
        "'' as delete_flag_col", "'trim name' as nl_rules",
        "cast(array() as array<struct<source_col:string,target_col:string,expression:string>>) as column_mappings",
        "'WH' as warehouse", "'1 HOUR' as schedule", "30 as timeout_minutes", "2 as max_retries",
        "1.5 as error_tolerance_pct", "'id' as null_check_cols", "0 as min_rows_expected",
        "'' as notification_email", "'' as pre_load_sql", "'' as post_load_sql",
    )
    out = normalise_configs(forms, NOW, "loader").withColumn(
        "p", F.from_json("pipeline_params", "source struct<filter:string>, strategy struct<merge_keys:"
                         "array<string>,watermark_initial:string>, quality struct<error_tolerance_pct:double>"))
    return out.select(
        "pipeline_id", "pipeline_name", "source_table", "target_table", "status",
        F.col("p.source.filter").alias("source_filter"),
        F.array_join("p.strategy.merge_keys", "|").alias("merge_keys"),
        F.col("p.strategy.watermark_initial").alias("watermark_initial"),
        F.col("p.quality.error_tolerance_pct").alias("tolerance"), "created_at",
    )


@query("b1_align", """
select o_orderkey as order_id, o_custkey as custkey_hint, round(o_totalprice * 0.9, 0) as net_price,
  lower(o_orderstatus) as o_orderstatus, o_orderpriority, cast(o_orderdate as date) as order_day,
  cast(null as varchar) as remark, timestamp '2024-02-01 00:00:00' as loaded_at from orders""")
def align_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping, rule, same name, similar name, default and typed NULL."""
    target = ddl(
        "order_id bigint, custkey_hint bigint, net_price double, o_orderstatus varchar(1), "
        "o_orderpriority varchar(16), order_day date, remark varchar(64), loaded_at timestamp_ntz"
    )
    source = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    out, _ = align(
        source, target,
        mappings=[Mapping("o_orderkey", "order_id"),
                  Mapping("o_totalprice", "net_price", "ROUND(src.o_totalprice * 0.9, 0)"),
                  Mapping("o_orderdate", "order_day")],
        rules=[R.Lower("o_orderstatus")],
        defaults={"loaded_at": F.lit(NOW).cast("timestamp_ntz")},
    )
    return out


@query("c1_c6_filters", f"""
with raw as (select o_orderkey, o_orderpriority, {_STATUS} as status,
  case when o_orderkey % 10 = 0 then null else o_totalprice end as price from orders)
select o_orderkey, status, price from raw
where status not in ('P', 'X') and o_orderpriority <> '5-LOW' and price is not null
  and o_orderpriority like '%-%' and price > 1000""")
def filters(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderpriority", f"{_STATUS} as status",
        "case when o_orderkey % 10 = 0 then null else o_totalprice end as price",
    ).alias("src")
    kept = C.source_filter(raw, "src.status NOT IN ('P', 'X')")
    kept = C.row_rules(kept, [R.DropEq("o_orderpriority", "5-LOW"), R.DropNull("price")])
    kept = kept.where(F.col("o_orderpriority").like("%-%") & (F.col("price") > 1000))
    return kept.select("o_orderkey", "status", "price")


@query("c2_newer_than", """
select event_id, ts from events where ts > timestamp '2024-01-20 00:00:00'
  and ts <= timestamp '2024-01-25 00:00:00'""")
def newer(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts")
    return C.newer_than(events, "ts", "2024-01-20 00:00:00", "2024-01-25 00:00:00")


@query("c7_since", """
select event_id, event_type from events
where event_type in ('error', 'signup') and ts >= timestamp '2024-01-30 12:00:00' - interval 24 hours""")
def since(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    return C.since(events, "ts", "2024-01-30 12:00:00", 24).select("event_id", "event_type")


_LINE_COLS = ("l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
              "l_returnflag, l_linestatus")


@query("e1_dedup_lineitem", f"""
select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc nulls last, {_LINE_COLS}) = 1""")
def dedup_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate DESC")


@query("e1_dedup_hot_key", """
with raw as (select event_id, case when event_id % 3 = 0 then -1 else user_id end as uid,
  case when event_id % 17 = 0 then null else ts end as changed, event_type from events)
select * from raw qualify row_number() over (
  partition by uid order by changed desc nulls last, event_id, event_type) = 1""")
def dedup_hot(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows share one key; some change times are missing."""
    raw = table(spark, sf, "events").selectExpr(
        "event_id", "case when event_id % 3 = 0 then -1 else user_id end as uid",
        "case when event_id % 17 = 0 then null else ts end as changed", "event_type")
    return dedup(raw, ["uid"], "changed DESC")


@query("e3_h4_duplicate_keys", """
select l_orderkey, l_linenumber, count(*) as versions from lineitem
group by 1, 2 having count(*) > 1""")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("h1_h5_aggregates", """
select o_orderstatus, o_orderpriority, count(*) as row_count, min(o_orderdate) as oldest,
  max(o_orderdate) as newest from orders group by 1, 2 having count(*) > 2""")
def aggregates(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("o_orderdate").alias("oldest"),
        F.max("o_orderdate").alias("newest"))
    return A.having(counts, "row_count > 2")


@query("h3_null_counts", """
with raw as (select case when l_orderkey % 3 = 0 then null else l_partkey end as partkey,
  case when l_orderkey % 50 = 0 then null else l_tax end as tax, l_shipdate as shipdate from lineitem)
select 'partkey' as column_name, count(*) - count(partkey) as null_count, count(*) as total_rows from raw
union all select 'tax', count(*) - count(tax), count(*) from raw
union all select 'shipdate', count(*) - count(shipdate), count(*) from raw""")
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr(
        "case when l_orderkey % 3 = 0 then null else l_partkey end as partkey",
        "case when l_orderkey % 50 = 0 then null else l_tax end as tax", "l_shipdate as shipdate")
    return A.null_counts(raw, ["partkey", "tax", "shipdate"])


@query("h5_max", "select max(ts) as max_value from events")
def max_of(spark: SparkSession, sf: str) -> DataFrame:
    return A.max_of(table(spark, sf, "events"), "ts")


@query("h6_value_counts", "select event_type, count(*) as row_count from events group by 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(table(spark, sf, "events"), "event_type")


_COUNTED = ("customer", "orders", "lineitem", "events", "documents", "pages")


@query("h2_q7_n3_row_counts", " union all ".join(
    f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _COUNTED))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.row_counts({t: table(spark, sf, t) for t in _COUNTED})


@query("j5_missing_columns", """
with refs as (select 'RAW.T' || c_nationkey as table_name,
  case c_custkey % 3 when 0 then 'id' when 1 then 'updated_at' else 'gone' end as column_name, c_custkey
  from customer),
cols as (select 'raw.t' || n_nationkey as table_name, c as column_name from nation,
  (values ('ID'), ('Updated_At')) v(c) where n_nationkey <> 7)
select * from refs r where not exists (select 1 from cols c
  where upper(c.table_name) = upper(r.table_name) and upper(c.column_name) = upper(r.column_name))""")
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "customer").selectExpr(
        "'RAW.T' || c_nationkey as table_name",
        "case c_custkey % 3 when 0 then 'id' when 1 then 'updated_at' else 'gone' end as column_name",
        "c_custkey")
    columns = table(spark, sf, "nation").where("n_nationkey <> 7").select(
        F.expr("'raw.t' || n_nationkey").alias("table_name"),
        F.explode(F.array(F.lit("ID"), F.lit("Updated_At"))).alias("column_name"))
    return J.missing_columns(refs, columns)


@query("n1_order", """
select o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey""")
def ordered(spark: SparkSession, sf: str) -> DataFrame:
    return J.order(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
                   "o_orderdate DESC NULLS LAST, o_orderkey")


@query("n2_top_k", """
select event_id, ts, user_id from events order by ts desc, event_id limit 50""")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return J.top_k(table(spark, sf, "events").select("event_id", "ts", "user_id"),
                   "ts DESC, event_id", 50)


@query("n3_union_all", """
select o_orderkey as k, 'order' as kind from orders union all
select l_orderkey, 'line' from lineitem""")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return A.union_all(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")),
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind")),
    )
