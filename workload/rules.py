"""Transformation rules, one query per group."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import scalars as S
from workload.base import query, table


def applied(df: DataFrame, keys: list[str], *rules: R.Rule) -> DataFrame:
    """Key columns and the outcome of each rule."""
    return df.alias("src").select(*keys, *[r.column().alias(r.target) for r in rules])


@query("d4_d8_dates", """
with raw as (
  select o_orderkey,
    case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
      when 1 then strftime(o_orderdate, '%m/%d/%Y')
      when 2 then upper(strftime(o_orderdate, '%d-%b-%Y'))
      when 3 then 'n/a' end as d,
    case when o_orderkey % 7 = 0 then 'soon'
      else strftime(o_orderdate, '%Y-%m-%d') || ' 12:30:00' end as t
  from orders)
select o_orderkey,
  cast(try_strptime(d, '%Y-%m-%d') as date) as iso_date,
  cast(try_strptime(d, '%m/%d/%Y') as date) as us_date,
  cast(try_strptime(d, '%d-%b-%Y') as date) as mon_date,
  cast(try_strptime(d, ['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y']) as date) as any_date,
  try_cast(t as timestamp) as happened_at
from raw""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
             when 1 then date_format(o_orderdate, 'MM/dd/yyyy')
             when 2 then upper(date_format(o_orderdate, 'dd-MMM-yyyy'))
             when 3 then 'n/a' end as d""",
        """case when o_orderkey % 7 = 0 then 'soon'
             else date_format(o_orderdate, 'yyyy-MM-dd') || ' 12:30:00' end as t""",
    )
    return applied(
        raw, ["o_orderkey"],
        R.ToDate("iso_date", "d"),
        R.ToDate("us_date", "d", ("MM/dd/yyyy",)),
        R.ToDate("mon_date", "d", ("dd-MMM-yyyy",)),
        R.ToDate("any_date", "d", ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy")),
        R.ToTimestamp("happened_at", "t"),
    )


@query("d9_d12_d29_numbers", """
with raw as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    case when l_orderkey % 9 = 0 then null else l_extendedprice end as price,
    case when l_orderkey % 11 = 0 then 'n/a' else format('{:,.2f}', l_extendedprice) end as txt,
    cast(cast(l_discount * 100 as decimal(8,2)) as varchar) || '%' as pct,
    case when l_orderkey % 13 = 0 then 'x' else cast(cast(l_quantity as decimal(8,1)) as varchar) end as qty
  from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  coalesce(cast(price as decimal(18,2)), 0) as price_num,
  try_cast(replace(txt, ',', '') as decimal(18,2)) as price_txt,
  try_cast(replace(pct, '%', '') as decimal(8,4)) as discount_pct,
  try_cast(qty as decimal(4,0)) as quantity,
  coalesce(price, 0) as price_or_zero,
  round(l_extendedprice, 0) as price_rounded
from raw""")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "case when l_orderkey % 9 = 0 then null else l_extendedprice end as price",
        "case when l_orderkey % 11 = 0 then 'n/a' else format_number(l_extendedprice, 2) end as txt",
        "string(cast(l_discount * 100 as decimal(8,2))) || '%' as pct",
        "case when l_orderkey % 13 = 0 then 'x' else string(cast(l_quantity as decimal(8,1))) end as qty",
    )
    return applied(
        raw, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
        R.NumToDecimal("price_num", "price"),
        R.StrToDecimal("price_txt", "txt", strip=","),
        R.StrToDecimal("discount_pct", "pct", 8, 4, strip="%"),
        R.StrToDecimal("quantity", "qty", 4, 0),
        R.Coalesce("price_or_zero", "price", 0.0),
        R.Round("price_rounded", "l_extendedprice", 0),
    )


@query("d13_epoch", """
select event_id, date_trunc('milliseconds', ts) as happened_at from events""")
def epoch(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        "event_id",
        F.timestamp_diff("MILLISECOND", S.ntz("1970-01-01"), "ts").cast("decimal(18,0)").alias("ms"),
    )
    return applied(raw, ["event_id"], R.EpochMs("happened_at", "ms"))


@query("d14_d16_hashes", """
select c_custkey, sha256(c_name) as name_hash, sha256(cast(c_custkey as varchar)) as key_hash,
  md5(c_name) as name_md5, 56 as width_224, 128 as width_512
from customer""")
def hashes(spark: SparkSession, sf: str) -> DataFrame:
    out = applied(
        table(spark, sf, "customer"), ["c_custkey"],
        R.Mask("name_hash", "c_name"), R.Mask("key_hash", "c_custkey"), R.Md5("name_md5", "c_name"),
        R.Mask("h224", "c_name", 224), R.Mask("h512", "c_name", 512),
    )
    return out.select(
        "c_custkey", "name_hash", "key_hash", "name_md5",
        F.length("h224").alias("width_224"), F.length("h512").alias("width_512"),
    )


@query("d17_d23_d30_strings", """
with raw as (
  select p_partkey, '  ' || p_name || ' ' as padded, p_brand, p_type,
    case when p_partkey % 4 = 0 then null else p_brand end as brand,
    case when p_partkey % 5 = 0 then null else p_size end as size,
    case p_partkey % 5 when 0 then 'A' when 1 then 'S' when 2 then 'C' when 3 then 'Z' end as code
  from part)
select p_partkey, p_brand as brand_name, coalesce(size, 0) as size, coalesce(brand, 'NONE') as brand,
  trim(padded) as name, upper(p_type) as type_upper, lower(p_type) as type_lower,
  trim(padded) || ' ' || trim(brand) as label,
  case when size > 25 then 'HIGH' else 'LOW' end as size_flag,
  case code when 'A' then 'Active' when 'S' then 'Suspended' when 'C' then 'Closed' end as status,
  replace(p_brand, 'Brand#', 'B-') as short_brand
from raw""")
def strings(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey", "'  ' || p_name || ' ' as padded", "p_brand", "p_type",
        "case when p_partkey % 4 = 0 then null else p_brand end as brand",
        "case when p_partkey % 5 = 0 then null else p_size end as size",
        """case p_partkey % 5 when 0 then 'A' when 1 then 'S' when 2 then 'C'
             when 3 then 'Z' end as code""",
    )
    return applied(
        raw, ["p_partkey"],
        R.Rename("brand_name", "p_brand"), R.Coalesce("size"), R.Coalesce("brand", value="NONE"),
        R.Trim("name", "padded"), R.Upper("type_upper", "p_type"), R.Lower("type_lower", "p_type"),
        R.ConcatWords("label", "padded", "brand"), R.Flag("size_flag", "size", 25),
        R.Decode("status", "code", (("A", "Active"), ("S", "Suspended"), ("C", "Closed"))),
        R.Replace("short_brand", "p_brand", "Brand#", "B-"),
    )


@query("d24_bands", """
with raw as (
  select c_custkey, case when c_custkey % 10 = 0 then null else c_acctbal end as bal,
    cast(c_custkey % 13 as varchar) as score
  from customer)
select c_custkey,
  case when bal <= 1000 then 'LOW' when bal <= 5000 then 'MEDIUM' when bal is not null then 'HIGH' end
    as balance_band,
  case when cast(score as int) < 1 then null when cast(score as int) <= 3 then 'LOW'
    when cast(score as int) <= 5 then 'MEDIUM' when cast(score as int) <= 7 then 'HIGH'
    when cast(score as int) <= 10 then 'CRITICAL' end as risk_band
from raw""")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 10 = 0 then null else c_acctbal end as bal",
        "string(c_custkey % 13) as score",
    )
    return applied(
        raw, ["c_custkey"],
        R.Band("balance_band", "bal", ((1000, "LOW"), (5000, "MEDIUM")), else_="HIGH"),
        R.Band("risk_band", "score", ((3, "LOW"), (5, "MEDIUM"), (7, "HIGH"), (10, "CRITICAL")),
               lower=1, cast="int"),
    )


@query("d25_csv_count", """
with raw as (select doc_id, case when doc_id % 6 = 0 then null else text end as t from documents)
select doc_id, cast(len(string_split(t, ',')) as int) as parts,
  cast(len(string_split(t, '.')) as int) as sentences from raw""")
def csv_count(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").selectExpr(
        "doc_id", "case when doc_id % 6 = 0 then null else text end as t")
    return applied(raw, ["doc_id"], R.CsvCount("parts", "t"), R.CsvCount("sentences", "t", "."))


@query("d26_d27_booleans", """
with raw as (
  select o_orderkey, case o_orderkey % 7 when 0 then 'TRUE' when 1 then 'FALSE' when 2 then 'yes'
    when 3 then '0' when 4 then 'junk' when 5 then 'true' end as t from orders)
select o_orderkey,
  case when lower(t) in ('true', 't', 'yes', 'y', '1') then true
    when lower(t) in ('false', 'f', 'no', 'n', '0') then false end as cast_form,
  case when t = 'TRUE' then true else false end as case_form
from raw""")
def booleans(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 7 when 0 then 'TRUE' when 1 then 'FALSE' when 2 then 'yes'
             when 3 then '0' when 4 then 'junk' when 5 then 'true' end as t""")
    return applied(raw, ["o_orderkey"], R.ToBool("cast_form", "t"), R.IsTrue("case_form", "t"))


@query("d1_d3_d34_json", """
with raw as (
  select event_id, case when event_id % 13 = 0 then '{bad' else
      '{"a":{"b":' || event_id || ',"w":1.5},"kind":"' || event_type || '","none":null,"tags":["'
      || event_type || '","x' || event_id % 5 || '"]}' end as j,
    case when event_id % 4 = 0 then null else '["' || event_type || '","' || event_id || '"]' end as arr
  from events),
ok as (select event_id, case when json_valid(j) then j end as j, arr from raw)
select event_id, cast(json_extract_string(j, '$.a.b') as bigint) as b,
  cast(json_extract_string(j, '$.a.w') as double) as w, json_extract_string(j, '$.kind') as kind,
  json_extract_string(j, '$.none') as none, json_extract_string(j, '$.missing') as missing,
  json_extract_string(j, '$.tags[1]') as second_tag,
  cast(json_array_length(arr) as int) as n, json_extract_string(arr, '$[1]') as second,
  json_extract_string(arr, '$[5]') as sixth
from ok""")
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").selectExpr(
        "event_id",
        """case when event_id % 13 = 0 then '{bad' else
             '{"a":{"b":' || event_id || ',"w":1.5},"kind":"' || event_type
             || '","none":null,"tags":["' || event_type || '","x' || event_id % 5 || '"]}' end as j""",
        """case when event_id % 4 = 0 then null
             else '["' || event_type || '","' || event_id || '"]' end as arr""",
    )
    out = applied(
        raw.withColumn("n", S.json_array_size("arr")).withColumn("second", S.json_array_get("arr", 1))
        .withColumn("sixth", S.json_array_get("arr", 5)),
        ["event_id", "n", "second", "sixth"],
        R.JsonField("b", "j", "a.b", "bigint"), R.JsonField("w", "j", "a.w", "double"),
        *R.json_fields("j", {"kind": "kind", "none": "none", "missing": "missing",
                             "second_tag": "$.tags[1]"}),
    )
    return out


@query("d28_d31_d33_time", """
with raw as (
  select event_id, ts, ts + to_seconds(cast(event_id % 10007 as double)) as later from events)
select event_id, cast(year(ts) as int) as y, strftime(ts, '%Y%m%d_%H%M%S_%g') as stamp,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as plain,
  date_diff('hour', ts, later) as hours, date_diff('minute', ts, later) as minutes,
  date_diff('second', ts, later) as seconds, date_diff('day', later, ts) as days_back,
  ts - interval 24 hours as day_before, ts - interval 1 day as prior_day
from raw""")
def time_functions(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        "event_id", "ts",
        F.expr("ts + make_dt_interval(0, 0, 0, event_id % 10007)").alias("later"),
    )
    return applied(
        raw.select(
            "*",
            S.boundary_diff("hour", "ts", "later").alias("hours"),
            S.boundary_diff("minute", "ts", "later").alias("minutes"),
            S.boundary_diff("second", "ts", "later").alias("seconds"),
            S.boundary_diff("day", "later", "ts").alias("days_back"),
            S.shift("ts", -24, "hour").alias("day_before"),
            S.shift("ts", -1, "day").alias("prior_day"),
        ),
        ["event_id", "hours", "minutes", "seconds", "days_back", "day_before", "prior_day"],
        R.Year("y", "ts"), R.FormatTs("stamp", "ts", "yyyyMMdd_HHmmss_SSS"),
        R.FormatTs("plain", "ts"),
    )


@query("d35_d38_names", """
with raw as (
  select p_partkey, p_name || '-' || p_brand as label, timestamp '2024-02-01 10:20:30' as made_at,
    'DB.' || p_type || '.' || p_name as tbl,
    case p_partkey % 4 when 0 then 'FULL_LOAD' when 1 then 'INCREMENTAL' when 2 then 'CDC' end as strategy
  from part)
select p_partkey,
  substring(regexp_replace(upper(label), '[^\\p{L}\\p{N}]', '_', 'g'), 1, 24) as slug,
  'ETL_' || substring(regexp_replace(upper(label), '[^\\p{L}\\p{N}]', '_', 'g'), 1, 24)
    || '_' || strftime(made_at, '%Y%m%d%H%M%S') as pipeline_id,
  substring('TASK_' || replace(replace(upper(label), ' ', '_'), '-', '_'), 1, 50) as task,
  split_part(tbl, '.', 3) as last_part, substring(cast(made_at as varchar), 1, 16) as minute_text,
  case strategy when 'FULL_LOAD' then 'Full' when 'INCREMENTAL' then 'Incr' when 'CDC' then 'CDC'
    else '—' end as strategy_label,
  tbl || ':' || strategy as joined, timestamp '2024-02-01 00:00:00' as stamped_at, 'loader' as stamped_by
from raw""")
def names(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(
        "p_partkey", F.expr("p_name || '-' || p_brand").alias("label"),
        S.ntz("2024-02-01 10:20:30").alias("made_at"),
        F.expr("'DB.' || p_type || '.' || p_name").alias("tbl"),
        F.expr("""case p_partkey % 4 when 0 then 'FULL_LOAD' when 1 then 'INCREMENTAL'
                    when 2 then 'CDC' end""").alias("strategy"),
    )
    return raw.select(
        "p_partkey", S.slug("label").alias("slug"), S.pipeline_id("label", F.col("made_at")).alias("pipeline_id"),
        S.task_name("label").alias("task"), S.last_segment("tbl").alias("last_part"),
        S.prefix("made_at").alias("minute_text"), S.strategy_label("strategy").alias("strategy_label"),
        S.concat("tbl", F.lit(":"), "strategy").alias("joined"),
        S.now_lit("2024-02-01 00:00:00").alias("stamped_at"), S.user_lit("loader").alias("stamped_by"),
    )
