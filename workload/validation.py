"""Configuration checks, widths and data quality."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import parse_params
from tidemark.functions import rules as R
from tidemark.operators import quality as Q
from tidemark.operators import validate as V
from tidemark.operators.align import resolve
from tidemark.schema import ddl
from workload.base import query, table

# Tables: a raw and a clean one per supplier, with differing columns.
# Kind, column, type, width, position, has a default.
_SHAPES = [
    ("RAW", "ID", "bigint", None, 1, False),
    ("RAW", "UPDATED_AT", "timestamp_ntz", None, 2, False),
    ("RAW", "CHANGED_TXT", "string", 32, 3, False),
    ("RAW", "AMOUNT", "double", None, 4, False),
    ("RAW", "RATE", "string", 16, 5, False),
    ("RAW", "GONE", "boolean", None, 6, False),
    ("CLEAN", "ID", "bigint", None, 1, False),
    ("CLEAN", "AMOUNT", "decimal(18,2)", None, 2, False),
    ("CLEAN", "RATE_PCT", "decimal(8,4)", None, 3, False),
    ("CLEAN", "HASH", "string", 32, 4, False),
    ("CLEAN", "REMARK", "string", 64, 5, False),
    ("CLEAN", "LOADED_AT", "timestamp_ntz", None, 6, True),
]
_KEPT = """not (kind = 'RAW' and name = 'GONE' and s_suppkey % 3 = 0)
    and not (kind = 'RAW' and name = 'UPDATED_AT' and s_suppkey % 5 = 0)
    and not (kind = 'CLEAN' and name = 'ID' and s_suppkey % 7 = 0)"""


def _sql_value(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


_COLUMNS_SQL = f"""columns as (
  select kind || '.S' || s_suppkey as table_name, name as column_name, type as data_type,
    cast(w as int) as width, cast(pos as int) as ordinal, true as nullable, dflt as has_default
  from supplier, (values {", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _SHAPES)})
    v(kind, name, type, w, pos, dflt)
  where {_KEPT})"""


def columns(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve columns per supplier by exploding an array, no join."""
    shapes = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(dtype).alias("type"),
                 F.lit(w).cast("int").alias("w"), F.lit(pos).alias("pos"), F.lit(dflt).alias("dflt"))
        for kind, name, dtype, w, pos, dflt in _SHAPES
    ])
    exploded = table(spark, sf, "supplier").select("s_suppkey", F.explode(shapes).alias("v"))
    return exploded.select("s_suppkey", "v.*").where(_KEPT).selectExpr(
        "kind || '.S' || s_suppkey as table_name", "name as column_name", "type as data_type",
        "w as width", "pos as ordinal", "true as nullable", "dflt as has_default")


# Configs: one per customer, over those tables, with planted mistakes.
_CONFIG_COLS = {
    "pipeline_id": "'P' || c_custkey",
    "name": "case when c_custkey % 31 = 0 then ' ' else c_name end",
    "src": "case when c_custkey % 37 = 0 then '' else 'raw.s' || c_custkey % 110 end",
    "tgt": """case when c_custkey % 41 = 0 then 'RAW.S' || c_custkey % 110
        else 'clean.s' || c_custkey % 110 end""",
    "mode": "case c_custkey % 4 when 0 then 'overwrite' else 'append' end",
    "strategy": """case c_custkey % 3 when 0 then 'INCREMENTAL' when 1 then 'FULL_LOAD' else 'CDC' end""",
    "mark": """case c_custkey % 7 when 0 then '' when 1 then 'changed_txt' else 'updated_at' end""",
    "mkey": "case c_custkey % 5 when 0 then '' when 1 then 'ID|NOPE' else 'ID' end",
    "flag": "case when c_custkey % 4 = 1 then 'gone' end",
    "dedup": "c_custkey % 2 = 0",
    "dkey": "case c_custkey % 8 when 0 then '' when 2 then 'id, missing' else 'id' end",
    "rule": "case when c_custkey % 6 <> 0 then 'HASH' end",
    "rule_in": "case when c_custkey % 12 = 1 then 'ghost' else 'id' end",
}


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").selectExpr(*[f"{e} as {n}" for n, e in _CONFIG_COLS.items()])
    params = F.to_json(F.struct(
        F.struct(F.col("name").alias("pipeline_name")).alias("identity"),
        F.struct(F.col("src").alias("table"), F.col("dedup").alias("deduplicate"),
                 F.col("dkey").alias("dedup_key")).alias("source"),
        F.struct(F.col("tgt").alias("table"), F.col("mode").alias("write_mode")).alias("target"),
        F.struct(F.col("strategy").alias("type"), F.col("mark").alias("watermark_col"),
                 F.expr("case when mkey = '' then array() else split(mkey, '[|]') end").alias("merge_keys"),
                 F.col("flag").alias("delete_flag_col")).alias("strategy"),
    ))
    rule = F.struct(
        F.col("rule").alias("target"), F.array("rule_in").alias("inputs"), F.lit(64).alias("out_width"))
    return c.select(
        "pipeline_id", parse_params(params).alias("params"),
        F.filter(F.array(rule), lambda r: r["target"].isNotNull()).alias("rules"))


_VALIDATE_SQL = "with c as (select " + ", ".join(
    f'{e} as "{n}"' for n, e in _CONFIG_COLS.items()) + f""" from customer), {_COLUMNS_SQL},
s as (select upper(table_name) as t, list(column_name) as names,
  list(column_name) filter (where data_type = 'string') as texts from columns group by 1),
p as (select c.*, upper(trim(src)) as st, upper(trim(tgt)) as tt, upper(mark) as mk, a.names as sn,
  a.texts as stx, b.names as tn
  from c left join s a on a.t = upper(trim(src)) left join s b on b.t = upper(trim(tgt))),
k as (select pipeline_id, strategy, unnest(string_split(mkey, '|')) as key, sn, tn, mkey from p where mkey <> ''),
d as (select pipeline_id, upper(trim(unnest(string_split(dkey, ',')))) as key, sn from p where dedup),
t as (select pipeline_id, unnest(tn) as col, sn, tn, rule from p)
select pipeline_id, 'M1_SOURCE_IS_TARGET' as "check", 'HARD' as severity, st as detail from p where st = tt
union all select pipeline_id, 'M2_WATERMARK_MISSING', 'HARD', mk from p
  where strategy = 'INCREMENTAL' and sn is not null and not list_contains(sn, mk)
union all select pipeline_id, 'M3_WATERMARK_IS_TEXT', 'WARN', mk from p
  where strategy = 'INCREMENTAL' and sn is not null and list_contains(stx, mk)
union all select pipeline_id, 'M4_MERGE_KEY_NOT_IN_SOURCE', 'HARD', key from k
  where strategy = 'CDC' and sn is not null and not list_contains(sn, key)
union all select pipeline_id, 'M4_MERGE_KEY_NOT_IN_TARGET', 'HARD', key from k
  where strategy = 'CDC' and tn is not null and not list_contains(tn, key)
union all select pipeline_id, 'M5_DELETE_FLAG_MISSING', 'HARD', upper(flag) from p
  where strategy = 'CDC' and flag is not null and sn is not null and not list_contains(sn, upper(flag))
union all select pipeline_id, 'M6_DEDUP_KEY_MISSING', 'HARD', key from d
  where key <> '' and sn is not null and not list_contains(sn, key)
union all select pipeline_id, 'M7_TARGET_UNMAPPED', 'WARN', col from t
  where sn is not null and (col = 'REMARK' or (col = 'HASH' and rule is null)
    or (col in ('ID', 'AMOUNT') and not list_contains(sn, col)))
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Pipeline name is required.' from p where trim(name) = ''
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Source table is required.' from p where trim(src) = ''
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Transformation rules are required.' from p where rule is null
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Watermark column is required for Incremental strategy.'
  from p where strategy = 'INCREMENTAL' and mark = ''
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Merge key column(s) required for CDC strategy.'
  from p where strategy = 'CDC' and mkey = ''
union all select pipeline_id, 'M10_REQUIRED', 'HARD', 'Dedup key column is required when deduplication is enabled.'
  from p where dedup and trim(dkey) = ''
union all select pipeline_id, 'M11_UNKNOWN_COLUMN', 'WARN', upper(rule_in) from p
  where rule is not null and sn is not null and not list_contains(sn, upper(rule_in))
union all select pipeline_id, 'M12_TABLE_MISSING', 'HARD', st from p where sn is null and st <> ''
union all select pipeline_id, 'M12_TABLE_MISSING', 'HARD', tt from p where tn is null and tt <> ''
union all select pipeline_id, 'M13_MODE_MISMATCH', 'WARN', 'INCREMENTAL with write mode overwrite' from p
  where strategy = 'INCREMENTAL' and mode = 'overwrite'"""


@query("m1_m13_validate", _VALIDATE_SQL)
def validate(spark: SparkSession, sf: str) -> DataFrame:
    return V.validate(_configs(spark, sf), columns(spark, sf))


@query("m8_width_static", f"""with {_COLUMNS_SQL},
r as (select 'clean.s' || c_custkey % 110 as table_name,
  case c_custkey % 3 when 0 then 'hash' when 1 then 'remark' else 'amount' end as target,
  cast(case when c_custkey % 2 = 0 then 64 else 128 end as int) as out_width from customer)
select r.table_name, target, width, out_width,
  'ALTER TABLE ' || r.table_name || ' MODIFY COLUMN ' || target || ' VARCHAR(' || out_width || ')' as suggestion
from r join columns c on upper(c.table_name) = upper(r.table_name) and upper(c.column_name) = upper(target)
where width is not null and out_width > width""")
def width_static(spark: SparkSession, sf: str) -> DataFrame:
    rules = table(spark, sf, "customer").selectExpr(
        "'clean.s' || c_custkey % 110 as table_name",
        "case c_custkey % 3 when 0 then 'hash' when 1 then 'remark' else 'amount' end as target",
        "case when c_custkey % 2 = 0 then 64 else 128 end as out_width")
    return V.width_static(rules, columns(spark, sf))


@query("m9_width_observed", """
with m as (select max(length(text)) as a, max(length(lang)) as b, max(length(source)) as c from documents)
select 'text' as column_name, cast(a as int) as max_length, 500 as width, a > 500 as too_long from m
union all select 'lang', cast(b as int), 8, b > 8 from m
union all select 'source', cast(c as int), 4, c > 4 from m""")
def width_observed(spark: SparkSession, sf: str) -> DataFrame:
    return V.width_observed(table(spark, sf, "documents"), {"text": 500, "lang": 8, "source": 4})


_BATCH = {
    "orderkey": "o_orderkey",
    "custkey": "case when o_orderkey % 40 = 0 then null else o_custkey end",
    "status": "case when o_orderkey % 9 = 0 then null else o_orderstatus end",
    "price": "case when o_orderkey % 200 = 0 then null else o_totalprice end",
}
_BATCH_SQL = "b as (select " + ", ".join(f"{e} as {n}" for n, e in _BATCH.items()) + " from orders)"


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {n}" for n, e in _BATCH.items()])


def _null_rows(col: str) -> str:
    return f"""select '{col}' as column_name, count(*) - count({col}) as null_count,
  count(*) as rows_loaded, (count(*) - count({col}))::double / count(*)::double * 100.0 as null_pct,
  (count(*) - count({col}))::double / count(*)::double * 100.0 > 2.0 as failed from b"""


@query("q2_check_nulls", f"with {_BATCH_SQL} " + " union all ".join(
    _null_rows(c) for c in ("custkey", "status", "price")))
def check_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return Q.check_nulls(_batch(spark, sf), ["custkey", "status", "price"], 2.0)


@query("q2_scope_target", f"""with {_BATCH_SQL}
select 'status' as column_name, count(*) - count(status) as null_count, cast(1000 as bigint) as rows_loaded,
  (count(*) - count(status))::double / 1000 * 100.0 as null_pct,
  (count(*) - count(status))::double / 1000 * 100.0 > 2.0 as failed from b""")
def nulls_in_target(spark: SparkSession, sf: str) -> DataFrame:
    """Literal form: NULLs of the whole target over the rows of one run."""
    return Q.check_nulls(_batch(spark, sf), ["status"], 2.0, rows_loaded=1000)


@query("q1_min_rows", """
select count(*) as rows_loaded, case when count(*) < 1000000000 then 'FAIL' else 'PASS' end as status,
  'MIN_ROWS_FAIL: loaded=' || count(*) || ' expected>=1000000000; ' as detail from orders""")
def min_rows(spark: SparkSession, sf: str) -> DataFrame:
    return Q.check_min_rows(table(spark, sf, "orders"), 1_000_000_000)


@query("q3_q5_verdict", f"""with {_BATCH_SQL},
m as (select count(*) as n, (count(*) - count(custkey))::double / count(*)::double * 100.0 as a,
  (count(*) - count(status))::double / count(*)::double * 100.0 as b,
  (count(*) - count(price))::double / count(*)::double * 100.0 as c from b),
d as (select n, case when n < 10 then 'MIN_ROWS_FAIL: loaded=' || n || ' expected>=10; ' else '' end
  || case when a > 2.0 then 'NULL_FAIL: col=custkey null_pct=' || a || '% (tolerance=2.0%); ' else '' end
  || case when b > 2.0 then 'NULL_FAIL: col=status null_pct=' || b || '% (tolerance=2.0%); ' else '' end
  || case when c > 2.0 then 'NULL_FAIL: col=price null_pct=' || c || '% (tolerance=2.0%); ' else '' end
  as issues from m)
select n as rows_loaded, case when issues = '' then 'PASS' else 'FAIL' end as status,
  case when issues = '' then 'All checks passed' else issues end as detail from d""")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_check(_batch(spark, sf), ["custkey", "status", "price"], 2.0, 10)


@query("q4_cast_errors", """
with raw as (select case o_orderkey % 20 when 0 then 'n/a' when 1 then null else '12.5' end as amount,
  case when o_orderkey % 30 = 0 then '1/1/24' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders),
m as (select count(*) as n, count(*) filter (where amount = 'n/a') as a,
  count(*) filter (where day = '1/1/24') as d from raw)
select 'amount' as column_name, a as error_count, n as total_rows, a::double / n::double * 100.0 as error_pct from m
union all select 'day', d, n, d::double / n::double * 100.0 from m""")
def cast_errors(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").selectExpr(
        "case o_orderkey % 20 when 0 then 'n/a' when 1 then null else '12.5' end as amount",
        """case when o_orderkey % 30 = 0 then '1/1/24'
             else date_format(o_orderdate, 'yyyy-MM-dd') end as day""")
    plan = resolve(raw.schema, ddl("amount decimal(18,2), day date"),
                   rules=[R.StrToDecimal("amount"), R.ToDate("day")])
    return Q.cast_errors(raw.alias("src"), plan.cast_checks)


@query("q6_check_unique", """
with d as (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
select count(*) as duplicate_keys, cast(sum(n - 1) as bigint) as surplus_rows,
  case when count(*) > 0 then 'FAIL' else 'PASS' end as status from d""")
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return Q.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
