import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.config import Mapping, PipelineConfig
from tidemark.functions import rules as R
from tidemark.operators import control as K
from tidemark.operators import filters as C
from tidemark.operators import marks as M
from tidemark.operators import quality as Q
from tidemark.operators.align import align, similar_name
from tidemark.operators.dedup import dedup, order_items
from tidemark.operators.merge import (
    DuplicateChangeKeys, anti_merge, merge_cdc, merge_summary, require_unique,
)
from tidemark.plans.loads import load, load_incremental
from tidemark.schema import columns_table, ddl, plain_schema


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# projection
def test_similar_names():
    assert similar_name("INTEREST_RATE_PCT", ["INTEREST_RATE", "X"]) == "INTEREST_RATE"
    assert similar_name("DETECTION_TIMESTAMP", ["DETECTION_TIMESTAMP_MS"]) == "DETECTION_TIMESTAMP_MS"
    assert similar_name("Customer-Id", ["customerid"]) == "customerid"
    assert similar_name("ID", ["ORDER_ID", "USER_ID"]) is None
    assert similar_name("RATE", ["CORPORATE"]) is None


def test_align_priorities_and_warnings(spark):
    src = spark.createDataFrame([(1, "x", 2.345, 9)], "id bigint, name string, rate double, secret int")
    out, warnings = align(
        src, ddl("id bigint, label varchar(4), name varchar(8), rate_pct decimal(8,2), gap date, at timestamp_ntz"),
        [Mapping("name", "label", "upper(src.name) || '!'")],
        [R.Lower("label", "name"), R.Upper("name"), R.Trim("at", "ghost")] [:2],
        {"at": F.lit("2024-01-01").cast("timestamp_ntz")},
    )
    assert out.columns == ["id", "label", "name", "rate_pct", "gap", "at"]
    row = out.first()
    assert (row["label"], row["name"], str(row["rate_pct"]), row["gap"]) == ("X!", "X", "2.35", None)
    assert row["at"] == dt.datetime(2024, 1, 1)
    assert [(w.column, w.kind) for w in warnings] == [("gap", "UNMAPPED")]


def test_copied_text_is_cast_tolerantly(spark):
    from tidemark.operators.align import resolve

    src = spark.createDataFrame([("7", "x", "2024-01-02")], "n string, m string, day_txt string")
    target = ddl("n int, amount int, day date")
    maps = [Mapping("m", "amount")]
    row = align(src, target, maps)[0].first()
    assert tuple(row) == (7, None, dt.date(2024, 1, 2))
    assert set(resolve(src.schema, target, maps).cast_checks) == {"n", "amount", "day"}


# filters
def test_mark_filter_is_strict_and_reaches_the_scan(spark, folder):
    spark.sql("select timestamp_ntz'2024-01-01' + make_dt_interval(id) as ts, id from range(10)").union(
        spark.sql("select cast(null as timestamp_ntz), 99L")).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    got = C.newer_than(df, "ts", "2024-01-03", "2024-01-05")
    assert sorted(r["id"] for r in got.collect()) == [3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan and "LessThanOrEqual(ts," in plan


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert bag(C.delete_where(df, "c = 'a'")) == Counter({("b",): 1, (None,): 1})


# dedup
def test_order_text():
    assert order_items("UPDATED_AT DESC, coalesce(a, b) asc nulls first,id") == [
        ("UPDATED_AT", True, True), ("coalesce(a, b)", False, False), ("id", False, True)]
    assert order_items(None) == []


def test_dedup_nulls_and_ties(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, 5, "b"), (2, None, "z"), (2, None, "y"), (None, 1, "n"), (None, 2, "m")],
        "k int, at int, v string")
    want = Counter({(1, 5, "b"): 1, (2, None, "y"): 1, (None, 2, "m"): 1})
    assert bag(dedup(df, ["k"], "at DESC")) == want
    assert bag(dedup(df.orderBy(F.desc("v")), ["k"], "at DESC")) == want


def test_dedup_with_a_variant_column(spark):
    df = spark.sql("select * from values (1, 5, '{\"a\":2}'), (1, 5, '{\"a\":1}') t(k, at, j)")
    df = df.withColumn("j", F.parse_json("j"))
    got = dedup(df, ["k"], "at DESC").select(F.to_json("j").alias("j")).collect()
    assert [r["j"] for r in got] == ['{"a":1}']


def test_dedup_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 7 as k", "id as at")
    plan = dedup(df, ["k"], "at DESC")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filter_comes_before_dedup(spark):
    """An older allowed row wins over a newer one that is filtered out."""
    src = spark.sql("select * from values (1, 'ok', timestamp_ntz'2024-01-01'), "
                    "(1, 'bad', timestamp_ntz'2024-01-02') t(id, status, updated_at)")
    cfg = PipelineConfig("P", "p", "s", "t", "INCREMENTAL", source_filter="status <> 'bad'",
                         deduplicate=True, dedup_keys=("id",), dedup_order_by="updated_at DESC",
                         watermark_col="updated_at")
    got = load_incremental(cfg, src, ddl("id int, status varchar(8)"), "2020-01-01").df
    assert bag(got) == Counter({(1, "ok"): 1})


# merge
def frames(spark):
    t = spark.createDataFrame(
        [(1, "a", 10), (2, "b", 20), (3, "c", 30), (None, "n", 40)], "k int, j string, v int")
    c = spark.createDataFrame(
        [(1, "a", 11, False), (2, "b", 21, True), (3, "x", 31, False), (4, "d", 41, True),
         (None, "n", 51, False), (3, "c", 30, None)], "k int, j string, v int, _deleted boolean")
    return t, c


def test_merge_composite_keys_and_nulls(spark):
    t, c = frames(spark)
    want = Counter({(1, "a", 11): 1, (3, "c", 30): 1, (3, "x", 31): 1, (None, "n", 40): 1, (None, "n", 51): 1})
    assert bag(merge_cdc(t, c, ["k", "j"])) == want
    assert bag(anti_merge(t, c, ["k", "j"])) == want
    literal = want + Counter({(4, "d", 41): 1})
    assert bag(merge_cdc(t, c, ["k", "j"], insert_deleted=True)) == literal
    ops = {r[0]: r[1] for r in merge_summary(t, c, ["k", "j"]).collect()}
    assert ops == {"update": 2, "delete": 1, "insert": 2, "ignored": 1, "unchanged": 1}
    ops = {r[0]: r[1] for r in merge_summary(t, c, ["k", "j"], skip_unchanged=True).collect()}
    assert ops == {"update": 1, "delete": 1, "insert": 2, "ignored": 1, "unchanged": 2}


def test_duplicate_changes_are_refused(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 2)], "k int, v int")
    with pytest.raises(DuplicateChangeKeys, match="versions=2"):
        require_unique(c, ["k"])
    require_unique(c.where("v = 1"), ["k"])
    cfg = PipelineConfig("P", "p", "s", "t", "CDC", merge_keys=("k",))
    with pytest.raises(DuplicateChangeKeys):
        load(cfg, c, ddl("k int, v int"), spark.createDataFrame([], "k int, v int"))


def test_unmatched_null_keys_are_spread(spark):
    from tidemark.operators.merge import null_key_salt

    df = spark.range(2000).selectExpr("cast(null as int) as k", "id as v")
    assert df.select(null_key_salt(df, ["k"]).alias("s")).distinct().count() > 500


# status fold
def replay(configs, events):
    """The transitions one after the other, for comparison."""
    state, ok = dict(configs), {}
    for pid, seq, kind in sorted(events, key=lambda e: e[1]):
        now = state.get(pid)
        guard = {"approve": ["PENDING"], "deploy": ["APPROVED"], "reject": ["PENDING"],
                 "reset": ["FAILED", "REJECTED"]}.get(kind)
        good = now is not None and kind in K.TRANSITIONS and (guard is None or now in guard)
        ok[pid, seq] = good
        if good:
            state[pid] = {"approve": "APPROVED", "deploy": "DEPLOYED", "reject": "REJECTED",
                          "reset": "PENDING", "fail": "FAILED", "decommission": "DECOMMISSIONED"}[kind]
    return state, ok


@pytest.mark.parametrize("bits,spread", [(10, 1), (2, 1), (1, 1), (2, 1 << 40), (3, -7)])
def test_fold_matches_replay(spark, bits, spread):
    import random

    rnd = random.Random(5)
    kinds = [*K.TRANSITIONS, "unknown"]
    ids = ["hot", "a", "b", "gone"]
    events = [(rnd.choices(ids, [6, 1, 1, 1])[0], (i - 150) * spread, rnd.choice(kinds)) for i in range(300)]
    events.sort(key=lambda e: e[1])
    start = {"hot": "PENDING", "a": "FAILED", "b": "DEPLOYED", "idle": "APPROVED"}
    configs = spark.createDataFrame(
        [(p, s, "old", None) for p, s in start.items()],
        "pipeline_id string, status string, task_name string, error_message string")
    stream = spark.createDataFrame(
        [(p, i, k, None, "u", None, f"t{i}", f"m{i}") for p, i, k in events],
        K.EVENTS_DDL.replace("at timestamp_ntz", "at string")).withColumn(
            "at", F.expr("timestamp_ntz'2024-01-01'"))
    got = K.apply_events(configs, stream, bits)
    state, ok = replay(start, events)
    assert {r["pipeline_id"]: r["status"] for r in got.configs.collect()} == state
    assert {(r["pipeline_id"], r["seq"]): r["ok"] for r in got.outcomes.collect()} == ok
    texts = {r["outcome"] for r in got.outcomes.where("pipeline_id = 'gone'").collect()}
    assert all(t.startswith("ERROR: gone") for t in texts)


def test_levels_of_the_fold(spark):
    """Groups stay within the fan-in at every level, and every pipeline ends in one block."""
    events = spark.range(300).selectExpr("if(id % 3 = 0, 'b', 'hot') as pipeline_id", "id as seq", "cast(id % 7 as int) as k")
    for bits, least in ((1, 6), (2, 3), (10, 1)):
        levels = K._levels(events, bits)
        assert len(levels) >= least
        for level in levels:
            assert level.selectExpr("max(size(parts))").first()[0] <= 1 << bits
        assert levels[-1].count() == 2


def test_events_without_id_or_order(spark):
    configs = spark.createDataFrame([("p", "PENDING")], "pipeline_id string, status string")
    rows = [("p", 1, "fail"), (None, 2, "fail"), ("p", None, "approve"), (None, None, "reset"), (None, 2, "fail")]
    stream = spark.createDataFrame([(p, s, k, None, None, None, None, None) for p, s, k in rows],
                                   K.EVENTS_DDL.replace("at timestamp_ntz", "at string")).withColumn("at", F.expr("timestamp_ntz'2024-01-01'"))
    got = K.apply_events(configs, stream)
    assert [r["status"] for r in got.configs.collect()] == ["FAILED"]
    out = sorted((str(r["pipeline_id"]), str(r["seq"]), r["ok"], r["outcome"] is None) for r in got.outcomes.collect())
    assert out == sorted([("p", "1", True, False), ("None", "2", False, True), ("None", "2", False, True),
                          ("p", "None", False, False), ("None", "None", False, True)])
    assert K.apply_events(configs, stream.limit(0)).configs.first()["status"] == "PENDING"


def test_reset_clears_and_reject_explains(spark):
    configs = spark.createDataFrame(
        [("p", "PENDING", "sql", "task", "boss", None)],
        "pipeline_id string, status string, generated_sql string, task_name string, "
        "approved_by string, error_message string")
    stream = spark.createDataFrame(
        [("p", 1, "reject", None, "ann", None, None, "no"), ("p", 2, "reset", None, None, None, None, None)],
        K.EVENTS_DDL.replace("at timestamp_ntz", "at string")).withColumn(
            "at", F.expr("timestamp_ntz'2024-01-01'"))
    first = K.apply_events(configs, stream.where("seq = 1")).configs.first()
    assert (first["status"], first["error_message"]) == ("REJECTED", "Rejected by ann: no")
    row = K.apply_events(configs, stream).configs.first()
    assert tuple(row) == ("p", "PENDING", None, None, None, None)


# marks
def test_marks_never_move_back(spark):
    log = spark.createDataFrame([], M.LOG_DDL)
    a = M.advance_mark(M.current_marks(log), "P", "ts", "2024-01-05", 10, "2024-02-01", 1)
    b = a.unionByName(M.advance_mark(M.current_marks(a), "P", "ts", None, 0, "2024-02-02", 2))
    c = b.unionByName(M.advance_mark(M.current_marks(b), "P", "ts", "2024-01-01", 3, "2024-02-03", 3))
    row = M.current_marks(c).first()
    assert row["last_value_ts"] == dt.datetime(2024, 1, 5) and row["rows_loaded"] == 3
    gone = c.unionByName(M.drop_mark(M.current_marks(c), "P", "2024-02-04", 4))
    assert M.current_marks(gone).count() == 0
    mark = M.read_mark(M.current_marks(gone), "P", "2020-01-01").first()["mark"]
    assert mark == dt.datetime(2020, 1, 1)


def test_numeric_and_date_marks(spark):
    df = spark.sql("select 5L as id, date'2024-01-02' as d, 'x' as s")
    assert M.mark_type(df.schema, "id").column == "last_value_num"
    assert M.mark_type(df.schema, "d").column == "last_value_ts"
    with pytest.raises(TypeError):
        M.mark_type(df.schema, "s")
    log = spark.createDataFrame([], M.LOG_DDL)
    row = M.advance_mark(M.current_marks(log), "P", "id", 5, 1, "2024-02-01", 1, numeric=True).first()
    assert row["last_value_num"] == 5 and row["last_value"].startswith("5")


# quality
def test_verdict_text_and_order(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x"), (4, "y")], "a int, b string")
    row = Q.quality_check(df, ["b", "a"], 30.0, 10).first()
    assert row["status"] == "FAIL"
    assert row["detail"] == ("MIN_ROWS_FAIL: loaded=4 expected>=10; "
                             "NULL_FAIL: col=b null_pct=50.0% (tolerance=30.0%); ")
    assert Q.quality_check(df, ["b"], 50.0).first()["detail"] == "All checks passed"
    empty = Q.quality_check(df.limit(0), ["a"], 0.0, 0).first()
    assert (empty["rows_loaded"], empty["status"]) == (0, "PASS")
    with pytest.raises(Q.QualityError):
        Q.gate(row["status"], row["detail"])


def test_null_percentage_can_exceed_hundred_for_a_whole_target(spark):
    df = spark.range(10).selectExpr("cast(null as int) as c")
    row = Q.check_nulls(df, ["c"], 1.0, rows_loaded=5).first()
    assert row["null_pct"] == 200.0 and row["failed"]


# validation details that the bulk query does not reach
def test_widths_from_ddl_and_catalog_metadata(spark):
    spark.sql("create or replace temp view wide as select 'abc' as c")
    declared = ddl("c varchar(2) not null, d char(3), e string")
    rows = columns_table(spark, {"T": declared}, {"T": {"e"}}).collect()
    assert [(r["column_name"], r["width"], r["has_default"]) for r in rows] == [
        ("c", 2, False), ("d", 3, False), ("e", None, True)]
    spark.sql("drop table if exists widths_demo")
    spark.sql("create table widths_demo (c varchar(7), n int) using parquet")
    from tidemark.schema import widths
    assert widths(spark.table("widths_demo").schema) == {"c": 7}
    spark.sql("drop table widths_demo")
    assert plain_schema(declared).simpleString() == "struct<c:string,d:string,e:string>"


def test_order_text_with_nested_calls_and_quotes():
    from tidemark.operators.dedup import order_items

    got = order_items("coalesce(a, nvl(b, c)) DESC, concat(d, ',') , e")
    assert [(x[0].strip(), x[1]) for x in got] == [("coalesce(a, nvl(b, c))", True), ("concat(d, ',')", False), ("e", False)]


def test_one_submission_inserts_a_key_once(spark):
    from tidemark.operators.joins import insert_absent

    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    old = spark.createDataFrame([(2, "z")], "k int, v string")
    rows = insert_absent(new, old, ["k"]).collect()
    assert sorted(r["k"] for r in rows) == [1, 2] and {r["v"] for r in rows if r["k"] == 2} == {"z"}


def test_batch_keys_of_different_pipelines_differ():
    from tidemark.sources.targets import AppendTarget

    names = ["P A", "P_A", "P-A", "P=A", "P 5fA", "P/A"]
    assert len({AppendTarget.load_key(n, 1) for n in names}) == len(names)
