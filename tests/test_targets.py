from collections import Counter

import demo
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig, normalise_configs, parse_params
from tidemark.operators.merge import DELETED, ORDER, merge_cdc
from tidemark.plans.loads import load_incremental
from tidemark.plans.runner import run_hook, run_pipeline
from tidemark.schema import ddl
from tidemark.sources.control_tables import ControlTables
from tidemark.sources.targets import AppendTarget, MergeTarget, ReplaceTarget
from tidemark.streaming.streams import stream_cdc, stream_incremental

QUICK = settings(max_examples=6, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = ddl("k int, v string")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def changes(spark, rows):
    """(key, value, deleted, day)"""
    return spark.createDataFrame(
        [(k, v, d, f"2024-01-{day:02d}") for k, v, d, day in rows],
        f"k int, v string, {DELETED} boolean, o string",
    ).withColumn(ORDER, F.col("o").cast("timestamp_ntz")).drop("o")


SPECIAL = ["A_B", "AB", "A B", "A=B", "A%3DB", "A:B", "A/B", "A#B", "A@B", "A__B", "A=5f=B", "ä~'\"\\B", "", "..", "a?*[x]{1}"]


def test_append_batches_replace_themselves(spark, folder):
    target = AppendTarget(spark, f"{folder}/t", SCHEMA)
    assert target.read().count() == 0
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    key = target.load_key("P X", "2024-01-01 00:00:00")
    assert key == target.load_key("P X", "2024-01-01") == "P X@2024-01-01 00:00:00.000000"
    target.write(a, key)
    target.write(a, key)
    target.write(a, target.load_key("P X", 17))
    assert bag(target.read()) == Counter({(1, "a"): 2})
    target.drop_batches(spark.createDataFrame([(key,), ("P X@later",)], "load_key string"))
    assert target.read().count() == 1
    assert {r["_load_key"] for r in target.with_keys().collect()} == {"P X@17"}
    target.write(a, key)
    assert target.read().count() == 2


def test_ids_with_any_character(spark, folder):
    """Write, retry and drop one batch per id: no two ids share one, and none escapes the drop."""
    target = AppendTarget(spark, f"{folder}/t", SCHEMA)
    for i, name in enumerate(SPECIAL):
        for _ in range(2 if i < 3 else 1):
            target.write(spark.createDataFrame([(i, name)], "k int, v string"), target.load_key(name, "2024-01-01"), pipeline_id=name)
    held = {(r["v"], r["_load_key"]) for r in target.with_keys().collect()}
    assert held == {(n, target.load_key(n, "2024-01-01")) for n in SPECIAL} and target.read().count() == len(SPECIAL)
    half = SPECIAL[::2]
    target.drop_batches(spark.createDataFrame([(target.load_key(n, "2024-01-01"),) for n in half], "k string"))
    assert {r["v"] for r in target.read().collect()} == set(SPECIAL) - set(half)


def test_staged_rows_are_unseen_until_published(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    append = AppendTarget(spark, f"{folder}/a", SCHEMA)
    replace = ReplaceTarget(spark, f"{folder}/r", SCHEMA)
    merge = MergeTarget(spark, f"{folder}/m", SCHEMA, ["k"], 2)
    append.write(rows, "P@1")
    replace.write(rows)
    merge.merge(changes(spark, [(1, "a", False, 1), (2, "b", False, 1)]))
    more = spark.createDataFrame([(3, "c")], "k int, v string")
    staged = append.stage(more), replace.stage(more), merge.stage_merge(changes(spark, [(2, "z", False, 2), (1, "", True, 2)]))
    for target in (append, replace, merge):
        assert bag(target.read()) == Counter({(1, "a"): 1, (2, "b"): 1})
    assert staged[2].counts["update"] == staged[2].counts["delete"] == 1 and staged[2].changed == 2
    append.publish(staged[0], "P@2")
    replace.publish(staged[1])
    merge.publish(staged[2])
    assert append.read().count() == 3 and bag(replace.read()) == Counter({(3, "c"): 1})
    assert bag(merge.read()) == Counter({(2, "z"): 1})
    assert replace.vacuum(0) == 1 and merge.vacuum(0) == 1 and append.vacuum(0) == 0
    assert append.read().count() == 3 and replace.read().count() == 1 and merge.read().count() == 1


def test_a_write_that_dies_leaves_the_old_table(spark, folder):
    target = ReplaceTarget(spark, f"{folder}/t", SCHEMA)
    target.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    broken = spark.range(100).select(F.expr("cast(id as int)").alias("k"), F.raise_error(F.lit("half-way")).cast("string").alias("v"))
    with pytest.raises(Exception, match="half-way"):
        target.write(broken)
    assert bag(target.read()) == Counter({(1, "a"): 1})


def test_batches_are_compacted(spark, folder):
    target = AppendTarget(spark, f"{folder}/t", SCHEMA)
    for day in range(1, 6):
        target.write(spark.createDataFrame([(day, "x")], "k int, v string"), target.load_key("P", f"2024-01-0{day}"),
                     pipeline_id="P", mark_from=f"2024-01-0{day}", mark_to=f"2024-01-0{day + 1}", rows=1)
    assert target.compact("2024-01-04", "P") == 3 and target.compact("2024-01-02", "P") == 0
    assert {r["k"] for r in target.read().collect()} == set(range(1, 6)) and target.read().count() == 5
    spans = sorted((r["mark_from"], r["mark_to"], r["row_count"]) for r in target.batches().collect())
    assert spans == [("2024-01-01", "2024-01-04", 3), ("2024-01-04", "2024-01-05", 1), ("2024-01-05", "2024-01-06", 1)]
    target.manifest.compact()
    assert target.read().count() == 5 and target.vacuum(0) == 3 and target.read().count() == 5


def test_named_tables_enforce_widths(spark):
    from tidemark.sources import tables as T

    spark.sql("drop table if exists named_demo")
    spark.sql("create table named_demo (id bigint, code varchar(2)) using parquet")
    row = spark.sql("select 1L as id, 'ab' as code")
    T.append(row, "named_demo")
    T.append(row, "named_demo")
    assert T.read(spark, "named_demo").count() == 2
    T.overwrite(row, "named_demo")
    assert bag(T.read(spark, "named_demo")) == Counter({(1, "ab"): 1})
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        T.append(spark.sql("select 1L as id, 'abc' as code"), "named_demo")
    with pytest.raises(Exception, match="OVERWRITE"):
        T.overwrite(spark.table("named_demo"), "named_demo")
    spark.sql("drop table named_demo")


def test_submitting_rows_twice(spark, folder):
    from tidemark.sources import tables as T

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    T.append(rows.where("k = 1"), f"{folder}/t")
    for _ in range(2):
        T.append_absent(rows, f"{folder}/t", ["k"])
    assert bag(T.read(spark, f"{folder}/t")) == Counter({(1, "a"): 1, (2, "b"): 1})


def test_merge_target_life_of_a_key(spark, folder):
    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=2)
    target.merge(changes(spark, [(1, "a", False, 1), (2, "b", False, 1), (9, "z", True, 1)]))
    assert bag(target.read()) == Counter({(1, "a"): 1, (2, "b"): 1})
    # deletes that leave no live row in any bucket
    target.merge(changes(spark, [(1, None, True, 2), (2, None, True, 2)]))
    assert target.read().count() == 0
    target.merge(changes(spark, [(1, "again", False, 3)]))
    assert bag(target.read()) == Counter({(1, "again"): 1})
    assert target.merge(changes(spark, [])) == []


def test_merge_target_rewrites_touched_buckets_only(spark, folder):
    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=16)
    target.merge(changes(spark, [(i, "a", False, 1) for i in range(100)]))
    touched = target.merge(changes(spark, [(5, "b", False, 2)]))
    assert len(touched) == 1
    assert target.read().count() == 100
    same = target.merge(changes(spark, [(5, "b", False, 2)]), skip_unchanged=True)
    assert same == []


def test_merge_target_ignores_older_changes(spark, folder):
    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=2)
    target.merge(changes(spark, [(1, "new", False, 9), (2, "x", True, 9)]), newer_only=True)
    target.merge(changes(spark, [(1, "old", False, 3), (2, "old", False, 3), (3, "c", False, 1)]),
                 newer_only=True)
    assert bag(target.read()) == Counter({(1, "new"): 1, (3, "c"): 1})


def test_null_keys_stay_and_are_inserted(spark, folder):
    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=4)
    target.merge(changes(spark, [(None, f"n{i}", False, 1) for i in range(40)]))
    target.merge(changes(spark, [(None, "more", False, 2), (1, "a", False, 2)]))
    assert target.read().count() == 42
    assert target.rows().select("_bucket").distinct().count() == 4


def test_layout_is_stored_and_others_are_refused(spark, folder):
    from tidemark.sources.targets import LayoutMismatch

    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=4)
    target.merge(changes(spark, [(i, "a", False, 1) for i in range(20)]))
    assert MergeTarget(spark, f"{folder}/t", SCHEMA, ["K"], buckets=4).read().count() == 20
    for keys, buckets in ((["k"], 8), (["v"], 4), (["k", "v"], 4)):
        with pytest.raises(LayoutMismatch):
            MergeTarget(spark, f"{folder}/t", SCHEMA, keys, buckets)
    target.rebucket(16)
    target.merge(changes(spark, [(3, "b", False, 2), (50, "n", False, 2)]))
    again = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=16)
    assert again.read().count() == 21 and again.read().where("v = 'b'").count() == 1
    target.rebucket(1)
    assert target.read().count() == 21


def test_a_merge_is_one_join_without_more_shuffles(spark, folder, capsys):
    target = MergeTarget(spark, f"{folder}/t", SCHEMA, ["k"], buckets=4)
    target.merge(changes(spark, [(i, "a", False, 1) for i in range(20)]))
    seen = []
    write = type(spark.range(1).write).parquet

    def spy(self, path, *args, **kwargs):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    type(spark.range(1).write).parquet = spy
    try:
        target.merge(changes(spark, [(3, "b", False, 2), (50, "n", False, 2)]))
    finally:
        type(spark.range(1).write).parquet = write
    plan = seen[0]
    assert plan.count("Join") == 1 and plan.count("Exchange ") == 2, plan


def test_null_keys_of_a_repeated_change_set_replace_themselves(spark, folder):
    target = MergeTarget(spark, f"{folder}/t", ddl("k int, v string, loaded_at timestamp_ntz"), ["k"], buckets=4)

    def batch(hour):
        return changes(spark, [(None, f"n{i}", False, 1) for i in range(9)] + [(1, "a", False, 1)]).withColumn(
            "loaded_at", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp_ntz"))

    for hour in (1, 2):
        target.merge(batch(hour), batch_id="P@1")
        assert target.read().count() == 10
    target.merge(batch(3), batch_id="P@2")
    assert target.read().count() == 19 and target.read().where("k = 1").count() == 1


def test_change_orders(spark, folder):
    """Several items, both directions, NULLs and ties: whatever the order of arrival, the row that a
    dedup of all changes would keep."""
    import itertools

    from tidemark.operators.dedup import dedup
    from tidemark.operators.merge import change_order

    spec = "day DESC, step, no DESC NULLS FIRST"
    rows = [(1, "a", 2, 5, 1), (1, "b", 2, 5, 1), (1, "c", 2, 4, 0), (1, "d", 2, 4, None), (1, "e", None, 0, 9), (1, "f", 1, 0, 9)]
    df = spark.createDataFrame(rows, "k int, v string, day int, step int, no int").select(
        "*", F.lit(False).alias(DELETED), change_order(spec).alias(ORDER))
    want = dedup(df.select("k", "v", "day", "step", "no"), ["k"], spec).first()["v"]
    assert want == "d"
    for n, order in enumerate(itertools.islice(itertools.permutations("abcdef"), 0, None, 143)):
        target = MergeTarget(spark, f"{folder}/t{n}", SCHEMA, ["k"], 1)
        for v in order:
            target.merge(df.where(F.col("v") == v), newer_only=True)
        assert [r["v"] for r in target.read().collect()] == [want]
    target = MergeTarget(spark, f"{folder}/ties", SCHEMA, ["k"], 1)
    for v in "bab":
        target.merge(df.where(F.col("v") == v), newer_only=True)
    assert [r["v"] for r in target.read().collect()] == ["a"]


_change = st.tuples(st.integers(0, 6), st.sampled_from("abc"), st.booleans(), st.just(1))


@QUICK
@given(st.lists(_change, unique_by=lambda c: c[0], max_size=7),
       st.lists(_change, unique_by=lambda c: c[0], max_size=7))
def test_merge_is_idempotent_and_store_agrees(spark, tmp_path_factory, first, second):
    path = str(tmp_path_factory.mktemp("merge"))
    target = MergeTarget(spark, f"{path}/t", SCHEMA, ["k"], buckets=3)
    model = {}
    for batch in (first, second, second):
        df = changes(spark, batch)
        expected = merge_cdc(target.read(), df, ["k"])
        want = bag(expected)
        target.merge(df)
        for k, v, gone, _ in batch:
            model.pop(k, None)
            if not gone:
                model[k] = v
        assert bag(target.read()) == want == Counter(model.items())


@QUICK
@given(st.lists(st.integers(1, 24), min_size=1, max_size=3))
def test_incremental_split_equals_one_load(spark, cuts):
    cfg, raw = demo.transactions_config(), demo.transactions_raw(spark)
    marks = ["2024-01-01", *[f"2024-01-{c:02d} 12:00:00" for c in sorted(set(cuts))], "2024-02-01"]
    whole = load_incremental(cfg, raw, demo.TRANSACTIONS_CLEAN, marks[0], now="2024-02-01").df
    parts = None
    for lo, hi in zip(marks, marks[1:]):
        part = load_incremental(cfg, raw, demo.TRANSACTIONS_CLEAN, lo, hi, "2024-02-01").df
        parts = part if parts is None else parts.unionByName(part)
    assert bag(parts) == bag(whole)


def test_hook_outcomes(spark):
    assert run_hook(spark, None) == run_hook(spark, "") == "SKIPPED"
    assert run_hook(spark, "SELECT 1") == "SUCCESS"
    assert run_hook(spark, "CREATE OR REPLACE TEMP VIEW hooked AS SELECT 1 AS x") == "SUCCESS"
    assert run_hook(spark, "SHOW TABLES") == "SUCCESS"
    assert spark.table("hooked").count() == 1
    with pytest.raises(Exception):
        run_hook(spark, "SELECT no_such_column")


def test_dedup_batch_is_staged_and_released(spark, folder):
    """Full load with dedup: staged, audited, published once."""
    raw = spark.sql("select id % 3 as id, id as at from range(9)")
    cfg = PipelineConfig("P", "p", "s", "t", "FULL_LOAD", deduplicate=True, dedup_keys=("id",),
                         dedup_order_by="at DESC", null_check_cols=("id",), min_rows_expected=3)
    target = ReplaceTarget(spark, f"{folder}/t", ddl("id bigint, at bigint"))
    got = run_pipeline(spark, cfg, ddl("id bigint, at bigint"), target,
                       ControlTables(spark, f"{folder}/c"), "2024-02-01", raw)
    assert got.rows == 3 and bag(target.read()) == Counter({(0, 6): 1, (1, 7): 1, (2, 8): 1})


def test_cast_errors_stop_a_run(spark, folder):
    from tidemark.functions import rules as R
    from tidemark.operators.quality import QualityError

    raw = spark.createDataFrame([("1",), ("x",), (None,), ("2",)], "n string")
    cfg = PipelineConfig("P", "p", "s", "t", "FULL_LOAD", error_tolerance_pct=10.0,
                         rules=(R.StrToDecimal("n"),))
    target = ReplaceTarget(spark, f"{folder}/t", ddl("n decimal(18,2)"))
    control = ControlTables(spark, f"{folder}/c")
    with pytest.raises(QualityError, match="CAST_FAIL"):
        run_pipeline(spark, cfg, ddl("n decimal(18,2)"), target, control, "2024-02-01", raw,
                     check_casts=True)
    assert target.read().count() == 0
    run_pipeline(spark, cfg, ddl("n decimal(18,2)"), target, control, "2024-02-02", raw)
    assert target.read().count() == 4


def test_a_failed_gate_publishes_nothing(spark, folder):
    """For each kind of target: nothing visible, no files left, the mark where it was; the source is read once."""
    from tidemark.operators.quality import QualityError

    good = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    bad = spark.createDataFrame([(5, None), (6, None), (7, "c")], "id bigint, v string")
    schema = ddl("id bigint, v string")
    for strategy in ("INCREMENTAL", "FULL_LOAD", "CDC"):
        cfg = PipelineConfig("P_1", "p", "s", "t", strategy, watermark_col="id" if strategy == "INCREMENTAL" else None,
                             watermark_initial="0", merge_keys=("id",), null_check_cols=("v",), error_tolerance_pct=5.0)
        path = f"{folder}/{strategy}"
        target = {"INCREMENTAL": lambda: AppendTarget(spark, path, schema), "FULL_LOAD": lambda: ReplaceTarget(spark, path, schema),
                  "CDC": lambda: MergeTarget(spark, path, schema, ["id"], 2)}[strategy]()
        control = ControlTables(spark, f"{folder}/c{strategy}")
        assert run_pipeline(spark, cfg, schema, target, control, "2024-02-01", good).rows == 2
        with pytest.raises(QualityError):
            run_pipeline(spark, cfg, schema, target, control, "2024-02-02", good.union(bad))
        assert bag(target.read()) == Counter({(1, "a"): 1, (2, "b"): 1})
        assert {r["status"] for r in control.run_log().collect()} == {"SUCCESS", "QUALITY_FAIL"}
        if strategy == "INCREMENTAL":
            assert control.marks().first()["last_value_num"] == 2
        import os
        folders = [f for f in os.listdir(path) if f.startswith("_") and "=" in f]
        assert len(folders) == 1
        with pytest.raises(QualityError):
            run_pipeline(spark, cfg, schema, target, control, "2024-02-03", good.union(bad), gate_order="post")
        assert target.read().count() > 2


def test_numeric_backfill(spark, folder):
    from tidemark.plans.runner import backfill

    schema = ddl("id bigint, v string")
    cfg = PipelineConfig("P_%/1", "p", "s", "t", "INCREMENTAL", watermark_col="id", watermark_initial="0")
    target = AppendTarget(spark, f"{folder}/t", schema)
    control = ControlTables(spark, f"{folder}/c")
    for top in (5, 9, 20):
        run_pipeline(spark, cfg, schema, target, control, f"2024-02-{top:02d}", spark.range(top).selectExpr("id", "string(id) as v"))
    assert target.read().count() == 19
    assert float(backfill(control, cfg, target, "6", "2024-03-01")) == 4  # the start of the batch that holds 6
    assert target.read().count() == 4 and control.marks().first()["last_value_num"] == 4
    run_pipeline(spark, cfg, schema, target, control, "2024-03-02", spark.range(20).selectExpr("id", "string(id) as v"))
    assert bag(target.read()) == Counter({(i, str(i)): 1 for i in range(1, 20)})
    backfill(control, cfg, target, "100", "2024-03-03")  # beyond all batches: only the mark moves
    assert target.read().count() == 19 and control.marks().first()["last_value_num"] == 100
    backfill(control, cfg, target, "10", "2024-03-04", keep_loaded=True)
    assert target.read().count() == 19 and control.marks().first()["last_value_num"] == 10


def test_numeric_marks_are_seeded_and_read_in_bulk(spark):
    from tidemark.operators import marks as M

    none = M.current_marks(spark.createDataFrame([], M.LOG_DDL))
    configs = spark.createDataFrame([("a", "id", "42"), ("b", "at", "2024-01-05"), ("c", "id", "-1.5")],
                                    "pipeline_id string, watermark_col string, watermark_initial string")
    seeded = M.current_marks(M.seed_marks(none, configs.where("pipeline_id <> 'c'"), "2024-02-01"))
    got = {r["pipeline_id"]: (str(r["mark"]), None if r["mark_num"] is None else float(r["mark_num"]))
           for r in M.read_marks(configs, seeded, numbers=True).collect()}
    assert got == {"a": ("None", 42.0), "b": ("2024-01-05 00:00:00", None), "c": ("None", -1.5)}
    reset = M.current_marks(M.reset_mark(seeded, "a", "7", "2024-02-02", 9)).first()
    assert (float(reset["last_value_num"]), reset["last_value_ts"], reset["last_run_status"]) == (7.0, None, "RESET")


def test_numeric_watermark_runs(spark, folder):
    schema = ddl("id bigint, v string")
    cfg = PipelineConfig("P", "p", "s", "t", "INCREMENTAL", watermark_col="id", watermark_initial="3")
    target = AppendTarget(spark, f"{folder}/t", schema)
    control = ControlTables(spark, f"{folder}/c")
    for top, rows in ((6, 2), (10, 4), (10, 0)):
        raw = spark.range(top).selectExpr("id", "string(id) as v")
        assert run_pipeline(spark, cfg, schema, target, control, f"2024-02-{top:02d}", raw).rows == rows
    assert target.read().count() == 6
    assert control.marks().first()["last_value_num"] == 9


def test_cdc_with_a_mark_reads_only_new_changes(spark, folder):
    cfg = demo.flags_config(watermark_col="updated_at", watermark_initial="2024-01-01")
    target = MergeTarget(spark, f"{folder}/t", demo.FLAGS_CLEAN, ["transaction_id"], 4)
    control = ControlTables(spark, f"{folder}/c")
    raw = demo.flags_raw(spark)
    early = raw.where("updated_at < timestamp_ntz'2024-01-21'")
    runs = [run_pipeline(spark, cfg, demo.FLAGS_CLEAN, target, control, f"2024-02-0{i}", src)
            for i, src in enumerate((early, raw, raw), start=1)]
    # early: TXN-004 (first form), 005, 007, 002; then the rest, among them a delete
    assert [r.rows for r in runs] == [4, 6, 0]
    assert target.read().count() == 7


def test_compacting_logs_changes_no_entry(spark, folder):
    control = ControlTables(spark, f"{folder}/c")
    for i in range(4):
        control.log_run(f"R{i % 2}", pipeline_id="P", status="RUNNING" if i < 2 else "SUCCESS")
    before = bag(control.log("runs"))
    control.compact("runs", "1999-01-01")
    assert bag(control.log("runs")) == before
    control.compact("runs", "2999-01-01")
    assert bag(control.log("runs")) == before
    assert len(control.log("runs").inputFiles()) == 1
    assert {r["status"] for r in control.run_log().collect()} == {"SUCCESS"}


def test_control_tables_state_machine(spark, folder):
    control = ControlTables(spark, f"{folder}/c")
    forms = spark.createDataFrame(
        [("P1", " my feed ", "finance", "", "db.raw.t ", " ", True, "id, day", "day desc", "db.clean.t",
          "append", "INCREMENTAL", "updated_at", "", "", "", "mask a", "WH", "1 HOUR", 30, 2, 1.5,
          "id, ,amt", 5, " ", None, "")],
        "pipeline_id string, pipeline_name string, domain string, owner_email string, "
        "source_table string, source_filter string, deduplicate boolean, dedup_key string, "
        "dedup_order_by string, target_table string, write_mode string, strategy string, "
        "watermark_col string, watermark_initial string, merge_keys string, delete_flag_col string, "
        "nl_rules string, warehouse string, schedule string, timeout_minutes int, max_retries int, "
        "error_tolerance_pct double, null_check_cols string, min_rows_expected int, "
        "notification_email string, pre_load_sql string, post_load_sql string",
    ).withColumn("column_mappings", F.expr(
        "cast(array() as array<struct<source_col:string,target_col:string,expression:string>>)"))
    rows = normalise_configs(forms, "2024-01-01", "ann")
    control.submit(rows)
    control.submit(rows)
    stored = control.log("configs")
    assert stored.count() == 1
    p = stored.select(parse_params("pipeline_params").alias("p")).first()["p"]
    assert p["source"]["table"] == "DB.RAW.T" and p["source"]["filter"] is None
    assert p["source"]["dedup_key"] == "ID, DAY" and p["strategy"]["merge_keys"] == []
    assert p["strategy"]["watermark_initial"] == "2020-01-01"
    assert p["quality"]["null_check_cols"] == ["ID", "AMT"] and p["hooks"]["pre_load_sql"] is None
    cfg = PipelineConfig.from_params("P1", stored.first()["pipeline_params"])
    assert cfg.dedup_keys == ("ID", "DAY") and cfg.min_rows_expected == 5

    at = "2024-01-02 00:00:00"
    assert control.event("P1", "deploy", at) == "ERROR: P1 not found or not in APPROVED status."
    assert control.event("P1", "approve", at, "bob", "SELECT 1", "TASK_X") == "OK: P1 approved by bob"
    assert control.event("P1", "deploy", "2024-01-03") == "OK: P1 deployed."
    assert control.event("nope", "fail", at) == "ERROR: nope not found."
    row = control.configs().first()
    assert (row["status"], row["approved_by"], row["task_name"]) == ("DEPLOYED", "bob", "TASK_X")

    control.seed_marks("2024-01-04")
    control.seed_marks("2024-01-05")
    mark = control.marks().first()
    assert (mark["watermark_col"], mark["last_run_status"]) == ("UPDATED_AT", "INIT")
    assert control.log("marks").count() == 1
    assert control.decommission("P1", "2024-01-06") == "OK: P1 decommissioned."
    assert control.marks().count() == 0
    assert control.configs().first()["status"] == "DECOMMISSIONED"


# streams
def test_stream_incremental_once(spark, folder):
    raw = demo.transactions_raw(spark)
    raw.write.parquet(f"{folder}/raw")
    target = AppendTarget(spark, f"{folder}/clean", demo.TRANSACTIONS_CLEAN)

    def go():
        stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/raw")
        stream_incremental(stream, demo.transactions_config(), demo.TRANSACTIONS_CLEAN, target,
                           f"{folder}/ck", "2024-02-01").awaitTermination()

    go()
    go()
    assert target.read().count() == 13
    # a late row, below the highest time: the stream takes it
    late = raw.where("transaction_id = 'TXN-001'").withColumn("transaction_id", F.lit("TXN-LATE"))
    late.write.mode("append").parquet(f"{folder}/raw")
    go()
    assert target.read().count() == 14


def test_stream_cdc_out_of_order(spark, folder):
    raw = demo.flags_raw(spark)
    target = MergeTarget(spark, f"{folder}/clean", demo.FLAGS_CLEAN, ["transaction_id"], 4)
    newest_first = ["updated_at >= timestamp_ntz'2024-01-21'", "updated_at < timestamp_ntz'2024-01-21'"]
    for part in newest_first:
        raw.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/raw")
        stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/raw")
        stream_cdc(stream, demo.flags_config(), demo.FLAGS_CLEAN, target, f"{folder}/ck",
                   "2024-02-01").awaitTermination()
    rows = {r["transaction_id"]: r for r in target.read().collect()}
    assert len(rows) == 7 and "TXN-007" not in rows
    assert rows["TXN-004"]["review_outcome"] == "FALSE_POSITIVE"
