"""The three demo feeds against results derived by hand."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import demo
import pytest

from tidemark.functions import rules as R
from tidemark.operators.merge import merge_cdc, merge_summary
from tidemark.operators.quality import QualityError
from tidemark.plans.loads import cdc_changes, load, load_full, load_incremental
from tidemark.plans.runner import backfill, run_pipeline
from tidemark.schema import plain_schema
from tidemark.sources.control_tables import ControlTables
from tidemark.sources.targets import AppendTarget, MergeTarget, ReplaceTarget

NOW = "2024-02-01 00:00:00"


def test_incremental_rows_and_values(spark):
    got = load_incremental(
        demo.transactions_config(), demo.transactions_raw(spark), demo.TRANSACTIONS_CLEAN,
        "2024-01-01", now=NOW,
    )
    rows = {r["transaction_id"]: r for r in got.df.collect()}
    assert len(rows) == 13 and not {"TXN-006", "TXN-008"} & set(rows)
    assert rows["TXN-003"]["tx_amount"] == Decimal("0.00")
    assert rows["TXN-002"]["tx_date"] == dt.date(2024, 1, 16)
    assert rows["TXN-001"]["tx_date"] == dt.date(2024, 1, 15)
    assert rows["TXN-001"]["merchant_name"] == "Shop 1"
    assert rows["TXN-001"]["customer_id"] == rows["TXN-001"]["account_number_hash"]
    assert len(rows["TXN-001"]["customer_id"]) == 64
    assert rows["TXN-001"]["loaded_at"] == dt.datetime(2024, 2, 1)
    assert got.warnings == []
    assert [f.name for f in got.df.schema] == [f.name for f in demo.TRANSACTIONS_CLEAN]


def test_full_load_values(spark):
    got = load_full(demo.accounts_config(), demo.accounts_raw(spark), demo.ACCOUNTS_CLEAN, NOW)
    rows = got.df.collect()
    assert len(rows) == 12
    assert Counter(r["account_status"] for r in rows) == {
        "Active": 9, "Suspended": 1, "Closed": 1, "Dormant": 1}
    assert Counter(r["risk_band"] for r in rows) == {
        "LOW": 6, "MEDIUM": 2, "HIGH": 2, "CRITICAL": 2}
    assert sorted(r["credit_limit"] for r in rows if r["credit_limit"] is not None) == [
        Decimal("5000.00"), Decimal("10000.00")]
    assert rows[4]["balance"] == Decimal("1250000.00")
    assert rows[0]["interest_rate_pct"] == Decimal("0.5000")
    assert rows[0]["opened_date"] == dt.date(2020, 1, 15)
    assert "relationship_mgr" not in got.df.columns


def _empty(spark, schema):
    return spark.createDataFrame([], plain_schema(schema))


def test_merge_into_empty_and_again(spark):
    cfg, raw = demo.flags_config(), demo.flags_raw(spark)
    changes = cdc_changes(cfg, raw, demo.FLAGS_CLEAN, NOW)
    assert changes.df.count() == 8
    first = load(cfg, raw, demo.FLAGS_CLEAN, _empty(spark, demo.FLAGS_CLEAN), now=NOW)
    rows = {r["transaction_id"]: r for r in first.collect()}
    assert sorted(rows) == [f"TXN-{n:03d}" for n in (2, 4, 5, 10, 12, 13, 15)]
    assert rows["TXN-004"]["analyst_reviewed"] is True
    assert rows["TXN-004"]["review_outcome"] == "FALSE_POSITIVE"
    assert rows["TXN-012"]["rule_count"] == 3
    assert rows["TXN-010"]["detection_timestamp"] == dt.datetime(2024, 1, 24, 11, 0)
    assert Counter(r["severity_label"] for r in rows.values()) == {
        "LOW": 2, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 2}
    again = load(cfg, raw, demo.FLAGS_CLEAN, first, now=NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def test_merge_literal_insert_of_deleted(spark):
    cfg, raw = demo.flags_config(), demo.flags_raw(spark)
    changes = cdc_changes(cfg, raw, demo.FLAGS_CLEAN, NOW).df
    empty = _empty(spark, demo.FLAGS_CLEAN)
    literal = merge_cdc(empty, changes, ["transaction_id"], insert_deleted=True)
    assert literal.count() == 8
    summary = {r[0]: r[1] for r in merge_summary(literal, changes, ["transaction_id"]).collect()}
    assert summary == {"update": 7, "delete": 1}


def test_run_incremental_twice(spark, folder):
    control = ControlTables(spark, f"{folder}/control")
    target = AppendTarget(spark, f"{folder}/clean", demo.TRANSACTIONS_CLEAN)
    cfg, raw = demo.transactions_config(), demo.transactions_raw(spark)
    first = run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control, NOW, raw)
    assert (first.rows, first.status) == (13, "SUCCESS")
    assert first.mark_to == dt.datetime(2024, 1, 25, 11, 30)
    second = run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control,
                          "2024-02-01 01:00:00", raw)
    assert second.rows == 0 and second.mark_to is None
    mark = control.marks().first()
    assert mark["last_value_ts"] == dt.datetime(2024, 1, 25, 11, 30)
    assert target.read().count() == 13
    log = {r["run_id"]: r for r in control.run_log().collect()}
    assert log[first.run_id]["rows_processed"] == 13
    assert log[first.run_id]["pre_hook_status"] == "SKIPPED"
    assert log[first.run_id]["quality_check_detail"] == "All checks passed"
    assert log[second.run_id]["status"] == "SUCCESS"


def test_incremental_batches_equal_one_load(spark, folder):
    cfg, raw = demo.transactions_config(), demo.transactions_raw(spark)
    control = ControlTables(spark, f"{folder}/control")
    target = AppendTarget(spark, f"{folder}/clean", demo.TRANSACTIONS_CLEAN)
    for i, upto in enumerate(("2024-01-17 12:00:00", "2024-01-20 15:08:33", "2024-12-31")):
        part = raw.where(f"updated_at <= timestamp_ntz'{upto}'")
        run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control,
                     f"2024-02-01 0{i}:00:00", part)
    once = load_incremental(cfg, raw, demo.TRANSACTIONS_CLEAN, "2024-01-01", now=NOW).df
    drop = [c for c in once.columns if c != "loaded_at"]
    assert sorted(map(str, target.read().select(drop).collect())) == sorted(
        map(str, once.select(drop).collect()))

    start = backfill(control, cfg, target, "2024-01-18", "2024-02-02 00:00:00")
    assert start.startswith("2024-01-17 08:11:00")
    assert target.read().count() == 3
    run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control, "2024-02-03", raw)
    assert sorted(map(str, target.read().select(drop).collect())) == sorted(
        map(str, once.select(drop).collect()))


def test_backfill_literal_appends_again(spark, folder):
    cfg, raw = demo.transactions_config(), demo.transactions_raw(spark)
    control = ControlTables(spark, f"{folder}/control")
    target = AppendTarget(spark, f"{folder}/clean", demo.TRANSACTIONS_CLEAN)
    run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control, NOW, raw)
    backfill(control, cfg, target, "2024-01-24", "2024-02-02 00:00:00", keep_loaded=True)
    run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control, "2024-02-03", raw)
    assert target.read().count() == 15


def test_run_full_load_repeatable(spark, folder):
    control = ControlTables(spark, f"{folder}/control")
    target = ReplaceTarget(spark, f"{folder}/clean", demo.ACCOUNTS_CLEAN)
    cfg, raw = demo.accounts_config(), demo.accounts_raw(spark)
    for hour in (1, 2):
        got = run_pipeline(spark, cfg, demo.ACCOUNTS_CLEAN, target, control,
                           f"2024-02-01 0{hour}:00:00", raw)
        assert got.rows == 12
    assert target.read().count() == 12


def test_run_cdc(spark, folder):
    control = ControlTables(spark, f"{folder}/control")
    target = MergeTarget(spark, f"{folder}/clean", demo.FLAGS_CLEAN, ["transaction_id"], 4)
    cfg, raw = demo.flags_config(), demo.flags_raw(spark)
    early = raw.where("NOT is_deleted")
    first = run_pipeline(spark, cfg, demo.FLAGS_CLEAN, target, control, "2024-02-01 01:00:00", early)
    assert first.rows == 8 and target.read().count() == 8
    second = run_pipeline(spark, cfg, demo.FLAGS_CLEAN, target, control, "2024-02-01 02:00:00", raw)
    assert second.rows == 8 and target.read().count() == 7
    third = run_pipeline(spark, cfg, demo.FLAGS_CLEAN, target, control, "2024-02-01 03:00:00", raw,
                         skip_unchanged=True)
    assert third.rows == 0 and target.read().count() == 7
    assert {r["loaded_at"].hour for r in target.read().collect()} == {2}


@pytest.mark.parametrize("order, left, mark_moves", [("pre", 0, False), ("post", 12, True)])
def test_quality_failure(spark, folder, order, left, mark_moves):
    control = ControlTables(spark, f"{folder}/control")
    target = ReplaceTarget(spark, f"{folder}/clean", demo.ACCOUNTS_CLEAN)
    cfg = demo.accounts_config()
    cfg = cfg.__class__(**{**cfg.__dict__, "min_rows_expected": 50})
    with pytest.raises(QualityError):
        run_pipeline(spark, cfg, demo.ACCOUNTS_CLEAN, target, control, NOW,
                     demo.accounts_raw(spark), gate_order=order)
    assert target.read().count() == left
    run = control.run_log().first()
    assert run["status"] == "QUALITY_FAIL"
    assert run["quality_check_detail"] == "MIN_ROWS_FAIL: loaded=12 expected>=50; "


def test_failed_run_keeps_mark(spark, folder):
    control = ControlTables(spark, f"{folder}/control")
    target = AppendTarget(spark, f"{folder}/clean", demo.TRANSACTIONS_CLEAN)
    raw = demo.transactions_raw(spark)
    cfg = demo.transactions_config()
    run_pipeline(spark, cfg, demo.TRANSACTIONS_CLEAN, target, control, NOW, raw)
    bad = demo.transactions_config(pre_load_sql="SELECT * FROM no_such_table")
    with pytest.raises(Exception, match="no_such_table"):
        run_pipeline(spark, bad, demo.TRANSACTIONS_CLEAN, target, control, "2024-02-02", raw)
    mark = control.marks().first()
    assert mark["last_run_status"] == "FAILED"
    assert mark["last_value_ts"] == dt.datetime(2024, 1, 25, 11, 30)
    failed = control.run_log().where("status = 'FAILED'").first()
    assert failed["pre_hook_status"].startswith("FAILED: ")
    assert "no_such_table" in failed["error_message"]


def test_width_warning_for_hash_in_narrow_column(spark):
    narrow = demo.ddl("customer_id varchar(32), tx_amount decimal(18,2)")
    got = load_full(
        demo.accounts_config().__class__(
            pipeline_id="P", pipeline_name="p", source_table="a", target_table="b",
            strategy="FULL_LOAD", rules=(R.Mask("customer_id", "account_number"),)),
        demo.transactions_raw(spark), narrow)
    assert [(w.column, w.kind) for w in got.warnings] == [("customer_id", "WIDTH")]
