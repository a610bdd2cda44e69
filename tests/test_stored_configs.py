import dataclasses
import json

import demo
import pytest
from pyspark.sql import functions as F

from tidemark.config import Mapping, PipelineConfig, config_rows
from tidemark.functions import codec
from tidemark.functions import rules as R
from tidemark.operators import joins as J
from tidemark.operators.align import align
from tidemark.operators.views import run_durations
from tidemark.plans.loads import load_full
from tidemark.plans.runner import NotDeployed, run_stored
from tidemark.schema import ddl
from tidemark.sources.control_tables import ControlTables
from tidemark.sources.targets import AppendTarget, MergeTarget

SAMPLES = [
    R.Rename("a", "b"), R.JsonField("a", "doc", "x.y", "int", True), R.ToDate("a", "b", ("yyyy-MM-dd", "MM/dd/yyyy")),
    R.ToTimestamp("a", fmt="yyyy"), R.NumToDecimal("a", default=None), R.StrToDecimal("a", strip="%"), R.EpochMs("a"),
    R.Mask("a", "b", 512), R.Md5("a"), R.Coalesce("a", value="x"), R.Trim("a"), R.Upper("a"), R.Lower("a"),
    R.ConcatWords("a", "b", "c"), R.Flag("a", "b", 2.5), R.Decode("a", "b", ((1, "x"), ("2", "y"))),
    R.Band("a", "b", ((0, "L"), (5.5, "M")), lower=-1, else_="H", cast="double"), R.CsvCount("a", "b"), R.ToBool("a"),
    R.IsTrue("a"), R.Year("a", "b"), R.Round("a", digits=3), R.Replace("a", old="x"), R.FormatTs("a"),
    R.DropEq("a", True), R.DropNull("a"),
]


def test_rules_survive_json():
    assert {type(r).__name__ for r in SAMPLES} == set(codec.KINDS)
    for rule in SAMPLES:
        assert codec.decode(json.loads(json.dumps(codec.encode(rule)))) == rule
    with pytest.raises(ValueError, match="unknown rule"):
        codec.decode({"rule": "object"})
    with pytest.raises(ValueError, match="no fields"):
        codec.decode({"rule": "Mask", "target": "a", "salt": 1})


def test_configs_survive_json():
    for cfg in (demo.transactions_config(), demo.accounts_config(), demo.flags_config()):
        assert PipelineConfig.from_params(cfg.pipeline_id, cfg.to_params()) == cfg
    full = PipelineConfig("P", "p", "s", "t", "CDC", dedup_keys=("a", "b"), merge_keys=("a",), rules=tuple(SAMPLES),
                          mappings=(Mapping("a", "b"), Mapping("a", "c", "src.a + 1")), null_check_cols=("x",),
                          execution={"schedule": "1 HOUR"}, pre_load_sql="SELECT 1", error_tolerance_pct=2.5)
    assert PipelineConfig.from_params("P", full.to_params()) == full
    assert PipelineConfig.from_params("P", full.to_params(), rules=(R.Trim("z"),)).rules == (R.Trim("z"),)


def test_runs_from_a_stored_config(spark, folder):
    control = ControlTables(spark, f"{folder}/c")
    cfg = dataclasses.replace(demo.flags_config(), target_table=f"{folder}/flags")
    control.submit(config_rows(spark, [cfg], "2024-01-01", "ann"))
    args = (spark, control, cfg.pipeline_id, demo.FLAGS_CLEAN)
    with pytest.raises(NotDeployed, match="PENDING"):
        run_stored(*args, source=demo.flags_raw(spark))
    with pytest.raises(NotDeployed, match="unknown"):
        run_stored(spark, control, "nope", demo.FLAGS_CLEAN)
    control.event(cfg.pipeline_id, "approve", "2024-01-02", "bob")
    control.event(cfg.pipeline_id, "deploy", "2024-01-02")
    assert run_stored(*args, now="2024-02-01", source=demo.flags_raw(spark)).rows == 7
    assert MergeTarget(spark, cfg.target_table, demo.FLAGS_CLEAN, cfg.merge_keys).read().count() == 7
    with pytest.raises(Exception, match="half-way"):
        broken = demo.flags_raw(spark).withColumn("flag_id", F.raise_error(F.lit("half-way")).cast("string"))
        run_stored(*args, now="2024-02-02", source=broken.where("flag_id is not null"))
    row = control.config(cfg.pipeline_id)
    assert row["status"] == "FAILED" and "half-way" in row["error_message"]


def test_cast_errors_of_json_and_bands(spark):
    raw = spark.createDataFrame(
        [('{"n": 1}', "5"), ('{"n": "x"}', "y"), ('{"m": 1}', None), (None, "900"), ("{bad", "")], "doc string, v string")
    cfg = PipelineConfig("P", "p", "s", "t", "FULL_LOAD", rules=(
        R.JsonField("n", "doc", "n", "int"), R.JsonField("t", "doc", "n"), R.Band("b", "v", ((10, "L"),), cast="double")))
    batch = load_full(cfg, raw, ddl("n int, t string, b string"), flag_casts=True)
    assert batch.cast_flags == ["_cast_n", "_cast_b"]
    assert [(r["_cast_n"], r["_cast_b"]) for r in batch.df.collect()] == [
        (False, False), (True, True), (False, False), (False, False), (False, True)]


def test_same_name_comes_before_a_default(spark):
    df = spark.createDataFrame([(1, "2020-01-01")], "id int, loaded_at string")
    target = ddl("id int, loaded_at timestamp_ntz, made_at timestamp_ntz")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    row = align(df, target, defaults={"loaded_at": now, "made_at": now})[0].first()
    assert (str(row["loaded_at"])[:4], str(row["made_at"])[:4]) == ("2020", "2024")


def test_code_tables(spark):
    facts = spark.range(1000).selectExpr("cast(id % 5 as string) as c", "id")
    codes = spark.createDataFrame([("0", "zero"), ("1", "one"), (None, "none")], "code string, label string")
    got = J.decode_by_table(facts, "c", codes, "code", "label", "out")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r["c"], r["out"]) for r in got.collect()} == {("0", "zero"), ("1", "one"), ("2", None), ("3", None), ("4", None)}
    many = spark.range(1000).selectExpr("cast(id as string) as code", "concat('n', id) as label")
    wide = J.decode_by_table(facts, "c", many, "code", "label", "out")
    assert wide.where("out = concat('n', c)").count() == 1000
    twice = codes.union(codes)
    assert J.decode_by_table(facts, "c", twice, "code", "label", "out").count() == 1400
    numbers = spark.createDataFrame([(1, "one")], "code int, label string")
    assert J.decode_by_table(facts, "c", numbers, "code", "label", "out").where("out = 'one'").count() == 200


def test_absent_rows_with_null_keys_and_clashing_names(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k int, _n string")
    held = spark.createDataFrame([(2, "x"), (None, "y")], "k int, _n string")
    got = J.absent(new, held, ["k"]).collect()
    assert sorted((r["k"] is None, r["k"]) for r in got) == [(False, 1), (True, None), (True, None)]


def test_durations_of_one_task(spark):
    log = spark.createDataFrame(
        [(f"r{i}", f"T{i % 2}", "SUCCESS", "2024-01-31 00:00:00", "2024-01-31 00:00:05", None) for i in range(4)],
        "run_id string, task_name string, status string, run_start_at string, run_end_at string, error_message string"
    ).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start_at", "run_end_at")})
    assert [r["run_id"] for r in run_durations(log, "2024-01-31 12:00:00", task_name="T1").collect()] == ["r1", "r3"]
    assert run_durations(log, "2024-01-31 12:00:00").count() == 4


def test_stored_runs_into_a_folder_of_their_strategy(spark, folder):
    control = ControlTables(spark, f"{folder}/c")
    cfg = dataclasses.replace(demo.transactions_config(), target_table=f"{folder}/clean")
    control.submit(config_rows(spark, [cfg], "2024-01-01"))
    control.event(cfg.pipeline_id, "approve", "2024-01-02", "bob")
    control.event(cfg.pipeline_id, "deploy", "2024-01-02")
    assert run_stored(spark, control, cfg.pipeline_id, demo.TRANSACTIONS_CLEAN, now="2024-02-01",
                      source=demo.transactions_raw(spark)).rows == 13
    assert AppendTarget(spark, cfg.target_table, demo.TRANSACTIONS_CLEAN).read().count() == 13


def test_declared_constraints_stop_a_run(spark, folder):
    from tidemark.operators.quality import QualityError
    from tidemark.plans.runner import run_pipeline
    from tidemark.sources.targets import ReplaceTarget

    schema = ddl("id bigint not null, v varchar(3)")
    control = ControlTables(spark, f"{folder}/c")
    cfg = PipelineConfig("P", "p", "s", "t", "FULL_LOAD", error_tolerance_pct=100.0)
    target = ReplaceTarget(spark, f"{folder}/t", schema)
    good = spark.createDataFrame([(1, "abc"), (2, None), (3, "äöü")], "id bigint, v string")
    assert run_pipeline(spark, cfg, schema, target, control, "2024-02-01", good).rows == 3
    for hour, (row, text) in enumerate((((None, "a"), "NOT_NULL_FAIL: col=id rows=1"), ((4, "abcd"), "WIDTH_FAIL: col=v rows=1"))):
        with pytest.raises(QualityError, match=text):
            run_pipeline(spark, cfg, schema, target, control, f"2024-02-02 0{hour}:00:00", good.union(
                spark.createDataFrame([row], "id bigint, v string")))
    assert target.read().count() == 3
    # a deleted change may hold nothing but its key
    cdc = PipelineConfig("Q", "q", "s", "t", "CDC", merge_keys=("id",), delete_flag_col="gone")
    merged = MergeTarget(spark, f"{folder}/m", ddl("id bigint not null, v varchar(3) not null"), ["id"], 2)
    rows = spark.createDataFrame([(1, "a", False), (2, None, True)], "id bigint, v string, gone boolean")
    run_pipeline(spark, cdc, ddl("id bigint not null, v varchar(3) not null"), merged, control, "2024-02-03", rows)
    assert merged.read().count() == 1
