"""Pipeline configuration: one typed object per job, one struct per row in bulk."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import now_lit, user_lit

# Names that stored configurations use.
STRATEGIES = ("INCREMENTAL", "FULL_LOAD", "CDC")
WRITE_MODES = {"INCREMENTAL": "append", "FULL_LOAD": "overwrite", "CDC": "upsert"}
DEFAULT_WATERMARK_INITIAL = "2020-01-01"

PARAMS_DDL = """
identity struct<pipeline_name: string, domain: string, owner_email: string>,
source struct<table: string, filter: string, deduplicate: boolean,
              dedup_key: string, dedup_order_by: string>,
target struct<table: string, write_mode: string>,
strategy struct<type: string, watermark_col: string, watermark_initial: string,
                merge_keys: array<string>, delete_flag_col: string>,
transformations struct<nl_rules: string,
    column_mappings: array<struct<source_col: string, target_col: string, expression: string>>>,
execution struct<warehouse: string, schedule: string, timeout_minutes: int, max_retries: int>,
quality struct<error_tolerance_pct: double, null_check_cols: array<string>,
               min_rows_expected: bigint, notification_email: string>,
hooks struct<pre_load_sql: string, post_load_sql: string>
"""


@dataclass(frozen=True)
class Mapping:
    """Explicit mapping: a SQL expression over ``src``, or a direct copy."""

    source_col: str
    target_col: str
    expression: str | None = None


@dataclass(frozen=True)
class PipelineConfig:
    pipeline_id: str
    pipeline_name: str
    source_table: str
    target_table: str
    strategy: str
    domain: str | None = None
    owner_email: str | None = None
    source_filter: str | None = None
    deduplicate: bool = False
    dedup_keys: tuple[str, ...] = ()
    dedup_order_by: str | None = None
    write_mode: str | None = None
    watermark_col: str | None = None
    watermark_initial: str = DEFAULT_WATERMARK_INITIAL
    merge_keys: tuple[str, ...] = ()
    delete_flag_col: str | None = None
    mappings: tuple[Mapping, ...] = ()
    rules: tuple = ()
    execution: dict = field(default_factory=dict)
    error_tolerance_pct: float = 1.0
    null_check_cols: tuple[str, ...] = ()
    min_rows_expected: int = 0
    notification_email: str | None = None
    pre_load_sql: str | None = None
    post_load_sql: str | None = None

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown load strategy {self.strategy!r}")

    @property
    def mode_warning(self) -> str | None:
        """The strategy decides; a different write mode only warns."""
        expected = WRITE_MODES[self.strategy]
        if self.write_mode and self.write_mode != expected:
            return f"write_mode {self.write_mode} ignored: {self.strategy} uses {expected}"
        return None

    def to_params(self) -> str:
        """The same document with the typed rules in it: ``from_params`` gives an equal configuration."""
        from tidemark.functions.codec import encode

        return json.dumps({
            "identity": {"pipeline_name": self.pipeline_name, "domain": self.domain, "owner_email": self.owner_email},
            "source": {"table": self.source_table, "filter": self.source_filter, "deduplicate": self.deduplicate,
                       "dedup_key": ", ".join(self.dedup_keys) or None, "dedup_order_by": self.dedup_order_by},
            "target": {"table": self.target_table, "write_mode": self.write_mode},
            "strategy": {"type": self.strategy, "watermark_col": self.watermark_col,
                         "watermark_initial": self.watermark_initial, "merge_keys": list(self.merge_keys),
                         "delete_flag_col": self.delete_flag_col},
            "transformations": {
                "nl_rules": None, "rules": [encode(r) for r in self.rules],
                "column_mappings": [{"source_col": m.source_col, "target_col": m.target_col, "expression": m.expression}
                                    for m in self.mappings]},
            "execution": dict(self.execution),
            "quality": {"error_tolerance_pct": self.error_tolerance_pct, "null_check_cols": list(self.null_check_cols),
                        "min_rows_expected": self.min_rows_expected, "notification_email": self.notification_email},
            "hooks": {"pre_load_sql": self.pre_load_sql, "post_load_sql": self.post_load_sql},
        })

    @classmethod
    def from_params(cls, pipeline_id: str, params: str | dict, rules: tuple = ()) -> PipelineConfig:
        """From the eight-section JSON document. Rules are those that it holds, unless given."""
        from tidemark.functions.codec import decode_all

        p = json.loads(params) if isinstance(params, str) else params
        source, strategy = p.get("source", {}), p.get("strategy", {})
        quality, hooks = p.get("quality", {}), p.get("hooks", {})
        transformations = p.get("transformations", {})
        return cls(
            pipeline_id=pipeline_id,
            pipeline_name=p["identity"]["pipeline_name"],
            domain=p["identity"].get("domain"),
            owner_email=p["identity"].get("owner_email"),
            source_table=source["table"],
            source_filter=source.get("filter"),
            deduplicate=bool(source.get("deduplicate")),
            dedup_keys=tuple(split_names(source.get("dedup_key"))),
            dedup_order_by=source.get("dedup_order_by"),
            target_table=p["target"]["table"],
            write_mode=p["target"].get("write_mode"),
            strategy=strategy["type"],
            watermark_col=strategy.get("watermark_col"),
            watermark_initial=strategy.get("watermark_initial") or DEFAULT_WATERMARK_INITIAL,
            merge_keys=tuple(strategy.get("merge_keys") or ()),
            delete_flag_col=strategy.get("delete_flag_col"),
            mappings=tuple(
                Mapping(m["source_col"], m["target_col"], m.get("expression"))
                for m in transformations.get("column_mappings") or ()
            ),
            rules=tuple(rules) or decode_all(transformations.get("rules")),
            execution=dict(p.get("execution", {})),
            error_tolerance_pct=float(quality.get("error_tolerance_pct", 1.0)),
            null_check_cols=tuple(quality.get("null_check_cols") or ()),
            min_rows_expected=int(quality.get("min_rows_expected") or 0),
            notification_email=quality.get("notification_email"),
            pre_load_sql=hooks.get("pre_load_sql"),
            post_load_sql=hooks.get("post_load_sql"),
        )


def config_rows(spark: SparkSession, configs: Sequence[PipelineConfig], now: str | None = None,
                user: str | None = None) -> DataFrame:
    """Rows of the config table for typed configurations, ready to be submitted."""
    rows = [(c.pipeline_id, c.pipeline_name, c.domain, c.to_params(), c.source_table, c.target_table, c.strategy)
            for c in configs]
    df = spark.createDataFrame(rows, "pipeline_id string, pipeline_name string, domain string, "
                                     "pipeline_params string, source_table string, target_table string, load_strategy string")
    none = F.lit(None)
    return df.select(
        "*", none.cast("string").alias("generated_sql"), none.cast("string").alias("task_name"),
        F.lit("PENDING").alias("status"), user_lit(user).alias("created_by"), now_lit(now).alias("created_at"),
        now_lit(now).alias("updated_at"), none.cast("string").alias("approved_by"),
        none.cast("timestamp_ntz").alias("approved_at"), none.cast("timestamp_ntz").alias("deployed_at"),
        none.cast("string").alias("error_message"))


def split_names(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def params_schema() -> T.StructType:
    return T.StructType.fromDDL(PARAMS_DDL)


def parse_params(col: Column | str) -> Column:
    """The configuration document as a struct, for jobs over many configs."""
    return F.from_json(F.col(col) if isinstance(col, str) else col, params_schema())


#: All white space that a form field may be padded with.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def _upper_list(c: Column) -> Column:
    """``" a, ,B "`` to ``["A", "B"]``."""
    return F.filter(
        F.transform(F.split(c, ","), lambda x: F.upper(stripped(x))), lambda x: x != ""
    )


def normalise_configs(submitted: DataFrame, now: str | None = None, user: str | None = None) -> DataFrame:
    """Raw form values, one row per submission, to rows of the config table.

    Names are trimmed and upper-cased, comma lists become arrays, blanks become
    NULL, and the fields every job filters on are repeated as plain columns.
    """
    def text(name: str) -> Column:
        return stripped(F.col(name))

    def upper(name: str) -> Column:
        return F.upper(stripped(F.col(name)))

    def upper_or_null(name: str) -> Column:
        return F.upper(_blank_to_null(F.col(name)))

    params = F.struct(
        F.struct(
            text("pipeline_name").alias("pipeline_name"),
            F.col("domain"),
            _blank_to_null(F.col("owner_email")).alias("owner_email"),
        ).alias("identity"),
        F.struct(
            upper("source_table").alias("table"),
            _blank_to_null(F.col("source_filter")).alias("filter"),
            F.col("deduplicate"),
            upper_or_null("dedup_key").alias("dedup_key"),
            _blank_to_null(F.col("dedup_order_by")).alias("dedup_order_by"),
        ).alias("source"),
        F.struct(upper("target_table").alias("table"), F.col("write_mode")).alias("target"),
        F.struct(
            F.col("strategy").alias("type"),
            upper_or_null("watermark_col").alias("watermark_col"),
            F.coalesce(
                _blank_to_null(F.col("watermark_initial")), F.lit(DEFAULT_WATERMARK_INITIAL)
            ).alias("watermark_initial"),
            _upper_list(F.col("merge_keys")).alias("merge_keys"),
            upper_or_null("delete_flag_col").alias("delete_flag_col"),
        ).alias("strategy"),
        F.struct(
            text("nl_rules").alias("nl_rules"), F.col("column_mappings")
        ).alias("transformations"),
        F.struct(
            F.col("warehouse"),
            F.col("schedule"),
            F.col("timeout_minutes").cast("int").alias("timeout_minutes"),
            F.col("max_retries").cast("int").alias("max_retries"),
        ).alias("execution"),
        F.struct(
            F.col("error_tolerance_pct").cast("double").alias("error_tolerance_pct"),
            _upper_list(F.col("null_check_cols")).alias("null_check_cols"),
            F.col("min_rows_expected").cast("long").alias("min_rows_expected"),
            _blank_to_null(F.col("notification_email")).alias("notification_email"),
        ).alias("quality"),
        F.struct(
            _blank_to_null(F.col("pre_load_sql")).alias("pre_load_sql"),
            _blank_to_null(F.col("post_load_sql")).alias("post_load_sql"),
        ).alias("hooks"),
    )
    return submitted.select(
        "pipeline_id",
        text("pipeline_name").alias("pipeline_name"),
        "domain",
        F.to_json(params, {"ignoreNullFields": "false"}).alias("pipeline_params"),
        upper("source_table").alias("source_table"),
        upper("target_table").alias("target_table"),
        F.col("strategy").alias("load_strategy"),
        F.lit(None).cast("string").alias("generated_sql"),
        F.lit(None).cast("string").alias("task_name"),
        F.lit("PENDING").alias("status"),
        user_lit(user).alias("created_by"),
        now_lit(now).alias("created_at"),
        now_lit(now).alias("updated_at"),
        F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp_ntz").alias("approved_at"),
        F.lit(None).cast("timestamp_ntz").alias("deployed_at"),
        F.lit(None).cast("string").alias("error_message"),
    )
