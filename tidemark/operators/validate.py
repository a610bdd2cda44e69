"""Configuration checks over any number of pipelines in one job.

``configs`` has one row per pipeline: ``pipeline_id``, ``params`` (the struct
of ``config.PARAMS_DDL``) and ``rules``, an array of structs with ``target``,
``inputs`` (array of source columns) and ``out_width``. ``columns`` is the
table made by ``schema.columns_table``.

Each table's columns are gathered into one row, whose size is bounded by the
width of the table, and joined to the configs once as source and once as
target. Every check is then an expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import stripped

HARD, WARN = "HARD", "WARN"


def _name(c: Column) -> Column:
    return F.upper(F.trim(c))


def _table_shapes(columns: DataFrame, prefix: str) -> DataFrame:
    entry = F.struct(
        F.col("ordinal"), _name(F.col("column_name")).alias("name"),
        F.col("data_type").alias("type"), F.col("width"),
        F.coalesce(F.col("has_default"), F.lit(False)).alias("has_default"),
        _squeezed(_name(F.col("column_name"))).alias("squeezed"),
    )
    return columns.groupBy(_name(F.col("table_name")).alias(f"{prefix}_table")).agg(
        F.array_sort(F.collect_list(entry)).alias(f"{prefix}_cols")
    )


def _issue(when: Column, check: str, severity: str, detail: Column) -> Column:
    made = F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        F.coalesce(detail, F.lit("")).alias("detail"),
    )
    return F.when(F.coalesce(when, F.lit(False)), F.array(made)).otherwise(F.array().cast(
        "array<struct<check:string,severity:string,detail:string>>"))


def _each(items: Column, check: str, severity: str) -> Column:
    """One issue per element of an array of names."""
    return F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda x: F.struct(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"), x.alias("detail")
        ),
    )


def _blank(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit("")) == ""


def _names(cols: Column) -> Column:
    return F.transform(cols, lambda c: c["name"])


def _not_in(items: Column, known: Column) -> Column:
    """Items, without case, that ``known`` lacks."""
    return F.filter(
        F.transform(items, lambda x: _name(x)),
        lambda x: (x != "") & ~F.array_contains(known, x),
    )


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z0-9]", "")


def _similar(wanted: Column, available: Column) -> Column:
    """Whether exactly one of the available columns is named loosely as ``wanted``: the same
    letters and digits (squeezed once per column of a table, not per config), else equal up to
    leading or trailing words."""
    exact = F.filter(available, lambda a: a["squeezed"] == wanted["squeezed"])

    def extends(longer: Column, shorter: Column) -> Column:
        return F.startswith(longer, F.concat(shorter, F.lit("_"))) | F.endswith(
            longer, F.concat(F.lit("_"), shorter)
        )

    near = F.filter(available, lambda a: extends(a["name"], wanted["name"]) | extends(wanted["name"], a["name"]))
    return F.when(F.size(exact) > 0, F.size(exact) == 1).otherwise(F.size(near) == 1)


def validate(configs: DataFrame, columns: DataFrame) -> DataFrame:
    """Issues: ``pipeline_id``, ``check``, ``severity``, ``detail``."""
    c = configs.select(
        "pipeline_id", "params", "rules",
        _name(F.col("params.source.table")).alias("source_table"),
        _name(F.col("params.target.table")).alias("target_table"),
    )
    shaped = (
        c.join(_table_shapes(columns, "s"), F.col("source_table") == F.col("s_table"), "left")
        .join(_table_shapes(columns, "t"), F.col("target_table") == F.col("t_table"), "left")
        .select(
            "pipeline_id", "source_table", "target_table", "params",
            F.col("s_cols"), F.col("t_cols"),
            _names("s_cols").alias("s_names"), _names("t_cols").alias("t_names"),
            F.coalesce("rules", F.array().cast(
                "array<struct<target:string,inputs:array<string>,out_width:int>>")).alias("rules"),
        )
    )
    strategy = F.col("params.strategy.type")
    incremental, cdc = strategy == "INCREMENTAL", strategy == "CDC"
    mark = _name(F.col("params.strategy.watermark_col"))
    flag = _name(F.col("params.strategy.delete_flag_col"))
    keys = F.coalesce(F.col("params.strategy.merge_keys"), F.array().cast("array<string>"))
    dedup = F.coalesce(F.col("params.source.deduplicate"), F.lit(False))
    dedup_keys = F.split(F.coalesce(F.col("params.source.dedup_key"), F.lit("")), ",")
    mapped = F.transform(
        F.coalesce(
            F.col("params.transformations.column_mappings"),
            F.array().cast(
                "array<struct<source_col:string,target_col:string,expression:string>>"),
        ),
        lambda m: _name(m["target_col"]),
    )
    ruled = F.transform("rules", lambda r: _name(r["target"]))
    mark_type = F.get(
        F.transform(
            F.filter("s_cols", lambda s: s["name"] == mark), lambda s: s["type"]
        ), F.lit(0),
    )
    # names are told apart first: only the few that are left are compared loosely
    open_ = F.filter("t_cols", lambda t: (
        ~t["has_default"] & ~F.array_contains(mapped, t["name"]) & ~F.array_contains(ruled, t["name"])
        & ~F.array_contains(F.col("s_names"), t["name"])))
    free = F.filter("s_cols", lambda s: ~F.array_contains(F.col("t_names"), s["name"]))
    unmapped = F.transform(F.filter(open_, lambda t: ~_similar(t, free)), lambda t: t["name"])
    rule_inputs = F.flatten(F.transform("rules", lambda r: r["inputs"]))
    no_rules = _blank(F.col("params.transformations.nl_rules")) & (F.size("rules") == 0)
    none = F.array().cast("array<string>")

    issues = F.concat(
        _issue(F.col("source_table") == F.col("target_table"), "M1_SOURCE_IS_TARGET", HARD,
               F.col("source_table")),
        _issue(incremental & ~F.array_contains(F.col("s_names"), mark),
               "M2_WATERMARK_MISSING", HARD, mark),
        _issue(incremental & (mark_type == "string"), "M3_WATERMARK_IS_TEXT", WARN, mark),
        _each(F.when(cdc, _not_in(keys, F.col("s_names"))).otherwise(none),
              "M4_MERGE_KEY_NOT_IN_SOURCE", HARD),
        _each(F.when(cdc, _not_in(keys, F.col("t_names"))).otherwise(none),
              "M4_MERGE_KEY_NOT_IN_TARGET", HARD),
        _issue(cdc & ~F.array_contains(F.col("s_names"), flag),
               "M5_DELETE_FLAG_MISSING", HARD, flag),
        _each(F.when(dedup, _not_in(dedup_keys, F.col("s_names"))).otherwise(none),
              "M6_DEDUP_KEY_MISSING", HARD),
        _each(unmapped, "M7_TARGET_UNMAPPED", WARN),
        _issue(_blank(F.col("params.identity.pipeline_name")), "M10_REQUIRED", HARD,
               F.lit("Pipeline name is required.")),
        _issue(_blank(F.col("params.source.table")), "M10_REQUIRED", HARD,
               F.lit("Source table is required.")),
        _issue(_blank(F.col("params.target.table")), "M10_REQUIRED", HARD,
               F.lit("Target table is required.")),
        _issue(no_rules, "M10_REQUIRED", HARD, F.lit("Transformation rules are required.")),
        _issue(incremental & _blank(F.col("params.strategy.watermark_col")), "M10_REQUIRED", HARD,
               F.lit("Watermark column is required for Incremental strategy.")),
        _issue(cdc & (F.size(keys) == 0), "M10_REQUIRED", HARD,
               F.lit("Merge key column(s) required for CDC strategy.")),
        _issue(dedup & _blank(F.col("params.source.dedup_key")), "M10_REQUIRED", HARD,
               F.lit("Dedup key column is required when deduplication is enabled.")),
        _each(_not_in(rule_inputs, F.col("s_names")), "M11_UNKNOWN_COLUMN", WARN),
        _issue(F.col("s_cols").isNull() & ~_blank(F.col("source_table")),
               "M12_TABLE_MISSING", HARD, F.col("source_table")),
        _issue(F.col("t_cols").isNull() & ~_blank(F.col("target_table")),
               "M12_TABLE_MISSING", HARD, F.col("target_table")),
        _issue(incremental & (F.col("params.target.write_mode") == "overwrite"),
               "M13_MODE_MISMATCH", WARN, F.lit("INCREMENTAL with write mode overwrite")),
    )
    return shaped.select("pipeline_id", F.explode(issues).alias("i")).select(
        "pipeline_id", "i.check", "i.severity", "i.detail"
    )


def width_static(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared widths that a rule's known output length exceeds.

    ``rules``: ``table_name``, ``target``, ``out_width``. The statement that
    would repair the column comes along; nothing is blocked.
    """
    known = columns.select(
        _name(F.col("table_name")).alias("_t"), _name(F.col("column_name")).alias("_c"), "width"
    ).where(F.col("width").isNotNull())
    joined = rules.join(
        known,
        (_name(F.col("table_name")) == F.col("_t")) & (_name(F.col("target")) == F.col("_c")),
    )
    fix = F.concat(
        F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" MODIFY COLUMN "), F.col("target"),
        F.lit(" VARCHAR("), F.col("out_width").cast("string"), F.lit(")"),
    )
    return joined.where(F.col("out_width") > F.col("width")).select(
        "table_name", "target", "width", "out_width", fix.alias("suggestion")
    )


def width_observed(df: DataFrame, declared: dict[str, int]) -> DataFrame:
    """Longest text per column against its declared width, in one pass.

    Whole texts are measured. One row per string column of ``declared``.
    """
    row = df.agg(*[F.max(F.length(F.col(c))).alias(c) for c in declared])
    out = row.unpivot([], list(declared), "column_name", "max_length")
    width = F.create_map(*[x for c, w in declared.items() for x in (F.lit(c), F.lit(w))])
    return out.select(
        "column_name", "max_length", F.element_at(width, F.col("column_name")).alias("width")
    ).withColumn(
        "too_long", F.coalesce(F.col("max_length") > F.col("width"), F.lit(False))
    )
