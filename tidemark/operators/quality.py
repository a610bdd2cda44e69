"""Data-quality checks.

Every check of a load is one aggregate over the batch: row count, NULLs per
column and cast errors per rule come from a single pass, however many columns
are checked. The verdict is an expression over that one row of metrics, so the
same code serves a lazy report and metrics observed while a batch is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.aggregates import null_counts
from tidemark.operators.dedup import duplicate_keys
from tidemark.schema import required, widths

ROWS = "rows_loaded"


@dataclass(frozen=True)
class Declared:
    """What a target declares of its columns: those that are NOT NULL, and text widths."""

    required: tuple[str, ...] = ()
    widths: tuple[tuple[str, int], ...] = ()

    @classmethod
    def of(cls, schema: T.StructType) -> Declared:
        return cls(tuple(required(schema)), tuple(widths(schema).items()))


class QualityError(RuntimeError):
    """A batch missed its thresholds."""


def metrics(null_cols: Sequence[str] = (), cast_checks: Sequence[str] = (),
            declared: Declared = Declared(), live: Column | None = None) -> list[Column]:
    """Aggregates for ``agg`` or ``observe``. ``cast_checks`` names boolean
    columns that are true where a cast lost a value; ``declared`` are the target's
    constraints, counted over ``live`` rows (those that will be rows of the target)."""
    live = F.lit(True) if live is None else live
    return [
        F.count(F.lit(1)).alias(ROWS),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls__{c}") for c in null_cols],
        *[F.count_if(F.col(c)).alias(f"casts__{c}") for c in cast_checks],
        *[F.count_if(live & F.col(c).isNull()).alias(f"required__{c}") for c in declared.required],
        *[F.count_if(live & (F.length(F.col(c)) > w)).alias(f"wide__{c}") for c, w in declared.widths],
    ]


def _percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * F.lit(100.0)


def min_rows_issue(loaded: Column, expected: int) -> Column:
    """Issue text or NULL; a threshold of zero checks nothing."""
    text = F.concat(
        F.lit("MIN_ROWS_FAIL: loaded="), loaded.cast("string"),
        F.lit(f" expected>={int(expected)}; "),
    )
    return F.when(F.lit(expected > 0) & (loaded < F.lit(expected)), text)


def null_issue(name: str, nulls: Column, loaded: Column, tolerance: float) -> Column:
    """Issue text or NULL; an empty batch checks nothing."""
    pct = F.when(loaded > 0, _percent(nulls, loaded))
    text = F.concat(
        F.lit(f"NULL_FAIL: col={name} null_pct="), pct.cast("string"),
        F.lit(f"% (tolerance={float(tolerance)}%); "),
    )
    return F.when(pct > F.lit(float(tolerance)), text)


def cast_issue(name: str, errors: Column, loaded: Column, tolerance: float) -> Column:
    pct = F.when(loaded > 0, _percent(errors, loaded))
    text = F.concat(
        F.lit(f"CAST_FAIL: col={name} error_pct="), pct.cast("string"),
        F.lit(f"% (tolerance={float(tolerance)}%); "),
    )
    return F.when(pct > F.lit(float(tolerance)), text)


def required_issue(name: str, nulls: Column) -> Column:
    """A declared NOT NULL has no tolerance."""
    text = F.concat(F.lit(f"NOT_NULL_FAIL: col={name} rows="), nulls.cast("string"), F.lit("; "))
    return F.when(nulls > 0, text)


def width_issue(name: str, wide: Column, width: int) -> Column:
    text = F.concat(F.lit(f"WIDTH_FAIL: col={name} rows="), wide.cast("string"), F.lit(f" (width={width}); "))
    return F.when(wide > 0, text)


def qc_detail(issues: Sequence[Column]) -> tuple[Column, Column]:
    """Status and detail text: the issues in their order, or all passed."""
    text = F.concat_ws("", *issues) if issues else F.lit("")
    failed = text != ""
    return (
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.when(failed, text).otherwise("All checks passed").alias("detail"),
    )


def verdict(
    row: DataFrame,
    null_cols: Sequence[str],
    tolerance: float,
    min_rows: int,
    cast_checks: Sequence[str] = (),
    rows_loaded: int | None = None,
    declared: Declared = Declared(),
) -> DataFrame:
    """One row of ``metrics`` to ``rows_loaded``, ``status`` and ``detail``.

    ``rows_loaded`` replaces the counted rows: affected rows of a merge, or the
    rows of this run when the metrics span the whole target.
    """
    loaded = F.col(ROWS) if rows_loaded is None else F.lit(rows_loaded)
    issues = [min_rows_issue(loaded, min_rows)]
    issues += [null_issue(c, F.col(f"nulls__{c}"), loaded, tolerance) for c in null_cols]
    issues += [cast_issue(c, F.col(f"casts__{c}"), loaded, tolerance) for c in cast_checks]
    issues += [required_issue(c, F.col(f"required__{c}")) for c in declared.required]
    issues += [width_issue(c, F.col(f"wide__{c}"), w) for c, w in declared.widths]
    status, detail = qc_detail(issues)
    return row.select(loaded.cast("long").alias(ROWS), status, detail)


def quality_check(
    df: DataFrame,
    null_cols: Sequence[str] = (),
    tolerance: float = 1.0,
    min_rows: int = 0,
    cast_checks: Mapping[str, Column] | None = None,
    rows_loaded: int | None = None,
) -> DataFrame:
    """Verdict over ``df``. For the scope ``target`` pass the whole target and
    the row count of the run."""
    checks = dict(cast_checks or {})
    flagged = df.select("*", *[c.alias(f"_cast_{n}") for n, c in checks.items()])
    named = [f"_cast_{n}" for n in checks]
    row = flagged.agg(*metrics(null_cols, named))
    renamed = row.select(*[F.col(c).alias(c.replace("casts___cast_", "casts__")) for c in row.columns])
    return verdict(renamed, null_cols, tolerance, min_rows, list(checks), rows_loaded)


def check_nulls(
    df: DataFrame, cols: Sequence[str], tolerance: float, rows_loaded: int | None = None
) -> DataFrame:
    """One row per column: counts, percentage and whether it is above tolerance."""
    loaded = F.col("total_rows") if rows_loaded is None else F.lit(rows_loaded)
    pct = F.when(loaded > 0, _percent(F.col("null_count"), loaded))
    return null_counts(df, cols).select(
        "column_name", "null_count", loaded.cast("long").alias(ROWS), pct.alias("null_pct"),
        F.coalesce(pct > F.lit(float(tolerance)), F.lit(False)).alias("failed"),
    )


def check_min_rows(df: DataFrame, expected: int) -> DataFrame:
    return verdict(df.agg(*metrics()), (), 0.0, expected)


def cast_errors(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Values lost by a cast, per rule: the input is filled, the outcome empty."""
    row = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(c).alias(n) for n, c in checks.items()],
    )
    out = row.unpivot(["total_rows"], list(checks), "column_name", "error_count")
    pct = F.when(F.col("total_rows") > 0, _percent(F.col("error_count"), F.col("total_rows")))
    return out.select("column_name", "error_count", "total_rows", pct.alias("error_pct"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the declared key holds: keys with several rows, and rows too many."""
    dup = duplicate_keys(df, keys)
    return dup.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("versions") - 1), F.lit(0)).alias("surplus_rows"),
    ).withColumn("status", F.when(F.col("duplicate_keys") > 0, "FAIL").otherwise("PASS"))


def gate(status: str, detail: str) -> None:
    """Stop the run when the verdict is a failure."""
    if status.startswith("FAIL"):
        raise QualityError(f"Quality check failed: FAIL: {detail}")
