"""Status transitions and run logs as bulk jobs over event tables.

A pipeline's status is a fold of its events in order. Each event either moves
the status or leaves it, depending on the status it meets, so an event acts as
a small function from status to status, and such functions compose. The fold is
a parallel prefix scan over that composition, in levels of one fixed fan-in:

* up: a block holds the events whose order numbers agree but for their last
  bits, so it never has more than the fan-in, whatever a pipeline's length.
  It reduces to one function; blocks reduce to larger blocks in the same way.
  A pipeline that is down to one fan-in of blocks takes them all at once;
* down: the status at which a block starts gives the one at which each of its
  parts starts, level by level, until every event knows the status it meets.

No task ever holds all the events of a long pipeline, and nothing is chosen by
the number of events. Levels lie in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

# Status names and the guard and outcome of each transition.
STATUSES = ("PENDING", "APPROVED", "DEPLOYED", "FAILED", "REJECTED", "DECOMMISSIONED")
ABSENT = 0  # status code of an id without a config; STATUSES count from 1
PENDING, APPROVED, DEPLOYED, FAILED, REJECTED, DECOMMISSIONED = range(1, 7)
TRANSITIONS = {
    "approve": ((PENDING,), APPROVED),
    "deploy": ((APPROVED,), DEPLOYED),
    "reject": ((PENDING,), REJECTED),
    "reset": ((FAILED, REJECTED), PENDING),
    "fail": (tuple(range(1, 7)), FAILED),
    "decommission": (tuple(range(1, 7)), DECOMMISSIONED),
}

#: Bits of the order number that one level takes up: a fan-in of 1,024.
FAN_BITS = 10

EVENTS_DDL = (
    "pipeline_id string, seq bigint, kind string, at timestamp_ntz, actor string, "
    "generated_sql string, task_name string, message string"
)


#: Kinds of events by number; any other kind is the last one and does nothing.
KINDS = tuple(TRANSITIONS)


def _literal(values) -> Column:
    """A literal array, made in one call."""
    return F.expr(f"array({', '.join(str(v).lower() for v in values)})")


def _table(cell) -> Column:
    """Literal array over (kind, status), read at ``kind * n + status``."""
    return _literal(cell(k, s) for k in range(len(KINDS) + 1) for s in range(len(STATUSES) + 1))


def _at(kind: Column, status: Column) -> Column:
    return kind * F.lit(len(STATUSES) + 1) + status


def _guarded(kind: int, status: int) -> bool:
    return kind < len(KINDS) and status in TRANSITIONS[KINDS[kind]][0]


def status_code(status: Column) -> Column:
    code = F.when(status.isNull(), F.lit(ABSENT))
    for i, name in enumerate(STATUSES, start=1):
        code = code.when(status == name, F.lit(i))
    return code.otherwise(F.lit(ABSENT))


def kind_code(kind: Column) -> Column:
    code = F.when(kind.isNull(), F.lit(len(KINDS)))
    for i, name in enumerate(KINDS):
        code = code.when(kind == name, F.lit(i))
    return code.otherwise(F.lit(len(KINDS)))


def _allowed(kind: Column, status: Column) -> Column:
    return F.get(_table(_guarded), _at(kind, status))


def _after(kind: int, status: int) -> int:
    return TRANSITIONS[KINDS[kind]][1] if _guarded(kind, status) else status


def _next() -> Column:
    return _table(_after)


def _functions() -> tuple[list[tuple[int, ...]], list[int]]:
    """All functions that sequences of events can amount to, and the number of
    the function that results when an event follows one: with few statuses and
    kinds there are only some dozens, so a block of events reduces to one
    number by looking up one number per event."""
    identity = tuple(range(len(STATUSES) + 1))
    found, number, then = [identity], {identity: 0}, []
    for fn in found:
        for kind in range(len(KINDS) + 1):
            new = tuple(_after(kind, s) for s in fn)
            if new not in number:
                number[new] = len(found)
                found.append(new)
            then.append(number[new])
    return found, then


FUNCTIONS, _THEN = _functions()


_CODES = "array<int>"


def _states_met(events: Column, start: Column) -> Column:
    """The status each event meets, for an ordered array of event structs."""
    met, table = F.array().cast(_CODES), _next()
    return F.aggregate(
        events,
        F.struct(start.cast("int").alias("now"), met.alias("met")),
        lambda acc, e: F.struct(
            F.get(table, _at(e["k"], acc["now"])).alias("now"),
            F.array_append(acc["met"], acc["now"]).alias("met"),
        ),
        lambda acc: acc["met"],
    )


def _as_function(events: Column) -> Column:
    """An ordered array of events as the number of one function."""
    then = _literal(_THEN)
    return F.aggregate(
        events, F.lit(0), lambda fn, e: F.get(then, fn * F.lit(len(KINDS) + 1) + e["k"])
    )


def _composed(parts: Column) -> Column:
    """An ordered array of structs with ``fn`` as the number of one function."""
    number = {fn: i for i, fn in enumerate(FUNCTIONS)}
    after = _literal(number[tuple(g[s] for s in f)] for f in FUNCTIONS for g in FUNCTIONS)
    return F.aggregate(
        parts, F.lit(0), lambda fn, p: F.get(after, fn * F.lit(len(FUNCTIONS)) + p["fn"])
    )


def _result(fn: Column, status: Column) -> Column:
    """Status that a function, given by its number, makes of a status."""
    flat = _literal(s for f in FUNCTIONS for s in f)
    return F.get(flat, fn * F.lit(len(STATUSES) + 1) + status)


def _starts(parts: Column, start: Column) -> Column:
    """Status before each part, for an ordered array of structs with ``fn``."""
    met = F.array().cast(_CODES)
    return F.aggregate(
        parts,
        F.struct(start.cast("int").alias("now"), met.alias("met")),
        lambda acc, p: F.struct(
            _result(p["fn"], acc["now"]).alias("now"),
            F.array_append(acc["met"], acc["now"]).alias("met"),
        ),
        lambda acc: acc["met"],
    )


def _ordered(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def _levels(events: DataFrame, bits: int) -> list[DataFrame]:
    """The up-sweep: per level (pipeline_id, b, parts, fn), each group of ``parts`` at most one
    fan-in, until every pipeline has one block. Level 0 has events as parts."""
    key = F.col("seq").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order, so that shifts meet at last
    first = events.groupBy("pipeline_id", F.shiftrightunsigned(key, bits).alias("b")).agg(
        _ordered("seq", "k").alias("parts"))
    levels = [stored(first.withColumn("fn", _as_function(F.col("parts"))), "fold-level")]
    while True:
        below = levels[-1].select("pipeline_id", "b", "fn")
        sizes = below.groupBy("pipeline_id").agg(F.count("*").alias("n"))
        if sizes.where("n > 1").isEmpty():
            return levels
        last = F.col("n") <= 1 << bits
        above = (
            below.join(sizes, "pipeline_id")
            .groupBy("pipeline_id", F.when(last, F.lit(0)).otherwise(F.shiftrightunsigned("b", bits)).alias("g"))
            .agg(_ordered("b", "fn").alias("parts")).withColumnRenamed("g", "b")
        )
        levels.append(stored(above.withColumn("fn", _composed(F.col("parts"))), "fold-level"))


def statuses_met(events: DataFrame, start: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """``pipeline_id``, ``seq`` and ``met``, the status code that each event meets.

    ``events``: pipeline_id, seq (unique per pipeline), k; ``start``: pipeline_id, start. Reads the
    events once. The result is stored.
    """
    levels = _levels(events, bits)
    at = levels[-1].select("pipeline_id", "b").join(start, "pipeline_id", "left").select(
        "pipeline_id", "b", F.coalesce("start", F.lit(ABSENT)).alias("at"))
    for level in reversed(levels[1:]):
        starts = F.arrays_zip("parts", _starts(F.col("parts"), F.col("at")).alias("at"))
        at = level.join(at, ["pipeline_id", "b"]).select("pipeline_id", F.explode(starts).alias("z")).select(
            "pipeline_id", F.col("z.parts.b").alias("b"), F.col("z.at").alias("at"))
    met = F.arrays_zip("parts", _states_met(F.col("parts"), F.col("at")).alias("met"))
    return stored(
        levels[0].join(at, ["pipeline_id", "b"]).select("pipeline_id", F.explode(met).alias("z")).select(
            "pipeline_id", F.col("z.parts.seq").alias("seq"), F.col("z.met").alias("met")), "fold-met")


@dataclass(frozen=True)
class Applied:
    """``configs`` after the events, and ``outcomes``, one row per event."""

    configs: DataFrame
    outcomes: DataFrame


def _outcome_text() -> Column:
    """Fixed wording of the answers."""
    pid = F.col("pipeline_id")
    ok = (
        F.when(F.col("kind") == "approve", F.concat(F.lit("OK: "), pid, F.lit(" approved by "), "actor"))
        .when(F.col("kind") == "deploy", F.concat(F.lit("OK: "), pid, F.lit(" deployed.")))
        .when(F.col("kind") == "fail", F.concat(F.lit("OK: "), pid, F.lit(" marked FAILED.")))
        .when(F.col("kind") == "reject", F.concat(F.lit("OK: "), pid, F.lit(" rejected by "), "actor"))
        .when(F.col("kind") == "reset", F.concat(F.lit("OK: "), pid, F.lit(" reset to PENDING.")))
        .otherwise(F.concat(F.lit("OK: "), pid, F.lit(" decommissioned.")))
    )
    reason = (
        F.when(F.col("kind") == "approve", " not found or not in PENDING status.")
        .when(F.col("kind") == "deploy", " not found or not in APPROVED status.")
        .when(F.col("kind") == "reject", " not found or not PENDING.")
        .when(F.col("kind") == "reset", " not in FAILED/REJECTED.")
        .otherwise(" not found.")
    )
    return F.when(F.col("ok"), ok).otherwise(F.concat(F.lit("ERROR: "), pid, reason))


def _last(value: Column, kinds: tuple[str, ...]) -> Column:
    """Value of the last effective event of the given kinds, as a struct so
    that a NULL value differs from no event."""
    at = F.when(F.col("ok") & F.col("kind").isin(*kinds), F.col("seq"))
    return F.max_by(F.struct(value.alias("v")), at)


def apply_events(configs: DataFrame, events: DataFrame, bits: int = FAN_BITS) -> Applied:
    """Apply ordered events (``EVENTS_DDL``, ``seq`` unique per pipeline).

    An event that meets a status its guard does not allow, or an unknown id,
    changes nothing and answers with an error. An event without an id or an
    order number is refused; without an id its text is NULL. The events are
    read once for the scan and once for each of the two results.
    """
    complete = F.col("pipeline_id").isNotNull() & F.col("seq").isNotNull()
    slim = events.where(complete).select("pipeline_id", "seq", kind_code(F.col("kind")).alias("k"))
    start = configs.select("pipeline_id", status_code(F.col("status")).alias("start"))
    met = statuses_met(slim, start, bits)
    known = events.where(complete).join(met, ["pipeline_id", "seq"]).select(*events.columns, "met")
    refused = events.where(~complete).select(*events.columns, F.lit(ABSENT).alias("met"))
    judged = known.unionByName(refused).withColumn(
        "ok", _allowed(kind_code(F.col("kind")), F.col("met"))
    )
    outcomes = judged.select("pipeline_id", "seq", "kind", "ok", _outcome_text().alias("outcome"))

    approval = ("approve", "reset")
    approved = F.col("kind") == "approve"
    trouble = (
        F.when(F.col("kind") == "fail", F.col("message"))
        .when(F.col("kind") == "reject",
              F.concat(F.lit("Rejected by "), "actor", F.lit(": "), "message"))
    )
    result = F.lit(None).cast("string")
    for name, (_, code) in TRANSITIONS.items():
        result = F.when(F.col("kind") == name, F.lit(STATUSES[code - 1])).otherwise(result)
    every = tuple(TRANSITIONS)
    latest = judged.groupBy("pipeline_id").agg(
        _last(result, every).alias("n_status"),
        _last(F.col("at"), every).alias("n_updated_at"),
        _last(F.when(approved, F.col("generated_sql")), approval).alias("n_generated_sql"),
        _last(F.when(approved, F.col("task_name")), approval).alias("n_task_name"),
        _last(F.when(approved, F.col("actor")), approval).alias("n_approved_by"),
        _last(F.when(approved, F.col("at")), approval).alias("n_approved_at"),
        _last(F.col("at"), ("deploy",)).alias("n_deployed_at"),
        _last(trouble, ("fail", "reject", "reset")).alias("n_error_message"),
    )
    changed = {c[2:]: c for c in latest.columns if c.startswith("n_")}
    after = configs.join(latest, "pipeline_id", "left").select(
        *[
            F.when(F.col(changed[c]).isNotNull(), F.col(f"{changed[c]}.v"))
            .otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in configs.columns
        ]
    )
    return Applied(after, outcomes)


RUN_LOG_FIELDS = (
    "pipeline_id", "task_name", "load_strategy", "run_start_at", "run_end_at", "status",
    "rows_processed", "watermark_from", "watermark_to", "pre_hook_status", "post_hook_status",
    "quality_check_status", "quality_check_detail", "error_message", "query_id",
)


def run_log_view(log: DataFrame, fields: tuple[str, ...] = RUN_LOG_FIELDS) -> DataFrame:
    """One row per run from an append-only log: per field, the last entry that
    set it. ``log`` has ``run_id``, ``seq`` and the fields, unset ones NULL."""
    present = [f for f in fields if f in log.columns]
    return log.groupBy("run_id").agg(
        *[
            F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f)
            for f in present
        ]
    )
