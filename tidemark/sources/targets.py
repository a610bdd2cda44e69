"""Target tables as Parquet folders, one class per load strategy.

Every write has two steps. ``stage`` writes files that no reader sees, and
``publish`` makes exactly those files part of the table, in one step. What is
audited in between is what is published, and a write that fails, or that the
audit stops, leaves the table as it was. Every write can be repeated: a retried
batch replaces its own rows, a retried merge gives the same rows. Paths lie on
storage that all executors share.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import DELETED, ORDER, earlier, newer
from tidemark.schema import plain_schema
from tidemark.session import delete
from tidemark.sources.manifest import Manifest, new_folder, read_or_empty, vacuum

__all__ = ["AppendTarget", "LayoutMismatch", "MergeTarget", "ReplaceTarget", "StagedMerge", "read_or_empty", "stage"]

LOAD_KEY = "_load_key"
BATCH = "_batch"
VERSION = "_version"
BUCKET = "_bucket"
_OLD, _NEW, _SALT = "_old", "_new", "_null_salt"
_AUDIT = {"loaded_at"}


class LayoutMismatch(ValueError):
    """A merge target is stored with other keys, buckets or order than the ones asked for."""


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a batch to the shared folder and go on from the files: the work
    is not repeated and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Target:
    #: Name of the folders that hold the parts.
    prefix = BATCH

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = plain_schema(schema)
        self.manifest = Manifest(spark, self.path)

    def stage(self, df: DataFrame) -> str:
        """Write rows that no reader sees yet; returns the folder to publish."""
        folder = new_folder()
        df.select(*self.schema.names).write.parquet(f"{self.path}/{self.prefix}={folder}")
        return folder

    def discard(self, folder: str) -> None:
        """Delete staged files."""
        delete(self.spark, f"{self.path}/{self.prefix}={folder}")

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Delete files that stopped being part of the table."""
        return vacuum(self.spark, self.manifest, self.path, self.prefix, keep_hours)


class AppendTarget(_Target):
    """Target of incremental loads: one part per batch.

    The batch key holds the pipeline and the mark the batch started from. A
    run that is repeated after a crash has the same key and replaces its rows
    instead of adding them twice. The manifest also holds the span of marks of
    a batch, which a backfill goes by.
    """

    @staticmethod
    def load_key(pipeline_id: str, start) -> str:
        """``<pipeline>@<start>``. Keys are values, not folder names: any character may stand in them."""
        text = str(start)
        if re.match(r"\d{4}-\d{2}-\d{2}", text):
            text = dt.datetime.fromisoformat(text).isoformat(sep=" ", timespec="microseconds")
        return f"{pipeline_id}@{text}"

    def batches(self) -> DataFrame:
        """Current batches: key, folder, row_count, pipeline_id, mark_from, mark_to."""
        return self.manifest.live()

    def _with_folders(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(BATCH, T.StringType())])
        paths = [f"{self.path}/{BATCH}={r[0]}" for r in self.batches().select("folder").collect()]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*paths)

    def read(self) -> DataFrame:
        return self._with_folders().select(*self.schema.names)

    def with_keys(self) -> DataFrame:
        """Rows with the key of their batch."""
        keys = self.batches().select(F.col("folder").alias(BATCH), F.col("key").alias(LOAD_KEY))
        return self._with_folders().join(keys, BATCH).drop(BATCH)

    def publish(self, folder: str, load_key: str, pipeline_id: str | None = None, mark_from=None,
                mark_to=None, rows: int | None = None) -> None:
        """Make a staged folder the rows of a batch."""
        text = [None if m is None else str(m) for m in (mark_from, mark_to)]
        self.manifest.commit([{"key": load_key, "folder": folder, "row_count": rows, "pipeline_id": pipeline_id,
                               "mark_from": text[0], "mark_to": text[1]}])

    def write(self, df: DataFrame, load_key: str, **span) -> None:
        """Stage and publish one batch."""
        self.publish(self.stage(df), load_key, **span)

    def drop_batches(self, load_keys: DataFrame) -> None:
        """Take all batches named in the one column of ``load_keys`` out of the table, in one step and
        without touching data; names that are no batch do nothing."""
        named = load_keys.distinct().select(F.col(load_keys.columns[0]).alias("key"))
        held = named.join(self.batches(), "key", "left_semi")
        self.manifest.commit_rows(held, False)

    def compact(self, mark: str, pipeline_id: str, numeric: bool = False) -> int:
        """Gather a pipeline's batches that end at or before a mark into one; returns how many those were.

        The new batch spans all their marks, so a backfill to a date within it starts at its beginning.
        Their rows and the new batch change places in one step.
        """
        kind = "decimal(38,10)" if numeric else "timestamp_ntz"
        old = self.batches().where(
            (F.col("pipeline_id") == pipeline_id) & (F.col("mark_to").cast(kind) <= F.lit(mark).cast(kind)))
        found = old.select("key", "folder", "row_count", "mark_from", "mark_to",
                           F.col("mark_from").cast(kind).alias("a"), F.col("mark_to").cast(kind).alias("b")).collect()
        if len(found) < 2:
            return 0
        first, last = min(found, key=lambda r: r["a"]), max(found, key=lambda r: r["b"])
        full = T.StructType(self.schema.fields)
        rows = self.spark.read.schema(full).parquet(*[f"{self.path}/{BATCH}={r['folder']}" for r in found])
        folder = self.stage(rows.hint("rebalance"))
        known = [r["row_count"] for r in found]
        new = {"folder": folder, "row_count": None if None in known else sum(known), "pipeline_id": pipeline_id,
               "mark_from": first["mark_from"], "mark_to": last["mark_to"]}
        entries = [(r["key"], r["key"] == first["key"]) for r in found]
        both = self.spark.createDataFrame(entries, "key string, live boolean")
        self._swap(both, new)
        return len(found)

    def _swap(self, keys: DataFrame, new: dict) -> None:
        """One commit in which the live key gets the new part and the others none."""
        seq = self.manifest._next()
        rows = keys.select(
            F.lit(seq).alias("seq"), "key", F.when(F.col("live"), F.lit(new["folder"])).alias("folder"), "live",
            *[F.when(F.col("live"), F.lit(new[c])).cast(t).alias(c) for c, t in (
                ("row_count", "bigint"), ("pipeline_id", "string"), ("mark_from", "string"), ("mark_to", "string"))],
            F.lit(None).cast("string").alias("detail"))
        rows.coalesce(1).write.mode("append").parquet(self.manifest.path)


class ReplaceTarget(_Target):
    """Target of full loads: each run replaces all rows, by one entry that points to the new version."""

    prefix = VERSION

    def read(self) -> DataFrame:
        """The published version, whatever is being written meanwhile."""
        found = self.manifest.live().select("folder").collect()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{VERSION}={found[0][0]}")

    def publish(self, folder: str, rows: int | None = None) -> None:
        self.manifest.commit([{"key": "table", "folder": folder, "row_count": rows}])

    def write(self, df: DataFrame) -> None:
        self.publish(self.stage(df))


@dataclass(frozen=True)
class StagedMerge:
    """Rewritten buckets that no reader sees yet, and the rows per operation, counted in the tasks
    that wrote them."""

    folder: str | None = None
    buckets: list[int] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def changed(self) -> int:
        return sum(self.counts.get(k, 0) for k in ("insert", "update", "delete"))


#: What becomes of a row: kept as it is; changed; a change that is older, equal, or deletes nothing.
OPERATIONS = ("kept", "insert", "update", "delete", "older", "unchanged", "ignored")


class MergeTarget(_Target):
    """Target of merges: rows in buckets by key, rewritten bucket by bucket.

    The keys, the number of buckets and the type of the change order are stored
    with the table, and other ones are refused. Only buckets that hold a
    changed key are read and written; the new files of all of them become
    current in one step. A deleted key that has a change order leaves a tombstone,
    which readers skip: it remembers when the key last changed.
    """

    prefix = VERSION

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 keys: Sequence[str], buckets: int = 64,
                 order_type: T.DataType | None = None):
        super().__init__(spark, path, schema)
        self.keys, self.buckets = list(keys), buckets
        self._order = order_type
        self._check()

    def _check(self) -> None:
        """Refuse what does not fit the stored layout; take over the stored order."""
        found = self.manifest.live().where("key = 'layout'").select("detail").collect()
        self._known = bool(found)
        if not found:
            return
        held = json.loads(found[0][0])
        asked = {"keys": [k.lower() for k in self.keys], "buckets": self.buckets}
        wrong = {k: (held[k], v) for k, v in asked.items() if held[k] != v}
        if self._order is not None and held["order"] != self._order.simpleString():
            wrong["order"] = (held["order"], self._order.simpleString())
        if wrong:
            raise LayoutMismatch(f"{self.path} is stored differently (stored, asked for): {wrong}")
        self._order = T.StructType.fromDDL(f"o {held['order']}").fields[0].dataType

    @property
    def order_type(self) -> T.DataType:
        return self._order or T.TimestampNTZType()

    @property
    def stored(self) -> T.StructType:
        return T.StructType([
            *self.schema.fields,
            T.StructField(DELETED, T.BooleanType()),
            T.StructField(ORDER, self.order_type),
            T.StructField(BATCH, T.StringType()),
            T.StructField(BUCKET, T.IntegerType()),
        ])

    def _salt(self) -> Column:
        """0 for complete keys. A row with a NULL in its key never matches anything: it is spread by all
        that it holds, but for when it was loaded, so that a repeated row lies where it lay."""
        any_null = F.lit(False)
        for k in self.keys:
            any_null = any_null | F.col(k).isNull()
        values = [F.col(f.name) for f in self.schema.fields
                  if f.dataType.typeName() not in ("variant", "map") and f.name.lower() not in _AUDIT]
        return F.when(any_null, F.xxhash64(*values)).otherwise(F.lit(0).cast("long"))

    def bucket(self) -> Column:
        """Bucket by key: the function by which Spark deals rows to tasks, so that one task of the
        merge holds one bucket and writes one file."""
        return F.pmod(F.hash(*self.keys, self._salt()), F.lit(self.buckets))

    def _paths(self, buckets: Sequence[int] | None = None) -> list[str]:
        live = self.manifest.live().where("key <> 'layout'")
        if buckets is not None:
            live = live.where(F.col("key").cast("int").isin(*buckets))
        return [f"{self.path}/{VERSION}={r['folder']}/{BUCKET}={r['key']}"
                for r in live.select("folder", "key").collect()]

    def rows_in(self, buckets: Sequence[int] | None) -> DataFrame:
        """Stored rows of some buckets, or all, with tombstones and hidden columns."""
        paths = self._paths(buckets) if buckets is None or len(buckets) else []
        full = T.StructType([*self.stored.fields, T.StructField(VERSION, T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*paths).drop(VERSION)

    def rows(self) -> DataFrame:
        return self.rows_in(None)

    def read(self) -> DataFrame:
        return self.rows().where(~F.col(DELETED)).select(*self.schema.names)

    def _shaped(self, changes: DataFrame, batch_id: str | None) -> DataFrame:
        hidden = {
            DELETED: F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in changes.columns else F.lit(False),
            ORDER: F.col(ORDER) if ORDER in changes.columns else F.lit(None),
            BATCH: F.lit(batch_id),
        }
        out = changes.select(
            *self.schema.names,
            *[c.cast(self.stored[n].dataType).alias(n) for n, c in hidden.items()],
        )
        return out.withColumn(BUCKET, self.bucket())

    def _operation(self, newer_only: bool, skip_unchanged: bool) -> Column:
        quiet = {*_AUDIT, *[k.lower() for k in self.keys]}
        compared = [n for n in self.schema.names if n.lower() not in quiet]
        old, new = F.col(_OLD), F.col(_NEW)
        live = old.isNotNull() & ~F.coalesce(old[DELETED], F.lit(False))
        op = F.when(new.isNull(), "kept")
        if newer_only:
            tied, later = newer(new[ORDER], old[ORDER], self.order_type)
            # ties fall to the remaining columns, as they do inside a batch
            ranked = [f for f in self.schema.fields if f.name.lower() not in _AUDIT] + [T.StructField(DELETED, T.BooleanType())]
            wins = later | (tied & earlier(new, old, ranked))
            op = op.when(old.isNotNull() & ~wins, "older")
        if skip_unchanged:
            same = old[DELETED].eqNullSafe(new[DELETED])
            for n in compared:
                same = same & old[n].eqNullSafe(new[n])
            op = op.when(old.isNotNull() & same, "unchanged")
        return (
            op.when(new[DELETED], F.when(live, "delete").otherwise("ignored"))
            .otherwise(F.when(live, "update").otherwise("insert"))
        )

    def stage_merge(self, changes: DataFrame, newer_only: bool = False, skip_unchanged: bool = False,
                    batch_id: str | None = None) -> StagedMerge:
        """Write the touched buckets anew, unseen; ``changes`` have unique keys and are read twice.

        One full join by key of the touched buckets with their changes, dealt by bucket: keys are unique on
        both sides and incomplete ones spread, so no key is hot. ``newer_only`` ignores a change that is not
        newer than the stored row. ``batch_id`` names the change set: where it is merged again, its rows with
        incomplete keys replace those of the first time.
        """
        if not self._known and self._order is None and ORDER in changes.columns:
            self._order = changes.schema[ORDER].dataType
        shaped = self._shaped(changes, batch_id)
        buckets = [r[0] for r in shaped.select(BUCKET).distinct().collect()]
        if not buckets:
            return StagedMerge()
        current = self.rows_in(buckets)
        if batch_id is not None:
            again = F.coalesce((self._salt() != 0) & (F.col(BATCH) == batch_id), F.lit(False))
            current = current.where(~again)

        def side(df: DataFrame, name: str) -> DataFrame:
            keyed = df.select(*self.keys, self._salt().alias(_SALT), F.struct(*df.columns).alias(name))
            return keyed.repartition(self.buckets, *self.keys, _SALT)

        both = side(current, _OLD).join(side(shaped, _NEW), [*self.keys, _SALT], "full_outer").select(
            _OLD, _NEW, self._operation(newer_only, skip_unchanged).alias("_op"))
        seen = Observation()
        stays = F.col("_op").isin("kept", "older", "unchanged")
        whole = F.when(stays, F.col(_OLD)).otherwise(F.col(_NEW))
        out = both.observe(seen, *[F.count_if(F.col("_op") == o).alias(o) for o in OPERATIONS]).select(
            *[whole[f.name].alias(f.name) for f in self.stored.fields])
        # a tombstone without a change order has nothing to remember
        out = out.where(~F.col(DELETED) | F.col(ORDER).isNotNull())
        folder = new_folder()
        out.write.partitionBy(BUCKET).parquet(f"{self.path}/{VERSION}={folder}")
        return StagedMerge(folder, sorted(buckets), dict(seen.get))

    def publish(self, staged: StagedMerge) -> None:
        """Make staged buckets current, all in one step."""
        entries = [{"key": str(b), "folder": staged.folder} for b in staged.buckets]
        if entries and not self._known:
            layout = {"keys": [k.lower() for k in self.keys], "buckets": self.buckets,
                      "order": self.order_type.simpleString()}
            entries.append({"key": "layout", "detail": json.dumps(layout)})
        if entries:
            self.manifest.commit(entries)
            self._known = True

    def merge(self, changes: DataFrame, newer_only: bool = False, skip_unchanged: bool = False,
              batch_id: str | None = None) -> list[int]:
        """Stage and publish; returns the rewritten buckets, none if nothing changed."""
        staged = self.stage_merge(changes, newer_only, skip_unchanged, batch_id)
        remembered = staged.counts.get("ignored", 0) if newer_only else 0
        if not staged.changed and not remembered:
            if staged.folder:
                self.discard(staged.folder)
            return []
        self.publish(staged)
        return staged.buckets

    def rebucket(self, buckets: int) -> None:
        """Deal all rows to another number of buckets, for a table that outgrew its layout; readers see
        the old table until the new one is complete."""
        old = [r["key"] for r in self.manifest.live().where("key <> 'layout'").select("key").collect()]
        rows, self.buckets = self.rows(), buckets
        folder = new_folder()
        dealt = rows.drop(BUCKET).withColumn(BUCKET, self.bucket()).withColumn(_SALT, self._salt())
        dealt.repartition(buckets, *self.keys, _SALT).drop(_SALT).write.partitionBy(BUCKET).parquet(
            f"{self.path}/{VERSION}={folder}")
        held = [r[0] for r in self.spark.read.parquet(f"{self.path}/{VERSION}={folder}").select(BUCKET).distinct().collect()] \
            if old else []
        layout = {"keys": [k.lower() for k in self.keys], "buckets": buckets, "order": self.order_type.simpleString()}
        seq = self.manifest._next()
        gone = [(seq, k, None, False, None) for k in old if int(k) not in set(held)]
        new = [(seq, str(b), folder, True, None) for b in held] + [(seq, "layout", None, True, json.dumps(layout))]
        entries = self.spark.createDataFrame(gone + new, "seq bigint, key string, folder string, live boolean, detail string")
        entries.select("seq", "key", "folder", "live", *[
            F.lit(None).cast(t).alias(c) for c, t in (
                ("row_count", "bigint"), ("pipeline_id", "string"), ("mark_from", "string"), ("mark_to", "string"))],
            "detail").coalesce(1).write.mode("append").parquet(self.manifest.path)
