"""What the operators share: tables, stored intermediate results, labelled samples."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored
from tidemark.llm.textarrays import slices
from tidemark.sources.tables import read

__all__ = ["FIT_ROWS", "fit_sample", "fold", "kept_in_worker", "kept_rows", "labelled_texts", "stored", "table"]

#: Labelled documents that one classifier is fitted on, at most.
FIT_ROWS = 16_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit_sample(labels: DataFrame, label: str, learn: Column, bound: int = FIT_ROWS) -> DataFrame:
    """At most ``bound`` labelled ids, chosen by hash: (doc_id, label).

    Rows without id or label are left out; an id with several labels counts as
    the label most of its rows give (1 on a tie). Because of the bound the
    result may be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    share = min(1.0, 2.0 * bound / max(1, labels.count()))
    mixed = F.xxhash64(F.col("doc_id"), F.lit(17))
    return (
        known.where(F.pmod(mixed, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(bound)
    )


def labelled_texts(docs: DataFrame, sample: DataFrame, purpose: str) -> DataFrame:
    """(doc_id, label, text) of the sampled documents, stored. The sample is bounded, hence the hint.

    An id with several rows counts with its least text, so the sample bounds texts as well as ids.
    """
    small = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))
    return stored(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(small, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text")),
        purpose,
    )


def kept_in_worker(name: str, key: object, make: Callable):
    """A value made once per Python worker and key; the latest of each name is kept. Functions travel by value,
    so globals of these modules would not outlive a task."""
    home = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    held = getattr(home, name, None)
    if held is None or held[0] != key:
        held = (key, make())
        setattr(home, name, held)
    return held[1]


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose texts (null: empty) ``keep`` says True of, all columns as they are.

    Each row travels as one struct: whatever its columns are called, none clashes.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = pc.fill_null(pc.struct_field(whole.column(0), "text"), "")
            for part in slices(pa.record_batch([whole.column(0), text], names=["row", "text"])):
                yield part.select(["row"]).filter(pa.array(keep(part.column(1)), pa.bool_()))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
