"""Whitening of embeddings by a covariance weighted with multiplicities.

Identical vectors are grouped first, so each distinct vector enters the covariance once, with its count (or
one) as its weight, is whitened once, and joins its rows by a digest:

1. rows are written with the vector's integers, its digest and a salt;
2. one aggregation gives the distinct vectors, their counts and the salts that their rows have;
3. sums, then a weighted product of the centred vectors per task, added up in a tree of tasks: the driver meets a
   few matrices of d x d numbers, whatever the number of rows;
4. the distinct vectors are projected, and their rows join them by digest and salt. A vector that holds a third
   of all rows is dealt over SALTS keys; it is repeated once per salt, no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import stored

COMPONENTS = 8
SALTS = 64
#: Tasks that partial products are added up in before the driver adds up those.
TREE = 16
#: Entries of x are held within this; beyond it a double has no fraction left to lose.
WIDEST = 1 << 53


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a list column; a null list is empty."""
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def integers(c: np.ndarray) -> np.ndarray:
    """The long x of each entry c (finite doubles)."""
    return np.clip(np.floor(1024 * c), -WIDEST, WIDEST).astype(np.int64) + 100000


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, d, digest, salt, x): the rows whose vector has only finite entries."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            values, at = _matrix(batch.column(1))
            finite = np.isfinite(values.astype(np.float64))
            bad = np.concatenate([[0], np.cumsum(~finite)])
            here = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(here & (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]]))
            x = [integers(values[at[i]: at[i + 1]].astype(np.float64)) for i in keep]
            digest = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            salt = (number + np.arange(len(keep))) % SALTS
            number += len(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array([len(v) for v in x], pa.int32()),
                 pa.array(digest, pa.binary()), pa.array(salt, pa.int32()), pa.array(x, pa.list_(pa.int64()))],
                names=["vec_id", "d", "digest", "salt", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "vec_id long, d int, digest binary, salt int, x array<long>")


def _parts(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and weights of a batch (x, weight)."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return x, batch.column(1).to_numpy(zero_copy_only=False)


def _sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Weights and weighted sums per dimension, exact."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            x, w = _parts(batch, d)
            # weights and entries in two halves each keep every product and sum within a long
            for half, shift in ((w & 0xFFFF, 0), (w >> 16, 16)):
                for part, more in ((x & 0xFFFFFF, 0), (x >> 24, 24)):
                    s = (half[:, None] * part).sum(0)
                    total[1:] = [t + (int(v) << (shift + more)) for t, v in zip(total[1:], s, strict=True)]
            total[0] += int(w.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["i", "total"])

    rows = distinct.select("x", "weight").mapInArrow(run, "i int, total string").groupBy("i").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["i"]: int(r["total"]) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, with the whole part of the mean taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of each vector; None where that is no long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    off = x - whole
    if (np.abs(off).max(initial=0) + 1) * float(n) < 2.0**62 and (np.abs(off).max(initial=0) + 1.0) ** 2 * n * n * len(sums) < 2.0**62:
        return ((n * off - rest) ** 2).sum(1).tolist()
    out = [sum((n * int(o) - int(r)) ** 2 for o, r in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _covariance(rows: DataFrame, make, d: int, n: int) -> np.ndarray:
    """Weighted covariance of ``make(vectors)``: a product per task, added up by TREE tasks, then the driver."""
    def product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            z, w = make(batch)
            total += z.T @ (z * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(d * d), False
        for batch in batches:
            for m in batch.column(0):
                total += m.values.to_numpy()
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = rows.mapInArrow(product, "m array<double>").repartition(TREE).mapInArrow(add, "m array<double>").collect()
    return sum((np.array(r["m"]) for r in parts), np.zeros(d * d)).reshape(d, d) / max(n, 1)


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a covariance, those without any spread left out.

    An eigenvector's largest entry is positive.
    """
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > max(e.max(initial=0), 0) * len(e) * np.finfo(float).eps]
    vectors = vectors[:, order]
    return e[order], vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)


_WHITE = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, most: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding) and component, up to ``most``.

    ``weights``: ``counts`` (the fit list is every row) or ``ones`` (every distinct vector once). Rows with a null
    or empty vector, or a null or non-finite entry, are left out. Vectors need one length; if there are several,
    the most frequent one counts (the longer on a tie) and the others get no rows. Entries so large that x leaves
    +-2^53 stop there; a deviation that is no long is null. Components without spread (at the precision of
    doubles) are left out, so equal vectors alone give no rows. Null ids and repeated rows get rows each, other
    columns are not read, an empty table gives no rows. Equal vectors are found by 128-bit digests.
    """
    if weights not in ("counts", "ones"):
        raise ValueError(f"weights: {weights}")
    spark = vectors.sparkSession
    rows = stored(_rows(vectors), "whiten-rows")
    lengths = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _WHITE)
    d = lengths[0]["d"]
    rows = rows.where(F.col("d") == d)
    salts = F.expr("bit_or(shiftleft(1L, salt))").alias("salts")
    distinct = stored(rows.groupBy("digest", "x").agg(F.count("*").alias("count"), salts).withColumn(
        "weight", F.col("count") if weights == "counts" else F.lit(1).cast("long")), "whiten-distinct")
    n, sums = _sums(distinct, d)

    def off_mean(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, w = _parts(batch, d)
        return centred(x, n, sums), w.astype(float)

    v = _covariance(distinct.select("x", "weight"), off_mean, d, n)
    e, vectors_of = components(v, most)
    k = len(e)
    if not k:
        return spark.createDataFrame([], _WHITE)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _parts(batch, d)
            white = centred(x, n, sums) @ vectors_of / np.sqrt(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), batch.column(3), pa.array(deviations(x, n, sums), pa.int64()),
                 pa.array(list(white), pa.list_(pa.float64()))], names=["digest", "weight", "salts", "deviation", "white"])

    white = stored(distinct.select("x", "weight", "digest", "salts").mapInArrow(
        project, "digest binary, weight long, salts long, deviation long, white array<double>"), "whiten-distinct-done")
    means = np.array(white.agg(*[(F.sum(F.col("white")[i] * F.col("weight")) / n).alias(f"m{i}") for i in range(k)]).first())

    def off_white(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return y - means, batch.column(1).to_numpy(zero_copy_only=False).astype(float)

    error = float(np.abs(_covariance(white.select("white", "weight"), off_white, k, n) - np.eye(k)).max())
    explained = F.element_at(F.lit((e / np.trace(v)).tolist()), F.col("component"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    dealt = white.select("digest", "deviation", "white", F.explode(bits).alias("salt"))
    return (
        rows.select("vec_id", "digest", "salt").join(dealt, ["digest", "salt"])
        .select("vec_id", "deviation", F.posexplode("white").alias("pos", "whitened"))
        .withColumn("component", F.col("pos") + 1)
        .select("vec_id", F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    )
