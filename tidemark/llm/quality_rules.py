"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each text has five counts. Texts beyond the fixed limits fail; for the others the counts become a
vector, and each (language, source) has a minimum-covariance-determinant estimate of its centre
and spread. A bounded sample of each group gives the starts: concentration steps from many small
subsets and from medians, each of which keeps the half of the texts that lies closest and estimates
again from it. The best go on over all texts, until the determinant falls no more; the least one
counts. Each of those steps is an aggregation over all texts; only sums per group leave a task. Texts
tied at the cut count with the share that fills the half. A text is rejected if its Mahalanobis
distance is beyond the chi-square limit. Small groups use the estimate of their language, or of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import stored
from tidemark.llm.textarrays import SPACE, as_bytes, mix, slices, span_hashes, text_column, word_bounds

DIMS = 5
#: Texts of a group (on average) that the starts are sought in, random starts, and those that go on.
SAMPLE, STARTS, GO_ON = 1000, 50, 2
#: Fall of the logarithm of the determinant below which steps end.
FALL = 1e-3
#: Texts that a group needs for an estimate of its own.
LEAST = 200
#: Chi-square limit with five degrees of freedom, one in a million.
CHI_LIMIT = 35.89
#: Least variance of each dimension (many texts have exactly no symbol and no repetition).
FLOOR = (0.04, 0.0025, 0.04, 0.01, 0.01)
_U = np.uint64
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _symbols() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"#*$%&|<>")] = True
    return out


_SYMBOL = _symbols()


def _twice(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another of their group, and which equal an earlier one."""
    order = np.lexsort((np.arange(len(value)), value, group))
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = (value[order[1:]] == value[order[:-1]]) & (group[order[1:]] == group[order[:-1]]) if len(value) > 1 else same[1:-1]
    any_, later = np.zeros(len(value), bool), np.zeros(len(value), bool)
    any_[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return any_, later


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The five counts of each text, in the order of the output columns."""
    data, at = as_bytes(texts)
    docs = len(at) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    starts, ends, first = word_bounds(data, at)
    n_words = np.diff(first)
    word_chars = per_text(~SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per_text(_SYMBOL[data])
    owner = np.repeat(np.arange(docs), n_words)
    words = span_hashes(data, starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = owner[2:] == owner[:-2]
        three = mix(words[:-2] * _U(0xD6E8FEB86659FD93) + words[1:-1] * _U(0xA0761D6478BD642F) + mix(words[2:]))
        i = np.flatnonzero(inside)
        i = i[_twice(owner[i], three[i])[0]]
        for j in range(3):
            covered[i + j] = True
    n_repeat = np.bincount(owner[covered], minlength=docs)
    begins = np.zeros(len(data), bool)
    begins[at[:-1][np.diff(at) > 0]] = True
    begins[1:] |= data[:-1] == 0x0A
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(data))
    b = b - (data[b - 1] == 0x0A) if len(a) else b
    full = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[full], b[full]
    line_owner = np.searchsorted(at, a, "right") - 1
    later = _twice(line_owner, span_hashes(data, a, b))[1]
    n_dup = np.bincount(line_owner[later], minlength=docs)
    return [x.astype(np.int64) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *map(pa.array, text_counts(text_column(batch)))],
                names=["doc_id", "lang", "source", *_COUNTS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(
        run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _vector() -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(
        F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n), F.asin(F.sqrt(F.col("n_repeat_words") / n)))


def _distance(x: str, centre: str, inverse: str) -> Column:
    z = [F.col(x)[i] - F.col(centre)[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + (1 if i == j else 2) * F.col(inverse)[i * DIMS + j] * z[i] * z[j]
    return total


def _consistency(share: float) -> float:
    """What the covariance of the ``share`` of normal vectors closest to the centre is multiplied by."""
    if share >= 1:
        return 1.0

    def below(x: float) -> float:  # chi-square with DIMS = 5 degrees of freedom
        return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)

    low, high = 0.0, 100.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if below(x) < share else (low, x)
    return share / (share - (x / 2) ** 2.5 * math.exp(-x / 2) / math.gamma(3.5))


def _spread(cov: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Inverse of the covariance made consistent, each variance at its floor or above, and its log determinant."""
    k = _consistency(share) * cov + np.diag(FLOOR)
    return np.linalg.inv(k), float(np.linalg.slogdet(k)[1])


_NUMBERS = T.ArrayType(T.DoubleType())
_ESTIMATE = [T.StructField("centre", _NUMBERS), T.StructField("inverse", _NUMBERS), T.StructField("det", T.DoubleType())]


# types as objects: a DDL text would need a session while the module is imported
@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), *_ESTIMATE])))
def _starts(vectors: pd.Series) -> pd.Series:
    """The least determinants that concentration steps reach within each list of vectors."""
    def half(x: np.ndarray, d: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, float]:
        near = x[np.argsort(d, kind="stable")[:h]]
        return near.mean(0), *_spread(np.cov(near.T, bias=True).reshape(DIMS, DIMS), h / len(x))

    def away(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)

    out = []
    for rows in vectors:
        x = np.stack([np.asarray(r, float) for r in rows])
        x = x[np.lexsort(x.T)]
        h = min(len(x), (len(x) + DIMS + 1) // 2)
        middle = np.median(x, 0)
        mad = np.median(np.abs(x - middle), 0)
        first = [half(x, ((x - middle) ** 2 / ((1.4826 * mad) ** 2 + FLOOR)).sum(1), h)]
        random = np.random.default_rng(0)
        for _ in range(STARTS):
            few = x[random.choice(len(x), min(len(x), DIMS + 1), replace=False)]
            cov = np.cov(few.T, bias=True).reshape(DIMS, DIMS)
            first.append(half(x, away(x, few.mean(0), _spread(cov, 1.0)[0]), h))
        first = [half(x, away(x, c, v), h) for c, v, _ in first]
        found = []
        for best in sorted(first, key=lambda e: e[2])[:10]:
            while (after := half(x, away(x, best[0], best[1]), h))[2] < best[2] - 1e-9:
                best = after
            if all(abs(best[2] - e[2]) > 1e-6 for e in found):
                found.append(best)
        found = sorted(found, key=lambda e: e[2])[:GO_ON]
        out.append([(k, c.tolist(), v.ravel().tolist(), d) for k, (c, v, d) in enumerate(found)])
    return pd.Series(out)


@F.pandas_udf(T.StructType(_ESTIMATE))
def _again(all_: pd.Series, n: pd.Series, sums: pd.Series, squares: pd.Series) -> pd.DataFrame:
    """The estimate from the number of a group's texts, and the weight and sums of x and of x x' of its half."""
    out = []
    upper = np.triu_indices(DIMS)
    for whole, k, s, q in zip(all_, n, sums, squares, strict=True):
        m = np.asarray(s, float) / k
        c = np.zeros((DIMS, DIMS))
        c[upper] = np.asarray(q, float) / k
        c = c + np.triu(c, 1).T - np.outer(m, m)
        inverse, det = _spread(c, k / whole)
        out.append((m.tolist(), inverse.ravel().tolist(), det))
    return pd.DataFrame(out, columns=["centre", "inverse", "det"])


def _match(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.withColumnsRenamed({c: f"g_{c}" for c in ("level", "lang", "source")})
    return rows.join(g, (rows.level == g.g_level) & rows.lang.eqNullSafe(g.g_lang) & rows.source.eqNullSafe(g.g_source))


_GROUP = ("level", "lang", "source")


def _step(spread: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step of each start over all texts; ``old`` is the determinant before."""
    d = _distance("x", "centre", "inverse")
    cut = stored(_match(spread, groups).groupBy(*_GROUP, "start").agg(
        F.first("centre").alias("centre"), F.first("inverse").alias("inverse"), F.first("det").alias("old"),
        F.first("members").alias("members"), F.percentile_approx(d, 0.5, 10000).alias("cut")), "outlier-cut")
    terms = [F.col("x")[i] for i in range(DIMS)] + [F.col("x")[i] * F.col("x")[j] for i in range(DIMS) for j in range(i, DIMS)]
    parts = {"near": F.col("d") < F.col("cut"), "tied": F.col("d") == F.col("cut")}
    sums = _match(spread, cut).withColumn("d", d).where("d <= cut").groupBy(*_GROUP, "start").agg(
        F.first("members").alias("members"), F.first("old").alias("old"),
        *[F.count_if(on).alias(f"n_{p}") for p, on in parts.items()],
        *[F.array(*[F.sum(F.when(on, t).otherwise(0.0)) for t in terms]).alias(p) for p, on in parts.items()])
    # ties fill the half
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("members") / 2 - F.col("n_near")) / F.col("n_tied")))
    half = sums.withColumn("share", share).withColumn("n", F.col("n_near") + F.col("share") * F.col("n_tied")).withColumn(
        "s", F.zip_with("near", "tied", lambda a, b: a + F.col("share") * b))
    found = half.withColumn("e", _again("members", "n", F.slice("s", 1, DIMS), F.slice("s", DIMS + 1, len(terms) - DIMS)))
    return stored(found.select(*_GROUP, "start", "members", "old", "e.*"), "outlier-step")


def estimates(rows: DataFrame) -> DataFrame:
    """Robust centre and inverse per (lang, source), per lang and overall; ``rows``: doc_id, lang, source, x.

    Groups of fewer than LEAST texts are left out, but not that of all texts. The dice are thrown per row, so
    equal rows are not drawn together: a sample holds about SAMPLE texts whatever a group is made of.
    """
    none = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), none.alias("source")),
        F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")))
    spread = rows.select(F.explode(levels).alias("g"), "x", F.xxhash64(F.monotonically_increasing_id()).alias("dice")).select("g.*", "x", "dice")
    members = stored(spread.groupBy(*_GROUP).agg(F.count("*").alias("members")).where(
        (F.col("level") == 2) | (F.col("members") >= LEAST)), "outlier-members")
    sample = _match(spread, members).where(F.pmod("dice", F.lit(1 << 30)) * F.col("members") < F.lit(SAMPLE << 30))
    starts = sample.groupBy(*_GROUP, "members").agg(F.collect_list("x").alias("xs")).select(
        *_GROUP, "members", F.explode(_starts("xs")).alias("e"))
    columns = [*_GROUP, "start", "members", "centre", "inverse", "det"]
    groups = stored(starts.select(*_GROUP, "members", "e.*").select(*columns), "outlier-starts")
    # in a group that is its own sample the steps are done
    ended = [groups.where(F.col("members") <= SAMPLE)]
    going = groups.where(F.col("members") > SAMPLE).withColumn("det", F.lit(math.inf))
    while going.limit(1).count():
        after = _step(spread, going)
        falls = F.col("det") < F.col("old") - FALL
        ended.append(after.where(~falls).select(*columns))
        going = after.where(falls).select(*columns)
    every = ended[0]
    for e in ended[1:]:
        every = every.unionByName(e)
    return stored(every.groupBy(*_GROUP).agg(F.min_by(F.struct("centre", "inverse"), F.struct("det", "start")).alias("b"))
                  .select(*_GROUP, "b.*"), "outlier-groups")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, source, text) with the counts, base_failed, kept,
    and ``distance``, the squared robust distance (null where the base rules failed).

    Null texts have no words. Null languages and sources form groups of their own. Repeated rows
    are judged each; other columns are not read; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(statistics(docs).withColumn("base_failed", failed).withColumn("x", _vector()), "outlier-rows")
    groups = estimates(rows.where("not base_failed").select("doc_id", "lang", "source", "x"))
    out = rows
    for level in (0, 1, 2):
        g = groups.where(F.col("level") == level).select(
            F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
            *[F.col(c).alias(f"{c}{level}") for c in ("centre", "inverse")])
        on = F.lit(True)
        if level < 2:
            on = on & F.col("lang").eqNullSafe(F.col("g_lang"))
        if level < 1:
            on = on & F.col("source").eqNullSafe(F.col("g_source"))
        if level == 2:  # one row
            g = F.broadcast(g.limit(1))
        out = out.join(g, on, "left").drop("g_lang", "g_source")
    for c in ("centre", "inverse"):
        out = out.withColumn(c, F.coalesce(*[F.col(f"{c}{level}") for level in (0, 1, 2)]))
    distance = F.when(~F.col("base_failed"), _distance("x", "centre", "inverse"))
    return out.select(
        "doc_id", *_COUNTS, "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CHI_LIMIT)).alias("kept"), distance.alias("distance"))
