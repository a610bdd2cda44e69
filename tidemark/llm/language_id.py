"""Language of a text by the nearest of several centroids per language.

A text is a vector of hashed character 1- to 3-grams over lower-cased letters (everything else
parts words), weighted by TF-IDF and of length one. Each language has a few centroids from
spherical k-means over a bounded sample of its labelled texts, and each centroid a radius: the
cosine distance that nearly all of its own texts keep. A text outside its nearest centroid's
radius is rejected; the nearest language is given all the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.base import FIT_ROWS, stored
from tidemark.llm.textarrays import slices, text_column

CELLS = 4096
CENTROIDS = 4
#: Sampled texts per language; over all languages at most ``base.FIT_ROWS``.
PER_LANGUAGE = 400
#: Share of a centroid's own texts within its radius, and the slack on it.
WITHIN, SLACK = 0.99, 1.25
#: Sharpness of the score over languages.
SHARP = 20.0
UNKNOWN = "und"
_CHUNK = 128


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls.table


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (texts x CELLS) and whether each text has a letter."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 2 for t in low], np.int64)
    c = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _Letters.get()[np.minimum(c, 0x10FFFF)]
    c = np.where(letter, c, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(low)), size)
    out = np.zeros(len(low) * CELLS)
    key = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        key = (key[:m] * np.uint64(0x100000001B3)) ^ c[n - 1:]
        ok = (doc[:m] == doc[n - 1:]) & letter[n // 2: n // 2 + m]
        h = ((key[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        out += np.bincount(doc[:m][ok] * CELLS + h.astype(np.int64), minlength=len(out))
    has = np.bincount(doc[letter], minlength=len(low)) > 0
    return out.reshape(len(low), CELLS), has


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest points: centroids of length one, and each row's own."""
    mean = v.mean(0)
    seeds = [int(np.argmax(v @ mean))]
    for _ in range(min(k, len(v)) - 1):
        seeds.append(int(np.argmin((v @ v[seeds].T).max(1))))
    c = v[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                s = v[own == j].sum(0)
                c[j] = s / max(np.linalg.norm(s), 1e-12)
    return c, np.argmax(v @ c.T, 1)


@dataclass
class Model:
    languages: list[str]  # one per centroid
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [], [], []
        kinds = sorted(set(self.languages))
        member = [np.array([x == k for x in self.languages]) for k in kinds]
        for i in range(0, len(texts), _CHUNK):
            n, has = counts(texts[i: i + _CHUNK])
            near = vectors(n, self.idf) @ self.centroids.T
            for row, ok in zip(near, has, strict=True):
                if not ok or not kinds:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                best = np.array([row[m].max() for m in member])
                w = np.exp(SHARP * (best - best.max()))
                j = int(np.argmax(best))
                names.append(kinds[j])
                scores.append(float(w[j] / w.sum()))
                c = int(np.argmax(np.where(member[j], row, -2)))
                rejected.append(bool(1 - row[c] > self.radius[c]))
        return names, scores, rejected


def fit(docs: DataFrame, learn: Column) -> Model:
    """Learn from text and lang of the rows that ``learn`` selects and whose text has a letter."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id", F.lit(29)), F.col("doc_id")]
    ids = (
        known.select("doc_id", "lang").withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
        .where(F.col("_n") <= PER_LANGUAGE).orderBy("_n", *order).limit(FIT_ROWS)
    )
    small = F.broadcast(ids.select(F.col("doc_id").alias("_id")).distinct())  # at most FIT_ROWS ids
    # one text, the least, per id and language: the bound on ids bounds texts
    texts = stored(known.select("doc_id", "lang", "text").join(small, F.col("doc_id") == F.col("_id"), "left_semi")
                   .groupBy("doc_id", "lang").agg(F.min("text").alias("text")), "language-texts")

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_in, total = np.zeros(CELLS), 0
        for batch in (part for whole in batches for part in slices(whole)):
            part = text_column(batch).to_pylist()
            for i in range(0, len(part), _CHUNK):
                n, has = counts(part[i: i + _CHUNK])
                docs_in += (n > 0).sum(0)
                total += int(has.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, CELLS)), pa.array(np.concatenate([[total], docs_in]).astype(np.int64))],
            names=["cell", "n"])

    got = texts.select("text").mapInArrow(present, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CELLS + 1)
    for r in got:
        n[r["cell"] + 1] = r["n"]
    idf = np.log((1 + n[0]) / (1 + n[1:])) + 1

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        some = []
        for i in range(0, len(rows), _CHUNK):
            n, has = counts(rows["text"].iloc[i: i + _CHUNK].tolist())
            some.append(vectors(n[has], idf))
        v = np.concatenate(some) if some else np.zeros((0, CELLS))
        if not len(v):
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        c, own = cluster(v, CENTROIDS)
        away = 1 - (v * c[own]).sum(1)
        used = np.unique(own)
        return pd.DataFrame({
            "lang": rows["lang"].iloc[0], "centroid": [c[j].astype(np.float32) for j in used],
            "radius": [float(np.quantile(away[own == j], WITHIN) * SLACK) for j in used]})

    rows = texts.groupBy("lang").applyInPandas(group, "lang string, centroid array<float>, radius double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["radius"]))
    centroids = np.array([r["centroid"] for r in rows]).reshape(len(rows), CELLS)
    return Model([r["lang"] for r in rows], centroids, np.array([r["radius"] for r in rows]), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's doc_id, lang_pred, score and whether the nearest centroid's radius rejects it.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was
    learnt. Ties go to the first language by name. Repeated rows are judged each, other columns are
    not read, an empty table gives no rows.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
            names, scores, rejected = model.predict(text_column(batch).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
