"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

Fit, on a bounded sample of labelled documents: the log-odds of each word under toxic and clean
labels with an informative Dirichlet prior (the words' share of all sampled documents), as a lower
confidence bound; words with a positive bound form the lexicon, every other word costs a little.
Near copies count once. On a part kept out of those counts: the Gumbel scale of the best segment
of a clean document, and the link from evidence to a probability.

Scoring walks each text once and finds all maximal segments in linear time. A segment's score S in
n words has an expected number K n exp(-lambda S) in clean text; the document's evidence is what
its segments exceed that by.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import fit_sample, labelled_texts, stored
from tidemark.llm.textarrays import shingle_sets, slices, text_column

_WORD = re.compile(r"[^\W\d_]+")
#: Size of the Dirichlet prior in documents at most, its share of the sample at most, and standard errors
#: below the estimate. On few labels a larger prior would hide every word.
PRIOR, PRIOR_SHARE = 1000.0, 0.1
ERRORS = 2.5
#: What a word outside the lexicon costs.
COST = 0.1


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    lexicon: dict[str, float]
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float
    cost: float = COST

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        level = math.log(max(self.scale * max(n, 1), 1e-12))
        return sum(max(0.0, self.rate * s - level) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.offset))))


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word + 1, score) of a text whose words at
    ``hits`` score as given and whose other words score ``-cost``; linear in the number of hits.

    The stack holds candidate segments with the running total before (left) and behind (right)
    them. A new one is joined with the last candidate that begins lower, if that one ends lower too.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, left, right, last lower candidate
    total, at = 0.0, 0
    for i, s in hits:
        total -= cost * (i - at)
        first, left = i, total
        total += s
        at = i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, at, left, total, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, r - lo) for f, e, lo, r, _ in stack]


def find(text: str, lexicon: dict[str, float], cost: float) -> tuple[list[tuple[int, int, float]], int]:
    all_words = words(text)
    hits = [(i, lexicon[w]) for i, w in enumerate(all_words) if w in lexicon]
    return segments(hits, cost), len(all_words)


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        tokens, at = shingle_sets(text_column(batch), 5)
        least = [int(tokens[a: b].min().view(np.int64)) if b > a else None for a, b in zip(at, at[1:])]
        bags = [Counter(words(t)) for t in text_column(batch).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(least, pa.int64()),
            pa.array([list(b) for b in bags], pa.list_(pa.string())),
            pa.array([list(b.values()) for b in bags], pa.list_(pa.int64())),
        ], names=["doc_id", "label", "least", "word", "n"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    """Learn from at most ``base.FIT_ROWS`` labelled documents; ``learn`` selects label rows."""
    texts = labelled_texts(docs, fit_sample(labels, label, learn), "toxic-texts")
    bags = texts.mapInArrow(_bags, "doc_id long, label int, least long, word array<string>, n array<long>")
    once = stored(
        bags.groupBy("least").agg(F.min_by(F.struct("doc_id", "label", "word", "n"), "doc_id").alias("x"))
        .select("x.*", (F.pmod(F.xxhash64("x.doc_id", F.lit(5)), F.lit(4)) == 0).alias("apart")),
        "toxic-bags")
    learnt = once.where("not apart")
    sums = {r["label"]: (r["d"], r["t"]) for r in learnt.groupBy("label").agg(
        F.count("*").alias("d"),
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("t")).collect()}
    clean, toxic = sums.get(0, (0, 0)), sums.get(1, (0, 0))
    if not clean[0] or not toxic[0]:
        share = toxic[0] / max(1, clean[0] + toxic[0])
        return Model({}, 1.0, 1.0, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    pairs = learnt.select("label", F.explode(F.arrays_zip("word", "n")).alias("x"))
    counts = pairs.groupBy("x.word").agg(
        F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"),
        F.sum(F.when(F.col("label") == 0, F.col("x.n")).otherwise(0)).alias("t0"),
    ).where((F.col("y1") >= 3) & (F.col("y1") * clean[0] > F.col("y0") * toxic[0])).toPandas()
    y1, y0 = counts["y1"].to_numpy(float), counts["y0"].to_numpy(float)
    size = min(PRIOR, PRIOR_SHARE * (clean[0] + toxic[0]))
    prior = size * (y1 + y0) / (clean[0] + toxic[0])
    odds = (np.log((y1 + prior) / (toxic[0] + size - y1 - prior).clip(1e-9))
            - np.log((y0 + prior) / (clean[0] + size - y0 - prior).clip(1e-9)))
    bound = odds - ERRORS * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    keep = bound > COST
    lexicon = dict(zip(counts["word"][keep], bound[keep].tolist(), strict=True))
    share = (counts["t0"].to_numpy(float)[keep] + prior[keep] / size) / max(1, clean[1])
    rate = _rate(share, bound[keep])
    apart = _apart(texts, once, lexicon)
    model = Model(lexicon, rate, 1.0, 1.0, 0.0)
    best = [(max((s for _, _, s in f), default=0.0), n) for f, n, y in apart if y == 0]
    decay = sum(max(n, 1) * math.exp(-rate * s) for s, n in best)
    model.scale = len(best) / decay if decay else 1.0
    x = np.array([math.log1p(model.evidence(f, n)) for f, n, _ in apart])
    model.slope, model.offset = logistic(x, np.array([y for *_, y in apart], float))
    return model


def _rate(share: np.ndarray, score: np.ndarray, cost: float = COST) -> float:
    """lambda: the positive root of E exp(lambda s) = 1 under the clean words' shares."""
    rest = max(0.0, 1 - share.sum())
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        over = (share * np.exp(np.minimum(mid * score, 600))).sum() + rest * math.exp(-mid * cost) > 1
        low, high = (low, mid) if over else (mid, high)
    return low


def _apart(texts: DataFrame, once: DataFrame, lexicon: dict[str, float]) -> list:
    """Segments, length and label of the documents kept out of the counts (a quarter of the sample)."""
    rows = texts.join(once.where("apart").select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, lexicon, COST) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([[s for _, _, s in f] for f, _ in found], pa.list_(pa.float64())),
                pa.array([n for _, n in found], pa.int64()), batch.column(1)], names=["s", "n", "label"])

    got = rows.select("text", "label").mapInArrow(run, "s array<double>, n long, label int").collect()
    return [([(0, 0, s) for s in r["s"]], r["n"], r["label"]) for r in sorted(got, key=lambda r: (r["n"], r["label"], r["s"]))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression (Newton steps, slope penalised)."""
    a, b = 0.0, 0.0
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design.T @ (y - p) - np.array([penalty * a, 1e-3 * b])
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([penalty, 1e-3])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's doc_id, score, evidence, n_words and ``passages``, its significant segments.

    A passage is (first word, last word + 1, segment score, expected number by chance). Null texts
    count as empty; those without words get the score of no evidence. Repeated rows are scored each,
    other columns are not read, an empty table gives no rows.
    """
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence, count, passages = [], [], [], []
            for text in batch.column(1):
                found, n = find(text.as_py() or "", model.lexicon, model.cost)
                e = model.evidence(found, n)
                scores.append(model.probability(e))
                evidence.append(e)
                count.append(n)
                chance = [(f, z, s, model.scale * n * math.exp(-model.rate * s)) for f, z, s in found]
                passages.append([dict(zip(("first", "end", "score", "expected"), c, strict=True)) for c in chance if c[3] < 1])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()),
                pa.array(count, pa.int64()), pa.array(passages, pa.list_(passage))],
                names=["doc_id", "score", "evidence", "n_words", "passages"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, evidence double, n_words long, "
             "passages array<struct<first: long, end: long, score: double, expected: double>>")
