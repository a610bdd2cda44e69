"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features and those of its neighbours give it a score, and moving
between good and bad costs what the chain has learnt. A document's quality is the mean probability
of good (forward-backward marginals), weighted by line length, put on the scale of the labels.
The chain is fitted on a bounded sample of labelled documents whose lines all carry the
document's label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import fit_sample, kept_rows, labelled_texts
from tidemark.llm.textarrays import LOWER, SPACE, as_bytes, slices, span_hashes, text_column, word_bounds
from tidemark.llm.toxicity import logistic

#: Documents that the chain is fitted on, at most, and lines that a document may have there.
FIT_DOCS = 5000
FIT_LINES = 1000
FEATURES = 12


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


_CLASSES = (
    _class(bytes(range(65, 91))), _class(b"#*$%&<>@^~=_\\{}[]"), _class(b"|"), _class(b"!?"),
    _class(bytes(range(48, 58))), _class(b".,;:"),
)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that has a word, each line's length, and each text's first line."""
    data, at = as_bytes(texts)
    n = len(data)
    first_byte = np.zeros(n, bool)
    first_byte[at[:-1][np.diff(at) > 0]] = True
    first_byte[1:] |= data[:-1] == 0x0A
    starts = np.flatnonzero(first_byte)
    ends = np.append(starts[1:], n)
    ends = ends - (data[ends - 1] == 0x0A) if len(starts) else ends
    w_start, w_end, _ = word_bounds(data, at)
    w_from, w_to = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    full = w_to > w_from
    starts, ends, w_from, w_to = starts[full], ends[full], w_from[full], w_to[full]
    first = np.searchsorted(starts, at)
    m = len(starts)
    if not m:
        return np.zeros((0, 3 * FEATURES + 1)), np.zeros(0), first
    size = (ends - starts).astype(float)

    def summed(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(v)])
        return c[b] - c[a]

    n_words = (w_to - w_from).astype(float)
    hashes = span_hashes(LOWER[data], w_start, w_end)
    again = np.zeros(len(hashes))
    again[1:] = hashes[1:] == hashes[:-1]
    again[w_from[w_from < len(again)]] = 0
    line_hash = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    order = np.lexsort((np.arange(m), line_hash, doc))
    same = np.zeros(m)
    same[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    x = np.empty((m, FEATURES))
    for j, c in enumerate(_CLASSES):
        x[:, j] = summed(c[data], starts, ends) / size
    x[:, 5] /= np.maximum(n_words / size, 1e-9)
    x[:, 6] = summed(again, w_from, w_to) / n_words
    x[:, 7] = same
    x[:, 8] = np.log1p(n_words) / 5
    x[:, 9] = n_words < 3
    x[:, 10] = summed(~SPACE[data], starts, ends) / n_words / 10
    x[:, 11] = np.isin(data[ends - 1], list(b".!?"))
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    heads, tails = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    left[heads], right[tails] = 0, 0
    return np.hstack([x, left, right, np.ones((m, 1))]), size, first


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chain(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    ``score``: of state 1 against state 0, per line; ``move``: 2 x 2. Returns the probability of
    state 1 per line, expected moves (2 x 2, summed), and the summed log partition.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, length = first[:-1][order], size[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # chains longer than t
    fwd = np.zeros((len(score), 2))
    back = np.zeros((len(score), 2))
    unit = np.stack([np.zeros(len(score)), score], 1)
    for t in range(longest):
        i = start[: active[t]] + t
        if t == 0:
            fwd[i] = unit[i]
        else:
            p = fwd[i - 1]
            fwd[i] = unit[i] + np.stack([_logsum(p[:, 0] + move[0, s], p[:, 1] + move[1, s]) for s in (0, 1)], 1)
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        nxt = back[i + 1] + unit[i + 1]
        back[i] = np.stack([_logsum(move[s, 0] + nxt[:, 0], move[s, 1] + nxt[:, 1]) for s in (0, 1)], 1)
    both = fwd + back
    total = _logsum(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(score), bool)
    inner[first[:-1][size > 0]] = False
    j = np.flatnonzero(inner)
    moves = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = np.exp(fwd[j - 1, a] + move[a, b] + unit[j, b] + back[j, b] - total[j]).sum()
    return good, moves, float(total[first[:-1][size > 0]].sum())


@dataclass
class Model:
    weight: np.ndarray
    move: np.ndarray
    slope: float
    offset: float

    def quality(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length-weighted mean probability of good per text (0 without lines), and per line."""
        x, size, first = lines(texts)
        good, _, _ = chain(x @ self.weight, first, self.move)
        c = np.concatenate([[0], np.cumsum(good * size)])
        w = np.concatenate([[0], np.cumsum(size)])
        total = w[first[1:]] - w[first[:-1]]
        mean = (c[first[1:]] - c[first[:-1]]) / np.maximum(total, 1e-9)
        return np.clip(mean, 0, 1), good, first

    def probability(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """Learn from at most FIT_DOCS labelled documents, those of more than FIT_LINES lines left out of the fit."""
    texts = labelled_texts(docs, fit_sample(labels, label, learn, FIT_DOCS), "quality-texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x, size, first = lines(text_column(batch))
            x = x[:, :FEATURES]
            ids, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = [i for i in range(len(ids)) if 0 < first[i + 1] - first[i] <= FIT_LINES]
            part = [slice(first[i], first[i + 1]) for i in ok]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in ok], pa.int64()), pa.array([y[i] for i in ok], pa.int32()),
                pa.array([x[p].astype(np.float32).ravel() for p in part], pa.list_(pa.float32())),
                pa.array([size[p] for p in part], pa.list_(pa.float64()))], names=["doc_id", "label", "x", "size"])

    rows = texts.mapInArrow(run, "doc_id long, label int, x array<float>, size array<double>").toArrow().sort_by("doc_id")
    labels_, count = rows["label"].to_numpy(), np.array([len(s) for s in rows["size"]], np.int64)
    if not len(count) or len(set(labels_.tolist())) < 2:
        share = float(labels_.mean()) if len(labels_) else 0.5
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, float(odds))
    own = np.concatenate([np.asarray(x.values).reshape(-1, FEATURES) for x in rows["x"]]).astype(float)
    size = np.concatenate([np.asarray(s.values) for s in rows["size"]])
    first = np.concatenate([[0], np.cumsum(count)])
    left, right = np.zeros_like(own), np.zeros_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    left[first[:-1]], right[first[1:] - 1] = 0, 0
    x = np.hstack([own, left, right, np.ones((len(own), 1))])
    y = np.repeat(labels_, count).astype(float)
    weight, move = _train(x, y, first)
    good, _, _ = chain(x @ weight, first, move)
    mean = np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1])
    slope, offset = logistic(mean, labels_.astype(float))
    return Model(weight, move, slope, offset)


def _train(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam steps over all lines."""
    n = len(y)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.array([[((y[j - 1] == a) & (y[j] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, moves, _ = chain(x @ theta[:-4], first, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - good), (seen - moves).ravel()]) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's doc_id, score, n_lines and n_bad_lines (probability of good below one half).

    Lines without a word are left out. Null and empty texts have no lines and get the score of
    quality 0. Repeated rows are scored each, other columns are not read, an empty table gives no rows.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            mean, good, first = model.quality(text_column(batch))
            bad = np.concatenate([[0], np.cumsum(good < 0.5)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(model.probability(mean)), pa.array(np.diff(first).astype(np.int64)),
                pa.array((bad[first[1:]] - bad[first[:-1]]).astype(np.int64))],
                names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_lines long, n_bad_lines long")


def accept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns as they are.

    Null and empty texts have the score of quality 0, repeated rows are judged each, null ids are no matter,
    columns of any name come through, an empty table gives no rows.
    """
    return kept_rows(docs, lambda texts: model.probability(model.quality(texts)[0]) >= least)
