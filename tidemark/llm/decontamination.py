"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

A passage of m bytes that occurs with at most k edits shares at least m - q + 1 - k q of its q-grams
with the text, all on diagonals (text position minus passage position) within k of each other.
Shared q-grams are counted in overlapping bands of diagonals; bands below the bound are dropped, the
others are verified by an alignment within the band.

Letters A-Z count as a-z and white space bytes as blanks. Items longer than WINDOW are searched in
windows that overlap by half. Items longer than PIECE are also searched in pieces of PIECE bytes, one
every STRIDE: a copied part of PIECE + STRIDE - 1 bytes holds a whole piece. Pieces count in texts where
the item is not found by its whole text or windows. The items are taken in blocks of bounded size; each
block is one pass over the documents, without a shuffle. Tasks are sent a block's items and build their index
from them, once per worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import kept_in_worker, kept_rows
from tidemark.llm.textarrays import LOWER, SPACE, as_bytes, slices, text_column

Q = 8
WINDOW = 256
PIECE, STRIDE = 96, 32
#: Edits per byte that a passage may have, and the shortest item that is evidence of anything.
EDITS = 0.06
SHORTEST = 24
#: Benchmark bytes per pass: an index takes some 80 bytes for each.
BLOCK_BYTES = 1 << 20
#: Shared q-grams looked at in one go (a text with more goes alone), and the numbers of (text, passage)
#: that fit a key above the 34 bits of a band.
HITS, PAIRS = 4 << 20, 1 << 29
_U = np.uint64
_TABLE_BITS = 23
_FOLD = LOWER.copy()
_FOLD[SPACE] = 0x20


def _grams(data: np.ndarray) -> np.ndarray:
    """Every run of eight bytes as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, _U)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - _TABLE_BITS)


def budget(m: int) -> int:
    """Edits that a passage of ``m`` bytes may have: a share EDITS, as far as the lemma still filters."""
    return max(0, min(int(m * EDITS), (m - Q) // (Q + 1)))


@dataclass
class Index:
    item: list[int]  # of each passage
    piece: np.ndarray  # whether it is a piece
    text: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted
    passage: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Index:
        owner, texts, piece = [], [], []
        for item, text in items:
            data = _FOLD[np.frombuffer((text or "").strip().encode(), np.uint8)]
            if len(data) < SHORTEST:
                continue
            starts = [0] if len(data) <= WINDOW else [*range(0, len(data) - WINDOW, WINDOW // 2), len(data) - WINDOW]
            pieces = [*range(0, len(data) - PIECE, STRIDE), len(data) - PIECE] if len(data) > PIECE else []
            owner += [item] * (len(starts) + len(pieces))
            texts += [data[s: s + WINDOW] for s in starts] + [data[s: s + PIECE] for s in pieces]
            piece += [False] * len(starts) + [True] * len(pieces)
        k = np.array([budget(len(t)) for t in texts], np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        grams = [_grams(t) for t in texts]
        flat = np.concatenate([np.zeros(0, _U), *grams])
        order = np.argsort(flat, kind="stable")
        count = np.array([len(g) for g in grams], np.int64)
        passage = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        place = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(g), dtype=np.int32) for g in grams]])
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[_slot(flat)] = True
        return Index(owner, np.array(piece, bool), texts, k, size - Q + 1 - k * Q, flat[order], passage[order], place[order], table)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, edits): the best place of each passage found in each text."""
        if not len(self.gram):
            return []
        raw, at = as_bytes(texts)
        data = _FOLD[raw]
        grams = _grams(data)
        spot = np.flatnonzero(self.table[_slot(grams)])
        first = np.searchsorted(self.gram, grams[spot], "left")
        last = np.searchsorted(self.gram, grams[spot], "right")
        hit = last > first
        spot, first, count = spot[hit], first[hit], (last - first)[hit]
        doc = np.searchsorted(at, spot, "right") - 1
        inside = spot + Q <= at[doc + 1]
        spot, first, count, doc = spot[inside], first[inside], count[inside], doc[inside]
        if not len(spot):
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # runs of texts with a bounded number of hits and of (text, passage) numbers
        total = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        one = int(doc[0])
        while one <= doc[-1]:
            most = min(len(texts), one + max(1, PAIRS // len(self.item)))
            end = min(most, max(one + 1, int(np.searchsorted(total, total[one] + HITS, "right")) - 1))
            a, b = np.searchsorted(doc, [one, end])
            if b > a:
                self._verify(data, at, doc[a:b], spot[a:b], first[a:b], count[a:b], best)
            one = end
        return [(d, p, *v) for (d, p), v in sorted(best.items())]

    def _verify(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, spot: np.ndarray, first: np.ndarray,
                count: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Put the best place of each passage found in a run of texts into ``best``; the other arrays are their q-grams."""
        base = int(doc[0])
        stop = np.cumsum(count)
        post = np.repeat(first - (stop - count), count) + np.arange(stop[-1])
        passage = self.passage[post]
        doc = np.repeat(doc, count)
        diagonal = np.repeat(spot, count) - at[doc] - self.place[post] + WINDOW  # not negative
        step = 2 * self.edits[passage] + 1
        band = diagonal // step
        key = ((doc - base) * len(self.item) + passage) << 34
        # a band may count each q-gram of the passage once
        place = self.place[post]
        both = np.concatenate([key | (band + 1), key | band])
        both, place = _enough(both, np.concatenate([place, place]), self.bound, len(self.item))
        order = np.lexsort((place, both))
        both, place = both[order], place[order]
        once = np.ones(len(both), bool)
        once[1:] = (both[1:] != both[:-1]) | (place[1:] != place[:-1])
        keys, n = np.unique(both[once], return_counts=True)
        which = (keys >> 34) % len(self.item)
        keep = np.flatnonzero(n >= self.bound[which])
        keep = keep[np.argsort(self.piece[which[keep]], kind="stable")]
        whole = set()
        for d, p, b in zip((base + (keys[keep] >> 34) // len(self.item)).tolist(), which[keep].tolist(),
                           ((keys[keep] & ((1 << 34) - 1)) - 1).tolist(), strict=True):
            if best.get((d, p), (0, 0, 1))[2] == 0 or (self.piece[p] and (d, self.item[p]) in whole):
                continue
            k = int(self.edits[p])
            low = b * (2 * k + 1) - WINDOW
            found = align(self.text[p], data[at[d]: at[d + 1]], low - k, low + 2 * (2 * k + 1) + k, k)
            if found and ((d, p) not in best or found[2] < best[d, p][2]):
                best[d, p] = found
                if not self.piece[p]:
                    whole.add((d, self.item[p]))


def _enough(key: np.ndarray, place: np.ndarray, bound: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop hits of bands that can't reach their bound even if every hit counted, by a hashed count."""
    slot = (key.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(44)).astype(np.int64)
    ok = np.bincount(slot, minlength=1 << 20)[slot] >= bound[(key >> 34) % passages]
    return key[ok], place[ok]


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of the passage in the text on diagonals ``low`` to ``high``, if within ``k``.

    One row per byte of the passage, one cell per diagonal; start carries along with each cell.
    """
    m, width = len(passage), high - low + 1
    same = text[max(0, low): max(0, high + m)].tobytes().find(passage.tobytes())
    if same >= 0:
        return max(0, low) + same, max(0, low) + same + m, 0
    diagonal = np.arange(low, high + 1)
    cells = np.arange(width)
    far = m + width + 1
    padded = np.full(m + width + 1, 256, np.int64)
    a, b = max(0, low), min(len(text), high + m)
    if b <= a:
        return None
    padded[a - low: b - low] = text[a:b]
    cost = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far)
    start = diagonal.copy()
    for i in range(m):
        use = cost + (padded[i: i + width] != passage[i])
        skip = np.append(cost[1:] + 1, far)
        here = np.where(use <= skip, use, skip)
        from_ = np.where(use <= skip, start, np.append(start[1:], 0))
        # extra bytes of the text: the best cell to the left plus the distance
        level = here - cells
        low_ = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low_, cells, 0))
        cost, start = low_ + cells, from_[at]
        if cost.min() > k:
            return None
    end = diagonal + m
    ok = np.flatnonzero((end >= 0) & (end <= len(text)) & (cost <= k))
    if not len(ok):
        return None
    c = ok[np.argmin(cost[ok])]
    return max(0, int(start[c])), int(end[c]), int(cost[c])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of bytes at a time."""
    items, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    for r in rows.toLocalIterator():
        items.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield items
            items, size = [], 0
    if items:
        yield items


def _index(items: list[tuple[int, str]]) -> Index:
    return kept_in_worker("benchmark", items, lambda: Index.of(items))


_HITS = "doc_id long, item_id long, start long, end long, edits long"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item found: doc_id, item_id, n_passages, and the best passage's byte
    range and edits; the passages are pieces if no longer part is found.

    Null and short texts and items match nothing, repeated rows of a document count as one, repeated
    items count once, other columns are not read; empty tables give no rows.
    """
    out = docs.sparkSession.createDataFrame([], _HITS)
    for items in _blocks(benchmark):
        def run(batches: Iterable[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = _index(items)
            for batch in (part for whole in batches for part in slices(whole)):
                found = index.search(text_column(batch))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.item[f[1]] for f in found], pa.int64()),
                     *[pa.array([f[j] for f in found], pa.int64()) for j in (2, 3, 4)]],
                    names=["doc_id", "item_id", "start", "end", "edits"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, _HITS))
    best = F.min(F.struct("edits", "start", "end")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(F.countDistinct("start").alias("n_passages"), best).select(
        "doc_id", "item_id", "n_passages", F.col("b.start").alias("start"), F.col("b.end").alias("end"),
        F.col("b.edits").alias("edits"))


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, all columns as they are.

    Null, empty and short texts stay, repeated rows are judged each, columns of any name come through, an
    empty table gives no rows; with an empty benchmark all rows stay.
    """
    out = docs
    for items in _blocks(benchmark):
        def clean(texts: pa.Array, items: list = items) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[f[0] for f in _index(items).search(texts)]] = False
            return keep

        out = kept_rows(out, clean)
    return out
