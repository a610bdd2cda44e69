"""How filters interact: what each removes, repeats and loses in every order of them.

One pass of a table-driven byte transducer takes each text's statistics: the class of a byte and the state
before it are looked up in a table whose entry says what is put out: a word opens or closes, a capital, a code
point, a symbol. Its two states (between words, in a word) follow from the last byte's class alone, so a slice
of bytes is looked up at once. Word spans go into an open-addressing hash table; a word that finds its slot
held is compared byte by byte with the holder and goes on to the next slot if they differ, so no hash decides.

Every text then is one bit per failed filter. Rows are reduced to counts per part and set of bits before
anything else is done: all orders and steps are read from at most 32 counts of each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textarrays import as_bytes, equal_spans, mix, slices, span_hashes, text_column

FILTERS = "ABCDE"
#: Bytes of a text that are run through the transducer at once; longer texts are cut between words.
STRETCH = 1 << 20
_U = np.uint64

# Classes of bytes, states, and what a step puts out.
SPACE, INNER, CAPITAL, SYMBOL, OTHER = range(5)
BETWEEN, WITHIN = range(2)
OPEN, CLOSE, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16


def _tables(symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, state after each class, and output by (state before, class)."""
    kind = np.full(256, OTHER, np.uint8)
    kind[list(b" \t\n\v\f\r")] = SPACE
    kind[0x80:0xC0] = INNER  # bytes of a character after its first
    kind[ord("A"): ord("Z") + 1] = CAPITAL
    kind[list(symbols)] = SYMBOL
    after = np.full(5, WITHIN, np.uint8)
    after[SPACE] = BETWEEN
    out = np.zeros((2, 5), np.uint8)
    out[:, [SPACE, CAPITAL, SYMBOL, OTHER]] |= POINT
    out[BETWEEN, 1:] |= OPEN
    out[WITHIN, SPACE] |= CLOSE
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    return kind, after, out.ravel()


def _stretches(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces of at most some STRETCH bytes that end between words, and the text of each piece."""
    if not len(at) or np.diff(at).max(initial=0) <= STRETCH:
        return at, np.arange(len(at) - 1)
    bounds, owner = [0], []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a > STRETCH:
            step = 1 << 16
            end = a + STRETCH
            while end < b and kind[data[end]] != SPACE:  # to the end of the word, however long
                ahead = np.flatnonzero(kind[data[end: min(b, end + step)]] == SPACE)
                end = end + int(ahead[0]) if len(ahead) else min(b, end + step)
            bounds.append(end)
            owner.append(i)
            a = end
        bounds.append(b)
        owner.append(i)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def first_of_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for each span that found no equal span of its owner in the table."""
    size = ends - starts
    mask = (1 << max(1, 2 * len(starts)).bit_length()) - 1
    slot = (mix(span_hashes(data, starts, ends) ^ mix(owner.astype(_U))) & _U(mask)).astype(np.int64)
    holder = np.full(mask + 1, -1, np.int64)
    new = np.zeros(len(starts), bool)
    waiting = np.arange(len(starts))
    while len(waiting):
        s = slot[waiting]
        empty = waiting[holder[s] < 0][::-1]
        holder[slot[empty]] = empty  # of several for one slot the first is written last
        held = holder[s]
        new[waiting[held == waiting]] = True
        other = np.flatnonzero((held != waiting) & ((owner[held] != owner[waiting]) | (size[held] != size[waiting])))
        alike = np.flatnonzero((held != waiting) & (owner[held] == owner[waiting]) & (size[held] == size[waiting]))
        differ = alike[~equal_spans(data, starts[held[alike]], data, starts[waiting[alike]], size[waiting[alike]])]
        waiting = waiting[np.sort(np.concatenate([other, differ]))]
        slot[waiting] = (slot[waiting] + 1) & mask
    return new


@dataclass(frozen=True)
class Profile:
    """Statistics of each text."""

    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray


def profile(texts: pa.Array, symbols: bytes = b"#$%&*|") -> Profile:
    """Words (runs of bytes other than white space), distinct ones, A-Z, code points, and ``symbols`` of each text."""
    kind, after, table = _tables(symbols)
    data, bounds = as_bytes(texts)
    at, text = _stretches(data, bounds, kind)
    n = len(bounds) - 1
    totals = [np.zeros(n, np.int64) for _ in range(5)]
    seen: dict[int, set[bytes]] = {}  # of texts in several pieces
    cut = np.bincount(text, minlength=n) > 1
    first = 0
    while first < len(text):  # pieces of about one stretch at a time
        last = max(first + 1, int(np.searchsorted(at, at[first] + STRETCH, "right")) - 1)
        part, edge, own = data[at[first]: at[last]], at[first: last + 1] - at[first], text[first:last]
        classes = kind[part]
        before = np.empty(len(part), np.uint8)
        before[1:] = after[classes[:-1]]
        before[edge[:-1][np.diff(edge) > 0]] = BETWEEN
        put = table[before * np.uint8(5) + classes]
        starts = np.flatnonzero(put & OPEN)
        closes = np.zeros(len(part) + 1, bool)
        closes[:-1] = (put & CLOSE) != 0
        full = edge[1:][np.diff(edge) > 0]
        closes[full] |= after[classes[full - 1]] == WITHIN
        ends = np.flatnonzero(closes)
        piece = np.searchsorted(edge, starts, "right") - 1
        new = first_of_equal(part, starts, ends, piece)
        fresh = np.bincount(piece[new], minlength=len(own))
        for k in np.flatnonzero(cut[own]):
            mine = np.flatnonzero(new & (piece == k))
            known = seen.setdefault(int(own[k]), set())
            size = len(known)
            known.update(part[starts[i]: ends[i]].tobytes() for i in mine)
            fresh[k] = len(known) - size
        piece_of = np.repeat(np.arange(len(own)), np.diff(edge))
        counts = [np.bincount(piece, minlength=len(own)), fresh,
                  *[np.bincount(piece_of[(put & flag) != 0], minlength=len(own)) for flag in (IS_CAPITAL, POINT, IS_SYMBOL)]]
        for total, c in zip(totals, counts, strict=True):
            np.add.at(total, own, c)
        first = last
    return Profile(*totals)


def failures(texts: pa.Array) -> np.ndarray:
    """One bit per failed filter of A to D, A lowest: under 50 words; distinct words below 65 %; capitals
    above 5 % of code points; any of ``#$%&*|``."""
    p = profile(texts)
    fails = (p.words < 50, 100 * p.distinct < 65 * p.words, 100 * p.capitals > 5 * p.points, p.symbols > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest): a slim row of each row of ``docs``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = text_column(batch)
            data, at = as_bytes(texts)
            digest = [hashlib.blake2b(data[a:b], digest_size=16).digest()
                      for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(failures(texts)), pa.array(digest, pa.binary())],
                names=["doc_id", "part", "fails", "digest"])

    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return slim.mapInArrow(run, "doc_id long, part string, fails long, digest binary")


def _flag(labels: DataFrame, column: str) -> Column:
    return F.max(F.coalesce(F.col(column) == 1, F.lit(False)).cast("int"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the set of filters they fail, E included.

    Rows with one id, text and source are counted together from the start, so repeated rows and groups of copies are
    small before they move. The first of equal texts is found by its digest and id: that join's key is as
    good as unique, however many copies a text has.
    """
    rows = _judged(docs).groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        _flag(labels, "quality").alias("good"), _flag(labels, "toxic").alias("toxic"))
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return (
        rows.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
        .join(marks, "doc_id", "left")
        .groupBy("part", (F.col("fails") + F.when(again, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))).alias("fails"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
             F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )


def _steps() -> Column:
    """All orders and steps as a literal array: order, step, the step's bit, and the bits before it."""
    parts = []
    for order in permutations(FILTERS):
        gone = 0
        for step, letter in enumerate(order, start=1):
            bit = 1 << FILTERS.index(letter)
            parts.append(f"struct('{''.join(order)}' as filter_order, {step} as step, {bit}L as bit, {gone}L as gone)")
            gone |= bit
    return F.expr(f"array({', '.join(parts)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step, with what the step does to the part.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. Null texts are empty, a null source is the
    part ''. A document counts as good (toxic) if any label row of its id says 1; null labels and ids say nothing. A
    null id is neither smaller than any id nor has smaller ones, so it never fails E; repeated rows of one id do not make
    each other fail. Equal texts are found by 128-bit digests. Other columns are not read; an empty table gives no rows.
    """
    per_part = patterns(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("found"))  # at most 32

    def total(value: str, when) -> Column:
        return F.aggregate(F.filter("found", when), F.lit(0).cast("long"), lambda a, p: a + p[value])

    bit, gone = F.col("bit"), F.col("gone")
    fails = lambda p: p["fails"].bitwiseAND(bit) != 0
    met = lambda p: p["fails"].bitwiseAND(gone) == 0
    here = lambda p: met(p) & fails(p)
    # a document that fails k filters is removed by each of them in 120 / k of the orders
    share = F.aggregate(
        F.filter("found", fails), F.lit(0).cast("long"),
        lambda a, p: a + p["n"] * (F.lit(120) / F.bit_count(p["fails"])).cast("long"))
    return per_part.select("part", "found", F.inline(_steps())).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda p: met(p) & ~fails(p)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda p: ~met(p) & fails(p)).alias("redundant"),
        total("n", lambda p: p["fails"] == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"))
