"""Numpy views of Arrow text columns: bytes, words and hashed word shingles of many documents at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and each text's bounds (one more than texts)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    at = as_bytes(text_column(batch))[1]
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's first word (one more than documents).

    Words are runs of bytes other than white space; they never cross documents.
    """
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number, without a copy per place; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time are mixed in, longest spans last."""
    code = eight_bytes(data)
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(_U) * _U(_BASE))
    long = np.flatnonzero(size > 1 << 12)  # few in any slice; their own hash spares thousands of rounds
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    rest = np.flatnonzero((size > 0) & (size <= 1 << 12))
    j = 0
    while len(rest):
        left = size[rest] - j
        word = code[starts[rest] + j]
        short = np.flatnonzero(left < 8)
        word[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        out[rest] = mix((out[rest] ^ word) * _U(_STEP))
        j += 8
        rest = rest[left > 8]
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``data`` from ``a`` and of ``other`` from ``b`` hold the same ``size`` bytes."""
    same = np.ones(len(a), bool)
    for i in np.flatnonzero(size > 256):
        same[i] = np.array_equal(data[a[i]: a[i] + size[i]], other[b[i]: b[i] + size[i]])
    code, other_code = eight_bytes(data), eight_bytes(other)
    rest = np.flatnonzero((size > 0) & (size <= 256))
    j = 0
    while len(rest):
        left = size[rest] - j
        x = code[a[rest] + j] ^ other_code[b[rest] + j]
        short = np.flatnonzero(left < 8)
        x[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
        same[rest[x != 0]] = False
        rest = rest[(x == 0) & (left > 8)]
        j += 8
    return same


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words and the document each belongs to.

    A document with 1 to ``k`` - 1 words has one shingle, the whole sequence.
    """
    count = np.diff(first)
    n = len(words)
    doc = np.repeat(np.arange(len(count)), count)
    acc = np.zeros(max(n - k + 1, 0), _U)
    for j in range(k):
        acc += words[j: n - k + 1 + j] * _U((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1)) if len(acc) else acc
    whole = doc[: len(acc)] == doc[k - 1:] if len(acc) else np.zeros(0, bool)
    out, owner = mix(acc[whole]), doc[: len(acc)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += words[first[short][has] + j] * _U((0xA0761D6478BD642F * (2 * j + 3)) & (2**64 - 1))
        extra = mix(extra + count[short].astype(_U))
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: all sets end to end, each in hash order, and their bounds."""
    data, at = as_bytes(texts)
    low = LOWER[data]
    starts, ends, first = word_bounds(low, at)
    out, owner = shingles(span_hashes(low, starts, ends), first, k)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))
