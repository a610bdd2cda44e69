"""Best-fit packing of token sequences with a fixed number of open bins (bounded space, online).

Documents are tokenised where they are read and packed in the order in which they come, partition
by partition: nothing is shuffled, and a lost task repeats its own packing. A bit set keyed by free
space finds the tightest open bin in one step; when a new bin is needed and all are open, the
fullest one closes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.textarrays import as_bytes, slices, span_hashes, text_column

SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long")
SEQUENCE = 1024
END = 2
OPEN_BINS = 256
#: Added tokens of the public vocabulary: their ids stand wherever a text holds them.
ADDED = {"<|endoftext|>": 50256}


class OpenBins:
    """At most ``limit`` open bins of ``size``; ``place`` gives (bin number, offset)."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.made, self.open = size, limit, 0, 0
        self.free_bits = 0  # bit f is set while an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            number, free = self.made, self.size
            self.made += 1
        if free > length:
            self.bins[free - length].append(number)
            self.free_bits |= 1 << (free - length)
            self.open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return number


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only a first piece may be shorter than ``size``."""
    head = length % size if length > size else length
    out = [(0, head)] if head else []
    return out + [(s, size) for s in range(head, length, size)]


class Encoder:
    """Ids of a public byte-level BPE vocabulary for many texts at once.

    The vocabulary's pattern ties a blank to the word behind it and never joins
    text across it, so texts are cut before each blank, and of equal pieces in
    a slice one is encoded. Texts in which a blank stands next to other white
    space, or which hold an added token, are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = ADDED if added is None else added
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.encode, self.encode_added = encoding.encode_ordinary, partial(encoding.encode, allowed_special="all")
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(k) for k in ranks]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit little-endian ids of each text (no nulls)."""
        data, at = as_bytes(texts)
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = self._whole(data, at) | holds
        out: list[np.ndarray] = [_NONE] * len(texts)
        for i in np.flatnonzero(whole):
            encode = self.encode_added if holds[i] else self.encode
            out[i] = np.array(encode(texts[int(i)].as_py()), "<u4")
        rest = np.flatnonzero(~whole & (np.diff(at) > 0))
        if len(rest):
            flat, bounds = self._by_pieces(*as_bytes(texts.take(pa.array(rest))))
            for k, i in enumerate(rest):
                out[i] = flat[bounds[k]: bounds[k + 1]]
        return out

    @staticmethod
    def _whole(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts with white space other than line ends and single blanks before a word."""
        after = np.full(len(data), 0x20, np.uint8)
        after[:-1] = data[1:]
        ends = at[1:] - 1
        after[ends[np.diff(at) > 0]] = 0x20
        odd = _ODD[data] | ((data == 0x20) & ((after == 0x20) | (after == 0x0A)))
        odd |= (data == 0xC2) & ((after == 0x85) | (after == 0xA0))
        return np.diff(np.concatenate([[0], np.cumsum(odd)])[at]) > 0

    def _by_pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = data == 0x20
        first[at[:-1]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        _, one, same = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[one], ends[one]
        order = np.argsort(data[s] != 0x20, kind="stable")  # the few that begin a text come last
        inner = order[: int((data[s] == 0x20).sum())]
        ids = [np.zeros(0, np.int64)]
        count = np.zeros(len(one), np.int64)
        if len(inner):
            size = e[inner] - s[inner]
            stop = np.cumsum(size)
            text = data[np.repeat(s[inner] - (stop - size), size) + np.arange(stop[-1])]
            got = np.array(self.encode(text.tobytes().decode("utf-8")), np.int64)
            begins = np.cumsum(self.width[got]) - self.width[got]
            count[inner] = np.bincount(np.searchsorted(stop, begins, "right"), minlength=len(inner))
            ids.append(got)
        for i in order[len(inner):]:
            got = np.array(self.encode(data[s[i]: e[i]].tobytes().decode("utf-8")), np.int64)
            count[i] = len(got)
            ids.append(got)
        flat = np.concatenate(ids).astype("<u4")
        place = np.empty(len(one), np.int64)
        place[order] = np.cumsum(count[order]) - count[order]
        n = count[same]
        stop = np.cumsum(n)
        out = flat[np.repeat(place[same] - (stop - n), n) + np.arange(stop[-1] if len(n) else 0)]
        return out, np.concatenate([[0], stop])[np.searchsorted(starts, at)]


_NONE = np.zeros(0, "<u4")
#: First bytes of white space beyond blanks and line ends (and of some other characters).
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0xE1, 0xE2, 0xE3]] = True


def pack(docs: DataFrame, size: int = SEQUENCE, end_id: int = END, open_bins: int = OPEN_BINS,
         ranks_path: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text).

    Null and empty texts are one piece that holds the end id. Repeated rows are packed again
    each; other columns are not read. Sequence numbers are unique and carry the partition.
    An empty table gives no rows. ``ranks_path``: the vocabulary as ranks; ``added``: its added tokens.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        encoder = Encoder(ranks_path or public.path("byte_bpe_50k.tiktoken"), public.PATTERN, added)
        bins = OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, 6 << 20)):
            rows: list[list] = [[] for _ in range(7)]
            for key, found in zip(batch.column(0).to_pylist(), encoder.ids(text_column(batch)),
                                  strict=True):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    number, offset = bins.place(length)
                    crc = zlib.crc32(ids[start: start + length].tobytes())
                    for col, v in zip(rows, (key, k, start, length, crc, base + number, offset),
                                      strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
