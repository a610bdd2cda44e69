"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

A byte-pair vocabulary never joins text across pre-tokens, so a text has as many tokens as its pre-tokens
together. Pre-tokens are cut in whole slices of text at once, and each one's length is looked up where the text
is read:

1. in a compact open-addressing hash table of frequent pre-tokens, broadcast to all workers; a hit is compared byte
   by byte. The table is gathered from a bounded sample of documents: each task of the sample hands on its most
   frequent pre-tokens with their lengths, at most TABLE of them, and the TABLE most frequent of all become the
   table (none longer than WIDEST bytes, so some 2 MB at most, whatever the corpus holds);
2. otherwise in the worker's cache of at most CACHE pre-tokens, which is emptied when it is full;
3. otherwise the vocabulary's own model encodes the pre-token, and the cache keeps its length.

The sample only decides where a length is looked up, never what it is: every pre-token of every text is
counted. Texts with characters that this Python's Unicode tables do not assign (the library's may), vocabularies of
another kind and ``.model`` files are encoded whole by their library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import kept_in_worker, stored
from tidemark.llm.textarrays import as_bytes, equal_spans, slices, span_hashes, text_column

#: Entries of the broadcast table and of a worker's cache, and the longest pre-token that either holds, in bytes.
TABLE, CACHE, WIDEST = 1 << 15, 1 << 18, 48
#: Documents that the table is gathered from, about.
SAMPLE = 4096
LIMIT = 1024
#: Bytes of text that are cut into pre-tokens at once, about; longer texts are cut before blanks.
STRETCH = 1 << 19
_U = np.uint64


# Classes of characters.
SPACE, LETTER, NUMBER, OTHER, UNASSIGNED = range(5)


def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind == "Cn":
            out[c] = UNASSIGNED
        elif kind[0] == "Z":
            out[c] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def cut(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each pre-token of texts (they cover the texts), and which texts hold unassigned characters.

    A pre-token is a run of letters, of numbers or of others with the blank before it; of white space all but
    the last before a word; or an apostrophe with s, t, m, d, re, ve or ll where it stands alone.
    """
    n_texts = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_texts, bool)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        code = data.astype(np.uint32)
    else:
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes[code]
    n = len(code)
    edge = np.searchsorted(lead, at)
    begins = np.zeros(n + 1, bool)
    begins[edge] = True
    starts = begins.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    # white space before a word of the same text: its last character goes with the word, or alone
    words = np.flatnonzero(starts[1:n] & ~begins[1:n] & (kind[:-1] == SPACE)) + 1
    starts[words - 1] = True
    starts[words[code[words - 1] == 0x20]] = False
    # apostrophes that stand alone before letters
    quotes = np.flatnonzero(code[: n - 1] == 0x27)
    quotes = quotes[starts[quotes] & ~begins[quotes + 1] & (kind[quotes + 1] == LETTER)]
    if len(quotes):
        one = code[quotes + 1]
        two = np.where((quotes + 2 < n) & ~begins[np.minimum(quotes + 2, n)], code[np.minimum(quotes + 2, n - 1)], 0)
        size = np.where(np.isin(one, list(b"stmd")), 1, 0)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        size = np.where(pair, 2, size)
        hit = size > 0
        starts[quotes[hit] + 1] = False
        starts[quotes[hit] + 1 + size[hit]] = True
    odd = np.zeros(n_texts, bool)
    strange = np.flatnonzero(kind == UNASSIGNED)
    odd[np.searchsorted(edge, strange, "right") - 1] = True
    return lead[np.flatnonzero(starts[:n])], odd


class Table:
    """Tokens of frequent pre-tokens: open addressing over one block of bytes, without collected objects."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        sizes = np.array([len(p) for p, _ in entries], np.int64)
        self.data = np.frombuffer(b"".join(p for p, _ in entries), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.tokens = np.array([n for _, n in entries], np.int32)
        self.mask = (1 << max(4, (2 * len(entries)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        for i, s in enumerate((self.hashes & _U(self.mask)).tolist()):
            while self.slots[s] >= 0:
                s = (s + 1) & self.mask
            self.slots[s] = i

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span; 0 where the table does not hold it."""
        out = np.zeros(len(starts), np.int64)
        waiting = np.flatnonzero(ends - starts <= WIDEST)
        hashes = span_hashes(data, starts[waiting], ends[waiting])
        slot = (hashes & _U(self.mask)).astype(np.int64)
        while len(waiting):
            held = self.slots[slot]
            on = held >= 0
            waiting, hashes, slot, held = waiting[on], hashes[on], slot[on], held[on]
            size = ends[waiting] - starts[waiting]
            alike = np.flatnonzero((self.hashes[held] == hashes) & (self.ends[held] - self.starts[held] == size))
            alike = alike[equal_spans(data, starts[waiting[alike]], self.data, self.starts[held[alike]], size[alike])]
            out[waiting[alike]] = self.tokens[held[alike]]
            on = np.ones(len(waiting), bool)
            on[alike] = False
            waiting, hashes, slot = waiting[on], hashes[on], (slot[on] + 1) & self.mask
        return out


class Vocabulary:
    """Encodes texts with the library of a vocabulary file; ``cuts`` if its texts can be cut into pre-tokens."""

    def __init__(self, path: str):
        self.cuts, self.cache = False, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.sizes = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        cuts = about["pre_tokenizer"] or {}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in about["added_tokens"])
        if (about["model"]["type"] == "BPE" and not about["normalizer"] and plain and cuts.get("type") == "ByteLevel"
                and cuts.get("use_regex") and not cuts.get("add_prefix_space")):
            self.cuts = True
            self.model, self.spelt, self.classes = tokenizer.model, _byte_characters(), _classes()
            added = sorted((t["content"] for t in about["added_tokens"]), key=len, reverse=True)
            self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def length(self, piece: bytes) -> int:
        """Tokens of one pre-token, from the cache or the library."""
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.decode("latin-1").translate(self.spelt)))
            if len(piece) <= WIDEST:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def stretches(self, text: str) -> tuple[list[str], int]:
        """Parts of a text that are cut apart from each other, and its number of added tokens between them."""
        parts = self.added.split(text) if self.added else [text]
        out = []
        for part in parts:
            first = 0
            while len(part) - first > STRETCH and (m := _BEFORE_BLANK.search(part, first + STRETCH)):
                out.append(part[first: m.end()])
                first = m.end()
            out.append(part[first:])
        return out, len(parts) - 1

    def spans(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice of texts: bytes, starts and ends of pre-tokens, the pre-tokens' bounds per text, odd texts."""
        for part in slices(pa.record_batch([texts], names=["text"]), STRETCH):
            data, at = as_bytes(part.column(0))
            starts, odd = cut(data, at, self.classes)
            yield data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, at), odd

    def counts(self, texts: pa.Array, table: Table) -> np.ndarray:
        """Tokens of each text (no nulls)."""
        every = texts.to_pylist()
        if not self.cuts:
            return np.array(self.sizes(every), np.int64)
        owner, parts, out = [], [], np.zeros(len(every), np.int64)
        for i, text in enumerate(every):
            some, more = self.stretches(text)
            out[i] = more
            owner += [i] * len(some)
            parts += some
        done = 0
        for data, starts, ends, first, odd in self.spans(pa.array(parts, pa.large_string())):
            n = table.find(data, starts, ends)
            raw = data.tobytes()
            missed = np.flatnonzero(n == 0)
            n[missed] = [self.length(raw[a:b]) for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
            total = np.diff(np.concatenate([[0], np.cumsum(n)])[first])
            for k in np.flatnonzero(odd):
                total[k] = self.sizes([parts[done + k]])[0]
            np.add.at(out, owner[done: done + len(total)], total)
            done += len(total)
        return out


_BEFORE_BLANK = re.compile(r"[^\s\x1c-\x1f](?= )")


def _vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers as public

    where = path or public.path("byte_bpe_50k.json")
    return kept_in_worker("vocabulary", where, lambda: Vocabulary(where))


def frequent(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> Table:
    """The broadcast table: the most frequent pre-tokens of about ``sample`` documents, with their lengths."""
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        seen: Counter[bytes] = Counter()
        for batch in batches:
            texts = text_column(batch, "text").to_pylist() if vocabulary.cuts else []
            parts = [p for text in texts for p in vocabulary.stretches(text)[0]]
            for data, starts, ends, _, _ in vocabulary.spans(pa.array(parts, pa.large_string())) if parts else ():
                raw, short = data.tobytes(), np.flatnonzero(ends - starts <= WIDEST)
                seen.update(raw[a:b] for a, b in zip(starts[short].tolist(), ends[short].tolist(), strict=True))
                if len(seen) > 4 * TABLE:
                    seen = Counter(dict(seen.most_common(TABLE)))
        top = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64()),
             pa.array([vocabulary.length(p) for p, _ in top], pa.int32())], names=["piece", "seen", "tokens"])

    share = min(1.0, sample / max(1, docs.count()))
    dice = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = docs.select("doc_id", "text").where(dice < F.lit(int(share * (1 << 30)))).mapInArrow(
        gather, "piece binary, seen long, tokens int")
    top = rows.groupBy("piece", "tokens").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE)
    # stored, so that the driver meets the table alone and not the most frequent of every task
    return Table([(bytes(r["piece"]), r["tokens"]) for r in stored(top.select("piece", "tokens"), "token-table").collect()])


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and whether those exceed ``limit``.

    ``path`` is a vocabulary file of ``tokenizers`` (.json) or ``sentencepiece`` (.model). Null texts count as
    empty: 0 bytes, 0 tokens. An added token written in a text counts as one. Null ids and repeated rows give a
    row each, other columns are not read, an empty table gives no rows. Very long texts are cut before blanks and
    looked up in stretches.
    """
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            for part in slices(batch, 4 * STRETCH):
                n = vocabulary.counts(text_column(part, "text"), table.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
