"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

Removed is every byte covered by a string of LENGTH bytes that also starts earlier (smaller
doc_id, or same document and earlier start). A text is cut into places where such strings may be
compared apart from each other:

1. Every window of LENGTH bytes has an anchor, the least hash among its runs of GRAM bytes. Equal
   windows have equal anchors at equal offsets, so all windows of one anchor (a run of starts)
   make one context, and only contexts under the same anchor hash need comparing. Contexts equal as
   a whole need no more: all but the first go.
2. The remaining contexts of one anchor hash are set end to end and sorted into suffix order.
   Breadth-first backward extension on the transform, from the empty string, visits intervals
   by increasing length; an extension that ends where no boundary is known yet sets the common
   prefix there to the current length. It stops at LENGTH: places without a boundary by then lie
   within groups of equal strings, whose earliest member stays.
3. A hash with many contexts is cut into blocks. Each block keeps the first of its own equal windows,
   and those are brought together between blocks by an aggregation on the windows' hashes.

Contexts are told apart by 64-bit hashes of anchors and whole contexts, texts of one id by 64-bit hashes,
windows between blocks by 128-bit hashes. Most repeats of whole passages are decided by step 1; the transform
decides those that begin or end within a context, and those whose surroundings differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import stored
from tidemark.llm.textarrays import as_bytes, eight_bytes, mix, slices, text_column

LENGTH = 100
GRAM = 24
#: Distinct contexts of one anchor hash per block, and bytes that blocks of small groups share.
BLOCK_CONTEXTS = 4096
BLOCK_BYTES = 1 << 20
_U = np.uint64
_POSITION = _U((1 << 24) - 1)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_LEAST = -(1 << 63)

# place packs the first start and, in 7 bits, how many starts follow. Columns d and t (the id and a 64-bit
# hash of the text) tell documents apart, also where many rows share an id or have none.
#: Bytes that contexts are sought in at once.
SLICE = 1 << 19


def _code(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()


def _gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    for j in range(GRAM // 8):
        out += code[8 * j: 8 * j + n] * _U(_MULTIPLIERS[j])
        out ^= out >> _U(29)
    return mix(out)


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: (text, first start in the data, last start, anchor, hash)."""
    n = len(data)
    starts = n - LENGTH + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none, none, none, np.zeros(0, _U)
    if n > 2 * SLICE:  # a long text: overlapping parts
        parts, size = [], SLICE
        for lo in range(0, starts, size):
            hi = min(n, lo + size + LENGTH - 1)
            inside = np.unique(np.clip(at, lo, hi)) - lo
            bounds = np.unique(np.concatenate([[0], inside, [hi - lo]]))
            got = contexts(data[lo:hi], bounds)
            text = np.searchsorted(at, got[1] + lo, "right") - 1
            ok = got[2] + lo + LENGTH <= at[text + 1]
            parts.append([c[ok] for c in (text, got[1] + lo, got[2] + lo, got[3] + lo, got[4])])
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    code = _code(data)
    grams = _gram_hashes(code, n - GRAM + 1)
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=_U)
    span, low = 1, key
    wide = LENGTH - GRAM + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:starts], low[wide - span: wide - span + starts])
    anchor = (low & _POSITION).astype(np.int64)
    text = np.searchsorted(at, np.arange(starts), "right") - 1
    ok = np.arange(starts) + LENGTH <= at[text + 1]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [starts]]) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return text[first], first, last, anchor[first], grams[anchor[first]]


def _whole_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hash of each whole context and its offsets; words of eight bytes, the last one overlapping."""
    code = eight_bytes(data)
    length = last - first + LENGTH
    out = mix(((last - first) << 8 | (anchor - first)).astype(_U))
    for j in range(0, int(length.max()) if len(length) else 0, 8):
        on = length > j
        where = np.minimum(first + j, first + length - 8)
        out = np.where(on, mix((out ^ code[np.where(on, where, 0)]) * _U(_MULTIPLIERS[0])), out)
    return out


_ANCHORS = "h long, whole long, d long, t long, place long"


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, t, text): the id (the least long for null), a hash of the text, and the text (empty for null)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, SLICE)):
        data, at = as_bytes(text_column(batch))
        text, first, last, anchor, h = contexts(data, at)
        d, t = (batch.column(i).to_numpy() for i in (0, 1))
        whole = _whole_hashes(data, first, last, anchor)
        step = 1 << 16  # a long text has many: hand them on in parts
        for a in range(0, len(text), step):
            own = text[a: a + step]
            place = ((first[a: a + step] - at[own]) << 7) | (last[a: a + step] - first[a: a + step])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[a: a + step].view(np.int64)), pa.array(whole[a: a + step].view(np.int64)),
                 pa.array(d[own]), pa.array(t[own]), pa.array(place)], names=["h", "whole", "d", "t", "place"])


_SORTED = "kind int, h long, d long, t long, place long, ordinal long"


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in order of (h, whole, d, t, place): kind 0, contexts equal to an earlier one; kind 1,
    the first of each of several different contexts of one hash, numbered."""
    waiting: tuple | None = None  # the first context of the current hash, until there is a second
    prev: tuple | None = None  # (h, whole, d, t, place)
    number = 0
    for batch in batches:
        h, whole, d, t, place = (batch.column(i).to_numpy() for i in range(5))
        n = len(h)
        if not n:
            continue
        ph = np.concatenate([[prev[0] if prev else ~h[0]], h[:-1]])
        pw = np.concatenate([[prev[1] if prev else 0], whole[:-1]])
        new_h = h != ph
        new = new_h | (whole != pw)
        # the same row twice (repeated rows of the table) is not earlier than itself
        pd_, pt, pp = (np.concatenate([[prev[k] if prev else 0], c[:-1]]) for k, c in ((2, d), (3, t), (4, place)))
        again = ~new & ((d != pd_) | (t != pt) | (place != pp))
        firsts = np.flatnonzero(new)
        begins = new_h[firsts]
        group = np.cumsum(begins)
        count = np.arange(len(firsts)) - np.concatenate([[0], np.flatnonzero(begins)])[np.minimum(group, begins.sum())]
        count = np.where(group == 0, number + np.arange(len(firsts)), count)
        several = np.zeros(len(firsts), bool)
        several[count > 0] = True
        lead = np.flatnonzero(count > 0)
        lead = lead[(count[lead] == 1) & (lead > 0)] - 1
        several[lead[count[lead] == 0]] = True
        rows = firsts[several]
        ex = [[], [], [], [], []]
        if len(firsts) and group[0] == 0 and waiting is not None and count[0] == 1:
            ex = [[waiting[0]], [waiting[2]], [waiting[3]], [waiting[4]], [0]]
        again = np.flatnonzero(again)
        cols = [np.concatenate([h[again], np.array(ex[0], np.int64), h[rows]]),
                np.concatenate([d[again], np.array(ex[1], np.int64), d[rows]]),
                np.concatenate([t[again], np.array(ex[2], np.int64), t[rows]]),
                np.concatenate([place[again], np.array(ex[3], np.int64), place[rows]]),
                np.concatenate([np.zeros(len(again), np.int64), np.array(ex[4], np.int64), count[several]])]
        kind = np.concatenate([np.zeros(len(again), np.int32), np.ones(len(cols[0]) - len(again), np.int32)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), *map(pa.array, cols)], names=["kind", "h", "d", "t", "place", "ordinal"])
        if len(firsts):
            number = int(count[-1]) + 1
            i = firsts[-1]
            waiting = (int(h[i]), int(whole[i]), int(d[i]), int(t[i]), int(place[i])) if count[-1] == 0 else None
        prev = (h[-1], whole[-1], d[-1], t[-1], place[-1])


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first 128 bytes (prefix doubling from 8); zeros follow the end."""
    n = len(data)
    rank = np.unique(_code(data).byteswap(), return_inverse=True)[1].astype(np.int64)
    width = 8
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 2) + nxt
        if width == 64:
            return np.argsort(key, kind="stable")
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
        if rank.max(initial=0) == n - 1:
            return np.argsort(rank, kind="stable")


def boundaries(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at the places of the suffix order where the common prefix with the one before is shorter
    than ``length``: threshold-bounded interval expansion on the Burrows-Wheeler transform."""
    n = len(order)
    bwt = data[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix that is one byte longer stands
    step[by_symbol] = np.arange(n)
    symbol = bwt[by_symbol]
    following = np.full(n, n, np.int64)  # next place with the same symbol
    preceding = np.full(n, -1, np.int64)
    same = symbol[1:] == symbol[:-1]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        stop = np.cumsum(size)
        entry = np.repeat(low - (stop - size), size) + np.arange(stop[-1])
        first = preceding[entry] < np.repeat(low, size)
        last = following[entry] >= np.repeat(high, size)
        # the extensions of one interval by each symbol are runs; sorted, firsts and lasts pair up
        a, b = np.sort(step[entry[first]]), np.sort(step[entry[last]]) + 1
        fresh = ~known[b]
        low, high = a[fresh], b[fresh]
        known[high] = True
        if not len(low):
            break
    return known[:n]


def equal_windows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts in order: which of each one's windows equal an earlier one (flags), and the rest."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    order = suffix_order(data)
    group = np.cumsum(boundaries(data, order, LENGTH))
    valid = np.zeros(len(data), bool)
    for s, z in zip(starts, size, strict=True):
        valid[s: s + z - LENGTH + 1] = True
    ok = valid[order]
    place, group = order[ok], group[ok]
    by = np.lexsort((place, group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    flag = np.zeros(len(data), bool)
    flag[place[by][later]] = True
    return [flag[s: s + z - LENGTH + 1] for s, z in zip(starts, size, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_FOUND = "kind int, w1 long, w2 long, d long, t long, first long, last long"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of (h, block, d, t, place): kind 0, runs of starts to remove; kind 1, windows
    of a hash with several blocks that are new in their block."""
    def new_windows(d: int, t: int, start: int, text: bytes, where: Iterable[int]) -> list[tuple]:
        out = []
        for i in where:
            w = hashlib.blake2b(text[i: i + LENGTH], digest_size=16).digest()
            out.append((1, int.from_bytes(w[:8], "little", signed=True),
                        int.from_bytes(w[8:], "little", signed=True), d, t, start + i, start + i))
        return out

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        if len({r[0:2] for r in rows}) < len(rows):
            for (_, _, d, t, place, text, many), flag in zip(rows, equal_windows([r[5] for r in rows]), strict=True):
                start = place >> 7
                out += [(0, 0, 0, d, t, start + a, start + b - 1) for a, b in _runs(flag)]
                if many:
                    out += new_windows(d, t, start, text, np.flatnonzero(~flag).tolist())
        elif rows and rows[0][6]:
            for _, _, d, t, place, text, _ in rows:
                out += new_windows(d, t, place >> 7, text, range(len(text) - LENGTH + 1))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(cols)],
            names=["kind", "w1", "w2", "d", "t", "first", "last"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if held and row[:5] == held[-1][:5]:
                continue  # a repeated row of the table
            # blocks of one hash are never compared together: across them the order is not by document
            if held and row[:2] != held[-1][:2] and (size > BLOCK_BYTES or row[6] != held[-1][6] or row[0] == held[-1][0]):
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield solve(held)


def repeats(docs: DataFrame) -> DataFrame:
    """(d, t, spans): per document the merged-to-be byte ranges [first, end) to remove.

    ``d`` is doc_id (the least long for null), ``t`` a 64-bit hash that tells texts with one id apart.
    """
    keyed = _keyed(docs)
    found = stored(
        keyed.mapInArrow(_anchors, _ANCHORS).repartition("h").sortWithinPartitions("h", "whole", "d", "t", "place")
        .mapInArrow(_repeated, _SORTED), "repeats-anchors")
    firsts = found.where("kind = 1")
    many = firsts.where(F.col("ordinal") == BLOCK_CONTEXTS).select(F.col("h").alias("m_h"))
    block = (F.col("ordinal") / BLOCK_CONTEXTS).cast("long").alias("block")
    marked = firsts.join(many, F.col("h") == F.col("m_h"), "left").select(
        "h", block, "d", "t", "place", F.col("m_h").isNotNull().alias("many"))
    per_doc = marked.groupBy("d", "t").agg(F.collect_list(F.struct("h", "block", "place", "many")).alias("c"))

    def bytes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 5, pa.binary(), pa.bool_())
        names = ["h", "block", "d", "t", "place", "bytes", "many"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                d, t, text, c = (batch.column(k)[i].as_py() for k in range(4))
                raw = text.encode()
                for x in c:
                    s, more = x["place"] >> 7, x["place"] & 127
                    rows.append((x["h"], x["block"], d, t, x["place"], raw[s: s + more + LENGTH], x["many"]))
                    if len(rows) >= 1 << 14:
                        yield out(rows)
                        rows = []
            yield out(rows)

    texts = keyed.join(per_doc, ["d", "t"]).select("d", "t", "text", "c")
    pieces = texts.mapInArrow(bytes_of, "h long, block long, d long, t long, place long, bytes binary, many boolean")
    compared = stored(
        pieces.repartition("h", "block").sortWithinPartitions("h", "block", "d", "t", "place")
        .mapInArrow(_compare, _FOUND), "repeats-compared")
    new = compared.where("kind = 1")
    earliest = new.groupBy("w1", "w2").agg(F.min(F.struct("d", "t", "first")).alias("e"), F.count("*").alias("n")) \
        .where("n > 1").withColumnsRenamed({"w1": "v1", "w2": "v2"})
    between = new.join(earliest, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))) \
        .where(F.struct("d", "t", "first") != F.col("e")).select("d", "t", "first", "last")
    equal = found.where("kind = 0").select(
        "d", "t", F.shiftright("place", 7).alias("first"),
        (F.shiftright("place", 7) + F.col("place").bitwiseAND(127)).alias("last"))
    within = compared.where("kind = 0").select("d", "t", "first", "last")
    return equal.union(within).union(between).groupBy("d", "t").agg(
        F.collect_set(F.struct(F.col("first"), (F.col("last") + LENGTH).alias("end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame) -> DataFrame:
    """(row, spans): each row of ``docs`` as one struct, so that no column name of theirs can clash."""
    found = repeats(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return whole.join(
        found, (F.coalesce(F.col("row.doc_id"), F.lit(_LEAST)) == F.col("d")) & (F.xxhash64(text) == F.col("t")), "left"
    ).select("row", "spans")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans and the SHA-256 of the rest.

    Null texts count as empty. Rows that share a doc_id are ordered by a 64-bit hash of their texts;
    equal rows are one document. A null id is the least. Very long texts are searched in overlapping
    parts. Other columns are not read; an empty table gives no rows.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, c in zip(batch.column(0), batch.column(1), strict=True):
                d, raw = row["doc_id"].as_py(), (row["text"].as_py() or "").encode()
                spans = merged([(x["first"], x["end"]) for x in c.as_py() or []])
                rows.append((d, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(raw, spans)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes: all columns, ``text`` and the column ``n_chars`` set anew.

    A removed range is narrowed to whole characters. Rows that keep nothing but white space go, if
    something was removed from them. Null and empty texts, null ids and repeated rows stay as they are but
    for what ``report`` says of them; columns of any name come through; an empty table gives no rows.
    """
    cols = docs.columns

    def kept(old: str, c: list[dict]) -> str:
        raw, spans = old.encode(), []
        for a, b in merged([(x["first"], x["end"]) for x in c]):
            while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            spans.append((a, b))
        return cut(raw, spans).decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(cols, batch.column(0).flatten(), strict=True))
            texts, keep = [], []
            for text, c in zip(columns["text"], batch.column(1), strict=True):
                old, spans = text.as_py(), c.as_py()
                texts.append(kept(old, spans) if spans and old is not None else old)
                keep.append(texts[-1] is old or bool(texts[-1].strip()))
            columns["text"] = pa.array(texts, pa.string())
            if n_chars in columns:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in texts], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in cols], names=cols).filter(pa.array(keep, pa.bool_()))

    return _with_spans(docs).mapInArrow(run, docs.schema)
