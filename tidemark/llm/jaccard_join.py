"""Exact Jaccard self-join of word-shingle sets by set-relation skipping, and its components.

1. Equal sets are one set from the start. Each set's shingles are put in one order, frequent ones
   last, and its first few (the prefix) are indexed: two similar sets share a prefix shingle.
2. The lists of the index, in order of (size, position), are cut into blocks. A block whose
   best entry can't reach the overlap that a size and position still allow is skipped whole.
3. In a long list all sets are first compared with one pivot. Their answers to it decide most
   other pairs: two sets near the pivot are in one group already, and the pivot's overlaps bound
   the overlap of any two others from above. What stays open is compared in rounds with a few sets
   at a time, whose answers join groups again; only what is open after the last round is compared
   pair by pair.
4. Folded hash histograms of the sets bound the overlap before texts move; the rest is verified on the
   sets, cut anew from the texts, which are smaller on the way.

Results are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.base import stored
from tidemark.llm.components import components
from tidemark.llm.textarrays import mix, shingle_sets, slices, text_column
from tidemark.session import discard, lean

_U = np.uint64
#: Lists longer than this go through a pivot.
LONG_LIST = 8
#: Rounds of comparing the open sets of a pivot with some of them, and how many those are.
ROUNDS = 2
HEADS = 32
#: Entries of one block of a list.
BLOCK = 4
#: A shingle is frequent if it is in more than one of so many sets; at most (mean set size x this) are.
FREQUENT = 32000
#: Bits of the filter that holds back texts no pair asks for: 16 MB in 4 KB pieces, whatever the table's size.
FILTER_BITS = 1 << 27
#: Cells of open sets travel as signed bytes: the count of an empty cell and of a full one.
_LEAST, _FULL = -128, 127
#: Shingles are counted in runs of so many; a run reports those that so many of its documents have.
_RUN, _SEEN = 2 << 20, 2


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, in order, and the rank of each, from counts over all documents.

    Tasks count the shingles of runs of documents, however those come in batches, and report those that they
    see twice. The order matters for speed alone; results are the same for any order.
    """
    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(found), return_counts=True)
        often = n >= _SEEN
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for part in (part for batch in batches for part in slices(batch)):
            found.append(shingle_sets(text_column(part), k)[0])
            if sum(map(len, found)) >= _RUN:
                yield counted(found)
                found = []
        if found:
            yield counted(found)

    least = max(4, docs.count() // FREQUENT)
    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > least).toArrow()
    token, n = (top.column(c).to_numpy() for c in ("token", "n"))
    token = token.view(_U)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(1, len(token) + 1)
    order = np.argsort(token)
    return token[order], rank[order]


def _reach(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of ``n`` with any similar set."""
    return -(-n * percent // 100)


def _need(n, m, percent: int):
    """Least overlap at which sets of ``n`` and ``m`` are similar."""
    return -(-(n + m) * percent // (100 + percent))


def _width(n: np.ndarray) -> np.ndarray:
    """Histogram cells of a set: a power of two near a quarter of its size."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 4)), 3, 16).astype(np.int64)


def _set_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    n = np.diff(at)
    total = np.zeros(len(tokens) + 1, _U)
    np.cumsum(tokens, out=total[1:])
    xor = np.zeros(len(n), _U)
    if (n > 0).any():
        xor[n > 0] = np.bitwise_xor.reduceat(tokens, at[:-1][n > 0])
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(xor + n.astype(_U)))


_SET_SCHEMA = "doc_id long, n_shingles long, set_id long, prefix array<long>, cells binary"


def sets_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: size, id (hash) of its set, prefix in index order, histogram."""
    common, rank = _frequent(docs, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            tokens, at = shingle_sets(text_column(batch), k)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(tokens), np.int64)
            if len(common) and len(tokens):
                where = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                late = np.where(common[where] == tokens, rank[where], 0)
            order = np.lexsort((tokens, late, owner))
            keep = n - _reach(n, percent) + 1
            inside = (np.arange(len(tokens)) - np.repeat(at[:-1], n)) < np.repeat(keep, n)
            prefix = tokens[order][inside].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.minimum(keep, n))])
            ids = _set_ids(tokens, at)
            width = _width(n)
            base = np.concatenate([[0], np.cumsum(width)])
            cell = (tokens & (width[owner] - 1).astype(_U)).astype(np.int64)
            counts = np.minimum(np.bincount(base[owner] + cell, minlength=base[-1]), 255).astype(np.uint8)
            raw = counts.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(n.astype(np.int64)), pa.array(ids.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(prefix)),
                pa.array([raw[base[i]: base[i + 1]] for i in range(len(n))], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_id", "prefix", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, _SET_SCHEMA)


def _blocks(n: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one list (ordered by n, then position) that may reach their overlap.

    Blocks of the list are skipped by their smallest size and position alone.
    """
    size = len(n)
    left, right = [], []
    for b in range(0, size, BLOCK):
        bn, ba = n[b: b + BLOCK], at[b: b + BLOCK]
        for c in range(b, size, BLOCK):
            cn, ca = n[c: c + BLOCK], at[c: c + BLOCK]
            if cn[0] * percent > bn[-1] * 100:
                break  # this block and all later ones hold larger sets
            most = 1 + min((bn - ba).max() - 1, (cn - ca).max() - 1)
            if most < _need(bn[0], cn[0], percent):
                continue
            reach = 1 + np.minimum.outer(bn - ba - 1, cn - ca - 1)
            ok = (reach >= _need(bn[:, None], cn[None, :], percent)) & (bn[:, None] * 100 >= cn[None, :] * percent)
            i, j = np.nonzero(ok)
            i, j = i + b, j + c
            left.append(i[i < j])
            right.append(j[i < j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _walk(percent: int):
    """Walk index lists that come in order: pairs of short lists, pivot and member rows of long ones."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the last list so far, at most LONG_LIST + 1 entries
        pivot = None  # (token, set, size, position) while inside a long list

        def emit(kind, token, a, na, ia, b, nb, ib):
            m = len(b)
            cols = [np.full(m, v, np.int64) if np.isscalar(v) else v for v in (token, a, na, ia, b, nb, ib)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, kind, np.int32)), *map(pa.array, cols)],
                names=["kind", "token", "a", "na", "ia", "b", "nb", "ib"])

        def short(cols):
            token, s, n, at = (c[np.lexsort((cols[3], cols[2], cols[0]))] for c in cols)
            cut = np.flatnonzero(np.diff(token)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(token)]])
            size = last - first
            two = first[size == 2]
            i, j = [two], [two + 1]
            for f, e in zip(first[size > 2], last[size > 2], strict=True):
                x, y = _blocks(n[f:e], at[f:e], percent)
                i.append(x + f)
                j.append(y + f)
            i, j = np.concatenate(i), np.concatenate(j)
            ok = (n[i] * 100 >= n[j] * percent) & (1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= _need(n[i], n[j], percent))
            i, j = i[ok], j[ok]
            return emit(0, token[i], s[i], n[i], at[i], s[j], n[j], at[j])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for c, h in enumerate(held)]
            token = cols[0]
            if not len(token):
                continue
            if pivot is not None:
                other = token != pivot[0]
                run_on = int(np.argmax(other)) if other.any() else len(token)
                if run_on:
                    yield emit(1, *pivot, *(c[:run_on] for c in cols[1:]))
                    cols = [c[run_on:] for c in cols]
                    token = cols[0]
                if not len(token):
                    held = [c[:0] for c in cols]
                    continue
                pivot = None
            cut = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
            size = np.diff(cut)
            for g in np.flatnonzero(size > LONG_LIST):
                f, e = cut[g], cut[g + 1]
                head = tuple(int(c[f]) for c in cols)
                yield emit(1, *head, *(c[f:e] for c in cols[1:]))
                if e == len(token):
                    pivot = head
            last = cut[-2] if pivot is None else len(token)
            done = np.repeat((size > 1) & (size <= LONG_LIST) & (cut[1:] <= last), size)
            if done.any():
                yield short([c[done] for c in cols])
            held = [c[last:] for c in cols]
        if len(held[0]) > 1:
            yield short(held)

    return run


def _overlaps(k: int, percent: int):
    """Overlap of the sets of the two texts of each row; rows that are not similar are kept with their overlap.

    Texts are what travels: compressed, they take less than half the bytes of their hashed sets. A text that
    stands in several rows of a slice is cut into shingles once.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column("x")), pc.binary_length(batch.column("y"))).to_numpy(zero_copy_only=False)
            for part in _cut(batch, size, 8 << 20):
                texts = pa.concat_arrays([part.column("x"), part.column("y")]).dictionary_encode()
                where = texts.indices.to_numpy(zero_copy_only=False)
                distinct = pa.record_batch([texts.dictionary], names=["text"])
                found = [shingle_sets(text_column(some), k) for some in slices(distinct)]
                sets = [tokens[at[i]: at[i + 1]] for tokens, at in found for i in range(len(at) - 1)]
                xs, ys = ([sets[i] for i in half] for half in np.split(where, 2))
                out = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys, strict=True)], np.int64)
                both = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("a", "b", "ra", "rb")), pa.array(out), pa.array(100 * out >= percent * (both - out))],
                    names=["a", "b", "ra", "rb", "overlap", "linked"])

    return run


def _cut(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose sizes add up to about ``limit``; a larger row stands alone."""
    ends = np.cumsum(size)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def _may_overlap(percent: int):
    """Pairs whose histograms allow the overlap."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column("ca"), batch.column("cb"), strict=True)):
                u, v = (np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64) for c in (p, q))
                if u.max(initial=0) == 255 or v.max(initial=0) == 255:
                    ok[i] = True  # a full cell bounds nothing
                    continue
                w = min(len(u), len(v))
                best = np.minimum(u.reshape(-1, w).sum(0), v.reshape(-1, w).sum(0)).sum()
                ok[i] = best >= _need(int(na[i]), int(nb[i]), percent)
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(ok))

    return run


def _asked_for(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``_id`` is an id of ``owners``, and few others.

    Ids are hashed into a bitmap of FILTER_BITS, whose pieces are broadcast: their size is bounded.
    Rows that share a bit with an owner pass too, so an exact join must follow; the fuller the bitmap,
    the more rows pass.
    """
    def bit(doc_id) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)) + 1

    place = bit(F.col("doc_id"))
    pieces = owners.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(bit(F.col("_id")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # bit p of a bitmap is bit p % 8, counted from the lowest, of its byte p / 8
    is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at.bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0
    return docs.join(F.broadcast(pieces), (F.bitmap_bucket_number(bit(F.col("_id"))) == F.col("piece")) & is_set, "left_semi")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Overlap and link of the pairs (a, b, their sizes na, nb and groups ra, rb) that pass the histograms (``sure``: have passed), stored."""
    cells = reps.select(F.col("set_id"), "cells")
    sure = pairs.where("sure").select("a", "b", "ra", "rb")
    passed = stored(
        pairs.where("not sure").join(cells.withColumnsRenamed({"set_id": "a", "cells": "ca"}), "a")
        .join(cells.withColumnsRenamed({"set_id": "b", "cells": "cb"}), "b")
        .select("a", "b", "ra", "rb", "na", "nb", "ca", "cb")
        .mapInArrow(_may_overlap(percent), "a long, b long, ra long, rb long").union(sure),
        "jaccard-pairs")
    wanted = passed.select(F.col("a").alias("set_id")).union(passed.select("b")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            tokens, at = shingle_sets(text_column(batch), k)
            # a repeated id may have brought another row's text
            yield batch.filter(pc.equal(pa.array(_set_ids(tokens, at).view(np.int64)), batch.column(0)))

    owners = reps.join(wanted, "set_id", "left_semi").select("set_id", "doc_id")
    texts = _asked_for(docs.select(F.col("doc_id").alias("_id"), "text"), owners)
    found = stored(
        texts.join(owners, F.col("_id").eqNullSafe(F.col("doc_id")))
        .select("set_id", "text").mapInArrow(run, "set_id long, text string"), "jaccard-texts")
    both = (
        passed.join(found.withColumnsRenamed({"set_id": "a", "text": "x"}), "a")
        .join(found.withColumnsRenamed({"set_id": "b", "text": "y"}), "b").select("a", "b", "ra", "rb", "x", "y")
    )
    answers = stored(both.mapInArrow(_overlaps(k, percent), "a long, b long, ra long, rb long, overlap long, linked boolean"),
                     "jaccard-answers")
    discard(passed, found)
    return answers


def _open_pairs(members: DataFrame, heads: DataFrame | None, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one pivot that are in different groups and may be similar by all answers so far.

    One side is of ``heads`` (None: any member). A pair comes once, at the least pivot both have, and
    not if it is ``known``. Stored; ``sure`` says that the histograms have been compared.
    """
    columns = ("s", "n", "o", "root", "lists", "cells", "pivots")
    x = members.select("pivot", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = (members if heads is None else heads).select("pivot", *[F.col(c).alias(f"y_{c}") for c in columns])
    need = F.ceil((F.col("x_n") + F.col("y_n")) * percent / F.lit(100 + percent))
    bound = F.least("x_o", "y_o") + F.least(F.col("x_n") - F.col("x_o"), F.col("y_n") - F.col("y_o"))
    shared = F.aggregate(F.zip_with("x_cells", "y_cells", lambda u, v: F.when((u == _FULL) | (v == _FULL), need.cast("int")).otherwise(
        F.least(u, v).cast("int") - _LEAST)), F.lit(0), lambda total, v: total + v)
    alike = F.size("x_cells") == F.size("y_cells")
    in_order = F.col("x_s") < F.col("y_s")
    pairs = x.join(y, "pivot").where(
        (in_order if heads is None else F.col("x_s") != F.col("y_s"))
        & (F.col("x_root") != F.col("y_root"))
        & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        & (F.when(F.col("x_o").isNull() | F.col("y_o").isNull(), need).otherwise(bound) >= need)
        & (F.col("pivot") == F.array_min(F.array_intersect("x_pivots", "y_pivots")))
        & F.arrays_overlap("x_lists", "y_lists")
        & (F.when(alike, shared).otherwise(need) >= need)
    ).select(
        *[F.when(in_order, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(name) for c, name in (("s", "a"), ("n", "na"), ("root", "ra"))],
        *[F.when(in_order, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(name) for c, name in (("s", "b"), ("n", "nb"), ("root", "rb"))],
        alike.alias("sure"))
    if heads is not None:
        pairs = pairs.distinct()  # both may be heads
    return stored(pairs.join(known, ["a", "b"], "left_anti"), "jaccard-rest")


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sets, links): a row per document (doc_id, n_shingles, set_id), and similar pairs of different sets.

    Pairs that the answers to pivots put into one group are not listed, and later links stand for the
    groups of their sets; components are the same.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(sets_of(docs, k, percent), "jaccard-rows")
    reps = rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("prefix").alias("prefix"), F.first("cells").alias("cells"))
    reps = stored(reps, "jaccard-sets-once")
    sets = stored(rows.select("doc_id", "n_shingles", "set_id"), "jaccard-sizes")
    discard(rows)
    entries = reps.select("set_id", "n_shingles", F.posexplode("prefix").alias("at", "token"))
    walked = stored(
        entries.select("token", "set_id", "n_shingles", F.col("at").cast("long").alias("at"))
        .repartition("token").sortWithinPartitions("token", "set_id")
        .mapInArrow(_walk(percent), "kind int, token long, a long, na long, ia long, b long, nb long, ib long"),
        "jaccard-lists")
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    size_ok = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    swap = (F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    first = walked.where((F.col("a") != F.col("b")) & size_ok).select(*ordered, *swap).distinct() \
        .withColumns({"ra": F.col("a"), "rb": F.col("b"), "sure": F.lit(False)})
    answers = _verified(docs, reps, first, k, percent)

    # Long lists: what the answers to the pivots leave open. A pair is compared once per pivot, not per
    # list, and not at all if the answers so far have both sets in one group. Half a hash names a list here:
    # where two agree by chance, a pair more is compared.
    linked = answers.where("linked").select("a", "b")
    so_far = stored(components(linked, "jaccard-components"), "jaccard-groups").withColumnRenamed("node", "s")
    known = answers.select("a", "b", "overlap", "linked")
    known = known.union(answers.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap", "linked"))
    members = stored(
        walked.where("kind = 1").groupBy("a", "b").agg(
            F.first("na").alias("na"), F.first("nb").alias("nb"), F.collect_set(F.shiftright("token", 32).cast("int")).alias("lists"))
        .join(known, ["a", "b"], "left").where("a <> b").select(
            F.col("a").alias("pivot"), F.col("b").alias("s"), F.col("nb").alias("n"), F.col("overlap").alias("o"), "lists")
        .join(so_far, "s", "left").withColumn("root", F.coalesce("root", "s"))
        .join(reps.select(F.col("set_id").alias("s"), F.transform(
            F.sequence(F.lit(1), F.length("cells")),
            lambda i: (F.conv(F.hex(F.substring(F.col("cells"), i, F.lit(1))), 16, 10).cast("int") + _LEAST).cast("tinyint")).alias("cells")), "s"),
        "jaccard-members")
    own = members.groupBy("s").agg(F.collect_set("pivot").alias("pivots"), F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))
    narrow, members = members, stored(members.drop("lists").join(own, "s"), "jaccard-open")
    discard(walked, narrow)
    known = known.select("a", "b")
    for i in range(ROUNDS):
        turn = F.row_number().over(W.partitionBy("pivot").orderBy(F.xxhash64("s", F.lit(i)), "s"))
        heads = members.withColumn("turn", turn).where(F.col("turn") <= HEADS).drop("turn")
        pairs = _open_pairs(members, heads, known, percent)
        answers = _verified(docs, reps, pairs, k, percent)
        discard(pairs)
        known = known.union(answers.select("a", "b"))
        new = answers.where("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        if new.isEmpty():
            break
        linked = linked.union(new)
        step = components(new, "jaccard-components").select(F.col("node").alias("root"), F.col("root").alias("next"))
        before, members = members, stored(
            members.join(step, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next"), "jaccard-open")
        discard(before)
    pairs = _open_pairs(members, None, known, percent)
    more = _verified(docs, reps, pairs, k, percent)
    discard(reps, members, pairs)
    return sets, linked.union(more.where("linked").select("ra", "rb").distinct())


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_id, root), stored; root is null without shingles.

    Shuffles go with the job that read them, stored results once the last job has: what lies on disk at a time is
    one job's shuffles and what later jobs read.
    """
    with lean(docs.sparkSession):
        sets, linked = links(docs, k, percent)
        roots = components(linked, "jaccard-components").withColumnsRenamed({"node": "set_id"})
        return stored(
            sets.join(roots, "set_id", "left").select(
                "doc_id", "n_shingles", "set_id",
                F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id")).alias("root")),
            "jaccard-labels")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their group (see ``groups``), all columns as they are.

    First is the least (doc_id, set of shingles); of repeated rows all but one go, a tie between texts of one id
    and set falls to the least text. Rows without shingles (null, empty or blank texts) stay. A null id is the
    least; columns of any name come through; an empty table gives no rows.
    """
    rows = _labelled(docs, k, percent)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(key.alias("k"), "set_id")).alias("f")).select(
        F.col("f.k").alias("key"), F.col("f.set_id").alias("own"))
    bare = rows.where("root is null").select(key.alias("key"), F.lit(0).cast("long").alias("own")).distinct()

    names = docs.columns
    place = names.index("text") if "text" in names else [c.lower() for c in names].index("text")

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = pc.struct_field(whole.column(0), [place])
            for batch in slices(pa.record_batch([*whole.columns, text], names=["row", "key", "text"])):
                tokens, at = shingle_sets(text_column(batch), k)
                ids = np.where(np.diff(at) > 0, _set_ids(tokens, at).view(np.int64), 0)
                yield batch.select(["row", "key"]).append_column("own", pa.array(ids, pa.int64()))

    # each row travels as one struct, so that no column name of its own can clash, and its text travels once
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    schema = T.StructType([*whole.schema.fields, T.StructField("own", T.LongType())])
    kept = whole.mapInArrow(named, schema).join(first.union(bare), ["key", "own"], "left_semi")
    # equal rows share key and set, and lie in one partition already: one stays
    return kept.withColumn("n", F.row_number().over(W.partitionBy("key", "own").orderBy("row.text"))) \
        .where((F.col("n") == 1) | (F.col("own") == 0)).select("row.*")


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z count as a-z. A text with 1 to ``k`` - 1
    words has one shingle; one without words, or null, has none and stays alone. Two sets are linked
    from ``percent`` per cent on. ``component_id`` is the least id of all rows reached by links; rows
    of equal text are linked, also repeated rows. An empty table gives no rows.
    """
    labelled = _labelled(docs, k, percent)
    least = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
