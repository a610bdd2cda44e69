"""The corpus pipeline, stage by stage beside plain versions of what each has to do."""

import json
import os
import random
import sys
import zlib

import numpy as np
import pytest
from brute import components, repeats
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

WORDS = [a + b for a in "the of and in on at er en".split() for b in ["", "th", "an", "ing", "or", "é"]]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    item, passage = prose(900, 40), prose(901, 60)
    texts = [prose(i, 90) for i in range(60)]
    texts += [texts[3].replace(texts[3].split()[20], "changed", 1), texts[3], texts[5] + " more words at the end"]
    texts += [f"{prose(200 + i, 60)}\n{passage}\n{prose(220 + i, 60)}" for i in range(4)]
    texts += [f"{prose(300, 70)} {item} {prose(301, 70)}", item.upper() + " " + prose(302, 80)]
    bad = ["buy now!!! $$$ click here\n" * 12 + prose(400 + i, 3) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts + bad)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    n = len(texts)
    labels = [(i, int(i < n), 0) for i in range(n + len(bad))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict((r[0], r[1]) for r in rows), n


def test_stages_do_their_work(spark, tables):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    import public_tokenizers as public
    path, texts, n_good = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "leaks", "packed"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    def run(name, df):
        out = stages[name](spark, df, path)
        out = spark.createDataFrame(out.collect(), out.schema)
        assert name == "packed" or out.columns == columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()} if name != "packed" else None

    docs, kept = run("quality", docs)
    good = set(range(n_good))
    assert good <= set(kept) and not set(range(n_good, n_good + 12)) & set(kept)
    assert all(kept[i] == texts[i] for i in kept)

    docs, one = run("near_duplicates", docs)
    groups = components(sorted(kept.items()), 5, 80)
    assert set(one) == {i for i, (size, first) in groups.items() if first == i or not size}
    assert 60 not in one and 61 not in one

    docs, cut = run("repeats", docs)
    want = repeats(sorted(one.items()))
    for i, text in cut.items():
        assert len((one[i] or "").encode()) - len((text or "").encode()) <= want[i][1]
        assert bool(want[i][1]) == (text != one[i])
    assert sum(bool(w[1]) for w in want.values()) >= 3 and set(one) - set(cut) <= {i for i, w in want.items() if w[1]}

    docs, clean = run("leaks", docs)
    leaked = {n_good - 2, n_good - 1}
    assert set(clean) == set(cut) - leaked and all(clean[i] == cut[i] for i in clean)

    packed, _ = run("packed", docs)
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces, bins = {}, {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(clean)
    for i, text in clean.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for r in pieces[i]:
            assert zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces[i]) == len(ids)
    for some in bins.values():
        assert sum(n for _, n in some) <= 1024 and sorted(some)[0][0] == 0


def test_run_equals_its_stages(spark, tables):
    pytest.importorskip("public_tokenizers")
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = F.struct(*names)

    def rows(df):
        return sorted(json.dumps(r.asDict()["k"].asDict()) for r in df.select(key.alias("k")).collect())

    assert rows(corpus_pipeline.run(spark, path)) == rows(docs)


def test_run_of_empty_tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.run(spark, path).count() == 0
