import os
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components, counts, repeats
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import (
    decontamination, jaccard_join, language_id, license_scan, line_quality, packing, quality_rules, suffix_dedup,
    textarrays, toxicity, url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h string"
WORDS = [a + b for a in "the of and in on at er en".split() for b in ["", "th", "an", "ing", "or", "é"]]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus():
    a, b = prose(1, 160), prose(2, 200)
    near = [a.replace(a.split()[40 + i], "changed", 1) for i in range(12)]
    hot = prose(3, 30)
    own = [prose(50 + i, 40) + " " + hot + " " + prose(90 + i, 40) for i in range(15)]
    return [a, b, a, *near, *own, None, "", " \n", "one", "one two", "ONE two", b + " " + a, "é" * 300, "é" * 300]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    texts = corpus()
    got = jaccard_join.groups(table(spark, texts), k, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components(list(enumerate(texts)), k, percent)


def test_held_back_texts(spark, monkeypatch):
    ids = [None, -(1 << 63), -1, *range(300), 7]
    docs = spark.createDataFrame([(i,) for i in ids], "_id long")
    owners = spark.createDataFrame([(i,) for i in ids[:4] + [7, 250]], "doc_id long")
    for bits in (1, 1 << 4, 1 << 27):
        monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits)
        got = [r[0] for r in jaccard_join._asked_for(docs, owners).collect()]
        assert {None, -(1 << 63), -1, 0, 7, 250} <= set(got) and got.count(7) == 2
        assert len(got) == len(ids) if bits == 1 else len(got) < len(ids)
    assert jaccard_join._asked_for(docs, owners.limit(0)).count() == 0


def test_one_of_each(spark):
    texts = corpus()
    want = {g for _, (n, g) in components(list(enumerate(texts)), 5, 80).items() if n}
    docs = table(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    got = [r["doc_id"] for r in jaccard_join.one_of_each(docs, 5, 80).collect()]
    assert sorted(got) == sorted(want | {i for i, t in enumerate(texts) if not (t or "").strip()})


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Long texts do not meet in batches of 10,000 rows while near copies are sought; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    with session.lean(spark):
        largest = texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert largest < 6 << 20 and spark.conf.get(key) == before
    with pytest.raises(ValueError), session.lean(spark):
        raise ValueError
    assert spark.conf.get(key) == before


def test_one_of_each_sends_each_text_once(spark):
    """The plan has one column of rows before Python, not a second one with their texts."""
    docs = table(spark, corpus())
    out = jaccard_join.one_of_each(docs, 5, 80)
    plan = out._jdf.queryExecution().analyzed().toString()
    sent = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(sent) == 1 and "row#" in sent[0] and "text#" not in sent[0]
    named = docs.withColumnRenamed("text", "TEXT").withColumn("row", F.lit(1))
    assert jaccard_join.one_of_each(named, 5, 80).count() == out.count()


def test_frequent_shingles_do_not_depend_on_batches(spark):
    docs = table(spark, corpus()).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = [x.tolist() for x in jaccard_join._frequent(docs, 4)]
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = [x.tolist() for x in jaccard_join._frequent(docs, 4)]
    finally:
        spark.conf.set(key, before)
    assert want[0] and got == want


def test_disk_of_groups(spark):
    """Shuffles and stored results go as soon as nothing reads them: what is left is what the result is made from."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).endswith(".data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    made, before, value = session.scratch_made(), shuffled(), spark.conf.get(key)
    jaccard_join.groups(table(spark, corpus()), 4, 85)
    there = [os.path.basename(p).rsplit("-", 1)[0] for p in session._made[made:] if os.path.exists(p)]
    assert set(there) <= {"jaccard-sizes", "jaccard-answers", "jaccard-components", "jaccard-groups", "jaccard-labels"}
    assert not shuffled() - before
    assert spark.conf.get(key) == value


def test_repeats(spark, monkeypatch):
    texts = corpus()
    want = repeats(list(enumerate(texts)))
    for block in (4096, 3):
        monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", block)
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.report(table(spark, texts)).collect()}
        assert got == want


def test_repeated_rows_and_null_ids(spark):
    a = prose(7, 60)
    got = suffix_dedup.report(table(spark, [a, a, a], [5, 5, None])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"] > 0) for r in got) == [(False, True), (False, True), (True, False)]


def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    assert packing.pack(none).count() == 0
    assert jaccard_join.groups(none).count() == 0
    assert suffix_dedup.report(none).count() == 0
    assert decontamination.find(none, bench).count() == 0
    assert license_scan.scan(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels, F.lit(True))).count() == 0
    assert line_quality.score(none, line_quality.fit(none, labels, F.lit(True))).count() == 0
    assert language_id.predict(none, language_id.fit(none, F.lit(True))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(pages, [url_filters.Rule("com/", "allow")]).count() == 0


def test_counts():
    texts = [t or "" for t in corpus()] + ["a b c a b c\na b c\n\na b c", "x # | $$ <b>"]
    got = np.stack(quality_rules.text_counts(pa.array(texts)), 1).tolist()
    assert got == [list(counts(t)) for t in texts]


@pytest.mark.parametrize("sample", [1000, 60])
def test_outliers_beside_a_third_of_copies(spark, monkeypatch, sample):
    if sample < 1000:
        monkeypatch.setattr(quality_rules, "SAMPLE", sample)
    texts = [prose(i, 60 + i % 90) for i in range(200)] + [prose(500, 60) + " " + "#" * 200] * 100
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, texts)).collect()}
    assert not any(got[i]["base_failed"] for i in range(300))
    assert not any(got[i]["kept"] for i in range(200, 300)) and sum(got[i]["kept"] for i in range(200)) > 180


def test_decontamination(spark):
    item = prose(11, 40)
    edited = item[:60] + "x" + item[60:120] + item[121:]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (1, item)], "item_id long, text string")
    docs = table(spark, [prose(1, 50) + item, prose(2, 90), item.upper() + " tail", prose(3, 30) + edited, None, ""])
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.find(docs, bench).collect()}
    assert {k for k in got} == {(0, 1), (2, 1), (3, 1)} and got[0, 1] == 0 and 0 < got[3, 1] <= 2
    assert sorted(r["doc_id"] for r in decontamination.drop(docs, bench).collect()) == [1, 4, 5]


def test_parts_of_items(spark):
    r = random.Random(6)
    items = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip() for n in (233, 390, 700, 100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    parts = [(0, items[0][40:190]), (1, items[1][:200]), (1, items[1][100:227]), (2, items[2][-127:]), (3, items[3][2:98])]
    docs = table(spark, [f"{prose(i, 20)} {p} {prose(30 + i, 20)}" for i, (_, p) in enumerate(parts)] + [prose(9, 300)])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench).collect()}
    assert {(i, k) for i, (k, _) in enumerate(parts[:4])} <= got and {d for d, _ in got} <= set(range(5))
    assert {r["doc_id"] for r in decontamination.drop(docs, bench).collect()} <= {4, 5}


def test_many_short_texts_and_passages(monkeypatch):
    r = random.Random(8)
    items = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=30)).replace(" ", "x")) for i in range(60_000)]
    texts = [""] * 9990 + [items[59_990 + i][1] for i in range(10)]
    index = decontamination.Index.of(items)
    assert len(texts) * len(index.item) > 1 << 29
    want = [(9990 + i, 59_990 + i, 0, 30, 0) for i in range(10)]
    assert index.search(pa.array(texts)) == want
    for hits in (1, 50):
        monkeypatch.setattr(decontamination, "HITS", hits)
        assert index.search(pa.array(texts)) == want


def test_segments_match_all_subarrays():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 14)
        hits = [(i, r.choice([0.5, 1.0, 2.5])) for i in range(n) if r.random() < 0.5]
        score = [-0.7] * n
        for i, s in hits:
            score[i] = s
        best = max((sum(score[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        got = max((s for *_, s in toxicity.segments(hits, 0.7)), default=0)
        assert got == pytest.approx(max(best, 0))


def test_encoder_round_trip():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    texts = [*[t or "" for t in corpus()], "a  b", "x\t b", " \n a", "tail ", "\n\n x", "don't 12 3²", "a　 b", "\x85 b"]
    got = packing.Encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ids(pa.array(texts))
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_added_token():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"one two{end}three", f"one two {end} three", f"{end}{end}\n", f" a  {end}  b\n\n{end}", "a <|endoftext| b",
             f"<|{end}|>", f"é {end}é", "", "plain text here"]
    got = packing.Encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ids(pa.array(texts))
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    rows = packing.pack(table(spark, [*corpus(), prose(5, 4000)])).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_licences(spark):
    texts = ["Released under the MIT License.", "licensed under the GNU General Public License, version 3.",
             "Licensed under CC BY-NC 4.0.", "mit license MIT license", "a license for all", None, ""]
    texts += [prose(i, 30) for i in range(60)]
    got = {r["doc_id"]: r for r in license_scan.scan(table(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["mit", "gpl,gpl-3.0", "cc-by-nc-4.0", "mit", "", "", ""]
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 2)
    assert got[5]["first_word"] is None and got[5]["n_words"] == 0


def test_licences_with_a_frequent_notice(spark):
    notice = next(t.text for t in license_scan.TEMPLATES if t.label == "bsd")
    texts = [f"{notice} {prose(i, 30)}" if i % 3 == 0 else prose(i, 30) for i in range(60)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(table(spark, texts)).collect()}
    assert all(got[i] == (("bsd", 1.0) if i % 3 == 0 else ("", 0.0)) for i in range(60))


def test_licences_side_by_side(spark):
    every = " -- ".join(t.text for t in license_scan.TEMPLATES)
    got = license_scan.scan(table(spark, [every, *[prose(i, 30) for i in range(60)]])).where("doc_id = 0").first()
    assert set(got["labels"].split(",")) == {t.label for t in license_scan.TEMPLATES} | {"apache"}


def test_urls(spark):
    urls = ["HTTP://A.Example.com/en/x", "http://www.example.com/en/", "http://x.net/es/", "http://x.net", None, "plain"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    from tidemark.llm.queries import URL_RULES
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("net/es/", "block")
    assert got[3][:3] == ("x.net", "", None) and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)


def test_chain_marginals():
    r = np.random.default_rng(0)
    score, first, move = r.normal(size=5), np.array([0, 3, 3, 5]), r.normal(size=(2, 2))
    good, _, _ = line_quality.chain(score, first, move)
    for a, b in ((0, 3), (3, 5)):
        n, weight = b - a, {}
        for m in range(2**n):
            y = [m >> i & 1 for i in range(n)]
            weight[m] = np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
        for i in range(n):
            want = sum(w for m, w in weight.items() if m >> i & 1) / sum(weight.values())
            assert good[a + i] == pytest.approx(want)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 5000, "c"])], ["text"])
    assert sum(p.num_rows for p in textarrays.slices(batch, 100)) == 5
