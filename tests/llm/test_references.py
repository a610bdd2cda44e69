"""Operators beside plain versions, SQL, or held-out labels."""

import itertools
import os
import random
import re
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import check_oracle  # noqa: E402

from tidemark.llm import packing, quality_rules, queries, toxicity  # noqa: E402

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = check_oracle.connect(SMALL)
    assert check_oracle.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SMALL) == ""


@needs_data
def test_counts_equal_their_sql(spark):
    con = check_oracle.connect(SMALL)
    base = lambda s, d: queries.QUERIES["op6_robust_outliers"](s, d).drop("kept", "distance")
    assert check_oracle.compare(spark, con, "op6", base, queries.OP6_SQL, SMALL) == ""


def best_first(score, a, b):
    """Maximal scoring segments by their definition: the best one, then those to its left and right."""
    sums = [(sum(score[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
    if not sums or max(sums)[0] <= 1e-12:
        return []
    _, _, i, j = max(sums)
    return [*best_first(score, a, i), (i, j), *best_first(score, j, b)]


def test_all_segments_by_definition():
    r = random.Random(7)
    for _ in range(300):
        n = r.randint(1, 16)
        hits = [(i, r.uniform(0.2, 3.0)) for i in range(n) if r.random() < 0.5]
        score = [-0.61803] * n
        for i, s in hits:
            score[i] = s
        got = [(f, e) for f, e, _ in toxicity.segments(hits, 0.61803)]
        assert got == best_first(score, 0, n)


def test_packing_beside_a_list_of_bins():
    """The same rule over a plain list: tightest open bin, and the fullest closes when all are open."""
    r = random.Random(3)
    for limit in (1, 3, 20):
        bins = packing.OpenBins(100, limit)
        plain, closed, made = [], [], 0  # free space of open bins
        for _ in range(400):
            n = r.choice([r.randint(1, 100), r.randint(1, 30)])
            number, offset = bins.place(n)
            fits = [f for f in plain if f >= n]
            if fits:
                free = min(fits)
                plain.remove(free)
            else:
                if len(plain) == limit:
                    closed.append(min(plain))
                    plain.remove(closed[-1])
                free = 100
                made += 1
            assert offset == 100 - free and number < bins.made == made
            if free > n:
                plain.append(free - n)


def test_least_determinant_beside_all_subsets():
    random_points = np.random.default_rng(5)
    for _ in range(5):
        x = random_points.normal(size=(12, quality_rules.DIMS))
        x[:3] += 6
        h = (12 + quality_rules.DIMS + 1) // 2
        best = min(quality_rules._spread(np.cov(x[list(s)].T, bias=True), h / 12)[1] for s in itertools.combinations(range(12), h))
        found = quality_rules._starts.func(pd.Series([list(x)]))[0]
        assert min(f[3] for f in found) == pytest.approx(best, abs=1e-6)


def test_base_labels_beside_a_plain_search(spark):
    from tidemark.llm import license_scan
    r = random.Random(9)
    words = ["mit", "license", "apache", "general", "public", "MIT", "License", "x", "é", "a1", "_"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))).replace(" x ", r.choice([", ", "\n", " x-"])) for _ in range(80)]
    texts += [None, ""]
    df = spark.createDataFrame([(i, t, "s", "e") for i, t in enumerate(texts)], "doc_id long, text string, source string, labels string")
    got = {g["doc_id"]: g for g in license_scan.scan(df).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, text in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k: k + len(p)]) == p]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = ",".join(sorted({label for _, label in places}))
        assert got[i]["base_labels"] == base and set(filter(None, base.split(","))) <= set(got[i]["labels"].split(","))


@needs_data
def test_held_out_accuracy(spark):
    """Quality by AUC, language by share, on rows whose labels no fit has seen."""
    quality = queries.QUERIES["op4_line_quality"](spark, LARGER).where("held_out").toPandas()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    both = quality.merge(labels, on="doc_id")
    good, bad = both.score[both.quality == 1].to_numpy(), both.score[both.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    language = queries.QUERIES["op9_language_id"](spark, LARGER).where("held_out").toPandas()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").toPandas().dropna()
    both = language.merge(docs, on="doc_id")
    known = both[both.lang_pred != "und"]
    assert (known.lang_pred == known.lang).mean() > 0.97
    toxic = queries.QUERIES["op1_toxicity"](spark, LARGER).where("held_out").toPandas().merge(labels, on="doc_id")
    bad, good = toxic.score[toxic.toxic == 1].to_numpy(), toxic.score[toxic.toxic == 0].to_numpy()
    assert ((bad[:, None] > good[None]) + 0.5 * (bad[:, None] == good[None])).mean() > 0.75
