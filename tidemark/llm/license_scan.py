"""License notices by a positional index of rare template words.

Each template is indexed by its own rarest words (highest IDF over all texts): where each of them
stands in it. So many of its places are indexed that a stretch with the required share of words in
place has enough votes, whichever words are missing: how frequent words are decides the cost, never
the result. Every place of such a word in a text votes for where each template would begin. A
template whose words agree on one beginning is a candidate, and it is found if its mandatory key
phrases stand in that stretch of the text. Phrases that name a licence are matched as they stand
beside that. Built-in functions only, and nothing but the licence words' counts leaves a row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The IDF from which a word counts as rare.
LEAST_IDF = math.log(8)
#: Votes that a candidate needs (fewer if that keeps frequent words out of the index), and words
#: that a key phrase may stand beside its place.
VOTES, SLACK = 3, 3
#: Share of a template's words that have to stand at their places.
COVERAGE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(re.findall(_WORD, self.text.lower())))


# Wording of public licence notices.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of "
             "the License at", ("in compliance with the license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation", ("free software", "general public license")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license",)),
)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _words(docs: DataFrame) -> DataFrame:
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return docs.select("doc_id", F.regexp_extract_all(low, F.lit(f"({_WORD})"), F.lit(1)).alias("w"))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand, from 0."""
    n = len(phrase)
    at = F.filter(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.expr("true") if not n else _all([F.get(words, i + j) == F.lit(p) for j, p in enumerate(phrase)]))
    return F.when(F.array_contains(words, phrase[0]) & (F.size(words) >= n), at).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all texts; one row per template word comes back."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = _words(docs).select(F.explode(F.array_intersect(_texts(vocabulary), F.col("w"))).alias("word")) \
        .groupBy("word").count().collect()
    total = docs.count()
    seen = {r["word"]: r["count"] for r in rows}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


def _indexed(t: Template, weight: dict[str, float]) -> tuple[list[str], int]:
    """Words to index, rare first, and the votes that any stretch with COVERAGE of ``t`` in place gets from them."""
    if not t.words:
        return [], 1
    ranked = sorted(set(t.words), key=lambda w: (-weight[w], w))
    n = len(t.words)
    least = next(i for i in range(n + 1) if i / n >= COVERAGE)
    choices = []
    for votes in range(min(VOTES, least), 0, -1):
        words: list[str] = []
        while sum(w in words for w in t.words) < n - least + votes:
            words.append(ranked[len(words)])
        choices.append((words, votes))
    return next((c for c in choices if weight[c[0][-1]] >= LEAST_IDF), choices[0])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best template's share of words in place, at least one half where
    a phrase was found).

    Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned each; other
    columns are not read; an empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    weight = idf(docs, templates)
    chosen = [_indexed(t, weight) for t in templates]
    indexed = sorted({x for words, _ in chosen for x in words}, key=lambda x: (-weight[x], x))
    postings = {x: [(k, i) for k, t in enumerate(templates) if x in chosen[k][0] for i, y in enumerate(t.words) if y == x]
                for x in indexed}
    need = [votes for _, votes in chosen]

    w = F.col("w")
    out = _words(docs)
    for k, phrase in enumerate(phrases):
        out = out.withColumn(f"b{k}", _places(w, phrase.split()))
    base = F.array_sort(F.concat(*[F.col(f"b{k}") for k in range(len(phrases))]))
    out = out.withColumn("base", base)
    index = F.create_map(*[x for word in indexed for x in (
        F.lit(word), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("p")) for k, i in postings[word]]))])
    hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(indexed))
    # a vote is the template's number and beginning in one long
    votes = F.flatten(F.transform(hits, lambda i: F.transform(
        F.element_at(index, F.get(w, i)),
        lambda x: x["t"].cast("long") * (1 << 33) + (i - x["p"]).cast("long") + (1 << 32))))
    out = out.withColumn("votes", F.when(F.size(w) > 0, F.array_sort(votes)).otherwise(F.array().cast("array<long>")))
    v = F.col("votes")
    wanted = F.array(*[F.lit(n) for n in need])
    enough = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda j: F.coalesce(
        F.get(v, j + F.get(wanted, F.shiftright(F.get(v, j), 33).cast("int")) - 1) == F.get(v, j), F.lit(False)))
    found = F.array_distinct(F.transform(enough, lambda j: F.get(v, j)))
    out = out.withColumn("found", F.when(F.size(v) > 0, found).otherwise(F.array().cast("array<long>")))

    labels, shares = [], []
    for k, t in enumerate(templates):
        share = F.array_max(F.transform(F.filter(F.col("found"), _votes_for(k)), _share_of(w, t)))
        out = out.withColumn(f"s{k}", F.when(F.size("found") > 0, share))
        labels.append(F.when(F.col(f"s{k}") >= COVERAGE, F.lit(t.label)))
        shares.append(F.when(F.col(f"s{k}") >= COVERAGE, F.col(f"s{k}")))
    base_labels = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())])))
    every = F.array_distinct(F.concat(base_labels, F.array_compact(F.array(*labels))))
    n = F.size("base")
    return out.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), n.cast("long").alias("n_base"),
        F.get(F.col("base"), F.lit(0)).cast("long").alias("first_word"), F.get(F.col("base"), n - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.greatest(F.lit(0.0), F.when(n > 0, 0.5), *shares).alias("score"))


def _votes_for(template: int):
    return lambda vote: F.shiftright(vote, 33) == template


def _share_of(words: Column, t: Template):
    return lambda vote: _coverage(words, vote, t)


def _coverage(words: Column, vote: Column, t: Template) -> Column:
    """Share of the template's words in place from where the vote says; 0 without its key phrases."""
    begin = (vote - F.shiftright(vote, 33) * (1 << 33) - (1 << 32)).cast("int")
    from_ = F.greatest(begin - SLACK, F.lit(0))
    until = begin + len(t.words) + SLACK
    stretch = F.concat(F.lit(" "), F.array_join(F.slice(words, from_ + 1, F.greatest(until - from_, F.lit(0))), " "), F.lit(" "))
    keys = _all([F.contains(stretch, F.lit(f" {k} ")) for k in t.keys])
    same = sum((F.when((begin + i >= 0) & (F.get(words, begin + i) == F.lit(x)), 1.0).otherwise(0.0)
                for i, x in enumerate(t.words)), F.lit(0.0))
    return F.when(keys, same / len(t.words)).otherwise(0.0)
