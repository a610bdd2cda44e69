"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontamination, filter_audit, jaccard_join, language_id, license_scan, line_quality, packing, quality_rules,
    suffix_dedup, token_counts, toxicity, url_filters, whitening,
)
from tidemark.llm.base import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w
    from documents),
sets as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from words),
sizes as (select doc_id, len(s) n from sets),
items as (select doc_id, unnest(s) t from sets),
pairs as (
    select x.doc_id a, y.doc_id b, count(*) c from items x join items y on x.t = y.t and x.doc_id < y.doc_id
    group by all),
links as (
    select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (
    select doc_id, doc_id from sizes
    union select b, r from reach join both_ways on a = reach.doc_id where r < b)
select s.doc_id, s.n as n_shingles, min(r) as component_id
from sizes s join reach using (doc_id) group by s.doc_id, s.n
"""


@query("op10_ngram_jaccard_join", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


@query("op4_line_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return line_quality.score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


OP6_SQL = r"""
with t as (select doc_id, coalesce(text, '') x from documents),
w as (
    select doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l from t),
places as (
    select doc_id, unnest(range(1, len(w) - 1)) i, w from w where len(w) >= 3),
three as (select doc_id, i, w[i:i + 2] t from places),
again as (select doc_id, i from three qualify count(*) over (partition by doc_id, t) > 1),
rep as (
    select doc_id, count(distinct i + j) n from again, (values (0), (1), (2)) v(j) group by doc_id)
select w.doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda y: length(y)))::bigint, 0) word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words,
    len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) base_failed
from w left join rep using (doc_id)
"""


@query("op6_robust_outliers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(F.col("doc_id"), 5) != 0)
    return language_id.predict(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


URL_RULES = [
    url_filters.Rule("com/", "allow"), url_filters.Rule("example.com/en/", "block"),
    url_filters.Rule("www.example.com/en/", "allow"), url_filters.Rule("net/es/", "block"),
    url_filters.Rule("net/fr/", "block"),
]

OP2_SQL = r"""
with parts as (
    select page_id, regexp_matches(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '(^|[^a-z0-9])(adult|porn|casino|betting|pills|viagra|ads|malware|phishing)([^a-z0-9]|$)')::int bad,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path from pages),
ruled as (
    select *, case
        when (host = 'www.example.com' or suffix(host, '.www.example.com')) and prefix(path, '/en/') then 'www.example.com/en/'
        when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/') then 'example.com/en/'
        when (host = 'net' or suffix(host, '.net')) and prefix(path, '/fr/') then 'net/fr/'
        when (host = 'net' or suffix(host, '.net')) and prefix(path, '/es/') then 'net/es/'
        when (host = 'com' or suffix(host, '.com')) and prefix(path, '/') then 'com/' end rule from parts),
marked as (
    select *, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' end ruled from ruled),
labels as (
    select host, count(*)::double n, sum(bad)::double k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') l,
        array_to_string(l[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp',
            'ne.jp', 'or.jp', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'co.in', 'co.kr', 'co.za') two
    from marked group by host),
hosts as (
    select host, n, k, array_to_string(case when two then l[-3:] else l[-2:] end, '.') dom,
        array_to_string(case when two then l[-2:] else l[-1:] end, '.') suf
    from labels),
doms as (select dom, suf, sum(n) n, sum(k) k from hosts group by all),
sufs as (select suf, sum(n) n, sum(k) k from doms group by all),
s0 as (select *, (select (sum(k) + 0.5) / (sum(n) + 1) from sufs) p from sufs),
c1 as (select sum(n * (k / n - p) ** 2) - sum(p * (1 - p)) ex, sum((n - 1) * p * (1 - p)) room from s0),
t1 as (select case when room > 0 then greatest(least(ex / room, 1.0), 0.0) else 0 end sp from c1),
u1 as (select greatest(least(case when sp > 0 then 1 / sp - 1 else 1000 end, 1000.0), 1.0) s from t1),
s1 as (select suf, (s * p + k) / (s + n) m from s0, u1),
d0 as (select dom, n, k, m p from doms join s1 using (suf)),
c2 as (select sum(n * (k / n - p) ** 2) - sum(p * (1 - p)) ex, sum((n - 1) * p * (1 - p)) room from d0),
t2 as (select case when room > 0 then greatest(least(ex / room, 1.0), 0.0) else 0 end sp from c2),
u2 as (select greatest(least(case when sp > 0 then 1 / sp - 1 else 1000 end, 1000.0), 1.0) s from t2),
d1 as (select dom, (s * p + k) / (s + n) m from d0, u2),
h0 as (select host, n, k, m p from hosts join d1 using (dom)),
c3 as (select sum(n * (k / n - p) ** 2) - sum(p * (1 - p)) ex, sum((n - 1) * p * (1 - p)) room from h0),
t3 as (select case when room > 0 then greatest(least(ex / room, 1.0), 0.0) else 0 end sp from c3),
u3 as (select greatest(least(case when sp > 0 then 1 / sp - 1 else 1000 end, 1000.0), 1.0) s from t3),
post as (select host, s * p + k a, s * (1 - p) + n - k b from h0, u3),
low as (select host, a / (a + b) - 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) low from post)
select page_id, host, path, rule, coalesce(ruled, case when low > 0.5 then 'block' else 'allow' end) verdict
from marked join low using (host)
"""


@query("op2_url_reputation", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("low")


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
    select doc_id, coalesce(source, '') part, coalesce(text, '') x,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
f as (
    select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
        + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x))::int
        + 8 * regexp_matches(x, '[#$%&*|]')::int
        + 16 * coalesce(min(doc_id) over (partition by x) < doc_id, false)::int m from d),
l as (
    select doc_id, max(coalesce(quality = 1, false)::int) good, max(coalesce(toxic = 1, false)::int) toxic
    from labels group by doc_id),
h as (
    select part, m, count(*) n, sum(coalesce(good, 0)) g, sum(coalesce(toxic, 0)) t from f left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 4, 8, 16]) b),
orders as (
    select v.c || w.c || x.c || y.c || z.c filter_order, [v.b, w.b, x.b, y.b, z.b] bits
    from letters v, letters w, letters x, letters y, letters z
    where v.b + w.b + x.b + y.b + z.b = 31 and len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
steps as (
    select filter_order, i step, bits[i] b, coalesce(list_sum(bits[1:i - 1]), 0)::int gone
    from orders, unnest([1, 2, 3, 4, 5]) s(i)),
done as (
    select part, filter_order, step, b,
        sum(n) filter (m & gone = 0 and m & b = 0) kept, sum(n) filter (m & gone = 0 and m & b > 0) removed,
        sum(n) filter (m & gone > 0 and m & b > 0) redundant, sum(n) filter (m = b) unique_fails,
        sum(g) filter (m & gone = 0 and m & b > 0) good_lost, sum(t) filter (m & gone = 0 and m & b > 0) toxic_lost
    from h, steps group by all)
select part, filter_order, step::int step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed,
    coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
    coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
    coalesce(sum(removed) over (partition by part, b), 0)::bigint shapley
from done
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
