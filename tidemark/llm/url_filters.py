"""URL verdicts: fixed rules, and empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes (blocked or not) are shrunk from host to registered domain to suffix to all:
each level's rate is drawn towards its parent's by a beta-binomial prior whose strength comes from
how much the children of that level differ (method of moments). A host is blocked if the lower
posterior bound of its rate is above a threshold. Built-in functions only.

Counts are aggregated before anything is joined; pages are joined with one row per host, so a hot
host's pages can be split over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A host is blocked if its rate is above this, so many standard deviations from the mean.
THRESHOLD, DEVIATIONS = 0.5, 2.0
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host, its subdomains, and paths that start with the path."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, and the longest fitting rule with its verdict (null where none fits)."""
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, r.pattern).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


# Public suffixes of two labels, and words whose presence in a url marks a bad outcome.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
                      "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
BAD_WORDS = ("adult", "porn", "casino", "betting", "pills", "viagra", "ads", "malware", "phishing")


def _bare(host: Column) -> Column:
    """A host without its port, which says nothing about who runs it."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _long_suffix(host: Column) -> Column:
    return F.substring_index(_bare(host), ".", -2).isin(*TWO_LABEL_SUFFIXES)


def domain_of(host: Column) -> Column:
    """The registered domain of a host: its suffix and the label before it."""
    return F.when(_long_suffix(host), F.substring_index(_bare(host), ".", -3)).otherwise(
        F.substring_index(_bare(host), ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label of a host, or the last two where they are a suffix of two labels."""
    return F.when(_long_suffix(host), F.substring_index(_bare(host), ".", -2)).otherwise(
        F.substring_index(_bare(host), ".", -1))


def outcomes_by_words(pages: DataFrame, words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """(host, bad) of each page: bad if its url holds one of the words, set off by anything but a-z and 0-9."""
    lower = F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER)
    found = lower.rlike("(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)")
    return pages.select(parts(F.col("url"))[0].alias("host"), found.cast("int").alias("bad"))


def _strength(children: DataFrame) -> DataFrame:
    """Prior strength of a level: the beta-binomial's method of moments over all children.

    ``children``: n, k and their parent's rate. Excess of the squared deviations over what counting
    alone gives tells how far children differ.
    """
    p, n = F.col("parent"), F.col("n")
    expected = F.sum(p * (1 - p))
    excess = F.sum(n * F.pow(F.col("k") / n - p, 2)) - expected
    room = F.sum((n - 1) * p * (1 - p))
    spread = F.when(room > 0, F.greatest(F.least(excess / room, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    strength = F.when(spread > 0, 1 / spread - 1).otherwise(STRONGEST)
    return children.agg(F.greatest(F.least(strength, F.lit(STRONGEST)), F.lit(WEAKEST)).alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, k, mean and low, the lower posterior bound, for every host of ``outcomes``.

    ``outcomes``: host and ``bad`` (1, 0, or null where a page has no label). Hosts without labels
    take what their domain, suffix or all labels say. Without any label every mean is one half.
    """
    bad = F.col("bad").cast("double")
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(bad), F.lit(0.0)).alias("k"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("parent"))

    def shrink(level: DataFrame) -> DataFrame:
        """Adds a and b of the posterior; ``level`` has n, k and parent."""
        prior = _strength(level.where("n > 0"))
        a = F.col("strength") * F.col("parent") + F.col("k")
        b = F.col("strength") * (1 - F.col("parent")) + F.col("n") - F.col("k")
        # one row on the right side
        return level.join(F.broadcast(prior), F.lit(True), "left").withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    top = shrink(suffixes.join(F.broadcast(total), F.lit(True), "left"))
    middle = shrink(domains.join(top.select("suffix", F.col("mean").alias("parent")), "suffix"))
    leaf = shrink(hosts.join(middle.select("domain", F.col("mean").alias("parent")), "domain"))
    size = F.col("a") + F.col("b")
    low = F.col("mean") - DEVIATIONS * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return leaf.select("host", "n", "k", "mean", F.greatest(low, F.lit(0.0)).alias("low"))


def judge(pages: DataFrame, rules: list[Rule], outcomes: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, and the host's
    ``low`` bound where no rule decides.

    ``outcomes`` (host, bad) are the labelled pages, of these or of other pages; by default
    ``outcomes_by_words``. The rules' own verdicts are no outcomes. A host is taken as written, with its port; domain and
    suffix are found without it. Null urls have an empty host and count as one host. Repeated rows are judged
    each; other columns are not read; an empty table gives no rows.
    """
    rows = ruled(pages, rules)
    labels = rows.select("host", F.lit(None).cast("int").alias("bad")).union(
        (outcomes_by_words(pages) if outcomes is None else outcomes).select("host", "bad"))
    known = reputation(labels).select(F.col("host").alias("_host"), "low")
    judged = rows.join(known, F.col("host") == F.col("_host"), "left")
    by_host = F.when(F.col("low") > THRESHOLD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
                         F.when(F.col("ruled").isNull(), F.col("low")).alias("low"))
