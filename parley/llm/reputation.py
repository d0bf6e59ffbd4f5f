"""URL filters: fixed rules, and host reputation by empirical Bayes.

Labelled pages count as good or bad. The share of bad pages of a host is shrunk to its
registered domain's, that to its suffix's and that to the overall share, each with a
beta-binomial prior whose strength comes from how much the level below it really
varies (method of moments). A host is blocked if the lower bound of its posterior share
is above a limit; a host without labelled pages inherits its domain's posterior.

Only counts per host move, with map-side sums, so a host with a third of all pages is
one row of each task. All steps are native expressions.

Defined cases: a null url or one without ``://`` has an empty host and path, is no
evidence and is allowed unless a rule fits; pages without a label are no evidence;
without any labelled page every host is allowed; repeated page rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.graph import small
from parley.session import persist

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: second-level names under which domains are registered
SECOND = ("co", "com", "net", "org", "ac", "gov", "edu")
#: limit of the bad share, standard deviations of the bound, bounds of a prior's strength
LIMIT, DEVIATIONS, STRENGTH = 0.5, 1.645, (2.0, 1000.0)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain(name: Column) -> Column:
    """Registered domain: the last two labels, or three under a two-letter country with a second-level name."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(F.slice(parts, -2, 1), 1).isin(*SECOND)
    return F.when(n < 2, name).when(deep, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def suffix(name: Column) -> Column:
    """What follows the first label of a registered domain."""
    return F.regexp_replace(name, r"^[^.]*\.?", "")


def rule_of(name: Column, at: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host and path; null where none does.

    ``rules`` are (verdict, host with path), a list written by hand.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((name == own) | F.endswith(name, F.lit("." + own))) & F.startswith(at, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame, parent: list[str]) -> DataFrame:
    """(parent, mu, m): share of bad pages among the parent's rows, and the strength of the prior around it."""
    sums = counts.groupBy(*parent).agg(
        F.sum("bad").cast("double").alias("k"), F.sum("n").cast("double").alias("t"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
    )
    mu = F.col("k") / F.col("t")
    # sum of n (p - mu)^2, written with sums that combine
    spread = F.col("kk") - F.col("t") * mu * mu
    within = mu * (1 - mu)
    free = F.col("t") - F.col("nn") / F.col("t")
    between = F.when(free > 0, (spread - (F.col("rows") - 1) * within) / free).otherwise(0.0)
    m = F.when(between > 0, within / between - 1).otherwise(STRENGTH[1])
    return sums.select(*parent, mu.alias("mu"), F.least(F.greatest(m, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("m"))


def reputation(evidence: DataFrame) -> DataFrame:
    """Posterior of every host in ``evidence`` (host, bad: 0 or 1 or null): host, domain, n, share, low.

    Hosts whose labels are all null are kept, with n = 0.
    """
    hosts = evidence.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = hosts.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    hosts = persist(hosts, "hosts")
    domains = persist(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def level(rows: DataFrame, priors: DataFrame, on: list[str], strength: DataFrame) -> DataFrame:
        """Adds a and b of the posterior, from the parent's posterior share and one strength for the level."""
        rows = rows.join(priors, on, "left") if on else rows.crossJoin(F.broadcast(priors))  # one row
        rows = rows.crossJoin(F.broadcast(strength.select("m")))  # one row
        a = F.col("bad") + F.col("m") * F.col("prior")
        b = F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("prior"))
        return rows.withColumns({"a": a, "b": b}).withColumn("share", F.col("a") / (F.col("a") + F.col("b")))

    seen = lambda rows: rows.where("n > 0")
    root = _strength(seen(suffixes), [])
    s = level(suffixes, root.select(F.col("mu").alias("prior")), [], _strength(seen(suffixes), []))
    d = level(domains, s.select("suffix", F.col("share").alias("prior")), ["suffix"], _strength(seen(domains), []))
    d = persist(d.select("domain", "n", "bad", "a", "b", "share"), "domain_posteriors")
    h = level(hosts, d.select("domain", F.col("share").alias("prior")), ["domain"], _strength(seen(hosts), []))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return h.select("host", "domain", "n", "bad", "share", (F.col("share") - DEVIATIONS * deviation).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page row's id, host, path, rule, verdict, and its host's ``share`` and ``low``.

    ``outcomes`` has (page, bad), at most one row a page.
    """
    pages = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"))
    pages = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = pages.join(outcomes.select(F.col("page").alias("page_id"), "bad"), "page_id", "left")
    evidence = known.select("host", F.when(F.col("host") != "", F.col("bad")).alias("bad"))
    found = persist(reputation(evidence).select("host", "share", "low"), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    judged = pages.withColumn("rule", rule).withColumn("fixed", verdict).join(small(found), "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", own).alias("verdict"), "share", "low")
