"""Host reputation and token count rollups."""

import os
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import reputation, tokencounts
from parley.llm.catalog import RULES

BPE = public_tokenizers.path("byte_bpe_50k.json")


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]


def fixed(host, path):
    best = (None, None)
    for verdict, rule in RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


URLS = [
    "http://A.Example.NET/en/1?x#y", "https://example.net/EN/1", "http://net/", "http://net", "http://internet/x", "ftp://x.org/fr/2#/de/",
    "http://m.example.com/de/9", "http://example.com?u=http://b.net/", "no scheme", "", None, "://", "http://h.org/fr", "a://b://c.net/en", "HTTP://É.org/fr/é",
]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, "http://z.org/", "x", 1)], "page_id long, url string, host string, bad int")
    none = spark.createDataFrame([], "page long, bad int")
    for r in reputation.judge(df, none, RULES).collect():
        url = "http://z.org/" if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path) == parse(url), url
        rule, verdict = fixed(*parse(url))
        assert (r.rule, r.verdict) == (rule, verdict or "allow"), url


def test_shrinkage(spark):
    rows, bad, k = [], [], 0
    for host, n, share in (("bad.spam.org", 60, 0.95), ("new.spam.org", 1, 0.0), ("good.fine.org", 200, 0.02), ("one.fine.org", 1, 1.0), ("big.fine.org", 400, 0.1), ("calm.other.com", 50, 0.1)):
        for i in range(n):
            rows.append((k, f"http://{host}/{k}"))
            bad.append((k, int(i < share * n)))
            k += 1
    rows.append((k, "http://quiet.spam.org/"))
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page long, bad int")
    got = {r.host: (r.share, r.low, r.verdict) for r in reputation.judge(pages, outcomes, []).collect()}
    assert got["bad.spam.org"][2] == "block" and got["good.fine.org"][2] == "allow"
    # one bad page does not block a host of a good domain; a bound lies below its share
    assert got["one.fine.org"][2] == "allow" and got["one.fine.org"][0] > got["good.fine.org"][0]
    assert all(low < share for share, low, _ in got.values())
    assert got["quiet.spam.org"][0] > got["calm.other.com"][0]
    assert reputation.judge(pages.where("false"), outcomes, RULES).count() == 0


def test_domains(spark):
    names = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "w.x.co.uk": ("x.co.uk", "co.uk"), "localhost": ("localhost", ""), "": ("", "")}
    df = spark.createDataFrame([(n,) for n in names], "h string")
    for r in df.select("h", reputation.domain(F.col("h")).alias("d"), reputation.suffix(reputation.domain(F.col("h"))).alias("s")).collect():
        assert (r.d, r.s) == names[r.h]


@pytest.fixture
def rollup(spark, tmp_path):
    return tokencounts.Rollup(spark, str(tmp_path / "rollup"))


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_is_idempotent(spark, rollup):
    row = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    first = spark.createDataFrame([(1, "a", "en", "v1", 5), (2, "a", "en", "v1", 7), (3, None, "de", "v1", None), (4, "b", "en", "v2", 1)], row)
    assert totals(rollup) == {}
    assert rollup.commit(1, tokencounts.inserts(first)) and not rollup.commit(1, tokencounts.inserts(first))
    want = {("a", "en", "v1"): (2, 12), (None, "de", "v1"): (1, 0), ("b", "en", "v2"): (1, 1)}
    assert totals(rollup) == want
    assert rollup.commit(2, tokencounts.deletes(first.where("doc_id in (1, 4)")))
    revised = first.where("doc_id = 2").withColumnRenamed("n_tokens", "old_tokens").withColumn("n_tokens", F.lit(10))
    assert rollup.commit(4, tokencounts.revisions(revised))
    want = {("a", "en", "v1"): (1, 10), (None, "de", "v1"): (1, 0)}
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit(2, tokencounts.inserts(first)) and rollup.commit(3, tokencounts.inserts(first.where("false")))
    assert totals(rollup) == want


def test_a_broken_batch_does_not_count(spark, rollup):
    rows = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer_version string, n_tokens long")
    rollup.commit(1, tokencounts.inserts(rows))
    os.remove(f"{rollup.folder}/batch-1-1/_SUCCESS")
    assert totals(rollup) == {}
    assert rollup.commit(1, tokencounts.inserts(rows)) and totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_counts_equal_the_library(corpus):
    library = Tokenizer.from_file(BPE)
    got = sorted((r.text or "", r.n_tokens) for r in tokencounts.count_tokens(corpus.withColumn("body", F.col("text")), BPE, "body").collect())
    assert got == sorted((r.text or "", len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in corpus.collect())
