"""What the quality rules keep and reject, on planted texts."""

import math
import random
from collections import Counter

import pytest
import xxhash

from parley.llm import catalog, perplexity

LETTERS = "etaoinshrdlucmfwygpbvk"


def sentence(rnd: random.Random, words: int) -> str:
    return " ".join("".join(rnd.choices(LETTERS, weights=range(len(LETTERS), 0, -1), k=rnd.randint(3, 7))) for _ in range(words))


def junk(rnd: random.Random, words: int) -> str:
    return " ".join("".join(chr(rnd.randint(33, 1500)) for _ in range(5)) for _ in range(words))


def test_planted_junk_lies_above_the_band(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, 100), "en") for i in range(100)] + [(1000 + i, junk(rnd, 60), "en") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op1_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        # a text that vouches for itself would lie below the band, as its contexts stand nowhere else
        if r.doc_id >= 1000:
            assert not r.kept and r.log_perplexity > r.high
    assert sum(r.kept for r in got) > 95


def test_equal_texts_get_equal_held_out_scores(spark):
    rnd = random.Random(6)
    rows = [(i, sentence(rnd, 40), "en") for i in range(20)]
    rows += [(100 + i, rows[i][1], "en") for i in range(20)]
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=True).collect()}
    assert all(got[i] == pytest.approx(got[100 + i]) for i in range(20))


def test_copies_do_not_narrow_the_band(spark):
    rnd = random.Random(7)
    rows = [(i, sentence(rnd, 120), "en") for i in range(60)]
    copy = sentence(rnd, 120)
    rows += [(1000 + i, copy, "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for held_out in (False, True):
        got = perplexity.quality(docs, held_out=held_out).collect()
        assert len(got) == len(rows)
        assert all(r.high > r.low for r in got)
        assert sum(r.kept for r in got if r.doc_id < 1000) > 50


def test_a_single_text_has_a_band(spark):
    text = sentence(random.Random(8), 40)
    r = perplexity.quality(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).head()
    assert r.kept and r.high > r.low


def symbols(text):
    """What the model sees: wide code points are two symbols."""
    return [None] * 4 + [x for c in text for x in ([c] if ord(c) < 1920 else [("lead", ord(c) >> 10), ("trail", ord(c) & 1023)])]


def plain_model(texts):
    """Probability of the last of up to five symbols, by modified Kneser-Ney over ``texts``."""
    counts = {5: Counter(tuple(s[j : j + 5]) for s in map(symbols, texts) for j in range(len(s) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    of_counts = {k: Counter(c.values()) for k, c in counts.items()}
    followers = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            followers[k].setdefault(g[:-1], []).append((g, n))

    def d(k, c):
        n, i = of_counts[k], min(c, 3)
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return min(max(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.1), i - 0.1)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 4096
        known = followers[k].get(gram[:-1])
        if not known:
            return p(gram[1:])
        total, c = sum(n for _, n in known), counts[k].get(gram, 0)
        return ((c - d(k, c)) / total if c else 0.0) + sum(d(k, n) for _, n in known) / total * p(gram[1:])

    return p


@pytest.mark.parametrize(("rows_of_a_file", "sweep"), [(500_000, 1 << 24), (150, 300)])
def test_held_out_scores_equal_a_plain_model(spark, monkeypatch, rows_of_a_file, sweep):
    # the second case has far more files than a worker keeps, and many sweeps
    for name, value in (("FILE_ROWS", rows_of_a_file), ("SWEEP", sweep), ("BLOCK", sweep)):
        monkeypatch.setattr(perplexity, name, value)
    rnd = random.Random(9)
    rows = [(sentence(rnd, 12), rnd.choice(["en", None])) for i in range(40)]
    rows += [("".join(chr(rnd.randint(0x4E00, 0x4E20)) for _ in range(60)) + rnd.choice(["", "\U0001f600", "\x01\x01"]), "zh") for _ in range(20)]
    rows += [rows[3], rows[45], ("", "en"), (None, "zh")]
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 1
    models = {(h, lang): plain_model([t for t, x in rows if t and x == lang and half(t) == h]) for h in (0, 1) for lang in ("en", None, "zh")}
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality(docs, held_out=True).collect()}
    for i, (text, lang) in enumerate(rows):
        if not text:
            assert got[i] is None
            continue
        p, s = models[1 - half(text), lang], symbols(text)
        want = -sum(math.log(p(tuple(s[j : j + 5]))) for j in range(len(s) - 4)) / len(text)
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_wide_code_points_are_not_folded(spark):
    text = "".join(chr(0x4E00 + i) for i in range(40))
    other = "".join(chr(0x4E00 + i + 2047) for i in range(40))
    docs = [(i, text, "zh") for i in range(5)] + [(9, other, "zh")]
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[9] > got[0] * 1.2
