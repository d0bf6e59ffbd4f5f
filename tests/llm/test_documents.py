"""Operators on texts against plain loops."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parley.llm import bpe, graph, jaccard, langid, linear, perplexity, spans, substrings, weak, winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


def test_spans_equal_split():
    column = pa.array(["a bb  ccc", None, "", "é\tü", "x" * 5000 + " y", "a bb"])
    block = spans.Block(column)
    block.words()
    h = block.hashes()
    by_word = defaultdict(set)
    for r, t in enumerate(column.to_pylist()):
        own = [block.text(i).decode() for i in range(block.bounds[r], block.bounds[r + 1])]
        assert own == (t or "").split()
        for i in range(block.bounds[r], block.bounds[r + 1]):
            by_word[block.text(i)].add(int(h[i]))
    assert all(len(x) == 1 for x in by_word.values()) and len({min(x) for x in by_word.values()}) == len(by_word)
    g = np.arange(20, dtype=np.uint64)[::-1].copy()
    assert [int(x) for x in spans.sliding_min(g, 6)] == [min(g[i : i + 6]) for i in range(15)]
    assert [list(x) for x in spans.unpack(spans.pack(g, np.array([True])))] == [list(g), [True]]


@pytest.mark.parametrize("window", [1, 4, 13, 50])
def test_substrings(corpus, window):
    rows = texts(corpus)
    last = 1 << 62
    first = {}
    for i, t in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), last if i is None else i)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (last if i is None else i):
                gone |= set(range(j, j + window))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert bag(substrings.remove_repeats(corpus, window).collect()) == bag(want)


def test_shards_take_even_shares_of_the_minimizers():
    rng = np.random.default_rng(1)
    block = spans.Block(pa.array([" ".join(map(str, rng.integers(0, 50000, 400))) for _ in range(300)]))
    block.words()
    for window in (13, 50):
        m, ok = substrings._minimizers(block, block.hashes(), window)
        n = np.diff(spans.shard_cuts(np.sort(m[ok]), 64))
        assert n.max() < 3 * n.mean()


def test_substrings_keep_blanks_of_what_stays(spark):
    p = " ".join(f"p{i}" for i in range(14))
    df = spark.createDataFrame([(1, f"a\n{p}"), (2, f" x  y\n{p} \n z"), (3, " b\n c ")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(df, 13, tidy=False, carry=("text",)).collect()}
    assert got == {1: f"a\n{p}", 2: " x  y\nz", 3: " b\n c "}


def test_wavelet_and_backward_search():
    rnd = np.random.default_rng(3)
    codes = np.append(rnd.integers(1, 9, 400), 0).astype(np.int32)
    tree = substrings.Wavelet(codes, 9)
    symbol, at = rnd.integers(0, 9, 200).astype(np.int32), rnd.integers(0, 402, 200).astype(np.int32)
    assert list(tree.rank(symbol, at)) == [int((codes[:a] == s).sum()) for s, a in zip(symbol, at)]
    index = substrings.FMIndex(codes, 9, 6)
    ends, lengths = rnd.integers(6, 400, 100), rnd.integers(1, 7, 100)
    low, high = index.search(codes, ends, lengths)
    flat = codes.tolist()
    for e, n, a, b in zip(ends, lengths, low, high):
        pattern = flat[e - n : e]
        count = sum(flat[i : i + n] == pattern for i in range(len(flat)))
        assert b - a == count or (count == 1 and b - a <= 1)


def shingles(t, n):
    w = (t or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(corpus, n, percent):
    rows = [(i, shingles(t, n)) for i, t in texts(corpus)]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = [(i, len(s), None if i is None else find(i)) for i, s in rows]
    assert bag(jaccard.similar_components(corpus, n, percent).collect()) == bag(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_winnowing(spark, corpus):
    rows = texts(corpus)
    items = [(1, rows[2][1]), (2, rows[78][1] and " ".join(rows[78][1].split()[10:28])), (3, "two words"), (4, "X"), (5, None), (None, "one"), (6, ""), (7, rows[2][1]), (3, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for item, x in items:
            v = word(x)
            if item is None or not v:
                continue
            n = min(13, len(v))
            for a in range(len(v) - n + 1):
                for b in range(len(w) - n + 1):
                    if v[a : a + n] == w[b : b + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(item))
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in winnow.contamination(corpus, bench).collect()]
    assert Counter(got) == Counter(want)


def test_words_are_split_a_few_rows_at_a_time():
    classes = bpe.char_classes(BPE)
    rows = ["<|endoftext|> " + "it's a  test\n\n of 12 words, été 日本 " * 40, "", None, "x" * 3000, "  end "] * 400
    block = spans.Block(pa.array(rows))
    words = bpe.Words(classes, {"<|endoftext|>": 0})
    tracemalloc.start()
    got = words.split(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(block.data)
    bounds = got[2]
    for i in (0, 1, 2, 3, 4, 1003, len(rows) - 1):
        alone = words.split(spans.Block(pa.array([rows[i]], pa.string())))
        low, a, b = block.offsets[i], bounds[i], bounds[i + 1]
        assert (got[0][a:b] - low).tolist() == alone[0].tolist() and (got[1][a:b] - low).tolist() == alone[1].tolist()
    assert len(bounds) == len(rows) + 1 and [x.tolist() for x in words.split(spans.Block(pa.array([], pa.string())))] == [[], [], [0]]


def test_bpe_equals_the_library(spark, corpus):
    extra = ["<|endoftext|>", "a<|endoftext|> 's<|endoftext|>", "it's we'll 'tis ''s \n's", "  two  \n\n x \r\n", "😀 12³ ½x", "\ufeffx\u200b \u2003y", "<|endof"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    df = corpus.select("doc_id", "text").unionByName(more)
    library = Tokenizer.from_file(BPE)
    want = [(i, tuple(e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for i, t in texts(df)]
    got = bpe.encode(df, BPE, decoded=True)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter(want)
    ids = bpe.encode(df.limit(5), BPE)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in bpe.decode(ids, BPE).collect())


def test_quality_base_rules_and_bands(corpus):
    want = []
    for i, t in texts(corpus):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    rows = perplexity.quality(corpus).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter(want)
    for r in rows:
        assert r.kept == (not r.base_failed and r.log_perplexity is not None and r.low <= r.log_perplexity <= r.high)
        assert (r.log_perplexity is None) == (r.n_chars == 0)


def test_kneser_ney_equals_a_plain_model(spark):
    rows = [("en", "abracadabra"), ("en", "abba cab"), ("en", "dab abra"), (None, "zzz"), ("en", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality(df).collect()}
    counts = {5: Counter()}
    for lang, t in rows:
        if lang and t:
            s = [None] * 4 + list(t)
            counts[5].update(tuple(s[j : j + 5]) for j in range(len(t)))
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def d(k, c):
        n = Counter(counts[k].values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        i = min(c, 3)
        return min(max(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.1), i - 0.1)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 4096
        followers = [(g, c) for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not followers:
            return p(gram[1:])
        total = sum(c for _, c in followers)
        c = counts[k].get(gram, 0)
        own = (c - d(k, c)) / total if c else 0.0
        return own + sum(d(k, c) for _, c in followers) / total * p(gram[1:])

    for i, (lang, t) in enumerate(rows):
        if lang and t:
            s = [None] * 4 + list(t)
            want = -sum(np.log(p(tuple(s[j : j + 5]))) for j in range(len(t))) / len(t)
            assert got[i] == pytest.approx(want, rel=1e-4)


def test_ftrl_learns_a_rule(spark, corpus):
    docs = [(i, f"fine words {i} here" if i % 3 else f"bad!!! w{i} ### words") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = df.where("doc_id < 200").selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) y")
    model = linear.fit(df, linear.sample(known, 150), linear.style_features, counted=True)
    got = {r.doc_id: r.score for r in model.scores(df).collect()}
    assert all((got[i] > 0.5) == bool(i % 3) for i in range(200, 300))
    odd = [r.score for r in model.scores(corpus).collect()]
    assert len(odd) == corpus.count() and all(0 <= s <= 1 for s in odd)
    kept = model.below(df.withColumn("z", df.doc_id), 0.5).collect()
    assert {r.z for r in kept} == {i for i, s in got.items() if s < 0.5}


def test_weak_supervision(spark, corpus):
    rows = []
    for i in range(900):
        bad = i % 9 == 0
        rows.append((i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(20)) + (f" zorgl{'abcdefghij'[i % 10]}x" if bad else ""), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = weak.toxicity_model(df.select("doc_id", "text"), df.where("doc_id < 600").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in model.scores(df).collect()}
    right = sum((got[i] >= 0.3) == (i % 9 == 0) for i in range(600, 900))
    assert right >= 290
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert weak.toxicity_model(corpus, none).scores(corpus).count() == corpus.count()


def test_label_model_finds_good_voters(spark):
    rnd = np.random.default_rng(5)
    y = rnd.random(4000) < 0.1
    n = weak._voters([np.zeros(0, np.uint64)] * (weak.KINDS * weak.VOTERS))[1]
    fire = rnd.random((4000, n)) < np.where(y[:, None], 0.4, 0.01)
    votes = (fire.astype(np.int64) << np.arange(n)).sum(axis=1)
    df = spark.createDataFrame(list(Counter(votes.tolist()).items()), "votes long, count long")
    p = weak.label_model(df).posterior(votes)
    # a voter that is silent abstains, so a lone mistaken vote may still win
    assert ((p > 0.5) == y).mean() > 0.95
    order = np.argsort(np.argsort(p))
    n1 = int(y.sum())
    assert (order[y].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1)) > 0.99


def test_segmentations_are_summed():
    known = [b" ", b"a", b"b", b"ab", b" a", b"bab", b"abababababab"]
    table = langid.Vocabulary(known)
    price = {p: 0.05 + 0.03 * i for i, p in enumerate(known)}
    by_hash = {langid.spans.mix(langid._prefixes(np.frombuffer(p, np.uint8)[None, :])[:, -1])[0]: p for p in known}
    probability = np.append([price[by_hash[h]] for h in table.hashes], 0.0)[:, None] * np.array([[1.0, 0.5]])

    def total(word, share):
        sums = [1.0]
        for j in range(1, len(word) + 1):
            sums.append(sum(share * p * sums[j - len(x)] for x, p in price.items() if word[:j].endswith(x) and len(x) <= j))
        return sums[-1]

    for word in (b" abab", b" ", b" ababababababab", b" " + b"ab" * 40):
        got = langid._word_logs(np.frombuffer(word, np.uint8)[None, :], table, probability)[0]
        assert got == pytest.approx([np.log(total(word, 1.0)), np.log(total(word, 0.5))])
    # a long word neither underflows nor is cut
    long = langid._word_logs(np.frombuffer(b" " + b"ab" * 5000, np.uint8)[None, :], table, probability)[0]
    short = langid._word_logs(np.frombuffer(b" " + b"ab" * 2500, np.uint8)[None, :], table, probability)[0]
    assert np.all(np.isfinite(long)) and long == pytest.approx(2 * short, rel=1e-2)


def test_every_piece_takes_part():
    path = public_tokenizers.path("piece_bpe_32k.model")
    known, table = langid.pieces(path), langid.vocabulary(path)
    assert len(known) == len(table) > 31_000 and max(map(len, known)) > 16
    for piece in known:
        lattice = langid.Lattice(np.frombuffer(piece, np.uint8)[None, :], table)
        assert lattice.ids[len(piece)][0, 0] < len(table)


def test_expected_uses_are_those_of_all_segmentations():
    known = [b" ", b"a", b"b", b"ab", b" a", b"bab"]
    table = langid.Vocabulary(known)
    probability = np.append(np.linspace(0.1, 0.3, len(table)), 0.0)[:, None]
    names = {langid.spans.mix(langid._prefixes(np.frombuffer(p, np.uint8)[None, :])[:, -1])[0]: p for p in known}
    price = {names[h]: probability[i, 0] for i, h in enumerate(table.hashes)}

    def ways(rest):
        if not rest:
            yield 1.0, []
        for x, p in price.items():
            if rest.startswith(x):
                for q, used in ways(rest[len(x) :]):
                    yield p * q, [x, *used]

    every = list(ways(b" ababab"))
    mass = sum(p for p, _ in every)
    want = {x: 3 * sum(p * used.count(x) for p, used in every) / mass for x in known}
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"]), pa.array([b"ababab"], pa.binary()), pa.array([3], pa.int64())], ["lang", "word", "n"])
    got = {names[table.hashes[i]]: n for b in langid._expected(table, probability, ["aa"])(iter([batch])) for i, n in zip(b.column("piece").to_pylist(), b.column("n").to_pylist())}
    assert got == pytest.approx({x: n for x, n in want.items() if n})


def test_an_id_on_many_rows_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(1, 30)] + [(1, 0.0)], "doc_id long, y double")
    known = linear.sample(labels, 100)
    assert {r.id: r.y for r in known.collect()}[1] == 0.5 and known.count() == 29
    seen = []
    learn = linear._learn

    def counted(settings):
        run = learn(settings)

        def rows(table):
            if table.num_rows > 29:
                raise ValueError(f"{table.num_rows} rows")
            return run(table)

        return rows

    linear._learn = counted
    try:
        linear.fit(docs, known, linear.style_features, counted=True)
    finally:
        linear._learn = learn
    assert not seen


def test_language_id(spark, corpus):
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["krzysz", "wczoraj", "gdzie", "strzal"]}
    rows = [(i, lang, " ".join(words[lang][(i + k * k) % 4] for k in range(8))) for i in range(60) for lang in ("aa", "bb")]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = langid.learn(df.where("doc_id < 80"), public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.lang_pred == rows[r.doc_id][1] for r in model.identify(df).collect())
    for r in model.identify(corpus).collect():
        assert 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "und")
    und = {r.doc_id for r in model.identify(corpus).where("lang_pred = 'und'").collect()}
    assert und == {i for i, t in texts(corpus) if not re.search(r"[^\W\d_]", t or "")}
    assert langid.learn(df.where("false"), public_tokenizers.path("piece_bpe_32k.model")).identify(df).select("lang_pred").distinct().first()[0] == "und"


def test_remainder_is_crc32(spark):
    df = spark.range(50)
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in df.select("id", linear.remainder("id", 5).alias("m")).collect())


def test_empty_tables(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    assert jaccard.similar_components(empty).count() == 0
    assert winnow.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert bpe.encode(empty, BPE).count() == 0
    assert perplexity.quality(empty).count() == 0


def test_digest_of_ids(spark):
    got = bpe.encode(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), BPE).first()
    ids = Tokenizer.from_file(BPE).encode("Hello world", add_special_tokens=False).ids
    assert hashlib.sha256(",".join(map(str, got.ids)).encode()).digest() == hashlib.sha256(",".join(map(str, ids)).encode()).digest()
