"""Spelling variants and SimHash classes against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import hamming, variants
from parley.llm.catalog import misspelt

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def got_variants(words):
    rows = variants.group_variants(words).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in rows}


@pytest.mark.parametrize("slot", [50_000, 7])
def test_variants(spark, monkeypatch, slot):
    monkeypatch.setattr(variants, "SLOT", slot)
    rnd = random.Random(5)
    # few letters, so that words share prefixes and suffixes over many slots; runs of equal letters; two-byte letters
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(300)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "aaaabaaaa", "z", "zebra" * 500, "zebra" * 500 + "s", "ÿ" * 9, "ÿ" * 10}
    counts = {w: rnd.choice([3, 3, 5, 6, 12, 12, 30]) for w in words}
    assert got_variants(spark.createDataFrame(list(counts.items()), "word string, n long")) == plain_variants(counts)


def test_counts_of_edited_words(spark, corpus, empty):
    rnd = random.Random(2)
    names = [("Straße", "straßen", "strasse"), ("Colour", "color", "COLOURS"), ("x" * 9, "X" * 8, "été×÷é")]
    rows = [(i if i % 40 else None, " ".join(rnd.choice(rnd.choice(names)) for _ in range(20)) + rnd.choice(["", "1éa", "\n-"])) for i in range(200)]
    rows += [(1, None), (2, ""), (3, rows[0][1])]
    plain = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            plain[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in plain.items() if n >= 3 and len(w) >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "word": F.lit("w"), "n": F.lit(2)})
    assert {r.word: r.n for r in variants.count_words(docs, edit=misspelt).collect()} == counts
    assert got_variants(variants.count_words(docs, edit=misspelt)) == plain_variants(counts)
    assert got_variants(variants.count_words(corpus)) == plain_variants(dict(variants.count_words(corpus).collect()))
    assert got_variants(variants.count_words(empty)) == {}


def fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, distance):
    """The smallest id reachable from each row."""
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance or (ids[i] is not None and ids[i] == ids[j]):
                root[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(ids))]


def test_simhash_of_texts(corpus, empty):
    rows = corpus.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    expected = Counter(zip((r.doc_id for r in rows), (f"{p:016x}" for p in prints), classes([r.doc_id for r in rows], prints, 4), strict=True))
    assert Counter(map(tuple, hamming.simhash_components(corpus).select("doc_id", "fingerprint", "component_id").collect())) == expected
    assert hamming.simhash_components(empty).collect() == []


def crowd(rnd, n):
    """Fingerprints in chains and clusters around few centres, beside random ones."""
    centres = [rnd.getrandbits(64) for _ in range(5)]
    out = {0, (1 << 64) - 1, 0xF, 0xFF}
    while len(out) < n:
        f = rnd.choice(centres) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 7)):
            f ^= 1 << rnd.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize(("distance", "hot"), [(4, 4096), (4, 3), (3, 4096), (3, 5), (1, 4)])
def test_links_lose_nothing(spark, distance, hot):
    prints = crowd(random.Random(distance * 100 + hot), 400)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    edges = hamming.links(spark.createDataFrame([(f,) for f in signed], "f long").repartition(3), distance, hot).collect()
    at = {f: i for i, f in enumerate(signed)}
    forest = hamming.Forest(len(prints))
    forest.join(np.array([at[e.a] for e in edges], int), np.array([at[e.b] for e in edges], int))
    assert forest.root.tolist() == classes(list(range(len(prints))), prints, distance)


def test_thresholds_and_distances():
    rnd = random.Random(1)
    counts = np.array([rnd.randint(0, 9) for _ in range(16)])
    values = np.repeat(np.arange(16), counts)
    plain = np.bincount([int(a ^ b).bit_count() for a in values for b in values], minlength=5) / len(values) ** 2
    assert np.allclose(hamming.pair_distances(counts), plain)
    # the partition of most candidates is not probed, and the others make up for it
    near = [np.array([1.0, 0, 0, 0, 0]), np.array([1e-6, 1e-6, 1, 0, 0]), np.array([1e-3, 1e-3, 1e-3, 1, 0])]
    chosen = hamming.thresholds(near, [20, 22, 22], 10**9, 4)
    assert sum(chosen) == 2 and chosen[0] == -1
    # bits that go together share a partition
    base = np.array([rnd.getrandbits(32) for _ in range(500)], np.uint64)
    bits = hamming._bits(np.concatenate([base]) | (base << np.uint64(32))).astype(float)
    parts = hamming.correlated_partitions(bits.T @ bits, 500, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and all(len(p) == 16 for p in parts)
    assert all((b + 32) % 64 in p for p in parts for b in p)


def test_wider_partitions_for_more_rows():
    found = [hamming.partition_count(n, 4) for n in (10**4, 10**6, 10**8, 10**10)]
    assert found == sorted(found, reverse=True) and found[-1] < found[0]
