"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import catalog, whitening


def integers(vector):
    return [math.floor(64 * np.float64(c)) + 1_000_000 for c in vector]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({n: F.lit("x") for n in ("id", "vector", "n", "i", "total")}).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(120, 6)).astype(np.float32)
    base[:, 3] = base[:, 0] * 2 + base[:, 3] / 8
    out = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    # repeats, an id on two rows, a null id, and what is dropped
    out += [out[5], (7, out[9][1]), (None, out[3][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    return out


def test_against_fractions(spark, rows):
    kept = [(i, integers(v)) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), 6
    sums = [sum(x[j] for _, x in kept) for j in range(dims)]
    cov = [[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept), n**3)) for b in range(dims)] for a in range(dims)]
    vectors = whitening.usable(table(spark, rows))
    model = whitening.fit(vectors, components=4)
    assert (model.n, model.sums, len(model.eigenvalues)) == (n, sums, 4)
    values, found = np.linalg.eigh(np.array(cov))
    assert np.allclose(model.eigenvalues, values[::-1][:4], rtol=1e-12)
    assert np.allclose(model.explained, values[::-1][:4] / np.trace(np.array(cov)), rtol=1e-12)
    got = model.apply(vectors).collect()
    expected = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        white = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ found[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
        expected.setdefault((i, deviation), []).append(np.abs(white))
    assert sorted(((r.id is None, r.id, int(r.deviation)) for r in got), key=str) == sorted(((i is None, i, d) for (i, d), k in expected.items() for _ in k), key=str)
    for r in got:
        assert np.allclose(np.abs(r.whitened), expected[r.id, int(r.deviation)][0], atol=1e-9)
    white = np.array([r.whitened for r in got])
    measured = np.abs(np.cov(white.T, bias=True) - np.eye(4)).max()
    error = model.identity_error(vectors)
    assert error < 1e-9 and measured < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v), float(w)]) for i, (v, w) in enumerate([(3e9, -1.5), (-7e9, 2.25), (1e10, 0.5), (2.0, 8.0)])]
    x = [integers(v) for _, v in rows]
    sums = [sum(v) for v in zip(*x, strict=True)]
    vectors = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(vectors)
    assert model.sums == sums
    exact = {i: sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.id: int(r.deviation) for r in model.apply(vectors).collect()} == exact
    assert model.trace == float(Fraction(sum(exact.values()), 64))


def test_empty_and_equal_vectors(spark, rows):
    none = whitening.usable(table(spark, rows).where("false"))
    model = whitening.fit(none)
    assert model.n == 0 and model.apply(none).collect() == [] and model.identity_error(none) == 0.0
    same = whitening.usable(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    model = whitening.fit(same)
    assert [(r.id, int(r.deviation), r.whitened) for r in model.apply(same).orderBy("id").collect()] == [(1, 0, []), (2, 0, [])]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = catalog.QUERIES["op13_embedding_whitening"](spark, folder)
    assert [f.simpleString() for f in found.schema] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double"]
    vectors = [v for v in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if v.embedding is not None and all(c is not None and math.isfinite(c) for c in v.embedding)]
    x = np.array([integers(v.embedding) for v in vectors], float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    rows = found.collect()
    assert len(rows) == 32 * len(vectors) and {r.n for r in rows} == {len(vectors)} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error <= 1e-4
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-6 * r.explained for r in rows)
