"""Hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Words are runs of letters and digits, or of other signs, in lower case; features are
word n-grams, word shapes with their pairs, and a mark where a word repeats the one
before it, hashed into a fixed number of places. Rows to learn from are a bounded
sample: the ``max_rows`` labelled rows of least id hash. Their features are made in
parallel; updates run row by row in one task over packed features. Scores are sparse
dot products over whole texts.

Defined cases: a text without words scores the intercept; null labels and null ids are
not learnt from; an id counts once, however many rows it has; a sample without rows gives
weights of zero and scores of a half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import small

U = np.uint64
BITS = 20
#: labelled rows that a model learns from, at most
MAX_ROWS = 8000
# class of each byte: 0 blank, 1 letter or digit, 2 other sign
_KIND = np.full(256, 2, np.uint8)
_KIND[spans.BLANKS] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")


def tokens(column: pa.Array) -> spans.Block:
    """A block whose words are runs of one class of sign, in lower case."""
    block = spans.Block(column)
    kind = _KIND[block.data]
    size = len(kind)
    change = np.ones(size + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[block.offsets] = True
    at = np.flatnonzero(change)
    filled = kind[at[:-1]] > 0 if size else np.zeros(0, bool)
    block.starts, block.ends = at[:-1][filled], at[1:][filled]
    block.bounds = np.searchsorted(block.starts, block.offsets)
    block.n_words = np.diff(block.bounds)
    block.shape = _SHAPE[block.data]
    block.data = spans._LOWER[block.data]
    return block


def _grams(block: spans.Block, h: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    g = spans.windows(h, n)
    ok = spans.inside(block.bounds, n, len(g))
    return block.row_of_word()[: len(g)][ok], spans.mix(g[ok] + U(salt))


def style_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature for quality, repeats included."""
    block = tokens(column)
    if not len(block.starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = block.hashes()
    s = spans.hash_spans(block.shape, block.starts, np.minimum(block.ends, block.starts + 12))
    found = [_grams(block, h, 1, 1), _grams(block, h, 2, 2), _grams(block, h, 3, 3), _grams(block, s, 1, 4), _grams(block, s, 2, 5)]
    for back in (1, 2):
        row = block.row_of_word()
        again = np.flatnonzero((h[back:] == h[:-back]) & (row[back:] == row[:-back]))
        found.append((row[again], np.full(len(again), 77 + back, U) * U(0x9E3779B97F4A7C15)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature for words that give a text away: words, beginnings of words, pairs."""
    block = tokens(column)
    if not len(block.starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h, row = block.hashes(), block.row_of_word()
    found = [(row, spans.mix(h + U(11))), _grams(block, h, 2, 12)]
    size = block.ends - block.starts
    for k in (4, 5):
        at = np.flatnonzero(size > k)
        found.append((row[at], spans.mix(spans.hash_spans(block.data, block.starts[at], block.starts[at] + k) + U(12 + k))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def vectors(features: Callable, column: pa.Array, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the rows, places and values: L2-normed counts, or 1 for presence."""
    row, h = features(column)
    key = (row.astype(U) << U(BITS)) | (h >> U(64 - BITS))
    if counted:
        key, n = np.unique(key, return_counts=True)
    else:
        key = np.sort(key)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        n = np.ones(len(key))
    row, place = (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)
    value = n.astype(np.float32)
    if counted:
        norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(column)))
        value = (value / norm[row]).astype(np.float32)
    return np.searchsorted(row, np.arange(len(column) + 1)), place, value


def _packed(features: Callable, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in spans.blocks(whole):
                bounds, place, value = vectors(features, part.column("text"), counted)
                body = [spans.pack(place[a:b].astype(np.uint32), value[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(body, pa.binary())], ["id", "y", "body"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes; the intercept is not regularised."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = [0.0, 0.0]
    # learning starts from the share of label 1
    share = min(max(sum(r[2] for r in rows) / max(1, len(rows)), 0.001), 0.999)
    start = float(np.log(share / (1 - share)))
    for epoch in range(epochs):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            place, value, y = rows[i]
            place, value = place.astype(np.int64), value.astype(np.float64)
            zi, ni = z[place], n[place]
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            b = -bias[0] / ((beta + np.sqrt(bias[1])) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + b + start, -35, 35)))
            g = (p - y) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[place] += g - step * w
            n[place] += g * g
            gb = p - y
            bias[0] += gb - (np.sqrt(bias[1] + gb * gb) - np.sqrt(bias[1])) / alpha * b
            bias[1] += gb * gb
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w.astype(np.float32), start + float(-bias[0] / ((beta + np.sqrt(bias[1])) / alpha))


def _learn(settings: dict):
    @spans.giving_back
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the order of arrival does not count
        # places and values as they came, 8 bytes each pair; a row is widened when it is its turn
        rows = [(*spans.unpack(body.as_py()), y) for body, y in zip(table.column("body"), table.column("y").to_pylist(), strict=True)]
        w, b = ftrl(rows, **settings)
        at = np.flatnonzero(w)
        return pa.table({"body": pa.array([spans.pack(at.astype(np.uint32), w[at], np.array([b]))], pa.binary())})

    return run


class Linear:
    """A fitted model: its features, weights and intercept."""

    def __init__(self, features: Callable, counted: bool, weights: np.ndarray, bias: float):
        self.features, self.counted, self.weights, self.bias = features, counted, weights, bias

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each row's id (``doc_id``) and ``score``, the probability of label 1."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))  # 2 ** BITS numbers
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return texts.mapInArrow(_scores(self.features, self.counted, shared), "doc_id long, score double")

    def below(self, docs: DataFrame, limit: float, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` whose score is below ``limit``, as they are."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))
        return docs.mapInArrow(_below(self.features, self.counted, shared, limit, text_col), docs.schema)


def _below(features: Callable, counted: bool, shared, limit: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for part in spans.blocks(whole, text_col):
                bounds, place, value = vectors(features, part.column(text_col), counted)
                yield part.filter(pa.array(_sigmoid(bounds, weights[place] * value.astype(np.float64), bias) < limit))

    return run


def _sigmoid(bounds: np.ndarray, terms: np.ndarray, bias: float) -> np.ndarray:
    dot = np.diff(np.concatenate(([0.0], np.cumsum(terms)))[bounds])
    return 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))


def _scores(features: Callable, counted: bool, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for part in spans.blocks(whole):
                bounds, place, value = vectors(features, part.column("text"), counted)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_sigmoid(bounds, weights[place] * value.astype(np.float64), bias))], ["doc_id", "score"])

    return run


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def sample(labels: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the ``max_rows`` ids of least hash; ``labels`` has the id and y. Where labels of an id differ, y is their mean."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col("y").isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)


def fit(docs: DataFrame, labelled: DataFrame, features: Callable, counted: bool, id_col: str = "doc_id", text_col: str = "text", **settings) -> Linear:
    """Learn from ``labelled`` (id, y), a bounded sample; y may be a probability.

    Of rows that share an id, the one of the least text hash is learnt from.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).alias("row"))
    once = texts.join(small(labelled), "id").groupBy("id", "y").agg(F.min("row").alias("row"))
    rows = once.select("id", "y", "row.text").mapInArrow(_packed(features, counted), "id long, y double, body binary")
    settings = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": 0.5, "l2": 0.5} | settings
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_learn(settings), "body binary").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    if found:
        at, w, b = spans.unpack(bytes(found[0].body))
        weights[at], bias = w, float(b[0])
    return Linear(features, counted, weights, bias)
