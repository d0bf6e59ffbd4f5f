"""Toxicity by weak supervision.

Voters: lexicons and patterns, each of which fires on a text or not. Lexicons come from
labelled rows: words, beginnings of words and word pairs whose share of toxic rows is
high under a smoothed estimate, dealt into several voters a kind by rank; a fixed list
of insults and two address patterns are voters too. A term needs labels once; the
votes on all texts need none.

Label model: a two-class mixture over the votes, fitted by expectation-maximisation
with the votes' counts in Spark. Each voter has a rate of firing in either class (its
accuracies). Voters that move together within the classes are no independent evidence:
the residual correlations under the posterior give each voter a weight below one.

Classifier: logistic regression on hashed words, beginnings of words and pairs, fitted
to the posterior labels of a bounded sample and scored on whole texts.

Defined cases: null and empty texts fire no voter and score the intercept; without
labelled rows only the fixed voters are left; rows of one id count once for learning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import small
from parley.llm.linear import MAX_ROWS, Linear, fit, sample, tokens, word_features
from parley.session import persist

U = np.uint64
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "trash", "disgusting", "dumb", "filth", "clown")
PAIRS = (("you", "are"), ("shut", "up"))
#: kinds of lexicon (word, four and five letters at a beginning, pair), voters of each kind and terms of each voter
KINDS, VOTERS, TERMS = 4, 6, 200
#: log likelihood ratio over the share of toxic rows that a term needs, so that chance does not name it
EVIDENCE = 10.0
#: share of toxic rows that a term needs
SHARE = 0.7
LEARNING = {"alpha": 1.0, "beta": 1.0, "l1": 4.0, "l2": 0.0, "epochs": 5}


def _terms(block: spans.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the terms of each kind."""
    if not len(block.starts):
        return [(np.zeros(0, np.int64), np.zeros(0, U))] * KINDS
    h, row = block.hashes(), block.row_of_word()
    size = block.ends - block.starts
    out = [(row, h)]
    for k in (4, 5):
        at = np.flatnonzero(size > k)
        out.append((row[at], spans.hash_spans(block.data, block.starts[at], block.starts[at] + k)))
    g = spans.windows(h, 2)
    ok = spans.inside(block.bounds, 2, len(g))
    out.append((row[: len(g)][ok], g[ok]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, rows, toxic) of a task's labelled rows."""
    held = [[] for _ in range(KINDS)]
    for whole in batches:
        for part in spans.blocks(whole):
            y = part.column("y").to_numpy(zero_copy_only=False)
            for box, (row, h) in zip(held, _terms(tokens(part.column("text"))), strict=True):
                r, v = spans.dense(row, h)
                box.append((v, y[r]))
    for kind, parts in enumerate(held):
        if parts:
            values, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            y = np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.astype(np.int64)), pa.array(np.bincount(back, minlength=len(values)).astype(np.int64)), pa.array(np.bincount(back, y, len(values)))], ["kind", "term", "rows", "toxic"])


def lexicons(docs: DataFrame, labelled: DataFrame) -> list[np.ndarray]:
    """Sorted term hashes (52 bits) of each mined voter; ``labelled`` is a bounded sample (id, y)."""
    texts = docs.join(small(labelled), "id").select("y", "text")
    sums = texts.mapInArrow(_counts, "kind int, term long, rows long, toxic double").groupBy("kind", "term").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))
    base = labelled.agg(F.avg("y")).first()[0] or 0.5
    base = min(max(float(base), 0.001), 0.999)
    share = (F.col("toxic") + base) / (F.col("rows") + 1)
    worth = F.col("toxic") * F.log(share / base) + (F.col("rows") - F.col("toxic")) * F.log((1 - share) / (1 - base))
    best = persist(sums.where(share >= SHARE).select("kind", "term", worth.alias("worth")).where(F.col("worth") >= EVIDENCE), "terms")
    out = []
    for kind in range(KINDS):  # at most VOTERS * TERMS terms of a kind leave the cluster
        top = [r.term for r in best.where(F.col("kind") == kind).orderBy(F.desc("worth"), "term").limit(VOTERS * TERMS).collect()]
        out += [np.sort(np.array(top[v::VOTERS], np.int64)).astype(U) for v in range(VOTERS)]
    return out


def _voters(mined: list[np.ndarray]) -> tuple[list[tuple[int, np.ndarray]], int]:
    """(kind, terms) of every voter."""
    one = lambda words: spans.hash_spans(np.frombuffer(b" ".join(words), np.uint8), *_edges(words))
    fixed = np.sort(one([w.encode() for w in INSULTS]) >> U(12))
    pairs = np.sort(np.array([spans.windows(one([a.encode(), b.encode()]), 2)[0] for a, b in PAIRS], U) >> U(12))
    voters = [(i // VOTERS, terms) for i, terms in enumerate(mined)] + [(0, fixed), (3, pairs)]
    return voters, len(voters)


def _edges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    return ends - size, ends


def _votes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, votes): one bit a voter."""
        voters, _ = _voters(shared.value)
        for whole in batches:
            for part in spans.blocks(whole):
                bits = np.zeros(part.num_rows, np.int64)
                kinds = [(row, h >> U(12)) for row, h in _terms(tokens(part.column("text")))]
                for v, (kind, terms) in enumerate(voters):
                    row, h = kinds[kind]
                    fired = np.unique(row[spans.member(h, terms) >= 0])
                    bits[fired] |= np.int64(1 << v)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bits)], ["id", "votes"])

    return run


class LabelModel:
    """Class share, firing rates by class and weights of the voters."""

    def __init__(self, n: int):
        self.n = n
        self.share, self.rates, self.weights = 0.1, np.tile([[0.02], [0.3]], (1, n)), np.ones(n)
        self.silence = np.array([0.9, 0.1])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that does not fire abstains; no vote at all is evidence of its own."""
        fired = ((votes[:, None] >> np.arange(self.n)) & 1).astype(float)
        odds = np.log(self.share / (1 - self.share)) + (fired * self.weights) @ (np.log(self.rates[1]) - np.log(self.rates[0]))
        odds += (votes == 0) * np.log(self.silence[1] / self.silence[0])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _moments(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task: rows and firings by class, and pairs of firings by class."""
        total = np.zeros((2, model.n + 2, model.n + 2))
        for b in batches:
            votes, count = b.column("votes").to_numpy(zero_copy_only=False), b.column("count").to_numpy(zero_copy_only=False)
            x = np.column_stack((np.ones(len(votes)), (votes[:, None] >> np.arange(model.n)) & 1, votes == 0)).astype(float)
            p = model.posterior(votes)
            for c, q in enumerate((1 - p, p)):
                total[c] += (x * (q * count)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel()), pa.array(np.arange(total.size, dtype=np.int32))], ["value", "at"])

    return run


def label_model(votes: DataFrame, rounds: int = 8) -> LabelModel:
    """Fitted to (votes, count) rows. Each round reads all of them and returns one small matrix."""
    n = _voters([np.zeros(0, U)] * (KINDS * VOTERS))[1]
    model = LabelModel(n)
    for _ in range(rounds):
        sums = votes.mapInArrow(_moments(model), "value double, at int").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
        m = np.array([r.value for r in sums]).reshape(2, n + 2, n + 2) if sums else np.zeros((2, n + 2, n + 2))
        rows, silent = m[:, 0, 0], m[:, 0, -1]
        m = m[:, :-1, :-1]
        if not rows.sum():
            break
        model.share = float(np.clip((rows[1] + 1) / (rows.sum() + 10), 1e-4, 0.5))
        model.silence = np.clip((silent + 0.5) / (rows + 1), 1e-4, 1 - 1e-4)
        # a voter is no evidence against the class it was made for
        model.rates = np.clip((m[:, 0, 1:] + np.array([[0.01], [0.3]])) / (rows[:, None] + 1), 1e-5, 1 - 1e-5)
        model.rates[1] = np.maximum(model.rates[1], model.rates[0])
        mean = m[:, 0, 1:] / np.maximum(rows[:, None], 1e-9)
        cov = sum(m[c, 1:, 1:] - rows[c] * np.outer(mean[c], mean[c]) for c in (0, 1)) / rows.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        correlation = np.clip(np.abs(cov / np.outer(sd, sd)), 0, 1) * (np.diag(cov) > 1e-9)[:, None] * (np.diag(cov) > 1e-9)
        np.fill_diagonal(correlation, 0)
        model.weights = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))
    return model


def _posteriors(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.posterior(b.column("votes").to_numpy(zero_copy_only=False)))], ["id", "y"])

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Linear:
    """The classifier; ``labels`` are the rows that may be learnt from, of which a bounded sample is."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = persist(sample(labels.withColumn("y", F.col(label_col)), max_rows, id_col), "sample")
    shared = spark.sparkContext.broadcast(lexicons(docs, known))  # at most KINDS * VOTERS * TERMS numbers
    votes = persist(docs.mapInArrow(_votes(shared), "id long, votes long"), "votes")
    model = label_model(persist(votes.groupBy("votes").count(), "patterns"))
    # the posterior, not a label, teaches the classifier
    chosen = persist(sample(votes.mapInArrow(_posteriors(model), "id long, y double"), max_rows, "id"), "posteriors")
    return fit(docs, chosen, word_features, counted=False, id_col="id", **LEARNING)
