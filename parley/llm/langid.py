"""Language identification with unigram pieces, all segmentations of a word summed.

The vocabulary is public and fixed: all its pieces, of any length, and every single byte; a
piece is known by a 64-bit hash of its bytes. Each language has a probability per piece,
learnt by expectation-maximisation from the word counts of a bounded sample of labelled
texts. A forward pass sums the probability of all segmentations of a word, scaled at each
byte so that long words do not underflow; a text's score is the sum of its words' logs and
the language's log share, and the posterior of the best language is the result's score.

Words are runs of letters, digits and non-ASCII signs, A-Z lowered, with a space before
them, whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null
language is not learnt from; of rows that share an id one is learnt from, that of the least
text hash; with no labelled text at all everything is ``und``; ties go to the first
language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import small
from parley.llm.linear import tokens
from parley.session import persist

U = np.uint64
#: labelled rows learnt from at most, and words whose scores a worker keeps
MAX_ROWS, KEPT = 20_000, 400_000
#: bytes of words laid out at once
CELLS = 1 << 19
_STEP = 0xA0761D6478BD642F | 1
_BACK = pow(_STEP, -1, 1 << 64)
LETTER = regex.compile(r"\p{L}")


def pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file, without its marks, and all single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted((own - {b""}) | {bytes([b]) for b in range(1, 256)})


class Vocabulary:
    """Pieces by the sorted hashes of their bytes: ``hashes``, their ``sizes`` in bytes, and the ``longest``."""

    def __init__(self, known: list[bytes]):
        h = np.array([_prefixes(np.frombuffer(p, np.uint8)[None, :])[0, -1] for p in known], U)
        h = spans.mix(h)
        order = np.argsort(h)
        self.hashes, self.sizes = h[order], np.array([len(p) for p in known])[order]
        self.longest = int(self.sizes.max())
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")

    def __len__(self) -> int:
        return len(self.hashes)


def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(pieces(path))


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hash sums of the first 0, 1, .. bytes of each row."""
    n = words.shape[1]
    powers = np.full(n, U(_STEP))
    powers[:1] = 1
    out = np.zeros((len(words), n + 1), U)
    np.cumsum(spans._BYTES[words] * np.multiply.accumulate(powers), axis=1, out=out[:, 1:])
    return out


def _words(column: pa.Array) -> spans.Block:
    block = tokens(column)
    keep = np.isin(block.data[block.starts], np.r_[48:58, 97:123, 128:256]) if len(block.starts) else np.zeros(0, bool)
    row = block.row_of_word()[keep]
    block.starts, block.ends = block.starts[keep], block.ends[keep]
    block.bounds = np.searchsorted(row, np.arange(block.rows + 1))
    block.n_words = np.diff(block.bounds)
    return block


class Lattice:
    """Which pieces stand where in the rows of a byte matrix."""

    def __init__(self, words: np.ndarray, known: Vocabulary):
        rows, self.n = words.shape
        self.none = len(known)
        sums = _prefixes(words)
        back = np.full(self.n, U(_BACK))
        back[:1] = 1
        back = np.multiply.accumulate(back)
        #: by size: the piece that begins at each byte, ``none`` where there is none
        self.ids: dict[int, np.ndarray] = {}
        #: sizes of the pieces that begin, and that end, at a byte in some row
        self.begin: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.end: list[list[int]] = [[] for _ in range(self.n + 1)]
        for size in range(1, min(known.longest, self.n) + 1):
            key = spans.mix((sums[:, size:] - sums[:, :-size]) * back[: self.n - size + 1])
            at = spans.member(key.ravel(), known.hashes).reshape(key.shape)
            # a hash of another size is no match
            found = (at >= 0) & (known.sizes[at] == size)
            if found.any():
                self.ids[size] = np.where(found, at, self.none).astype(np.int32)
                for i in np.flatnonzero(found.any(axis=0)).tolist():
                    self.begin[i].append(size)
                    self.end[i + size].append(size)


def _forward(lattice: Lattice, probability: np.ndarray, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled sums over the segmentations of the first j bytes, and the logs of their scales (bytes + 1, rows).

    ``probability`` gives (rows, k) of piece numbers: a column for each language.
    """
    start = probability(np.full(rows, lattice.none))
    alpha, scale = [np.ones_like(start)], np.zeros((lattice.n + 1, rows))
    for j in range(1, lattice.n + 1):
        total = np.zeros_like(start)
        for size in lattice.end[j]:
            # scales fall along a word, so the factor is one at least
            total += alpha[j - size] * probability(lattice.ids[size][:, j - size]) * np.exp(scale[j - size] - scale[j - 1])[:, None]
        most = np.maximum(total.max(axis=1), 1e-300)
        alpha.append(total / most[:, None])
        scale[j] = scale[j - 1] + np.log(most)
    return alpha, scale


def _word_logs(words: np.ndarray, known: Vocabulary, probability: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each row, by language."""
    alpha, scale = _forward(Lattice(words, known), lambda ids: probability[ids], len(words))
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]


def _matrices(block: spans.Block, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chosen words by length: (their places in ``which``, bytes with the space before)."""
    size = block.ends[which] - block.starts[which]
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        step = max(1, CELLS // int(n + 1))
        for low in range(0, len(same), step):
            at = same[low : low + step]
            raw = block.data[block.starts[which[at]][:, None] + np.arange(n)]
            yield at, np.concatenate((np.full((len(at), 1), 32, np.uint8), raw), axis=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each block."""
    for whole in batches:
        for part in spans.blocks(whole):
            block = _words(part.column("text"))
            h, langs = block.hashes(), part.column("lang").dictionary_encode()
            owner = langs.indices.to_numpy(zero_copy_only=False)[block.row_of_word()]
            for lang in np.unique(owner):
                mine = np.flatnonzero(owner == lang)
                _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                words = [block.text(i) for i in mine[first]]
                yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(lang)].as_py()] * len(words)), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def _expected(known: Vocabulary, probability: np.ndarray, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, piece, n): expected uses of each piece in the task's words."""
        total = np.zeros((len(known) + 1, len(langs)))
        number = {x: i for i, x in enumerate(langs)}
        for b in batches:
            words = b.column("word")
            block = spans.Block(pa.array([], pa.string()))
            offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
            block.data = np.frombuffer(words.buffers()[2], np.uint8)
            block.starts, block.ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])
            count = b.column("n").to_numpy().astype(float)
            for at, matrix in _matrices(block, np.arange(len(words))):
                lattice, own = Lattice(matrix, known), lang[at]
                alpha, before = _forward(lattice, lambda ids, own=own: probability[ids, own][:, None], len(at))
                n = lattice.n
                beta, after = [None] * n + [np.ones(len(at))], np.zeros((n + 1, len(at)))
                for i in range(n - 1, -1, -1):
                    back = np.zeros(len(at))
                    for size in lattice.begin[i]:
                        piece = lattice.ids[size][:, i]
                        use = probability[piece, own] * beta[i + size] * np.exp(after[i + size] - after[i + 1])
                        back += use
                        # whatever the scales, the share of the word's segmentations that use the piece here
                        share = alpha[i][:, 0] * probability[piece, own] * beta[i + size] * np.exp(np.minimum(before[i] + after[i + size] - before[n], 700.0))
                        np.add.at(total, (piece, own), share * count[at])
                    most = np.maximum(back, 1e-300)
                    beta[i], after[i] = back / most, after[i + 1] + np.log(most)
        for i, lang in enumerate(langs):
            some = np.flatnonzero(total[:-1, i] > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some, i])], ["lang", "piece", "n"])

    return run


class Identifier:
    """Piece probabilities by language and the languages' shares."""

    def __init__(self, table: Vocabulary, langs: list[str], probability: np.ndarray, share: np.ndarray):
        self.table, self.langs, self.probability, self.share = table, langs, probability, share

    def identify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each row's id (``doc_id``), ``lang_pred`` and ``score``."""
        shared = docs.sparkSession.sparkContext.broadcast(self)  # vocabulary x languages
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return texts.mapInArrow(_identify(shared), "doc_id long, lang_pred string, score double")


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        known, logs = np.zeros(0, U), np.zeros((0, len(model.langs)), np.float32)
        for whole in batches:
            for part in spans.blocks(whole):
                letters = np.array([x is not None and LETTER.search(x) is not None for x in part.column("text").to_pylist()], bool) & bool(model.langs)
                best, score = np.full(part.num_rows, len(model.langs)), np.zeros(part.num_rows)
                if letters.any():
                    block = _words(part.column("text"))
                    values, first, back = np.unique(block.hashes(), return_index=True, return_inverse=True)
                    at = spans.member(values, known)
                    new = np.flatnonzero(at < 0)
                    found = np.zeros((len(new), len(model.langs)), np.float32)
                    for place, matrix in _matrices(block, first[new]):
                        found[place] = _word_logs(matrix, model.table, model.probability)
                    word = np.empty((len(values), len(model.langs)), np.float32)
                    word[at >= 0], word[new] = logs[at[at >= 0]], found
                    if len(known) + len(new) > KEPT:
                        known, logs = values, word
                    else:
                        order = np.argsort(np.concatenate((known, values[new])))
                        known, logs = np.concatenate((known, values[new]))[order], np.concatenate((logs, found))[order]
                    total = np.concatenate((np.zeros((1, word.shape[1])), np.cumsum(word[back], axis=0, dtype=np.float64)))
                    odds = np.diff(total[block.bounds], axis=0) + np.log(model.share)
                    odds -= odds.max(axis=1, keepdims=True)
                    posterior = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
                    best = np.where(letters, posterior.argmax(axis=1), best)
                    score = np.where(letters, posterior.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "lang_pred", "score"])

    return run


def learn(docs: DataFrame, path: str, rounds: int = 3, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Fit to the ``max_rows`` labelled ids of least hash among ``docs``, one row of each."""
    table = vocabulary(path)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = persist(rows.select(F.col(id_col).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows), "sample")
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).alias("row"))
    texts = texts.join(small(chosen), "id").groupBy("id").agg(F.min("row").alias("row")).select("row.lang", "row.text")
    counts = texts.mapInArrow(_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = persist(counts, "words")
    shares = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").cast("double").alias("n")).collect()}  # languages only
    langs = sorted(shares)
    start = np.append(0.02 ** np.minimum(table.sizes, 3), 0.0)  # bytes are likelier than long pieces only while nothing is known
    probability = np.repeat((start / start.sum())[:, None], max(1, len(langs)), axis=1)
    for _ in range(rounds if langs else 0):
        sums = counts.mapInArrow(_expected(table, probability, langs), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages
        n = np.zeros((len(table) + 1, len(langs)))
        n[sums.piece.to_numpy(int), sums.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = sums.n.to_numpy()
        n[:-1] += 0.01
        probability = n / n.sum(axis=0)
    share = np.array([shares[x] for x in langs]) if langs else np.ones(1)
    return Identifier(table, langs, probability, share / share.sum())
