"""Quality rules with character n-gram perplexity under a modified Kneser-Ney model.

Counting: tasks count the 5-grams of code points per language (four start marks before
each text) and Spark sums them. Lower orders count distinct left neighbours, from the
order above. The discounts of each order and language come from its counts of counts.
Characters are 12-bit symbols: code points below ``SINGLE`` are one symbol, others two (a lead
and a trail, as in UTF-16), so no two texts are equal to the model; the start mark is a symbol
of its own. An n-gram is one 60-bit number and suffixes and contexts are shifts. Perplexity is
per code point.

The model is stored in the shared folder as files of sorted 64-bit hashes (of order,
language and n-gram) with the interpolated log probability and the log weight left for
lower orders. Scoring gathers the distinct n-grams of ``SWEEP`` bytes of text, makes their
hashes of all orders at once, sorts them and passes over the files once, so a task holds one
file at a time and not the model, and reads each file once per sweep.

Held-out scores: texts are halved by their hash, copies together, each half has a model of
its own per language, and a text is scored by the model of the other half, so that it does
not vouch for itself. All rows are counted and all are scored.

Perplexity bands: per language, quartiles of the log perplexity of the distinct texts that
pass the base rules, widened by ``reach`` times their distance, ``LEAST_WIDTH`` at least,
on either side.

Defined cases: null text is empty and fails the base rules; a null language is one
language of its own; perplexity of a text without characters is null and such a text is
not kept; equal texts get equal scores.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import small
from parley.session import persist, shared_folder

ORDER, CODE = 5, 12
CODES = 1 << CODE
#: code points of one symbol, first symbols of leads and of trails of 1,024, and the start mark
SINGLE, LEAD, TRAIL, START = 1920, 1920, 3008, 4095
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: model entries of one file, files that a worker keeps, n-grams that a task keeps while counting, bytes of a block and of a sweep
FILE_ROWS, FILES, HELD, BLOCK, SWEEP = 500_000, 2, 1_000_000, 2 << 20, 6 << 20
#: distance of the quartiles, in log perplexity, that a band is widened by at least
LEAST_WIDTH = 0.01
U = np.uint64
FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")]
    + [("log_perplexity", pa.float64())]
)
FEATURES_SQL = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, log_perplexity double"


def _codes(block: spans.Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each behind four start marks, and where each text with its marks begins (rows + 1)."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))[block.offsets]
    symbols = points.astype(np.uint16)
    wide = np.flatnonzero(points >= SINGLE)
    if len(wide):
        symbols[wide] = LEAD + (points[wide] >> 10)
        symbols = np.insert(symbols, wide + 1, TRAIL + (points[wide] & 1023))
        ends = ends + np.searchsorted(wide, ends)
    edges = ends + (ORDER - 1) * np.arange(block.rows + 1)
    codes = np.full(edges[-1], START, np.uint16)
    own = np.ones(edges[-1], bool)
    own[(edges[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    codes[own] = symbols
    return codes, edges


def _grams(codes: np.ndarray) -> np.ndarray:
    key = codes[: len(codes) - ORDER + 1].astype(U)
    for i in range(1, ORDER):
        key = (key << U(CODE)) | codes[i : len(codes) - ORDER + 1 + i]
    return key


def _places(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the 5-gram of each character begins in the flat codes, and the row bounds among these."""
    chars = np.diff(edges) - (ORDER - 1)
    bounds = np.concatenate(([0], np.cumsum(chars)))
    return np.arange(bounds[-1]) + np.repeat(edges[:-1] - bounds[:-1], chars), bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task."""
    kept: dict[str | None, list] = {}
    held = 0
    for whole in batches:
        for part in spans.blocks(whole, limit=BLOCK):
            langs = part.column("lang").dictionary_encode()
            codes, edges = _codes(spans.Block(part.column("text")))
            if not len(codes) > ORDER:
                continue
            key = _grams(codes)
            at, bounds = _places(edges)
            which = np.repeat(langs.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.diff(bounds))
            key = key[at]
            for lang in np.unique(which):
                values, n = np.unique(key[which == lang], return_counts=True)
                kept.setdefault(None if lang < 0 else langs.dictionary[int(lang)].as_py(), []).append((values, n))
                held += len(values)
        if held > HELD:
            yield from _counted(kept)
            kept, held = {}, 0
            spans.give_back()
    yield from _counted(kept)
    kept.clear()
    spans.give_back()


def _counted(kept: dict) -> Iterator[pa.RecordBatch]:
    for lang, parts in kept.items():
        values, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        for low in range(0, len(values), 500_000):
            v = values[low : low + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(v.view(np.int64)), pa.array(n[low : low + 500_000])], ["lang", "gram", "n"])


def train(docs: DataFrame) -> str:
    """Count, estimate and store the model; returns its folder. ``docs`` has text and lang."""
    counts = {ORDER: persist(docs.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (CODE * k)) - 1))
        counts[k] = persist(counts[k + 1].groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    lower = None
    parts = []
    for k in range(1, ORDER + 1):
        c = counts[k]
        n1, n2, n3, n4 = (F.sum((F.col("n") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4))
        seen = c.groupBy("lang").agg(n1, n2, n3, n4)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))

        def discount(i: int, y=y):
            # counts of counts of small inputs can put it out of range
            raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))
            return F.least(F.greatest(raw, F.lit(0.1)), F.lit(i - 0.1))

        seen = seen.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
        same = lambda x, y: x["lang"].eqNullSafe(y["lang"])
        c = c.join(F.broadcast(seen), same(c, seen)).drop(seen["lang"])  # one row a language
        c = c.select("lang", "gram", "n", F.shiftright("gram", CODE).alias("context"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        total = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left")).select("lang", "context", "total", (F.col("left") / F.col("total")).alias("weight"))
        total = persist(total, f"contexts{k}")
        joined = c.alias("c").join(total.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")) & (F.col("c.context") == F.col("t.context")))
        base = joined.select("c.lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), "weight")
        if lower is None:
            p = base.select("lang", "gram", (F.col("own") + F.col("weight") / CODES).alias("p"))
        else:
            tail = F.col("gram").bitwiseAND(F.lit((1 << (CODE * (k - 1))) - 1))
            base = base.withColumn("tail", tail)
            p = base.alias("b").join(lower.alias("l"), F.col("b.lang").eqNullSafe(F.col("l.lang")) & (F.col("tail") == F.col("l.gram")))
            p = p.select("b.lang", "b.gram", (F.col("own") + F.col("weight") * F.col("p")).alias("p"))
        lower = persist(p, f"order{k}")
        parts.append(lower.select(F.lit(k).alias("k"), "lang", "gram", F.log("p").alias("value"), F.lit(0).alias("kind")))
        parts.append(total.select(F.lit(k - 1).alias("k"), "lang", F.col("context").alias("gram"), F.log("weight").alias("value"), F.lit(1).alias("kind")))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionAll(part)
    entries = persist(entries.mapInArrow(_hashed, "h long, value float"), "entries")
    # an even number of equal ranges of the hash space, as unsigned numbers: none holds both signs
    files = 2 * max(1, -(-entries.count() // (2 * FILE_ROWS)))
    shard = F.floor((F.shiftright("h", 40).bitwiseAND(F.lit((1 << 24) - 1))) * files / F.lit(1 << 24)).cast("int")
    folder = shared_folder(docs.sparkSession, "model")
    entries.withColumn("shard", shard).repartition(files, "shard").sortWithinPartitions("shard", "h").write.partitionBy("shard").parquet(folder)
    return f"{folder}|{files}"


def _salted(lang: str | None, order: np.ndarray | int, gram: np.ndarray, kind: int) -> np.ndarray:
    name = np.frombuffer(("n" if lang is None else "l" + lang).encode(), np.uint8)
    salt = spans.hash_spans(name, np.array([0]), np.array([len(name)]))[0]
    return spans.mix(gram.astype(U) * U(16) + U(kind) + U(2) * np.asarray(order).astype(U) ^ salt)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        which = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order, gram, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "gram", "kind"))
        h = np.zeros(b.num_rows, U)
        for lang in np.unique(which):
            for k in (0, 1):
                m = (which == lang) & (kind == k)
                h[m] = _salted(None if lang < 0 else langs.dictionary[int(lang)].as_py(), order[m], gram[m].view(U), k)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("value").cast(pa.float32())], ["h", "value"])


class Model:
    """Sorted hash arrays in files; looks up hashes file by file and keeps at most ``FILES`` of them."""

    def __init__(self, where: str):
        self.folder, files = where.rsplit("|", 1)
        self.files = int(files)
        self.kept: dict[int, tuple] = {}
        if "://" in self.folder or self.folder.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(self.folder)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), self.folder

    def _file(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.kept:
            infos = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/shard={i}", allow_not_found=True))
            tables = [pq.read_table(io.BytesIO(self.fs.open_input_file(x.path).read()), columns=["h", "value"]) for x in infos if x.path.endswith(".parquet")]
            h = np.concatenate([t.column("h").to_numpy() for t in tables] or [np.zeros(0, np.int64)]).view(U)
            value = np.concatenate([t.column("value").to_numpy() for t in tables] or [np.zeros(0, np.float32)])
            if np.any(h[1:] < h[:-1]):  # of several parts
                order = np.argsort(h)
                h, value = h[order], value[order]
            if len(self.kept) >= FILES:
                self.kept.pop(next(iter(self.kept)))
            self.kept[i] = (h, value)
        return self.kept[i]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, NaN where there is none; one pass over the files."""
        order = np.argsort(h)
        want, found = h[order], np.full(len(h), np.nan, np.float32)
        # the range of each file, by the top bits as they were written
        shard = ((want >> U(40)) * U(self.files)) >> U(24)
        cuts = np.searchsorted(shard, np.arange(self.files + 1))
        for i in range(self.files):
            low, high = cuts[i], cuts[i + 1]
            if low == high:
                continue
            table, value = self._file(i)
            at = spans.member(want[low:high], table)
            if len(table):
                found[low:high] = np.where(at >= 0, value[at], np.nan)
        out = np.empty_like(found)
        out[order] = found
        return out

    def scores(self, asked: dict[str | None, np.ndarray]) -> dict[str | None, np.ndarray]:
        """Log probability of the last symbol of each of the sorted 5-grams, by language."""
        steps, keys = [], []
        for lang, grams in asked.items():
            known = grams
            for k in range(ORDER, 0, -1):
                # those of order k, and where each of order k + 1 finds its own
                mine, back = (known, np.arange(len(known))) if k == ORDER else np.unique(known & U((1 << (CODE * k)) - 1), return_inverse=True)
                context, of = np.unique(mine >> U(CODE), return_inverse=True)
                keys += [_salted(lang, k, mine, 0), _salted(lang, k - 1, context, 1)]
                steps.append((lang, back.astype(np.int32), of.astype(np.int32)))
                known = mine
        values = np.split(self.find(np.concatenate(keys)), np.cumsum([len(x) for x in keys])[:-1]) if keys else []
        out: dict[str | None, np.ndarray] = {}
        for at in range(len(steps) - 1, -1, -1):  # from single symbols up
            lang, back, of = steps[at]
            own, left = values[2 * at].astype(float), values[2 * at + 1].astype(float)
            lower = out.get(lang, -np.log(CODES))
            out[lang] = np.where(np.isnan(own), np.nan_to_num(left, nan=0.0)[of] + lower, own)[back]
        return out


def _base(part: pa.RecordBatch, block: spans.Block) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows, data, edges = block.rows, block.data, block.offsets
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])
    h, row = block.hashes(), block.row_of_word()
    repeats = np.zeros(rows, np.int64)
    g = spans.windows(h, 5)
    ok = np.flatnonzero(spans.inside(block.bounds, 5, len(g)))
    if len(ok):
        key = (row[ok].astype(U) << U(52)) | (g[ok] >> U(12))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        hit = ok[spans.member(key, twice) >= 0]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + 5, -1)
        repeats = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=rows)
    lines = spans.Block(part.column("text"))
    lines.words(spans.separators((0x0A, 0x0A)))
    filled = np.searchsorted(block.starts, lines.ends) > np.searchsorted(block.starts, lines.starts)
    owner = lines.row_of_word()[filled]
    distinct, _ = spans.dense(owner, lines.hashes()[filled])
    dup = np.bincount(owner, minlength=rows) - np.bincount(distinct, minlength=rows)
    return [block.n_words, sums(~spans.BLANKS[data] & ((data & 0xC0) != 0x80)), sums(SYMBOLS[data]), dup, repeats]


def _score(where: str, block: int, sweep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = Model(where), [], 0
        for whole in batches:
            for part in spans.blocks(whole, limit=block):
                held.append(part)
                size += part.column("text").nbytes
                if size >= sweep:
                    yield from _scored(model, held)
                    held, size = [], 0
        yield from _scored(model, held)

    return run


def _scored(model: Model, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and log perplexity of the rows of some blocks, by one pass over the model."""
    asked: dict[str | None, list] = {}
    notes = []
    for part in parts:
        codes, edges = _codes(spans.Block(part.column("text")))
        at, bounds = _places(edges)
        gram = _grams(codes)[at] if len(at) else np.zeros(0, U)
        langs = part.column("judge").dictionary_encode()
        of_row = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        which = np.repeat(of_row, np.diff(bounds))
        mine = []
        for code in np.unique(which):
            lang = None if code < 0 else langs.dictionary[int(code)].as_py()
            values, back = np.unique(gram[which == code], return_inverse=True)
            asked.setdefault(lang, []).append(values)
            mine.append((lang, np.flatnonzero(of_row == code), values, back.astype(np.int32)))
        notes.append((np.diff(bounds), mine))
    distinct = {lang: np.unique(np.concatenate(x)) for lang, x in asked.items()}
    asked.clear()
    logs = model.scores(distinct)
    for part, (symbols, mine) in zip(parts, notes, strict=True):
        block = spans.Block(part.column("text"))
        block.words()
        total = np.zeros(block.rows)
        for lang, rows, values, back in mine:
            each = logs[lang][np.searchsorted(distinct[lang], values)][back]
            ends = np.cumsum(symbols[rows])
            total[rows] = np.diff(np.concatenate(([0.0], np.cumsum(each)))[np.concatenate(([0], ends))])
        mine.clear()
        chars = np.diff(np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))[block.offsets])
        log_perplexity = pa.array(-total / np.maximum(chars, 1), mask=chars == 0)
        yield spans.batch(FEATURES, [part.column("doc_id"), part.column("lang"), part.column("text_hash"), *_base(part, block), chars, log_perplexity])
    spans.give_back()


def quality(docs: DataFrame, reach: float = 2.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: bool = False) -> DataFrame:
    """Each row's base features, ``log_perplexity``, ``low`` and ``high`` of its language, ``base_failed`` and ``kept``.

    ``held_out`` scores each text by the model of the other half of the texts, else by that of all, itself included.
    """
    text_hash = F.xxhash64(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), text_hash.alias("text_hash"))
    half = F.pmod("text_hash", F.lit(2))
    # a null language has a name of its own in each half
    model = lambda side: F.concat(side.cast("string"), F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n"))) if held_out else F.col("lang")
    where = train(docs.select(model(half).alias("lang"), "text"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    scored = docs.withColumn("judge", model(1 - half)).mapInArrow(_score(where, BLOCK, SWEEP), FEATURES_SQL)
    scored = persist(scored.withColumn("base_failed", failed), "scored")
    quarter = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    # copies vote once, else a large group of them would be the band
    texts = scored.where("not base_failed").groupBy("lang", "text_hash").agg(F.min("log_perplexity").alias("log_perplexity"))
    bands = texts.groupBy("lang").agg(quarter.alias("q"))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_WIDTH)) * reach
    bands = persist(bands.select(F.col("lang").alias("l"), (F.col("q")[0] - width).alias("low"), (F.col("q")[1] + width).alias("high")), "bands")
    out = scored.join(small(bands), scored["lang"].eqNullSafe(bands["l"]), "left").drop("l", "text_hash")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", kept)
