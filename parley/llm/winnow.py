"""Benchmark decontamination by winnowed fingerprints.

Of every run of ``w`` neighbouring ``k``-word grams the one with the least hash is a
fingerprint, with w + k - 1 = the length to be guaranteed, so a shared span of that
length shares a fingerprint. Documents and items are winnowed alike, joined on the
fingerprint, and each seed is extended over the item's words along its diagonal; only
runs of a whole window count. Items shorter than a window have a length of their own
and are winnowed for that length, documents too.

Defined cases: null or empty text has no words and no hits; items without words or
with a null id are no items; rows of one item id are one item; repeated document rows
give repeated result rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import small
from parley.session import persist

GRAM = 5
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PRINTS = "key long, id long, length int, pos int, print long"
OUT = "key long, id long, n_words long, n_hit long, items array<string>"
OUT_ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def fingerprints(block: spans.Block, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat word positions and hashes of the fingerprints that guarantee spans of ``length`` words."""
    k = min(GRAM, length)
    w = length - k + 1
    g = spans.windows(h, k)
    least = spans.sliding_min(g, w)
    if not len(least):
        return np.zeros(0, np.int64), g[:0]
    least = np.where(spans.inside(block.bounds, length, len(least)), least, U(0))
    padded = np.concatenate((np.zeros(w - 1, U), least, np.zeros(w - 1, U)))
    most = ~spans.sliding_min(~padded, w)
    at = np.flatnonzero(most == g)
    return at, g[at]


def _prints(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in spans.blocks(whole):
                block = spans.Block(part.column("text"), lower=True)
                block.words(spans.NOT_ALNUM)
                h, row = block.hashes(), block.row_of_word()
                for length in lengths:
                    at, value = fingerprints(block, h, length)
                    r = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([part.column("key").take(r), part.column("id").take(r), pa.array(np.full(len(at), length, np.int32)), pa.array((at - block.bounds[row[at]]).astype(np.int32)), pa.array(value.view(np.int64))], ["key", "id", "length", "pos", "print"])

    return run


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in spans.blocks(whole):
                block = spans.Block(part.column("text"), lower=True)
                block.words(spans.NOT_ALNUM)
                hits, items = np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)]
                seeds = part.column("seeds")
                for r in np.flatnonzero(seeds.is_valid().to_numpy(zero_copy_only=False)):
                    words = words_of(part.column("text")[int(r)].as_py())
                    cover, found = np.zeros(len(words) + 1, np.int64), set()
                    for seed in seeds[int(r)].as_py():
                        other = words_of(seed["text"])
                        need = min(window, len(other))
                        run_length = 0
                        for j in range(max(0, -seed["diagonal"]), min(len(other), len(words) - seed["diagonal"]) + 1):
                            same = j < min(len(other), len(words) - seed["diagonal"]) and other[j] == words[j + seed["diagonal"]]
                            if same:
                                run_length += 1
                                continue
                            if run_length >= need:
                                cover[j + seed["diagonal"] - run_length] += 1
                                cover[j + seed["diagonal"]] -= 1
                                found.add(seed["item"])
                            run_length = 0
                    hits[r], items[r] = int((np.cumsum(cover) > 0).sum()), sorted(found)
                yield spans.batch(OUT_ARROW, [part.column("key"), part.column("id"), block.n_words, hits, items])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document row's ``doc_id``, ``n_words``, ``n_hit`` (words in windows of an item) and ``items`` (their ids).

    The fingerprints of the items are broadcast while they are few and joined by a
    shuffle beyond that; so are the seeds that go back to the texts.
    """
    docs = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    # one row per text of an item; a text without words gives no fingerprint
    length = F.size(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)))
    items = persist(items.withColumn("length", F.least(length, F.lit(window)).cast("int")).where("length > 0"), "items")
    lengths = tuple(sorted(r[0] for r in items.select("length").distinct().collect()))  # at most ``window`` values
    own = items.select(F.xxhash64("item", "text").alias("key"), F.lit(0).cast("long").alias("id"), "text", "item", "length")
    test = own.select("key", "id", "text").mapInArrow(_prints(lengths), PRINTS).select(F.col("key").alias("item_key"), F.col("length").alias("item_length"), F.col("pos").alias("item_pos"), "print")
    test = test.join(own.select(F.col("key").alias("item_key"), F.col("length").alias("item_length")), ["item_key", "item_length"])
    test = persist(test, "prints")
    train = docs.mapInArrow(_prints(lengths), PRINTS)
    seeds = train.join(small(test), (train["print"] == test["print"]) & (F.col("length") == F.col("item_length")))
    seeds = persist(seeds.select("key", "id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "seeds")
    texts = own.select(F.col("key").alias("item_key"), "item", "text")
    by_doc = seeds.join(small(texts, 20_000), "item_key").groupBy("key", "id").agg(F.collect_list(F.struct("item", "text", "diagonal")).alias("seeds"))
    few = seeds.limit(100_001).count() <= 100_000
    by_doc = by_doc.withColumnsRenamed({"key": "k", "id": "i"})
    joined = docs.join(F.broadcast(by_doc) if few else by_doc, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    out = joined.select("key", "id", "text", "seeds").mapInArrow(_extend(window), OUT)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "items")
