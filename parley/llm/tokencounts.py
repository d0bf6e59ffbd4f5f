"""Token counts as rollups kept up by deltas.

Totals by source, language and tokenizer version are sums, so each batch of changes is
reduced to signed sums per group: an insert adds a document and its tokens, a delete
takes them away, a revision takes the old count away and adds the new one. A batch is
one folder under its number and counts once Spark has written its success marker; to
commit a number again does nothing, and a batch that broke off is written anew. The
rollup is the sum over the committed batches, and ``compact`` folds them into one.

A hot group is one row of each task before any shuffle.

Defined cases: null source, language or version is a group of its own; a null count is
0 tokens; null texts have 0 tokens; groups whose documents are all gone are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.bpe import Words, char_classes, tokenizer

TEXT = "__text"  # the text on its way to be counted
#: words whose size a worker remembers
KEPT = 500_000
KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def _count(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, encode = Words(*shared.value), tokenizer(path).encode_batch_fast
        known, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            at = whole.schema.get_field_index(TEXT)
            for part in spans.blocks(whole, TEXT):
                block = spans.Block(part.column(TEXT))
                start, end, bounds = words.split(block)
                values, first, back = np.unique(spans.hash_spans(block.data, start, end), return_index=True, return_inverse=True)
                place = spans.member(values, known)
                new = np.flatnonzero(place < 0)
                found = np.zeros(len(new), np.int64)
                for low in range(0, len(new), 5000):
                    some = first[new[low : low + 5000]]
                    found[low : low + 5000] = [len(e.ids) for e in encode([block.data[start[i] : end[i]].tobytes().decode() for i in some], add_special_tokens=False)]
                size = np.empty(len(values), np.int64)
                size[place >= 0], size[new] = sizes[place[place >= 0]], found
                if len(known) + len(new) > KEPT:
                    known, sizes = values, size
                else:
                    order = np.argsort(np.concatenate((known, values[new])))
                    known, sizes = np.concatenate((known, values[new]))[order], np.concatenate((sizes, found))[order]
                n = np.diff(np.concatenate(([0], np.cumsum(size[back])))[bounds])
                columns = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*(x for x in part.schema.names if x != TEXT), "n_tokens"])
                spans.give_back()

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``n_tokens``, as the tokenizers library counts with the file at ``path``.

    Texts are split into words, and a worker encodes each distinct word of its texts once
    while it remembers it.
    """
    docs = docs.drop("n_tokens").withColumnRenamed(text_col, TEXT)
    specials = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    shared = docs.sparkSession.sparkContext.broadcast((char_classes(path), specials))  # one byte a code point
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != TEXT)
    return docs.mapInArrow(_count(path, shared), f"{schema}, n_tokens long")


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add the rows (source, lang, tokenizer_version, n_tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Changes for rows with ``old_tokens`` and ``n_tokens`` under the same group."""
    change = F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


class Rollup:
    """A folder of committed batches, in storage that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _folders(self) -> dict[tuple[int, int], str]:
        """Committed (first batch, last batch) and their folders."""
        if not self.fs.exists(self._path()):
            return {}
        found = {}
        for status in self.fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith("batch-") and self.fs.exists(self._path(name, "_SUCCESS")):
                low, high = name.removeprefix("batch-").split("-")
                found[int(low), int(high)] = f"{self.folder}/{name}"
        # a compacted folder stands for the batches within it, also while these are still there
        return {k: v for k, v in found.items() if not any(o != k and o[0] <= k[0] and k[1] <= o[1] for o in found)}

    def commit(self, number: int, changes: DataFrame) -> bool:
        """Apply a batch once; says whether it was new."""
        if any(low <= number <= high for low, high in self._folders()):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        # what an earlier try left without its marker is overwritten
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}-{number}")
        return True

    def totals(self) -> DataFrame:
        folders = list(self._folders().values())
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        sums = self.spark.read.schema(DELTA).parquet(*folders).groupBy(*KEYS)
        return sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the longest run of committed batches without a gap from the first into one folder."""
        folders = self._folders()
        run: list[tuple[int, int]] = []
        for low, high in sorted(folders):
            if run and low != run[-1][1] + 1:
                break
            run.append((low, high))
        if len(run) > 1:
            rows = self.spark.read.schema(DELTA).parquet(*(folders[k] for k in run))
            sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            sums.write.mode("overwrite").parquet(f"{self.folder}/batch-{run[0][0]}-{run[-1][1]}")
