"""From documents to token ids, in five stages, each over all that the one before kept.

All stages keep null ids and null or empty texts unless they say otherwise, work on whole
texts, carry columns that documents have beside their own, and give an empty table for one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.bpe import encode
from parley.llm.graph import small
from parley.llm.jaccard import similar_components
from parley.llm.linear import remainder
from parley.llm.substrings import remove_repeats
from parley.llm.weak import toxicity_model
from parley.llm.winnow import contamination
from parley.session import persist

#: score from which a document is toxic, words of a shingle and similarity in percent of a near copy,
#: words of a repeated passage, and words of a benchmark window
TOXIC, SHINGLE, SIMILAR, PASSAGE, BENCHMARK = 0.3, 5, 80, 50, 13


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns as in the toxicity query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    return toxicity_model(docs, labels).below(docs, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. A null id is in no group.

    Rows of one id are one document: they stay or go together.
    """
    found = similar_components(docs, n=SHINGLE, percent=SIMILAR)
    gone = persist(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(small(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a smaller id has; other columns stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # numbered, so that no name can meet those of the result
    held = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)))
    found = remove_repeats(held, window=PASSAGE, carry=tuple(f"_{i}" for i in range(len(rest))), tidy=False)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(f"_{i}") for i, c in enumerate(rest)}}
    if "n_chars" in rest:
        size = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(columns["n_chars"])
        columns["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows; all rows of an id go if one does."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=BENCHMARK)
    gone = persist(found.where("n_hit > 0 and n_hit * 20 >= n_words").select("doc_id").distinct(), "contaminated")
    return docs.join(small(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    found = encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
