"""Spelling variants: exact neighbours at one inserted, deleted or replaced code point.

Words are numbered in two tries, forward and reversed. A word without its code point i is
the pair (node of what stands before i, reversed node of what stands after i), and a word
cut at i is the pair of both sides, so all comparisons are joins on two integers:

- two words of one skipped pair differ by a replaced code point,
- a skipped pair of one word that is a cut of another: the first has one code point more.

Both are exact, since a node stands for one string. A pair is shared by at most as many
words as there are code points, so no group grows with the input.

A trie is numbered from its sorted words: a node is named after the first word that has the
prefix. Words are sorted into ranges (slots) that tasks number on their own; a node that
runs over the end of a slot is a prefix of the slot's last word and is named by slot and
depth, so later slots know it from the first and last words of all slots, which is all that
the driver sees.

Defined cases: null texts have no words; a null id edits no word; repeated rows count each
time; ties of the largest count go to the first word in code-point order; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.graph import small
from parley.session import persist

#: words of a slot, and bits of a word's place in its slot and of a node's depth
SLOT, PLACE, DEPTH = 50_000, 20, 24
CUT, SKIP, SKIP_AGAIN = 0, 1, 2
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, of at least so many code points and occurrences.

    ``edit`` of an id and a word gives the word that is counted instead.
    """
    runs = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0)), lambda run: F.translate(run, UPPER, LOWER))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))
    words = words.select((F.coalesce(edit(F.col("id"), F.col("word")), F.col("word")) if edit else F.col("word")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _carried(slots: list) -> dict[int, list[int]]:
    """For each slot the owners, by depth, of the prefixes of its first word that earlier slots have too."""
    carried: dict[int, list[int]] = {}
    before, of_last = None, []
    for slot, first, last in slots:
        own = of_last[: _shared(before, first) + 1] if before is not None else []
        carried[slot] = own
        through = min(len(own), _shared(first, last) + 1)
        of_last = own[:through] + [slot] * (len(last) + 1 - through)
        before = last
    return carried


def _nodes(keys: list[str], slot: int, carried: list[int]) -> list[list[int]]:
    """Numbers of the nodes of each of the sorted ``keys``, the root first."""
    last, out = keys[-1], []
    before, nodes = "", []
    for j, key in enumerate(keys):
        if j:
            nodes = nodes[: _shared(before, key) + 1]
        else:
            nodes = [(owner << (PLACE + DEPTH)) | k for k, owner in enumerate(carried)]
        end = _shared(key, last)
        # place 0 is the slot's last word, the others are counted from 1
        nodes = nodes + [(slot << (PLACE + DEPTH)) | ((0 if k <= end else j + 1) << DEPTH) | k for k in range(len(nodes), len(key) + 1)]
        out.append(nodes)
        before = key
    return out


def _slots(words: DataFrame, key: str, name: str) -> tuple[DataFrame, dict[int, list[int]]]:
    """``words`` stored by ranges of ``key`` with their ``slot``, and what each slot has from earlier ones."""
    words = persist(words, f"{name}-in")
    count = max(1, -(-words.count() // SLOT))
    count = max(count, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = persist(words.repartitionByRange(count, key).withColumn("slot", F.spark_partition_id()), name)
    edges = ranged.groupBy("slot").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    return ranged, _carried(sorted((r["slot"], r["first"], r["last"]) for r in edges.collect()))


def _forward(carried: dict[int, list[int]]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        table = table.take(pc.sort_indices(table.column("word")))
        keys = table.column("word").to_pylist()
        ids = pa.array(range(slot << PLACE, (slot << PLACE) + len(keys)), pa.int64())
        nodes = pa.array(_nodes(keys, slot, carried[slot]), pa.list_(pa.int64()))
        return pa.table([ids, table.column("word"), table.column("n"), nodes], ["id", "word", "n", "nodes"])

    return run


def _pairs(carried: dict[int, list[int]]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        table = table.take(pc.sort_indices(table.column("turned")))
        turned = table.column("turned").to_pylist()
        before, after, kinds, ids, counts = [], [], [], [], []
        for word, suffix, prefix, i, n in zip(turned, _nodes(turned, slot, carried[slot]), table.column("nodes").to_pylist(), table.column("id").to_pylist(), table.column("n").to_pylist(), strict=True):
            size = len(word)
            before += prefix + prefix[:size]
            after += suffix[::-1] + suffix[:size][::-1]
            # of equal neighbours only the last is skipped for a deletion, so that it is found once
            kinds += [CUT] * (size + 1) + [SKIP if k == size - 1 or word[size - 1 - k] != word[size - 2 - k] else SKIP_AGAIN for k in range(size)]
            ids += [i] * (2 * size + 1)
            counts += [n] * (2 * size + 1)
        return pa.table([pa.array(x, t) for x, t in ((before, pa.int64()), (after, pa.int64()), (kinds, pa.int32()), (ids, pa.int64()), (counts, pa.int64()))], ["p", "s", "kind", "id", "n"])

    return run


def neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) of ``words`` (word, n), ids in code-point order, and all links (id, near, near_n), both ways."""
    ranged, carried = _slots(words, "word", "words")
    forward = ranged.groupBy("slot").applyInArrow(_forward(carried), "id long, word string, n long, nodes array<long>")
    turned, back = _slots(forward.withColumn("turned", F.reverse("word")), "turned", "turned")
    pairs = persist(turned.groupBy("slot").applyInArrow(_pairs(back), "p long, s long, kind int, id long, n long"), "pairs")
    skips, cuts = pairs.where(F.col("kind") != CUT), pairs.where(F.col("kind") == CUT)
    other = lambda side: side.select("p", "s", F.col("id").alias("near"), F.col("n").alias("near_n"))
    # a pair that one word has links nothing
    several = skips.groupBy("p", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    replaced = skips.join(several, ["p", "s"])
    replaced = replaced.join(other(replaced), ["p", "s"]).where("id <> near").select("id", "near", "near_n")
    longer = skips.where(F.col("kind") == SKIP).join(other(cuts), ["p", "s"])
    both = longer.select("id", "near", "near_n").unionAll(longer.select(F.col("near").alias("id"), F.col("id").alias("near"), F.col("n").alias("near_n")))
    return turned.select("id", "word", "n"), replaced.unionAll(both)


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Each of ``words`` (word, n) with ``n_near``, its ``form`` with ``form_n``, and its ``root``.

    The form is the near word of largest n, ties by code points, where that is at least
    ``times`` the word's n; the root is the end of the chain of forms, the word itself where
    there is none. ``times`` must be over 1: n grows along a chain, so that it ends.
    """
    named, near = neighbours(words)
    # ids are in code-point order, so of equal counts the largest negated id is the first word
    best = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("first"))).alias("best"))
    known = persist(best, "near")
    found = named.join(known, "id", "left")
    taken = F.col("best.near_n") >= F.col("n") * times
    found = found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.first")).alias("form_id"), F.when(taken, F.col("best.near_n")).alias("form_n"))
    found = persist(found, "forms")
    roots = found.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    while True:  # twice as far along the chains in each round
        step = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        further = persist(roots.join(step, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("id", "root_id")
        if further.where("moved").isEmpty():
            break
    wanted = roots.select(F.col("root_id").alias("id")).unionAll(found.where("form_id is not null").select(F.col("form_id").alias("id"))).distinct()
    names = small(persist(found.join(wanted, "id", "left_semi").select("id", "word"), "names"))
    name = lambda column, alias: names.select(F.col("id").alias(column), F.col("word").alias(alias))
    out = found.join(roots, "id", "left").join(name("form_id", "form"), "form_id", "left").join(name("root_id", "found_root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("found_root", "word").alias("root"), "n", "n_near", "form_n")
