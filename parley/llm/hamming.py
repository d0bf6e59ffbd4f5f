"""SimHash classes: fingerprints that differ in few bits, found by the generalised pigeonhole.

Fingerprints: the XXH64 of every shingle of a text, bit by bit the majority.

Linking: the 64 bits are dealt into m partitions, and partition i gets a threshold t(i) of
-1 (not probed) or more, with sum t(i) = distance - m + 1. Two fingerprints within
``distance`` then agree up to t(i) bits in at least one partition i, so each probes every
value within t(i) bits of its own there, and what it meets is verified on all 64 bits. No
link is lost, whatever the partitions and thresholds. These are chosen for cost: bits that
correlate over all distinct fingerprints share a partition, which leaves the others more
selective, and the thresholds come from dynamic programming over estimated candidates: the
exact distribution of distances over all pairs in pieces of a partition (by a
Walsh-Hadamard transform of their counts), convolved over its pieces.

Skew: equal fingerprints are one row. Probes are dealt by partition and value, in shards of
bounded size; a shard gives out a forest of its links, not the pairs. A value that more than
``HOT`` fingerprints have in a partition is not probed: its members, and those that would
probe it, meet in points instead. Two fingerprints are within 4 bits exactly when some point
is within 2 bits of both, and all that share a point link, so each gives its 2,081 points and
the cost is linear in the members.

Defined cases: null texts and texts without words have fingerprint zero, which links like
any other; rows of one id are linked; a null id has a fingerprint, and its class is named by
the ids in it, null if there is none; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import components, small
from parley.session import persist

BITS, SEED = 64, 42
#: fingerprints of one value from which it is hot, and its least share of all, which bounds the list of hot values
HOT, HOT_SHARE = 4096, 50_000
#: probe rows of a shard, pairs verified at once, bits of a piece of a partition, cost of a probe in verified pairs
SHARD_ROWS, PAIRS, PIECE, PROBE_COST = 400_000, 1 << 21, 10, 50
U = np.uint64


def _fingerprints(n: int):
    """(id, f) of each row; f holds the bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in spans.blocks(whole, limit=1 << 21):
                block = spans.Block(part.column("text"), lower=True)
                block.words()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_majorities(block, n).view(np.int64))], ["id", "f"])

    return run


def _joined(block: spans.Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a block with one space after each, and where each begins and ends."""
    size = block.ends - block.starts
    starts = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum()))
    shift = np.cumsum(size) - size
    out[at + np.repeat(starts - shift, size)] = block.data[at + np.repeat(block.starts - shift, size)]
    return out.tobytes(), starts, starts + size


def _majorities(block: spans.Block, n: int) -> np.ndarray:
    out = np.zeros(block.rows, U)
    filled = np.flatnonzero(block.n_words)
    if not len(filled):
        return out
    text, starts, ends = _joined(block)
    words, low = block.n_words[filled], block.bounds[:-1][filled]
    # a text of fewer words is one shingle
    shingles, width = np.maximum(words - n + 1, 1), np.minimum(words, n)
    first = np.cumsum(shingles) - shingles
    begin = np.arange(int(shingles.sum())) + np.repeat(low - first, shingles)
    close = begin + np.repeat(width, shingles) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[close].tolist(), strict=True)), U, len(begin))
    for b in range(BITS):
        ones = np.add.reduceat(((h >> U(b)) & U(1)).astype(np.int64), first)
        out[filled] |= (2 * ones > shingles).astype(U) << U(b)
    return out


def _bits(f: np.ndarray) -> np.ndarray:
    """(rows, 64) of 0 and 1, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(f).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _taken(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("f").to_numpy(zero_copy_only=False).view(U)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): how often bits a and b are both set, of a task."""
    total = np.zeros((BITS, BITS))
    for b in batches:
        for at in range(0, b.num_rows, 1 << 16):
            x = _bits(_taken(b.slice(at, 1 << 16))).astype(np.float32)
            total += x.T @ x  # counts below 2 ** 24 are exact
    a, b = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel().astype(np.int64))], ["a", "b", "n"])


def correlated_partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in ``m`` partitions of nearly equal width: each grows by the bit that correlates most with those it has."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        left = sorted(free)
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        free.discard(group[0])
        while len(group) < len(left) // (m - k) + (len(left) % (m - k) > 0):
            best = max(sorted(free), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def _gathered(f: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number."""
    out = np.zeros(len(f), U)
    for k, b in enumerate(bits):
        out |= ((f >> U(b)) & U(1)) << U(k)
    return out


def _piece_counts(pieces: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(p), np.int64) for p in pieces]
        for b in batches:
            f = _taken(b)
            for p, t in zip(pieces, total, strict=True):
                t += np.bincount(_gathered(f, p).astype(np.int64), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)), pa.array(t[at])], ["piece", "value", "n"])

    return run


def pair_distances(counts: np.ndarray) -> np.ndarray:
    """Share of all pairs at each Hamming distance, for the counts of all values of some bits."""
    x = counts.astype(float)
    width = len(x).bit_length() - 1

    def transform(x: np.ndarray) -> np.ndarray:
        for k in range(width):
            x = x.reshape(-1, 2, 1 << k)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
        return x

    pairs = transform(transform(x) ** 2) / len(x)
    out = np.bincount(np.bitwise_count(np.arange(len(x))), np.maximum(pairs, 0), minlength=width + 1)
    return out / max(out.sum(), 1)


def thresholds(near: list[np.ndarray], widths: list[int], n: int, distance: int) -> list[int]:
    """Threshold of each partition, of least cost, with sum distance - m + 1.

    ``near`` has the share of pairs at each distance in each partition.
    """
    m = len(widths)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        return n * PROBE_COST * sum(comb(widths[i], k) for k in range(t + 1)) + n * n / 2 * float(near[i][: t + 1].sum())

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        further: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, min(distance, widths[i]) + 1):
                option = (spent + cost(i, t), [*chosen, t])
                if total + t not in further or option < further[total + t]:
                    further[total + t] = option
        best = further
    return best[distance - m + 1][1]


def _flips(width: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of ``width`` bits, that of none first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], U)


def _hot_flags(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return spans.member(key, hot) >= 0 if len(hot) else np.zeros(len(key), bool)


def _key(i: int, value: np.ndarray) -> np.ndarray:
    return (U(i) << U(58)) | value


def _values(parts: list[list[int]], chosen: list[int]):
    """(key, n): how many fingerprints of a batch have each value of each probed partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _taken(b)
            for i, bits in enumerate(parts):
                if chosen[i] >= 0:
                    value, n = np.unique(_key(i, _gathered(f, bits)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _probes(parts: list[list[int]], chosen: list[int], hot: np.ndarray, shards: int):
    """(shard, key, f, own) of each value that a fingerprint probes; ``own`` where it is its own value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                f = _taken(whole.slice(at, 1 << 14))
                for i, bits in enumerate(parts):
                    if chosen[i] < 0:
                        continue
                    value = _gathered(f, bits)
                    mine = ~_hot_flags(_key(i, value), hot)
                    for k, flip in enumerate(_flips(len(bits), chosen[i])):
                        key = _key(i, value ^ flip)
                        keep = mine & ~_hot_flags(key, hot) if k else mine
                        key = key[keep]
                        shard = spans.shard_of(spans.mix(key), shards)
                        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(f[keep].view(np.int64)), pa.array(np.full(len(key), k == 0))], ["shard", "key", "f", "own"])

    return run


def _crowd(parts: list[list[int]], chosen: list[int], hot: np.ndarray):
    """Fingerprints of a hot value, and those that would probe one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _taken(b)
            found = np.zeros(len(f), bool)
            for i, bits in enumerate(parts):
                if chosen[i] >= 0:
                    value = _gathered(f, bits)
                    for flip in _flips(len(bits), chosen[i]):
                        found |= _hot_flags(_key(i, value ^ flip), hot)
            yield pa.RecordBatch.from_arrays([pa.array(f[found].view(np.int64))], ["f"])

    return run


def _points(distance: int, shards: int):
    """(shard, key, f, own) of all points within half of ``distance`` bits, rounded up; ``own`` within it rounded down."""
    flips = _flips(BITS, (distance + 1) // 2)
    inner = np.bitwise_count(flips) <= distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                f = _taken(whole.slice(at, 64))
                key = (f[:, None] ^ flips).ravel()
                shard = spans.shard_of(spans.mix(key), shards).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), pa.array(np.repeat(f, len(flips)).view(np.int64)), pa.array(np.tile(inner, len(f)))], ["shard", "key", "f", "own"])

    return run


class Forest:
    """Union of nodes 0 .. n - 1; the root of a tree is its least node."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while True:
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = self.root[a], self.root[b]


def _forest_rows(node: np.ndarray, forest: Forest) -> pa.Table:
    under = np.flatnonzero(forest.root != np.arange(len(node)))
    return pa.table([pa.array(node[under].view(np.int64)), pa.array(node[forest.root[under]].view(np.int64))], ["a", "b"])


def _verified(distance: int):
    """Links of a shard: what probes a value against the fingerprints that have it, verified, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        key, f = (table.column(c).to_numpy().view(U) for c in ("key", "f"))
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((~own, key))
        key, f, own = key[order], f[order], own[order]
        node, at = np.unique(f, return_inverse=True)
        members = np.flatnonzero(own)
        held = key[members]
        # an own row meets only the members after it
        low = np.where(own, np.searchsorted(members, np.arange(len(key)), "right"), np.searchsorted(held, key, "left"))
        count = np.maximum(np.searchsorted(held, key, "right") - low, 0)
        forest, done, total = Forest(len(node)), 0, np.cumsum(count)
        while done < len(key):
            spent = total[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(total, spent + PAIRS, "right")))
            asks = np.repeat(np.arange(done, to), count[done:to])
            shift = np.cumsum(count[done:to]) - count[done:to]
            asked = members[np.arange(len(asks)) + np.repeat(low[done:to] - shift, count[done:to])]
            near = np.bitwise_count(f[asks] ^ f[asked]) <= distance
            forest.join(at[asks[near]], at[asked[near]])
            done = to
        return _forest_rows(node, forest)

    return run


def _met(table: pa.Table) -> pa.Table:
    """Links of all that share a point which is an own one of some of them, as a forest."""
    key, f = (table.column(c).to_numpy().view(U) for c in ("key", "f"))
    own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    node, at = np.unique(f, return_inverse=True)
    order = np.lexsort((~own, key))
    key, own, at = key[order], own[order], at[order]
    begins = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    meets = own[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    same = np.flatnonzero(~begins[1:] & meets[1:])
    forest = Forest(len(node))
    forest.join(at[same], at[same + 1])
    return _forest_rows(node, forest)


def partition_count(n: int, distance: int) -> int:
    """Partitions of least cost if all bits were even and independent, 2 at least as a value has up to 32 bits."""

    def cost(m: int) -> float:
        width, spare = BITS // m, distance - m + 1
        base, more = divmod(spare, m)
        balls = [sum(comb(width, k) for k in range(base + (i < more) + 1)) for i in range(m)]
        return n * PROBE_COST * sum(balls) + n * n / 2 * sum(balls) / 2**width

    return min(range(2, max(distance, 1) + 2), key=cost)


def links(prints: DataFrame, distance: int = 4, hot: int = HOT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``f`` whose components are those of all links within ``distance``."""
    spark = prints.sparkSession
    n = prints.count()
    together = np.zeros((BITS, BITS))
    for r in prints.mapInArrow(_together, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        together[r.a, r.b] = r.n
    parts = correlated_partitions(together, n, partition_count(n, distance))
    widths = [len(p) for p in parts]
    split = [[p[k : k + PIECE] for k in range(0, len(p), PIECE)] for p in parts]
    pieces = [q for p in split for q in p]
    counts = [np.zeros(1 << len(q)) for q in pieces]
    # at most 2 ** PIECE rows a piece
    for r in prints.mapInArrow(_piece_counts(pieces), "piece int, value long, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).collect():
        counts[r.piece][r.value] = r.n
    near, k = [], 0
    for p in split:
        both = np.ones(1)
        for _ in p:
            both = np.convolve(both, pair_distances(counts[k]))
            k += 1
        near.append(both)
    chosen = thresholds(near, widths, n, distance)

    tally = prints.mapInArrow(_values(parts, chosen), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = tally.where(F.col("n") > max(hot, n // HOT_SHARE)).select("key").collect()
    crowded = np.sort(np.array([r.key for r in found], np.int64).view(U))
    rows = n * sum(sum(comb(w, j) for j in range(t + 1)) for w, t in zip(widths, chosen, strict=True))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
    probes = prints.mapInArrow(_probes(parts, chosen, crowded, shards), "shard int, key long, f long, own boolean")
    edges = probes.groupBy("shard").applyInArrow(_verified(distance), "a long, b long")
    if len(crowded):
        crowd = persist(prints.mapInArrow(_crowd(parts, chosen, crowded), "f long"), "crowd")
        each = sum(comb(BITS, k) for k in range((distance + 1) // 2 + 1))
        shards = max(shards, -(-crowd.count() * each // SHARD_ROWS))
        points = crowd.mapInArrow(_points(distance, shards), "shard int, key long, f long, own boolean")
        edges = edges.unionAll(points.groupBy("shard").applyInArrow(_met, "a long, b long"))
    return edges


def simhash_components(docs: DataFrame, n: int = 4, distance: int = 4, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id (``doc_id``), ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = persist(docs.mapInArrow(_fingerprints(n), "id long, f long"), "fingerprints")
    classes = persist(rows.groupBy("f").agg(F.min("id").alias("rep")), "classes")
    edges = links(classes.select("f"), distance, hot)
    # an id on rows of several texts ties their fingerprints together
    several = rows.where("id is not null").groupBy("id").agg(F.min("f").alias("b"), F.max("f").alias("most")).where("b <> most")
    ties = rows.join(several, "id").select(F.col("f").alias("a"), "b").where("a <> b")
    reached = components(persist(edges.unionAll(ties).distinct(), "links"))
    named = classes.join(reached.withColumnRenamed("id", "f"), "f", "left").select("f", "rep", F.coalesce("component", "f").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = persist(named.join(least, "component").select("f", "component_id"), "named")
    found = rows.join(small(named), "f")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
