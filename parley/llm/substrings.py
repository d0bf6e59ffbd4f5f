"""Substring dedup: repeated word windows found by backward search in FM-index shards.

Every window of ``window`` words has a minimizer, the smallest hash among its
``GRAM``-word grams. Equal windows have equal minimizers, so the text is cut into
segments of windows that share one and each segment goes to the shard of its
minimizer; no shard needs another. Minimizers that stand in one document only are
found first, from counts, and their segments stay at home.

A shard concatenates its segments, orders the suffixes, takes the Burrows-Wheeler
transform and stores it as a wavelet matrix of packed bits with rank counts. Each
segment is then streamed from its end through backward search. The statistics are
needed up to the segment's length only: if the whole segment also occurs in an
earlier document, all its windows do; if not, its windows are searched one by one.

Hot passages: equal segments of a bucket of documents are sent once, and windows of
a minimizer with more than ``HOT`` documents are sent one by one under their own
hash, so a shard gets each distinct content at most once per bucket.

Defined cases: null text has no words; a null id counts as later than all others and
null ids are never earlier than each other; repeated rows of one id and text are no
repeats of each other, as no id is smaller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans

GRAM = 5
HOT = 2000
LAST = np.iinfo(np.int64).max
PACKED = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
SENT = PACKED.append(pa.field("settled", pa.bool_()))
U = np.uint64


class Wavelet:
    """Wavelet matrix over small integers: one packed bit row with rank counts per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.rows = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(U)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32)
            self.rows.append((level, words, before, int(len(bit) - bit.sum())))
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.first = self._walk(np.arange(symbols, dtype=np.int32), np.zeros(symbols, np.int32))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.rows:
            word = at >> 6
            mask = (U(1) << (at & 63).astype(U)) - U(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones).astype(np.int32)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols; symbol 0 ends a segment.

    Suffixes are ordered by their first ``depth`` symbols or more, which suffices for
    patterns of that length.
    """

    def __init__(self, codes: np.ndarray, symbols: int, depth: int):
        n = len(codes)
        order, reach, rank = None, 1, codes
        while order is None or reach < depth:
            key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2)
            key[: max(0, n - reach)] += rank[reach:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=np.int32)
            reach *= 2
        del key, rank
        self.order = order
        self.n = n
        self.wavelet = Wavelet(codes[order - 1] if n else codes, symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))[:-1].astype(np.int32)

    def search(self, codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the pattern codes[end - length : end] of each query; size 1 or less is cut short."""
        low, high = np.zeros(len(ends), np.int32), np.full(len(ends), self.n, np.int32)
        live = np.arange(len(ends))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (high[live] - low[live] > 1)]
            if not len(live):
                break
            c = codes[ends[live] - 1 - step]
            if step:
                both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
                low[live], high[live] = self.before[c] + both[: len(live)], self.before[c] + both[len(live) :]
            else:
                low[live] = self.before[c]
                high[live] = np.append(self.before, self.n)[c + 1]
        return low, high


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest value of each interval; intervals of one length never overlap, so this reads each value once per length."""
    out = np.full(len(low), LAST)
    some = np.flatnonzero(high - low > 1)
    if len(some):
        pairs, back = np.unique(low[some].astype(np.int64) << 32 | high[some], return_inverse=True)
        flat = np.empty(2 * len(pairs), np.int64)
        flat[0::2], flat[1::2] = pairs >> 32, pairs & 0xFFFFFFFF
        out[some] = np.minimum.reduceat(np.append(values, LAST), flat)[0::2][back]
    return out


def _minimizers(block: spans.Block, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Top 52 bits of the mixed minimizer of each window of the flat words, and which windows lie in one row.

    Minima crowd at the low end of the hash space, so shards that are equal ranges of it take even
    shares of them only once they are mixed.
    """
    gram = min(GRAM, window)
    m = spans.mix(spans.sliding_min(spans.windows(h, gram), window - gram + 1)) >> U(12)
    return m, spans.inside(block.bounds, window, len(m))


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _table_ids(table: pa.Table, name: str) -> np.ndarray:
    return _ids(table.column(name).combine_chunks())


def _candidates(window: int, shards: int):
    @spans.giving_back
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one bucket: its minimizers with their number of documents, dealt to the shards."""
        found = []
        for part in spans.blocks(table, "_text"):
            block = spans.Block(part.column("_text"))
            block.words()
            m, ok = _minimizers(block, block.hashes(), window)
            found.append(spans.dense(block.row_of_word()[: len(m)][ok], m[ok] << U(12))[1])
        values, counts = np.unique(np.concatenate([*found, np.zeros(0, U)]), return_counts=True)
        cuts = spans.shard_cuts(values, shards)
        rows = [(s, spans.pack(values[a:b], counts[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=PACKED)

    return run


@spans.giving_back
def _repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one shard: for each bucket, its minimizers that two documents or more have, and which are hot."""
    packs = [spans.unpack(x.as_py()) for x in table.column("body")]
    every = np.concatenate([p[0] for p in packs])
    values, back = np.unique(every, return_inverse=True)
    total = np.bincount(back, np.concatenate([p[1] for p in packs]), len(values))
    at, bodies = 0, []
    for p in packs:
        n = total[back[at : at + len(p[0])]]
        at += len(p[0])
        keep = n > 1
        bodies.append(spans.pack(p[0][keep], n[keep] > HOT) if keep.any() else None)
    return pa.table([table.column("shard"), table.column("bucket"), pa.array(bodies, pa.binary())], schema=PACKED).filter(pa.array([b is not None for b in bodies]))


def _segments(window: int, shards: int):
    @spans.giving_back
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, repeated: pa.Table) -> pa.Table:
        """Of one bucket: its distinct segments for the shards, and the windows settled here, which only pass through one."""
        packs = [spans.unpack(x.as_py()) for x in repeated.column("body")]
        known = np.concatenate([p[0] for p in packs]) if packs else np.zeros(0, U)
        hot = np.concatenate([p[1].view(bool) for p in packs]) if packs else np.zeros(0, bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        width = window - min(GRAM, window) + 1
        kept = [[] for _ in range(6)]
        hashes: list[np.ndarray] = []
        shift = 0
        for part in spans.blocks(docs, "_text") if len(known) else ():
            block = spans.Block(part.column("_text"))
            block.words()
            h = block.hashes()
            m, ok = _minimizers(block, h, window)
            at = spans.member(m, known)
            use = np.flatnonzero(ok & (at >= 0))
            if not len(use):
                continue
            own, warm, row = m[use], hot[at[use]], block.row_of_word()[use]
            new = np.ones(len(use), bool)
            new[1:] = (own[1:] != own[:-1]) | (use[1:] != use[:-1] + 1) | (row[1:] != row[:-1]) | warm[1:]
            begin = np.flatnonzero(new)
            within = np.arange(len(use)) - np.repeat(begin, np.diff(np.append(begin, len(use))))
            begin = np.flatnonzero(within % width == 0)
            start, length = use[begin], np.diff(np.append(begin, len(use))) + window - 1
            content = _content(h, start, length)
            route = np.where(warm[begin], content >> U(12), own[begin])
            ids = _ids(part.column("_id"))
            keys = part.column("_key").to_numpy(zero_copy_only=False) if isinstance(part.column("_key"), pa.Array) else part.column("_key").combine_chunks().to_numpy()
            r = row[begin]
            for box, x in zip(kept, (content, route, ids[r], keys[r], start - block.bounds[r], length), strict=True):
                box.append(x)
            # the words of the segments, behind one another
            hashes.append(h[_ranges(start, length)])
        if not hashes:
            return SENT.empty_table()
        content, route, ids, keys, start, length = (np.concatenate(x) for x in kept)
        words = np.concatenate(hashes)
        offset = np.concatenate(([0], np.cumsum(length)))
        order = np.lexsort((ids, content))
        c, i = content[order], ids[order]
        head = np.concatenate(([True], c[1:] != c[:-1]))
        least = i[np.flatnonzero(head)][np.cumsum(head) - 1]
        rows = []
        late = order[i > least]
        if len(late):
            rows.append((key[0].as_py() % shards, spans.pack(keys[late], start[late].astype(np.int32), length[late].astype(np.int32)), True))
        send = order[i == least]  # one document's, at every place where it has the content
        send = send[np.argsort(route[send], kind="stable")]
        cuts = spans.shard_cuts(route[send], shards)
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                x = send[a:b]
                values, codes = np.unique(words[_ranges(offset[x], length[x])], return_inverse=True)
                rows.append((s, spans.pack(route[x], ids[x], keys[x], start[x].astype(np.int32), length[x].astype(np.int16), values, codes.astype(np.uint16 if len(values) < 65536 else np.uint32)), False))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], schema=SENT)

    return run


def _content(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * spans._powers(spans._ODD, len(h)), out=total[1:])
    return spans.mix((total[start + length] - total[start]) * spans._powers(spans._INV, len(h) + 1)[start] + length.astype(U))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, then the same of the next."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _search(window: int):
    @spans.giving_back
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one shard: the windows that also stand in an earlier document, as (key, start, words) by bucket."""
        settled = pc.equal(table.column("settled"), True)
        through = table.filter(settled).select(PACKED.names)
        table = table.filter(pc.invert(settled))
        if not table.num_rows:
            return through
        packs = [spans.unpack(x.as_py()) for x in table.column("body")]
        route, ids, keys, start, length = (np.concatenate([p[i] for p in packs]) for i in range(5))
        length = length.astype(np.int64)
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(p[0]) for p in packs])
        vocabulary = np.unique(np.concatenate([p[5] for p in packs]))
        flat = np.concatenate([np.searchsorted(vocabulary, p[5])[p[6]] for p in packs]) + 1
        ends = np.cumsum(length + 1) - 1  # where each segment's 0 stands
        codes = np.zeros(int(ends[-1]) + 1, np.int32)
        codes[_ranges(ends - length, length)] = flat
        index = FMIndex(codes, len(vocabulary) + 1, int(length.max()))
        earlier = np.repeat(ids, length + 1)[index.order]
        # a segment is asked for only if an earlier document has its minimizer
        groups, back = np.unique(route, return_inverse=True)
        least = np.full(len(groups), LAST)
        np.minimum.at(least, back, ids)
        ask = np.flatnonzero(ids > least[back])
        low, high = index.search(codes, ends[ask], length[ask])
        whole = _least(earlier, low, high) < ids[ask]
        hits = [(ask[whole], start[ask[whole]], length[ask[whole]])]
        rest = ask[~whole]
        rest = rest[length[rest] > window]
        if len(rest):
            count = length[rest] - window + 1
            segment = np.repeat(rest, count)
            nth = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
            end = ends[segment] - length[segment] + nth + window
            low, high = index.search(codes, end, np.full(len(end), window))
            hit = _least(earlier, low, high) < ids[segment]
            hits.append((segment[hit], start[segment[hit]] + nth[hit], np.full(int(hit.sum()), window)))
        which, begin, size = (np.concatenate([x[i] for x in hits]) for i in range(3))
        by = bucket[which]
        order = np.argsort(by, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], by[order][1:] != by[order][:-1]))) if len(order) else np.zeros(0, int)
        bodies, names = [], []
        for x in np.split(order, cuts[1:]) if len(order) else ():
            names.append(int(by[x[0]]))
            bodies.append(spans.pack(keys[which[x]], begin[x].astype(np.int32), size[x].astype(np.int32)))
        found = pa.table([pa.array([-1] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], schema=PACKED)
        return pa.concat_tables([through, found])

    return run


def _remove(carry: list[str], tidy: bool):
    @spans.giving_back
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        """Of one bucket: each document without the words of its repeated windows."""
        packs = [spans.unpack(x.as_py()) for x in hits.column("body")]
        if packs:
            keys, begin, size = (np.concatenate([p[i] for p in packs]) for i in range(3))
            order = np.argsort(keys, kind="stable")
            keys, begin, size = keys[order], begin[order], size[order]
        out = [[], [], []]
        own = docs.column("_key").to_numpy()
        for k, text in zip(own, docs.column("_text"), strict=True):
            text = text.as_py()
            raw = (text or "").encode()
            words = raw.split()
            n, removed, kept = len(words), 0, text
            if packs and (b := np.searchsorted(keys, k, "right")) > (a := np.searchsorted(keys, k)):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, begin[a:b], 1)
                np.add.at(edge, begin[a:b] + size[a:b], -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed = int(n - keep.sum())
                if tidy:
                    words = [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]
                else:
                    kept = _cut(text, keep)
            if tidy:
                kept = b" ".join(words).decode()
            for box, x in zip(out, (n, removed, kept), strict=True):
                box.append(x)
        columns = {"doc_id": docs.column("_id"), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept": pa.array(out[2], pa.string())}
        return pa.table(columns | {c: docs.column("+" + c) for c in carry})

    return run


def _cut(text: str, keep: np.ndarray) -> str:
    """The text without its removed words; blanks around kept words stay."""
    block = spans.Block(pa.array([text]))
    block.words()
    parts, at = [], 0
    for first, last in _runs(~keep):
        parts.append(block.data[at : block.starts[first]].tobytes())
        at = block.starts[last + 1] if last + 1 < len(keep) else len(block.data)
    parts.append(block.data[at:].tobytes())
    return b"".join(parts).decode()


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """Each row's id, n_words, n_removed, ``kept`` and the columns ``carry``.

    ``kept`` is the text without repeated windows, its words joined by one space; unless
    ``tidy``, a text that loses nothing stays as it is and others keep their own blanks.

    A word goes if a window of ``window`` words covers it that also starts in a row with
    a smaller id; all windows are judged on the input. The documents are shuffled once,
    into buckets; the three steps that read them share that exchange.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, shards = n, 4 * n  # an index takes about 100 bytes a word, a bucket of documents far less
    packed = "shard int, bucket int, body binary"
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_key"), *(F.col(c).alias(f"+{c}") for c in carry))
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int")).repartition(n, "_bucket")

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept string", *(f"`{c}` {kinds[c]}" for c in carry)])

    def by_bucket(df: DataFrame):
        return keyed.groupBy("_bucket").cogroup(df.repartition(n, "bucket").groupBy("bucket"))

    candidates = keyed.groupBy("_bucket").applyInArrow(_candidates(window, shards), packed)
    repeated = candidates.groupBy("shard").applyInArrow(_repeated, packed)
    segments = by_bucket(repeated).applyInArrow(_segments(window, shards), packed + ", settled boolean")
    hits = segments.groupBy("shard").applyInArrow(_search(window), packed)
    return by_bucket(hits).applyInArrow(_remove(list(carry), tidy), schema)
