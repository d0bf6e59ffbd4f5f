"""BPE encoding and decoding through a table of distinct words.

Spark tasks split the texts of a batch into words (the pre-tokens of the vocabulary)
and keep, per batch, each distinct word once and a number for each position. The
distinct words of all batches meet in shards by their bytes' hash; a shard encodes each
word once. The ids go back to their batches and are put in place by position. Decoding
joins ids to the pieces of the vocabulary, whose size is fixed.

A batch's positions and words are shuffled once and read twice from that exchange.

Defined cases: null and empty texts have no ids; repeated rows and null ids are kept
as they are; strings of special tokens become their ids, as the vocabulary file says.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans

LETTER, NUMBER, BLANK = 1, 2, 3
BATCH_BYTES, PART_BYTES = 5 << 20, 512 << 10
SENT = pa.schema([("batch", pa.string()), ("shard", pa.int32()), ("body", pa.binary())])
SENT_SQL = "batch string, shard int, body binary"
U = np.uint64


class Words:
    """Splits texts as a byte-level vocabulary file does. ``classes``: class of every code point."""

    def __init__(self, classes: bytes, specials: dict[str, int]):
        self.classes = np.frombuffer(classes, np.uint8)
        self.specials = sorted((s.encode() for s in specials), key=len, reverse=True)

    def split(self, block: spans.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and for each row the number of its first word (rows + 1).

        Rows are split a few at a time: the arrays of a part take some thirty times its bytes.
        """
        edges, at, words, found = block.offsets, 0, 0, []
        while at < block.rows or not found:
            to = min(block.rows, max(at + 1, int(np.searchsorted(edges, edges[at] + PART_BYTES, "right")) - 1))
            low = edges[at]
            begins, closes, bounds = self._part(block.data[low : edges[to]], edges[at : to + 1] - low)
            found.append((begins + low, closes + low, bounds[:-1] + words))
            at, words = to, words + len(begins)
        starts, ends, bounds = (np.concatenate(x) for x in zip(*found))
        return starts, ends, np.append(bounds, words)

    def _part(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = data.tobytes()
        special = self._special(raw, edges)
        cuts = np.unique(np.concatenate((edges, special.ravel()))).astype(np.int64)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
        kind = self.classes[points]
        head = np.zeros(n + 1, bool)  # first point of a part; parts are split on their own
        head[np.searchsorted(at, cuts[cuts < len(data)])] = True
        head[n] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= head[:n]
        start = change.copy()
        blank, space = kind == BLANK, points == 32
        # a run of blanks before a word leaves its last one apart; a space there belongs to the word
        last = np.zeros(n, bool)
        last[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
        start |= last
        taken = np.zeros(n, bool)
        taken[1:] = (last & space)[:-1]
        start &= ~taken
        # contractions: an apostrophe at the start of a match, then one of seven endings
        tick = np.flatnonzero((points == 39) & change & ~taken)
        if len(tick):
            padded = np.concatenate((points, np.zeros(2, np.uint32)))
            one, two = padded[tick + 1], padded[tick + 2]
            in_part = ~head[np.minimum(tick + 1, n)]
            in_part2 = in_part & ~head[np.minimum(tick + 2, n)]
            pair = in_part2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            single = in_part & np.isin(one, (115, 116, 109, 100))
            for mark, size in ((pair, 2), (single, 1)):
                t = tick[mark]
                start[t + 1] = False
                after = t + 1 + size
                after = after[after < n]
                start[after[(kind[after] == LETTER)]] = True
        begins = at[np.flatnonzero(start)]
        if len(special):
            inside = np.searchsorted(special[:, 0], begins, "right") - 1
            within = (inside >= 0) & (begins > special[np.maximum(inside, 0), 0]) & (begins < special[np.maximum(inside, 0), 1])
            begins = begins[~within]
        return begins, np.append(begins[1:], len(data)), np.searchsorted(begins, edges)

    def _special(self, raw: bytes, edges: np.ndarray) -> np.ndarray:
        found: list[tuple[int, int]] = []
        for s in self.specials:
            i = raw.find(s)
            while i >= 0:
                row = int(np.searchsorted(edges, i, "right"))
                inside_row = row >= len(edges) or i + len(s) <= edges[row]
                if inside_row and not any(a < i + len(s) and i < b for a, b in found):
                    found.append((i, i + len(s)))
                    i = raw.find(s, i + len(s))
                else:
                    i = raw.find(s, i + 1)
        return np.array(sorted(found), np.int64).reshape(-1, 2)


@functools.lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(2)
def char_classes(path: str) -> bytes:
    """Class of every code point, asked of the vocabulary's own splitter, whose Unicode version counts.

    A point that joins a punctuation mark before it is neither letter nor number, one
    that joins a letter is a letter, one that joins a digit a number; the rest are blanks.
    """
    split = tokenizer(path).pre_tokenizer
    table = np.full(0x110000, BLANK, np.uint8)
    rest = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c != 10], np.uint32)
    for probe, kind in (("!", 0), ("a", LETTER), ("1", NUMBER)):
        joined = []
        for low in range(0, len(rest), 4096):
            some = rest[low : low + 4096]
            triples = np.column_stack((np.full(len(some), ord(probe), np.uint32), some, np.full(len(some), 10, np.uint32)))
            alone = np.ones(3 * len(some), bool)
            alone[np.fromiter((span[0] for _, span in split.pre_tokenize_str(triples.tobytes().decode("utf-32-le"))), int)] = False
            joined.append(alone[1::3])
        joined = np.concatenate(joined)
        table[rest[joined]] = kind
        rest = rest[~joined]
    return table.tobytes()


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id, behind one another, and their offsets."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    table = {i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    rows = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def _split(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(*shared.value), 0
        part_id = TaskContext.get().partitionId()
        for whole in batches:
            for part in spans.blocks(whole, limit=BATCH_BYTES):
                block = spans.Block(part.column("text"))
                start, end, bounds = words.split(block)
                h = spans.hash_spans(block.data, start, end)
                values, first, codes, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if len(values) >= 1 << 24:
                    raise ValueError("a batch has too many distinct words")
                # frequent words get small numbers, so that the high bytes of most positions are zero
                rank = np.empty(len(values), np.uint32)
                rank[np.argsort(-counts, kind="stable")] = np.arange(len(values), dtype=np.uint32)
                codes = rank[codes]
                # a shard's words go in order of their first bytes, which packs them better
                owner = spans.shard_of(values, shards)
                order = np.lexsort((_first_bytes(block.data, start[first], end[first]), owner))
                at, size = start[first][order], (end - start)[first][order]
                place = np.empty(len(values), np.uint32)
                place[rank[order]] = np.arange(len(values), dtype=np.uint32)
                ids = part.column("id")
                name = f"{part_id}-{number}"
                number += 1
                planes = [(x >> np.uint32(8 * i)).astype(np.uint8) for x in (codes, place) for i in range(3)]
                null = ids.is_null().to_numpy(zero_copy_only=False)
                rows = [(-1, spans.pack(ids.fill_null(0).to_numpy(zero_copy_only=False), null, np.diff(bounds).astype(np.uint32), *planes))]
                cuts = np.searchsorted(owner[order], np.arange(shards + 1))
                for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        rows.append((s, spans.pack(np.array([a], np.uint32), size[a:b].astype(np.uint32), block.data[_ranges(at[a:b], size[a:b])])))
                yield spans.batch(SENT, [[name] * len(rows), [r[0] for r in rows], [r[1] for r in rows]])
                spans.give_back()

    return run


def _first_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    key = np.zeros(len(start), U)
    for i in range(8):
        at = start + i
        key = (key << U(8)) | np.where(at < end, data[np.minimum(at, len(data) - 1)], 0).astype(U)
    return key


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pc.greater_equal(b.column("shard"), 0))


def _encode(path: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one shard: every distinct word encoded once; for each batch the ids of its words."""
        encode = tokenizer(path).encode_batch_fast
        number: dict[bytes, int] = {}
        refs = []
        for x in table.column("body"):
            first, length, raw = spans.unpack(x.as_py())
            raw, ends = raw.tobytes(), np.cumsum(length)
            refs.append((first, np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip((ends - length).tolist(), ends.tolist())])))
        words, sizes, flats = list(number), [], []
        for low in range(0, len(words), 5000):
            found = [e.ids for e in encode([w.decode() for w in words[low : low + 5000]], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in found]))
            flats.append(np.array([i for x in found for i in x], np.uint32))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        begin = np.cumsum(size) - size
        narrow = np.uint16 if int(flat.max(initial=0)) < 65536 else np.uint32
        spans.give_back()
        bodies = [spans.pack(first, size[w].astype(np.uint32), flat[_ranges(begin[w], size[w])].astype(narrow)) for first, w in refs]
        return pa.table([table.column("batch"), table.column("shard"), pa.array(bodies, pa.binary())], schema=SENT)

    return run


def _placed(texts: pa.Table, words: pa.Table) -> tuple[pa.Array, pa.ListArray]:
    """Of one batch: the documents' ids, and their token ids by the numbers at their positions."""
    body = [x for x, s in zip(texts.column("body"), texts.column("shard").to_pylist(), strict=True) if s < 0]
    ids, null, counts, *planes = spans.unpack(body[0].as_py())
    codes, place = (sum(p.astype(np.int64) << (8 * i) for i, p in enumerate(x)) for x in (planes[:3], planes[3:]))
    codes = place[codes]
    size = np.zeros(len(place), np.int64)
    packs = sorted((spans.unpack(x.as_py()) for x in words.column("body")), key=lambda p: int(p[0][0]))
    for first, n, _ in packs:
        size[first[0] : first[0] + len(n)] = n
    flat = np.concatenate([p[2].astype(np.int32) for p in packs] or [np.zeros(0, np.int32)])
    begin = np.cumsum(size) - size
    out = flat[_ranges(begin[codes], size[codes])]
    ends = np.concatenate(([0], np.cumsum(size[codes])))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
    return pa.array(ids, pa.int64(), mask=null.view(bool)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out, pa.int32()))


def _place(shared):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, words: pa.Table) -> pa.Table:
        ids, lists = _placed(texts, words)
        spans.give_back()
        columns = {"id": ids, "ids": lists}
        return pa.table(columns if shared is None else columns | {"decoded": _text(lists, *shared.value)})

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Each row's id (``doc_id``) and ``ids``, equal to the library's encoding with the file at ``path``.

    With ``decoded``, the ids are also joined to their pieces again, in the same tasks.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    specials = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    shared = spark.sparkContext.broadcast((char_classes(path), specials))
    back = spark.sparkContext.broadcast(pieces(path)) if decoded else None
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = texts.mapInArrow(_split(shared, n), SENT_SQL).repartition(n, "batch")
    words = sent.mapInArrow(_only_words, SENT_SQL).groupBy("shard").applyInArrow(_encode(path), SENT_SQL)
    placed = sent.groupBy("batch").cogroup(words.repartition(n, "batch").groupBy("batch")).applyInArrow(_place(back), "id long, ids array<int>" + ", decoded string" * decoded)
    return placed.withColumnRenamed("id", "doc_id")


def _text(lists: pa.ListArray, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The text of each list of ids."""
    size, out = np.diff(offsets), []
    for low in range(0, len(lists), 500):
        part = lists.slice(low, 500)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
        raw = data[_ranges(offsets[flat], size[flat])].tobytes()
        ends = np.concatenate(([0], np.cumsum(size[flat])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        out += [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:])]
    return pa.array(out, pa.string())


def _join_pieces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), _text(b.column("ids"), *shared.value)], [*b.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with a column ``ids``) and ``decoded``; the pieces are a table as long as the vocabulary."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces(path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_join_pieces(shared), f"{schema}, decoded string")
