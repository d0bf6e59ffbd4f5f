"""Words and n-grams of whole texts as flat numpy arrays, for use inside Spark tasks.

A block is some rows of a text column: one byte array, one offset per row. Words
are byte spans, so upper and lower bounds of every word of a block are found at
once, without a Python object per word. Hashes are 64 bits and the same in every
process. Null texts have no words.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ODD, _INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4000
LONG_WORD, PIECE = 256, 1 << 18


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: bytes outside `[^\x20\x09-\x0D]+`
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between blocks."""
    have = _POWERS.get(base)  # of the pieces and blocks seen so far
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), U)
        have[1:] = U(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xCF1BBCDCB7A56463)
    return h ^ (h >> U(32))


class Block:
    """Rows of one string column: ``data`` (uint8) and ``offsets`` (rows + 1)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        _, offs, data = column.buffers()
        if n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        else:
            o = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
            self.data = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if o[-1] > o[0] else np.zeros(0, np.uint8)
            self.offsets = o - o[0]
        if lower:
            self.data = _LOWER[self.data]
        self.rows = n

    def words(self, seps: np.ndarray = BLANKS) -> None:
        """Sets starts, ends (byte positions), bounds (rows + 1: first word of each row)."""
        size = len(self.data)
        edge = np.ones(size + 2, bool)
        edge[1:-1] = seps[self.data]
        first = ~edge[1:-1]
        begins, closes = edge[:-2].copy(), edge[2:].copy()
        cut = self.offsets[(self.offsets > 0) & (self.offsets < size)]
        begins[cut] = True
        closes[cut - 1] = True
        self.starts = np.flatnonzero(first & begins)
        self.ends = np.flatnonzero(first & closes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_spans(self.data, self.starts, self.ends)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and do not overlap."""
    h = np.zeros(len(starts), U)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    i = 0
    while i < len(starts):  # pieces that stay in the cache
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        if j > i + 1 or ends[i] - low <= LONG_WORD:
            size = int(ends[j - 1] - low)
            total = np.zeros(size + 1, U)
            np.cumsum(_BYTES[data[low : low + size]] * _powers(_ODD, size), out=total[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            h[i:j] = mix((total[e] - total[s]) * _powers(_INV, size + 1)[s])
        i = j
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours of a flat array, rows not regarded.

    Item i covers h[i : i + k]; the result has len(h) - k + 1 items, none if shorter.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _powers(_ODD, len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INV, n))


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words stay inside one row, for word bounds of the rows."""
    ok = np.zeros(n + 1, np.int32)
    low, high = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    np.add.at(ok, np.minimum(low, n), 1)
    np.add.at(ok, np.minimum(high, n), -1)
    return np.cumsum(ok[:-1]) > 0


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch or table in slices of about ``limit`` bytes of text and at most ``BLOCK_ROWS`` rows.

    One long text is a slice of its own. Memory that the slices needed is given back at the end.
    """
    column = batch.column(text)
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, min(at + BLOCK_ROWS, int(np.searchsorted(total, before + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def dense(row: np.ndarray, value: np.ndarray, bits: int = 52) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, top ``bits`` of value), sorted by both, with one integer sort.

    Rows must be fewer than 2 ** (64 - bits).
    """
    key = (row.astype(U) << U(bits)) | (value >> U(64 - bits))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> U(bits)).astype(np.int64), key & U((1 << bits) - 1)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours; len(g) - w + 1 items, none if shorter."""
    if len(g) < w:
        return g[:0]
    reach, m = 1, g
    while reach * 2 <= w:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    return np.minimum(m[: len(g) - w + 1], m[w - reach : w - reach + len(g) - w + 1])


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each value in a sorted table, -1 where it is not there."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    raw = len(head).to_bytes(4, "little") + head + body
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(message: bytes) -> list[np.ndarray]:
    raw = pa.decompress(message[8:], int.from_bytes(message[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for x in raw[4 : 4 + n].decode().split(";"):
        kind, count = np.dtype(x[:3]), int(x[3:])
        out.append(np.frombuffer(raw, kind, count, at))
        at += kind.itemsize * count
    return out


def shard_cuts(sorted_values: np.ndarray, shards: int, bits: int = 52) -> np.ndarray:
    """Where each of ``shards`` equal ranges of a hash space begins in sorted values (shards + 1)."""
    edges = np.array([(s << bits) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_values, edges), [len(sorted_values)]))


def give_back() -> None:
    """Return freed memory to the machine, where the C library can; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def giving_back(run: Callable) -> Callable:
    """A function of one group that returns the memory it freed once its result is made."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            return run(*args)
        finally:
            give_back()

    wrapped.__signature__ = inspect.signature(run)  # Spark tells by the arguments what to pass
    return wrapped


def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges each 64-bit hash is in."""
    return ((values >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
