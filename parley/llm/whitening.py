"""Embedding whitening by polarisation: covariances out of exact sums of squares.

An entry c becomes the integer x = floor(scale * c) + shift. A first pass sums x; a second
pass sums, for every dimension and for every sum of two dimensions, the squares of the
values centred at the rounded mean. Both are integers and added exactly (64 bits inside a
block, decimals in Spark), and the rest of the mean is taken off exactly on the driver, so
each is n ** 3 times a variance without error. Cov(i, j) is half of what Var(i + j) has over
Var(i) + Var(j). The driver holds one matrix of dimensions x dimensions, whatever the input.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped;
of vectors of several lengths those of the commonest stay (of two, the longer). Repeated ids
and repeated vectors are rows like any other. An empty table gives an empty result, as does
one whose vectors are all equal: components without variance are left out. Entries so large
that scale * c passes 2 ** 60 count as that. Sums beyond 38 digits raise an overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: entries of one block of rows, size from which 64-bit sums could overflow, and the largest integer of an entry
CELLS, SAFE, MOST = 1 << 17, 1 << 62, 1 << 60
EXACT = pa.decimal128(38, 0)


def _finite(entry: Column) -> Column:
    return entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) != F.lit(float("inf")))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows without null or non-finite entries."""
    named = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.where(F.col("vector").isNotNull() & F.coalesce(F.forall("vector", _finite), F.lit(False)))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows and their integers (dims x rows)."""
    step = max(1, CELLS // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
            x = np.clip(np.floor(flat * scale), -float(MOST), float(MOST)).astype(np.int64) + shift
            yield part, np.ascontiguousarray(x.T)


def _widest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` as they are if a result of at most ``most`` fits 64 bits, else as Python integers."""
    return values if most < SAFE else values.astype(object)


def _rows(keys: list[np.ndarray], values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    numbers = pa.array([Decimal(int(v)) for v in values], EXACT)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), numbers], names)


def _sums(dims: int, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for part, x in _blocks(batches, dims, scale, shift):
            total += _exact(x, _widest(x) * x.shape[1]).sum(axis=1).astype(object)
            n += part.num_rows
        yield _rows([np.arange(dims + 1)], np.append(total, n), ["i", "total"])

    return run


def _squares(dims: int, scale: int, shift: int, middle: list[int]):
    """Sums of squares of every dimension (i, i) and of every sum of two dimensions (i, j), centred at ``middle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(dims)
        total = np.zeros(len(i), object)
        base = np.array(middle, np.int64)[:, None]
        for _, x in _blocks(batches, dims, scale, shift):
            y = x - base
            y = _exact(y, 4 * (_widest(y) ** 2) * y.shape[1])
            found = []
            for d in range(dims):
                both = y[d:] + y[d]
                both[0] = y[d]
                found.append((both * both).sum(axis=1))
            total += np.concatenate(found).astype(object)
        yield _rows([i, j], total, ["i", "j", "total"])

    return run


@dataclass
class Whitening:
    """A fitted transform: ``n`` vectors with per-dimension ``sums``, components by falling eigenvalue."""

    scale: int
    shift: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    #: unit eigenvectors as rows, their eigenvalues, and the trace of the covariance
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]

    def _middle(self) -> tuple[list[int], list[int]]:
        """The rounded means, and what the sums have beyond them."""
        middle = [(2 * s + self.n) // (2 * self.n) if self.n else 0 for s in self.sums]
        return middle, [s - self.n * m for s, m in zip(self.sums, middle, strict=True)]

    def _projection(self):
        """A function from integers (dims x rows) to whitened values (rows x components)."""
        middle, rest = self._middle()
        base = np.array(middle, np.int64)[:, None]
        offset = np.array([r / self.n for r in rest])[:, None] if self.n else np.zeros((0, 1))
        turn = self.components / np.sqrt(self.eigenvalues)[:, None] if len(self.eigenvalues) else self.components
        return lambda x: ((turn @ ((x - base).astype(np.float64) - offset)).T if len(turn) else np.zeros((x.shape[1], 0)))

    def kept(self, vectors: DataFrame) -> DataFrame:
        return vectors.where(F.size("vector") == self.dims) if self.n else vectors.limit(0)

    def apply(self, vectors: DataFrame, id_type: str = "long") -> DataFrame:
        """(id, deviation, whitened): deviation is the sum over dimensions of (n * x - S) ** 2, exact."""
        dims, scale, shift, n = self.dims, self.scale, self.shift, self.n
        project, (middle, rest) = self._projection(), self._middle()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, left = np.array(middle, np.int64)[:, None], np.array(rest, object)[:, None]
            for part, x in _blocks(batches, dims, scale, shift):
                y = x - base
                most = n * _widest(y) + max(map(abs, rest))
                if dims * most * most < SAFE:
                    far = n * y - left.astype(np.int64)
                    deviation = pa.array((far * far).sum(axis=0)).cast(EXACT)
                else:
                    far = n * y.astype(object) - left
                    deviation = pa.array([Decimal(int(v)) for v in (far * far).sum(axis=0)], EXACT)
                white = np.ascontiguousarray(project(x))
                ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["id", "deviation", "whitened"])

        return self.kept(vectors).mapInArrow(run, f"id {id_type}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, vectors: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
        k = len(self.eigenvalues)
        if not k:
            return 0.0
        dims, scale, shift, project = self.dims, self.scale, self.shift, self._projection()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for _, x in _blocks(batches, dims, scale, shift):
                white = project(x)
                total[:k] += white.T @ white
                total[k] += white.sum(axis=0)
            a, b = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())], ["a", "b", "v"])

        found = np.zeros((k + 1, k))
        for r in self.kept(vectors).mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
            found[r.a, r.b] = r.v
        mean = found[k] / self.n
        return float(np.abs(found[:k] / self.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> Whitening:
    """Fit on all rows of ``vectors`` (id, vector), as ``usable`` returns them."""
    model = Whitening(scale, shift)
    lengths = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None or common.dims == 0:
        return model
    dims = common.dims
    fitted = vectors.where(F.size("vector") == dims)
    sums = fitted.mapInArrow(_sums(dims, scale, shift), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total"))
    sums = {r.i: int(r.total) for r in sums.collect()}
    model.n, model.sums = sums[dims], [sums[i] for i in range(dims)]
    middle, rest = model._middle()
    squares = fitted.mapInArrow(_squares(dims, scale, shift, middle), "i int, j int, total decimal(38,0)")
    squares = {(r.i, r.j): int(r.total) for r in squares.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    n = model.n
    # n ** 2 times the sum of squares around the true mean, of a dimension and of a sum of two
    alone = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        covariance[i, i] = alone[i] / n**3
        for j in range(i + 1, dims):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - alone[i] - alone[j]) / (2 * n**3)
    model.trace = sum(alone) / n**3
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0.0) * dims * np.finfo(float).eps]
    model.eigenvalues, model.components = values[order], np.ascontiguousarray(found[:, order].T)
    return model
