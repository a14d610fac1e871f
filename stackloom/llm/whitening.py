"""Whitening of embeddings from an exact covariance by bit-sliced scatter.

Entries become integers. A task cuts its rows into blocks; in a block each dimension is
shifted to start at zero and split into bit planes, which are packed across rows into 64-bit
words. The number of rows that have bit ``a`` of one dimension and bit ``b`` of another is
the popcount of the AND of two planes; weighted by ``2**(a + b)`` and summed over planes this
is the exact cross-product of two dimensions, from which the shift is taken out again as
integers. Sums of blocks are exact at any number of rows, so the result does not depend on
how rows are dealt to tasks. The cross-products are centred as integers
(``n * Q - S * S'``) before the one division that makes them the covariance.

One matrix of dimensions by dimensions per task is all that is shuffled or reaches the
driver, whatever the number of rows.

Defined cases: rows whose vector is null or holds null or non-finite entries (entries of
``2**53`` or more in size count as such, as their integers would not be exact) are left out,
and so are vectors of another length than the most frequent one (the longer one on ties);
repeated rows count each; a null id is kept; components whose eigenvalue is no larger than
what rounding leaves of zero have no whitened value and are left out, so equal vectors, a
single row or an empty table give no components. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import stored
from stackloom.session import ship

#: Integers per unit, what is added to them, and the most components.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows whose planes are counted at once, a multiple of 64.
BLOCK = 1 << 14
LARGEST = float(1 << 53)


def vectors(column: pa.Array, dims: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, values)``: the rows of a list column that have ``length`` finite entries, and these as doubles; all lengths, or only ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    offsets = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(lengths == d) if d >= 0 else np.zeros(0, np.int64)
        found = values[offsets[:-1][rows][:, None] + np.arange(max(d, 0))]
        good = (np.abs(found) * SCALE < LARGEST).all(axis=1)
        yield d, rows[good], found[good]


def integers(values: np.ndarray) -> np.ndarray:
    """The contract's integers without their offset, which no covariance sees."""
    return np.floor(SCALE * values).astype(np.int64)


def planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension and bit of each plane, planes of 64-bit words across rows) of non-negative integers."""
    across = np.zeros((rows.shape[1], -(-len(rows) // 64) * 64), np.int64)
    across[:, : len(rows)] = rows.T
    bits = np.array([int(m).bit_length() for m in across.max(axis=1, initial=0)], np.int64)
    dim = np.repeat(np.arange(len(bits)), bits)
    bit = np.arange(len(dim)) - np.repeat(np.cumsum(bits) - bits, bits)
    packed = [np.packbits((across[d] >> b & 1).astype(np.uint8)).view(np.uint64) for d, b in zip(dim.tolist(), bit.tolist())]
    return dim, bit, np.array(packed, np.uint64).reshape(len(dim), across.shape[1] // 64)


def cross_products(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact cross-products of the columns as Python integers, sums of the columns) of one block, by popcounts of its bit planes."""
    n, d = rows.shape
    shift = rows.min(axis=0)
    dim, bit, words = planes(rows - shift)
    product = np.zeros((d, d), object)
    sums = np.zeros(d, object)
    weights = [1 << int(b) for b in bit]
    small = 2 * int(bit.max(initial=0)) + 2 + n.bit_length() <= 62
    np.add.at(sums, dim, np.array([w * int(c) for w, c in zip(weights, np.bitwise_count(words).sum(axis=1, dtype=np.int64))], object))
    if len(dim):
        first = np.flatnonzero(np.append(True, dim[1:] != dim[:-1]))
        place = np.searchsorted(dim[first], dim)
        heavy = bit if small else np.array(weights, object)
        for p in range(len(dim)):  # with the planes of its own and of later dimensions
            k = first[place[p]]
            counts = np.bitwise_count(words[p] & words[k:]).sum(axis=1, dtype=np.int64)
            weighted = counts << heavy[k:] if small else counts.astype(object) * heavy[k:]
            later = first[place[p] :]
            product[dim[p], dim[later]] += np.add.reduceat(weighted, later - k).astype(object) * weights[p]
        product = np.triu(product) + np.triu(product, 1).T
    s = shift.astype(object)
    product = product + np.outer(s, sums) + np.outer(sums, s) + n * np.outer(s, s)
    return product, sums + n * s


@dataclass
class Whitening:
    """``n`` vectors of ``mean`` (of the integers without offset), ``sums`` of it, and what maps them to components of unit variance."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    project: np.ndarray
    explained: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Exact scatter of all vectors, summed in Spark; dimensions squared numbers reach the driver."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # per length: n, sums, products
        for batch in batches:
            for d, _, values in vectors(batch.column(0), None):
                for i in range(0, len(values), BLOCK):
                    product, sums = cross_products(integers(values[i : i + BLOCK]))
                    total = held.setdefault(d, [0, 0, 0])
                    for k, x in enumerate((len(values[i : i + BLOCK]), sums, product)):
                        total[k] = total[k] + x
        for d, (n, sums, product) in held.items():
            i, j = np.triu_indices(d)
            cells = [(d, -1, -1, str(n)), *[(d, k, -1, str(s)) for k, s in enumerate(sums)], *[(d, a, b, str(product[a, b])) for a, b in zip(i.tolist(), j.tolist())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["d", "i", "j", "v"])

    parts = rows.select(column).mapInArrow(run, "d int, i int, j int, v string")
    cells = stored(parts.groupBy("d", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("decimal(38,0)").alias("v")), "whitening-scatter")
    sizes = {r.d: int(r.v) for r in cells.where("i < 0").collect()}
    d = max(sizes, key=lambda k: (sizes[k], k), default=0)
    if not d or not sizes[d]:
        return Whitening(0, np.zeros(0, object), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    n, sums, product = sizes[d], np.zeros(d, object), np.zeros((d, d), object)
    for r in cells.where(F.col("d") == d).where("i >= 0").collect():
        if r.j < 0:
            sums[r.i] = int(r.v)
        else:
            product[r.i, r.j] = product[r.j, r.i] = int(r.v)
    centred = n * product - np.outer(sums, sums)
    covariance = np.array([[float(Fraction(int(x), n * n)) for x in row] for row in centred])
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    kept = (values > values[0] * d * 16 * np.finfo(float).eps) & (np.arange(d) < components)
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    return Whitening(n, sums, mean, columns[:, kept] / np.sqrt(values[kept]), values[kept] / np.trace(covariance) if kept.any() else np.zeros(0))


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums over dimensions of ``(n * x - S) ** 2``."""
    most = max((abs(n * int(m) - s) for e in (rows.min(axis=0, initial=0), rows.max(axis=0, initial=0)) for m, s in zip(e, sums)), default=0)
    if len(sums) * most**2 < 1 << 63 and max(map(abs, sums), default=0) < 1 << 63:
        away = n * rows - sums.astype(np.int64)
        return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
    away = n * rows.astype(object) - sums
    return pa.array([str(v) for v in (away * away).sum(axis=1)]).cast(pa.decimal128(38, 0))


def transform(rows: DataFrame, how: Whitening, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Rows ``vec_id, whitened, deviation`` for every vector that :func:`fit` counted; ``whitened`` has one double per component."""
    ship(rows.sparkSession)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, values in vectors(batch.column(1), how.dims):
                x = integers(values)
                z = (x - how.mean) @ how.project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists, deviations(x, how.n, how.sums)], names=[id_column, "whitened", "deviation"])

    return rows.where(F.lit(how.n > 0)).select(id_column, column).mapInArrow(run, f"{id_column} {kind}, whitened array<double>, deviation decimal(38,0)")


def whiten(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """(:func:`transform` of ``rows(vec_id, embedding)``, what was fitted on all of them)."""
    how = fit(rows, components=components)
    return transform(rows, how), how


def identity_error(whitened: DataFrame) -> float:
    """The largest absolute entry of the covariance of all ``whitened`` vectors minus the identity; 0 without components.

    A task sums the products of its own vectors about its own mean; tasks' sums about the
    common mean follow from their means.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, 0.0, 0.0
        for batch in batches:
            lists = batch.column(0)
            z = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            if not z.size:
                continue
            own = z.mean(axis=0)
            gap, both = own - mean, n + len(z)
            scatter = scatter + (z - own).T @ (z - own) + np.outer(gap, gap) * (n * len(z) / both)
            n, mean = both, mean + gap * (len(z) / both)
        if n:
            k = len(mean)
            i, j = np.divmod(np.arange(k * k), k)
            sums = [*(scatter + n * np.outer(mean, mean)).ravel(), *(n * mean), float(n)]
            places = [[*i, *range(k), -1], [*j, *[-1] * k, -1]]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()) for p in places] + [pa.array(sums, pa.float64())], names=["i", "j", "v"])

    cells = whitened.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not cells:
        return 0.0
    at = {(r.i, r.j): r.v for r in cells}
    n, k = at[-1, -1], max(i for i, _ in at) + 1
    mean = np.array([at[i, -1] for i in range(k)]) / n
    covariance = np.array([[at[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())
