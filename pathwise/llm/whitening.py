"""Whitening of embeddings from an exact covariance: digit-slice GEMM, big integers, one eigendecomposition.

An entry c counts as the integer x = floor(1024 c) + 100000. A first pass sums the vectors; with m, the rounded mean, a
second one multiplies y = x - m: each block of y is split into limbs of `LIMB_BITS` bits, so that float64 products of
limbs, summed over the block's rows, are integers below 2^53 and BLAS gives them exactly; the limbs' products are
recombined as big integers, and blocks, partitions and rounds of merging add those. So n^2 V = n sum(y y') - s s' (s the
sum of y) is exact however many rows there are and however large the entries, and no order of merging changes a bit. V
is divided out with correct rounding, decomposed, and its eigenvectors are refined in extended precision. A third pass
sums the whitened rows' covariance, the check against the identity, and the last one gives the result.

What goes to the driver is one merged row of the dimension's size; partial sums are merged in Spark, `MERGE` at a time.

Defined cases: rows whose vector is null or has a null or non-finite entry are dropped, and so are rows whose length is
not the most frequent one (the longest of those); |1024 c| counts as 2^61 beyond that; repeated rows count as often as
they occur; a null vec_id is as good as any; components without variance (an eigenvalue below `FLAT` of the largest)
cannot be whitened and have no rows, so fewer than two different vectors give an empty result, as does an empty table;
`deviation` is null where its value needs more than 64 bits, `deviation_wide` has it up to 38 digits; other columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import discard, slices, table, written

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Rows of a block and bits of a limb: 2^12 products of 2 x 20 bits stay below 2^53.
ROWS, LIMB_BITS = 4096, 20
LARGEST = 1 << 61
MERGE = 32
FLAT = 1e-13


def flat_vectors(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of `length` entries, all finite, as rows of doubles, and their places."""
    sizes = np.diff(vectors.offsets.to_numpy())
    there = vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes == length)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are NaN
    starts = vectors.offsets.to_numpy()[:-1][there]
    rows = values[starts[:, None] + np.arange(length)] if len(starts) else np.zeros((0, length))
    good = np.isfinite(rows).all(1)
    return rows[good], np.flatnonzero(there)[good]


def integers(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * SCALE)
    wide = np.abs(scaled) >= LARGEST
    out = np.where(wide, 0.0, scaled).astype(np.int64)
    return np.where(wide, np.where(scaled > 0, LARGEST, -LARGEST), out) + OFFSET


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """`values` = sum of limb k times 2 ** (k LIMB_BITS), as doubles; the last limb has the sign."""
    out, mask = [], (1 << LIMB_BITS) - 1
    while np.abs(values).max(initial=0) > mask >> 1:
        out.append((values & mask).astype(np.float64))
        values = values >> LIMB_BITS
    return [*out, values.astype(np.float64)]


def gram(values: np.ndarray) -> np.ndarray:
    """values' transpose times values, in exact big integers (an object array)."""
    out = np.zeros((values.shape[1], values.shape[1]), object)
    for k in range(0, len(values), ROWS):
        parts = limbs(values[k : k + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)
                out += (product if i == j else product + product.T) * (1 << (LIMB_BITS * (i + j)))
    return out


def _packed(count: int, numbers: np.ndarray) -> bytes:
    """A count and big integers, all in as many bytes as the largest needs."""
    flat = [int(x) for x in numbers.ravel()]
    wide = max((x.bit_length() for x in flat), default=0) // 8 + 1
    return struct.pack("<qq", count, wide) + b"".join(x.to_bytes(wide, "little", signed=True) for x in flat)


def _unpacked(data: bytes) -> tuple[int, np.ndarray]:
    count, wide = struct.unpack_from("<qq", data)
    return count, np.array([int.from_bytes(data[k : k + wide], "little", signed=True) for k in range(16, len(data), wide)], object)


def _added(parts: list[bytes]) -> bytes:
    counts, numbers = zip(*map(_unpacked, parts), strict=True)
    return _packed(sum(counts), sum(numbers))


def _merged(partials: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value of all rows of `partials` (a column `part`), merged by Spark `MERGE` rows at a time; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in slices(batches, MERGE):
            held += batch["part"].to_pylist()
            if len(held) > 1:
                held = [merge(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["part"])

    now = written(partials, "whitening-parts")
    while (n := now.count()) > 1:
        before, now = now, written(now.repartition(-(-n // MERGE)).mapInArrow(run, "part binary"), "whitening-parts")
        discard(before)
    row = now.first()
    discard(now)
    return None if row is None else bytes(row["part"])


@dataclass(frozen=True)
class Whitening:
    """What the passes know: count and dimension, m and s (x sums to n m + s), eigenvalues, components as columns, trace."""

    n: int
    shift: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def length(self) -> int:
        return len(self.shift)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles: the integer part is exact, what is subtracted then is at most a half."""
        return (x - self.shift).astype(np.float64) - np.array([int(r) / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        y = x - self.shift
        most = int(np.abs(y).max(initial=0)) * self.n + max((abs(int(r)) for r in self.rest), default=0)
        if most * most * self.length < 1 << 63:
            return ((y * self.n - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        return (((y.astype(object) * self.n - self.rest) ** 2).sum(1)).tolist()


def decomposed(n: int, shift: np.ndarray, rest: np.ndarray, products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The eigenvectors of V = (n products - rest rest') / n^2 by falling eigenvalue, refined in extended precision."""
    exact = n * products - np.outer(rest, rest)
    cov = np.array([[int(x) / (n * n) for x in row] for row in exact]).reshape(exact.shape)
    trace = int(np.trace(exact)) / (n * n) if len(exact) else 0.0
    values, vectors = np.linalg.eigh(cov) if len(exact) else (np.zeros(0), np.zeros((0, 0)))
    wide, basis = cov.astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(2):  # quadratic convergence; close eigenvalues keep eigh's vectors of their common space
        off = np.eye(len(basis)) - basis.T @ basis
        inner = basis.T @ wide @ basis
        own = np.diag(inner) / (1 - np.diag(off))
        gap = own[None, :] - own[:, None]
        near = np.abs(gap) <= 8 * np.finfo(np.float64).eps * np.abs(own).max(initial=0) * max(1, len(own))
        basis = basis + basis @ np.where(near, off / 2, (inner + own[None, :] * off) / np.where(near, 1, gap))
        values = own
    order = np.argsort(-values, kind="stable")[:components]
    kept = [k for k in order if values[k] > FLAT * values.max()]
    chosen = (basis[:, kept] / np.sqrt((basis[:, kept] ** 2).sum(0))).astype(np.float64)
    signs = np.sign(chosen[np.abs(chosen).argmax(0), np.arange(chosen.shape[1])]) if chosen.size else np.ones(chosen.shape[1])
    return Whitening(n, shift, rest, values[kept].astype(np.float64), chosen * signs, trace)


def _partial(rows: DataFrame, length: int, add: Callable, finish: Callable) -> DataFrame:
    """One row (part) of every partition with vectors: add(state, x) for every batch's integers, then finish(state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in slices(batches, ROWS):
            vectors, _ = flat_vectors(batch["v"], length)
            if len(vectors):
                state = add(state, integers(vectors))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([finish(state)], pa.binary())], ["part"])

    return rows.select("v").mapInArrow(run, "part binary")


def _moments(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    values = np.frombuffer(data, np.float64, offset=8)
    k = int((np.sqrt(1 + 4 * len(values)) - 1) / 2)
    return struct.unpack_from("<q", data)[0], values[:k], values[k:].reshape(k, k)


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and sum of centred products of two sets of rows together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(rows: DataFrame) -> tuple[Whitening, float] | None:
    """The whitening of all of `rows` (a column v) and its identity error; None where nothing can be whitened."""
    good = F.when(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.size("v"))
    common = rows.groupBy(good.alias("length")).agg(F.count("*").alias("n")).filter("length > 0").orderBy(F.desc("n"), F.desc("length")).first()
    if common is None:
        return None
    length = common["length"]

    def add_sums(state, x):
        count, total = state or (0, np.zeros(length, object))
        high, low = x >> 31, x & ((1 << 31) - 1)  # sums of a block's halves fit 64 bits
        return count + len(x), total + high.sum(0).astype(object) * (1 << 31) + low.sum(0).astype(object)

    n, total = _unpacked(_merged(_partial(rows, length, add_sums, lambda s: _packed(*s)), _added))
    shift = np.array([(2 * int(t) + n) // (2 * n) for t in total], np.int64)
    rest = np.array([int(t) - n * int(m) for t, m in zip(total, shift, strict=True)], object)

    def add_products(state, x):
        count, products = state or (0, np.zeros((length, length), object))
        return count + len(x), products + gram(x - shift)

    products = _unpacked(_merged(_partial(rows, length, add_products, lambda s: _packed(*s)), _added))[1].reshape(length, length)
    found = decomposed(n, shift, rest, products)
    if not len(found.values):
        return None

    def add_moments(state, x):
        z = found.whitened(x)
        mean = z.mean(0)
        new = len(z), mean, (z - mean).T @ (z - mean)
        return _joined(state, new) if state else new

    def merge_moments(parts: list[bytes]) -> bytes:
        out = _moments(parts[0])
        for part in parts[1:]:
            out = _joined(out, _moments(part))
        return pack_moments(out)

    pack_moments = lambda s: struct.pack("<q", s[0]) + s[1].tobytes() + s[2].tobytes()
    count, _, squares = _moments(_merged(_partial(rows, length, add_moments, pack_moments), merge_moments))
    return found, float(np.abs(squares / count - np.eye(len(squares))).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The id, component, n, deviation, whitened, explained, identity_error and deviation_wide of every row and component."""
    kind = rows.schema[id_column].dataType.simpleString()
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    fitted = fit(rows)
    names = [id_column, *(x.split()[0] for x in RESULT.split(", "))]
    if fitted is None:
        return rows.sparkSession.createDataFrame([], f"`{id_column}` {kind}, {RESULT}")
    found, error = fitted
    k = len(found.values)
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            vectors, places = flat_vectors(batch["v"], found.length)
            if not len(vectors):
                continue
            x = integers(vectors)
            exact = found.deviations(x)
            count, each = len(x), np.repeat(np.arange(len(x)), k)
            narrow = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(pa.array(each))
            wide = pa.array([d if d < 10**38 else None for d in exact], pa.decimal128(38, 0)).take(pa.array(each))
            columns = [batch["id"].take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, found.n, np.int64)), narrow]
            columns += [pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)), wide]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"`{id_column}` {kind}, {RESULT}")


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
