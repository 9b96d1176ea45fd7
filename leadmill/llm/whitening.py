"""Whitening of embeddings with an exact covariance: digit-slice GEMM.

1. One pass gives each dimension's sum of the integers ``x = floor(64 * c) + 1000000``, exactly.
2. A second pass centres them without rounding, ``y = n * x - S``, splits ``y`` into signed limbs of
   ``LIMB`` bits and multiplies all limbs of ``ROWS`` vectors by each other in one float64 product: a
   limb product is under ``2 ** (2 * LIMB)`` and a sum of ``ROWS`` of them under ``2 ** 53``, so BLAS
   rounds nothing. Products are recombined as big integers inside the task; tasks give two decimal
   digits of base ``10 ** 30`` for each pair of dimensions, which Spark sums.
3. The d x d sums meet on the driver, which divides by ``n ** 3`` (correctly rounded) and decomposes.
4. A third pass projects each vector; a fourth takes the covariance of what the third gives.

What reaches the driver is d sums, d * d sums and k * k sums, whatever the number of vectors.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out.
Vectors of a length other than the most frequent one (the longest of several) are left out. Entries
beyond ``2 ** 62 / 64`` count as that. Null and repeated ids are rows like others. A component whose
variance is under ``1e-13`` of the largest has no direction of its own and is left out, so equal
vectors, or a single one, give no rows. A deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB, ROWS = 20, 4096
SHIFT = 1_000_000
COMPONENTS = 32
_LARGEST = float(1 << 62)
_BASE = 10**30


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose list has entries, all of them finite numbers; their lengths; their entries end to end."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)  # null lists have no entries here
    fine = np.isfinite(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False))
    wrong = np.zeros(len(lengths), dtype=np.int64)
    np.add.at(wrong, np.repeat(np.arange(len(lengths)), lengths)[~fine], 1)
    good = (lengths > 0) & (wrong == 0)
    return np.flatnonzero(good), lengths[good], flat.to_numpy(zero_copy_only=False)[np.repeat(good, lengths)]


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a finite vector of ``dim`` entries, and these vectors."""
    rows, lengths, flat = finite_vectors(column)
    return rows[lengths == dim], flat[np.repeat(lengths == dim, lengths)].reshape(-1, dim)


def integers(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(64 * entries), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` without rounding: longs where they suffice, else Python's integers."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of LIMB bits, lowest first, as float64."""
    sign, rest = np.where(y < 0, -1, 1), abs(y)
    out = []
    while rest.any():
        out.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
        rest = rest >> LIMB
    return out or [np.zeros(y.shape)]


def gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` as big integers, from float64 products that are all exact."""
    dim, total = y.shape[1], None
    for low in range(0, len(y), ROWS):
        parts = limbs(y[low : low + ROWS])
        product = np.hstack(parts)
        product = (product.T @ product).astype(np.int64)
        whole = np.zeros((dim, dim), dtype=object)
        for i in range(len(parts)):
            for j in range(len(parts)):
                whole += product[i * dim : (i + 1) * dim, j * dim : (j + 1) * dim].astype(object) << (LIMB * (i + j))
        total = whole if total is None else total + whole
    return np.zeros((dim, dim), dtype=object) if total is None else total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        _, lengths, _ = finite_vectors(batch.column(0))
        for dim in np.unique(lengths).tolist():
            _, vectors = matrix(batch.column(0), dim)
            x = integers(vectors)
            count, total = held.get(dim, (0, np.zeros(dim, dtype=object)))
            held[dim] = count + len(x), total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0)
    for dim, (count, total) in held.items():
        yield _digits(np.full(dim, dim), np.arange(dim), total, count)


def _digits(a, b, values, count: int) -> pa.RecordBatch:
    """Rows (a, b, count, high, low): big integers as two decimals of base 10 ** 30."""
    high = [int(v) // _BASE for v in values]
    low = [int(v) % _BASE for v in values]
    whole = lambda v: pa.array(v, pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([count] * len(high), pa.int64()), whole(high), whole(low)], names=["a", "b", "count", "high", "low"])


_DIGITS = "a int, b int, count long, high decimal(38,0), low decimal(38,0)"


def _merged(digits: DataFrame) -> list[tuple[int, int, int, int]]:
    """(a, b, count, value) over all tasks; as many rows as pairs of dimensions."""
    rows = digits.groupBy("a", "b").agg(F.sum("count").alias("count"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(r["a"], r["b"], r["count"], int(r["high"]) * _BASE + int(r["low"])) for r in rows]


def _products(dim: int, n: int, sums: list[int]):
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            _, vectors = matrix(batch.column(0), dim)
            total = total + gram(centred(integers(vectors), n, sums))
        yield _digits(*upper, total[upper], 0)

    return run


@dataclass
class Whitening:
    """``n`` vectors of ``dim`` entries with sums ``sums``; row k of ``axes`` is the k-th component."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of all vectors with finite entries; None without any."""
    vectors = embeddings.select(F.col(column).alias("v"))
    by_length: dict[int, dict[int, tuple[int, int]]] = {}
    for dim, i, count, value in _merged(vectors.mapInArrow(_sums, _DIGITS)):
        by_length.setdefault(dim, {})[i] = count, value
    if not by_length:
        return None
    dim = max(by_length, key=lambda k: (by_length[k][0][0], k))
    n, sums = by_length[dim][0][0], [by_length[dim][i][1] for i in range(dim)]
    covariance = np.zeros((dim, dim))
    for i, j, _, value in _merged(vectors.mapInArrow(_products(dim, n, sums), _DIGITS)):
        covariance[i, j] = covariance[j, i] = value / n**3  # integers, so correctly rounded
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes.T[::-1]
    axes = axes * np.where(axes[np.arange(dim), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    shown = [k for k in range(min(components, dim)) if values[k] > 1e-13 * values[0]]
    trace = sum(covariance[i, i] for i in range(dim))
    return Whitening(dim, n, sums, axes[shown], values[shown], values[shown] / trace if trace else values[shown])


def _squares(y: np.ndarray) -> list[int | None]:
    """Each row's sum of squares, exact; None beyond a long."""
    if y.dtype != object and (not len(y) or y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63):
        return (y * y).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1).tolist()]


def _project(w: Whitening, y: np.ndarray) -> np.ndarray:
    return (y / w.n).astype(np.float64) @ (w.axes / np.sqrt(w.values)[:, None]).T


def _whiten(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = matrix(batch.column(1), w.dim)
            y = centred(integers(vectors), w.n, w.sums)
            white = _project(w, y)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), max(1, white.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(_squares(y), pa.int64()), listed], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, w: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, deviation and the array ``whitened`` for each row with a finite vector of the fitted length."""
    kind = embeddings.schema[key].dataType.simpleString()
    return embeddings.select(F.col(key).alias("vec_id"), F.col(column).alias("v")).mapInArrow(_whiten(w), f"vec_id {kind}, deviation long, whitened array<double>")


def _second_moments(w: Whitening):
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            _, vectors = matrix(batch.column(0), w.dim)
            white = _project(w, centred(integers(vectors), w.n, w.sums))
            total, first = total + white.T @ white, first + white.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.full(k, -1)), pa.int32()), pa.array(np.append(j, np.arange(k)), pa.int32()), pa.array(np.append(total[i, j], first))], names=["a", "b", "value"])

    return run


def identity_error(embeddings: DataFrame, w: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all rows.

    Vectors are centred as integers before anything is multiplied, so the whitened ones' mean is zero
    but for the rounding of their sum, whose square is taken off as well."""
    k = len(w.values)
    rows = embeddings.select(F.col(column).alias("v")).mapInArrow(_second_moments(w), "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value")).collect()
    mean = {r["b"]: r["value"] / w.n for r in rows if r["a"] < 0}
    return max((abs(r["value"] / w.n - mean[r["a"]] * mean[r["b"]] - (r["a"] == r["b"])) for r in rows if r["a"] >= 0), default=0.0) if k else 0.0
