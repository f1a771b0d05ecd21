"""Whitening of embeddings: covariances by polarisation, from exact sums of squares.

Every component c becomes the whole number x = floor(64 c) + 1000000. The model is fitted on each
distinct vector once (n of them, with sums S per dimension). With y = n x - S, which is centred and
whole, the squares of y_i and of y_i + y_j are added up exactly for every dimension and every pair
of dimensions; their differences give all covariances, V_ij = (Q_ij - Q_i - Q_j) / (2 n^3), each
rounded once. An eigendecomposition of V gives the components.

The distinct vectors are found by a shuffle with partial aggregation, so a vector that is repeated
very often costs no more than any other. Tasks return sums only: their size is the square of the
dimension (``Limits.dimensions``) whatever the number of rows.

Defined cases: a row is left out if its vector is null, empty, holds a null or non-finite component,
or has another length than most distinct vectors have (ties: the longer). A component beyond
+-2^62 / 64 counts as that bound. Components of the covariance without variance (an eigenvalue that
is zero but for rounding) are left out, so one vector, or none, gives no rows; repeated rows are
each returned; a deviation beyond 64 bits is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm.common import ship

SCALE, SHIFT = 64.0, 1_000_000
DIGIT = 21
LIMB = 30  # bits of one part of an exact sum on its way through a shuffle
CHUNK = 1024  # rows whose pair sums are held at once


@dataclass(frozen=True)
class Limits:
    dimensions: int = 1024  # the sums of all pairs are gathered: half a million at this bound


@dataclass(frozen=True)
class Whitening:
    """The fitted transformation; ``sums`` are exact."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one unit eigenvector a row
    trace: float
    identity_error: float


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, x) of the vectors that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    most = F.lit(2.0**62)
    x = F.transform(
        vector, lambda c: F.floor(F.greatest(-most, F.least(most, c.cast("double") * SCALE))).cast("long") + F.lit(SHIFT).cast("long")
    )
    rows = df.where(F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False)))
    return rows.select(F.col(key).alias("_key"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds it, else in whole numbers of any size."""
    widest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    kind = np.int64 if widest < 2**61 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares down each column, of at most 2^20 rows."""
    if not len(y):
        return [0] * y.shape[1]
    top = int(np.abs(y).max())
    if y.dtype == object or top * top * len(y) < 2**63:
        return [int(v) for v in (y * y).sum(axis=0)]
    # digits of 21 bits: no sum of their products leaves 64 bits
    digits = []
    while top >> (DIGIT * (len(digits) + 1)):
        digits.append((y >> (DIGIT * len(digits))) & ((1 << DIGIT) - 1))
    digits.append(y >> (DIGIT * len(digits)))
    total = [0] * y.shape[1]
    for p, a in enumerate(digits):
        for q, b in enumerate(digits):
            total = [t + (int(v) << (DIGIT * (p + q))) for t, v in zip(total, (a * b).sum(axis=0))]
    return total


def column_sums(x: np.ndarray) -> list[int]:
    wide = int(np.abs(x).max(initial=0)) * len(x) >= 2**63
    return [int(v) for v in (x.astype(object) if wide else x).sum(axis=0)]


def pair_places(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions i <= j of every sum; i = j is the dimension itself."""
    return np.triu_indices(d)


def exact_sums(rows: DataFrame, width: int, of) -> list[int]:
    """Exact column sums over all rows of ``of(x)``, which adds up one chunk of vectors.

    Each task sends its sums in parts of 30 bits, so they add up in 64 bits over any number of tasks.
    """
    schema = pa.schema([("place", pa.int32()), ("limb", pa.int32()), ("part", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for part in parts:
            x = matrix(part.column("x"))
            for at in range(0, len(x), CHUNK):
                total = [a + b for a, b in zip(total, of(x[at : at + CHUNK]))]
        found = [(k, limb, value) for k, t in enumerate(total) for limb, value in limbs(t)]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    sums = rows.mapInArrow(run, "place int, limb int, part long").groupBy("place", "limb").agg(F.sum("part").alias("part"))
    total = [0] * width
    for r in sums.collect():
        total[r["place"]] += r["part"] << (LIMB * r["limb"])
    return total


def limbs(value: int) -> Iterable[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & ((1 << LIMB) - 1):
            yield k, sign * part
        value >>= LIMB
        k += 1


def fit(df: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding", limits: Limits = Limits()) -> Whitening | None:
    """None where no component has variance."""
    spark = df.sparkSession
    ship(spark)
    distinct = written(whole(df, key, vector).select("x").distinct(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    commonest = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None:
        return None
    d, n = commonest["d"], commonest["n"]
    if d > limits.dimensions:
        raise ValueError(f"vectors have {d} dimensions; Limits.dimensions is {limits.dimensions}")
    rows = distinct.where(F.size("x") == d)
    sums = tuple(exact_sums(rows, d, column_sums))
    i, j = pair_places(d)

    def squares(x: np.ndarray) -> list[int]:
        y = centred(x, n, sums)
        # the sum of a dimension with itself is the dimension's own square
        return [q for k in range(d) for q in square_sums(np.concatenate((y[:, k : k + 1], y[:, k : k + 1] + y[:, k + 1 :]), axis=1))]

    q = exact_sums(rows, len(i), squares)
    own = {a: v for a, b, v in zip(i, j, q) if a == b}
    cov = np.empty((d, d))
    for a, b, v in zip(i, j, q):
        # true division of whole numbers rounds once
        cov[a, b] = cov[b, a] = own[a] / n**3 if a == b else (v - own[a] - own[b]) / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors.T[::-1]
    kept = min(components, int((values > max(values[0], 0) * d * np.finfo(float).eps).sum()))
    if kept == 0:
        return None
    values, vectors = values[:kept].copy(), np.ascontiguousarray(vectors[:kept])
    error = identity_error(rows, n, sums, values, vectors)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)), error)


def projected(y: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal results in any batch."""
    z = (y / n).astype(np.float64)
    scaled = vectors / np.sqrt(values)[:, None]
    return np.stack([(z * axis).sum(axis=1) for axis in scaled], axis=1)


def identity_error(rows: DataFrame, n: int, sums: tuple[int, ...], values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the rows."""
    k = len(values)
    schema = pa.schema([("place", pa.int32()), ("part", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for part in parts:
            w = projected(centred(matrix(part.column("x")), n, sums), n, values, vectors)
            first += w.sum(axis=0)
            second += w.T @ w
        both = np.concatenate((first, second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], schema=schema)

    sums_of = np.zeros(k + k * k)
    for r in rows.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect():
        sums_of[r["place"]] = r["part"]
    mean, second = sums_of[:k] / n, sums_of[k:].reshape(k, k) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each component; nothing is shuffled."""
    spark = df.sparkSession
    ship(spark)
    if model is None:
        return spark.createDataFrame([], RESULT)
    d, k = len(model.sums), len(model.values)
    explained = model.values / model.trace
    schema = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
        + [(name, pa.float64()) for name in ("whitened", "explained", "identity_error")]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_part in parts:
            for at in range(0, whole_part.num_rows, CHUNK):
                part = whole_part.slice(at, CHUNK)
                rows = part.num_rows
                y = centred(matrix(part.column("x")), model.n, model.sums)
                deviation = [v if v < 2**63 else None for v in square_sums(y.T)]
                # Arrow's own repetition keeps ids that are null
                ids = part.column("_key").take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [
                    ids.cast(pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(projected(y, model.n, model.values, model.vectors).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return whole(df, key, vector).where(F.size("x") == d).mapInArrow(run, RESULT)
