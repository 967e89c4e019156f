"""Embedding whitening: exact cross-products of integer vectors from bit planes, eigenvectors, whitened coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq.session import release, written

SCALE, BASE = 64, 1_000_000
COMPONENTS = 16
#: Vectors whose bit planes are in memory at once: a multiple of 64.
BLOCK = 4096
#: x beyond 2**52 from BASE counts as that far: a double has no finer integers there.
MOST = float(1 << 52)
#: Exact sums are carried as high * 2**LIMB + low.
LIMB = 64


def integers(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x, the integer vector of each row: floor(SCALE * entry) + BASE. Rows whose vector is null, holds null, NaN or an infinity are
    dropped, and so are those of another length than most rows have (of equally common ones, the largest) or of none."""
    entry = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * SCALE))).cast("long") + BASE)
    rows = written(embeddings.where(sound).select(F.col(key).alias("key"), x.alias("x")), "integers")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (usual[0]["d"] if usual else 0))


def matrices(batches: Iterator[pa.RecordBatch], d: int, most: int = BLOCK) -> Iterator[np.ndarray]:
    """The x of record batches, as arrays of at most `most` rows."""
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for i in range(0, len(flat), most):
            yield flat[i : i + most]


def planes(y: np.ndarray) -> np.ndarray:
    """(d, planes, words): bit b of every row's non-negative integers of a dimension, packed in 64-bit words."""
    n, d = y.shape
    wide = max(1, int(y.max()).bit_length())
    padded = np.zeros((d, wide, -(-n // 64) * 64), np.uint8)
    for b in range(wide):
        padded[:, b, :n] = (y.T >> b) & 1
    return np.packbits(padded, axis=2, bitorder="little").view(np.uint64)


def scatter(x: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """(sums of x_i * x_j for i <= j, sums of x_i), exact, of a block of integer vectors less BASE.

    Each dimension is shifted by its least value, so that few bit planes remain. The product of two
    dimensions is the sum over pairs of planes of 2**(a + b) times the number of rows that have both bits; the shifts are put back in whole numbers.
    """
    x = x - BASE
    low = x.min(axis=0)
    packed = planes(x - low)
    d, wide, words = packed.shape
    n, shift = len(x), [int(v) for v in low]
    # weights of a + b: few distinct ones, summed as integers of any size
    plain = [sum(int(c) << b for b, c in enumerate(np.bitwise_count(packed[i]).sum(axis=1, dtype=np.int64))) for i in range(d)]
    products = [[0] * d for _ in range(d)]
    for i in range(d):
        counts = np.zeros((d - i, wide, wide), np.int64)
        for a in range(wide):
            if packed[i, a].any():
                counts[:, a] = np.bitwise_count(packed[i:] & packed[i, a]).sum(axis=2, dtype=np.int64)
        for j in range(i, d):
            total = 0
            for a in range(wide):
                for b in range(wide):
                    total += int(counts[j - i, a, b]) << (a + b)
            products[i][j] = total + shift[i] * plain[j] + shift[j] * plain[i] + n * shift[i] * shift[j]
    return products, [p + n * s for p, s in zip(plain, shift, strict=True)]


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the vectors x less BASE of fit, exact. The driver gets (d + 1) * (d + 2) / 2 numbers.

    Each task sums its blocks and gives one row for each pair of dimensions; Spark sums them as decimals in two limbs.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = [[0] * d for _ in range(d)], [0] * d, 0
        for x in matrices(batches, d):
            p, s = scatter(x)
            n += len(x)
            for i in range(d):
                sums[i] += s[i]
                for j in range(i, d):
                    products[i][j] += p[i][j]
        if n:
            cells = [(i, j, products[i][j]) for i in range(d) for j in range(i, d)] + [(-1, i, sums[i]) for i in range(d)] + [(-1, -1, n)]
            high, low = [v >> LIMB for _, _, v in cells], [v & (1 << LIMB) - 1 for _, _, v in cells]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array(high, kind), pa.array(low, kind)], names=["i", "j", "high", "low"])

    parts = fit.select("x").mapInArrow(scan, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n = found.get((-1, -1), 0)
    sums = [found.get((-1, i), 0) for i in range(d)]
    return n, sums, [[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]


def components_of(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; unit eigenvectors as columns; trace) of the covariance, which is centred in whole numbers: n * products - sums * sums.

    Eigenvalues that are zero but for rounding are left out.
    """
    d = len(sums)
    # a quotient of whole numbers is rounded once
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps
    k = min(most, int(real.sum()))
    return values[:k], vectors[:, :k], math.fsum(np.diag(v))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each row of embeddings that integers() keeps and each
    component up to `components`.

    The covariance is that of the distinct integer vectors, n in number, whose cross-products are exact sums of popcounts of
    bit planes. deviation: the sum over dimensions of (n * x - S)**2, exact, null beyond a long. whitened: x - S / n on the component,
    over the root of its eigenvalue. explained: the eigenvalue's share of the trace. identity_error: the largest entry of whitened's
    covariance over the distinct vectors, less the identity, by a second pass over them.

    Components of eigenvalue zero (fewer distinct vectors than dimensions, constant dimensions), or too near to it beside the largest for
    double precision, are left out: nothing can be whitened there. No or one distinct vector: no rows. Repeated rows: each gets its own. Null ids stay. Other columns are ignored. What reaches the driver
    and each task besides rows is of the vectors' length squared.
    """
    rows = integers(embeddings, key, vector)
    kind = dict(embeddings.dtypes)[key]
    out = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = written(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    first = fit.select(F.size("x").alias("d")).limit(1).collect()
    n, values = 0, np.zeros(0)
    if first:
        d = first[0]["d"]
        n, sums, products = moments(fit, d)
        values, vectors, trace = components_of(n, sums, products, components)
    k = len(values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], out)
    mean, spread = np.array(sums, object), vectors / np.sqrt(values)
    big = max(abs(int(s)) for s in sums)

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs if they hold it, else as Python's integers."""
        x = x - BASE
        fits = max(int(np.abs(x).max()), 1) * n + big < 1 << 62
        return x * n - mean.astype(np.int64) if fits else x.astype(object) * n - mean

    def whitened(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / n) @ spread

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for x in matrices(batches, d):
            w = whitened(centred(x))
            total, seen = total + w.T @ w, True
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    parts = fit.mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    error = max(abs(r["s"] / n - (r["i"] == r["j"])) for r in parts)
    release(fit)
    explained = values / trace

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("key"), 0
            for x in matrices([batch], d):
                y = centred(x)
                deviation = exact_squares(y)
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(np.repeat(np.arange(at, at + m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(whitened(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m

    return rows.mapInArrow(scan, out)


def exact_squares(y: np.ndarray) -> list[int | None]:
    """The sum of each row's squares, None beyond a long."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    found = (y.astype(object) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in found]
