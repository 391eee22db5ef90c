"""Whitening of embeddings, from exact cross-products of bit-sliced integers.

Entries become integers. In each block of rows a dimension is shifted to its least entry, and the bits of what is left
are packed across the rows, 64 rows a word: plane a of dimension i. The sum of products of two dimensions is then the
sum of 2^(a+b) times the number of ones that planes a and b have in common, which is exact. A further dimension of ones
gives the number of rows and the sums in the same way, and with these the shifts are undone. Blocks are added up as
integers of any size, the covariance is centred as integers, and only then becomes floating point.

What comes to the driver is one matrix of dimensions by dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
#: An entry as large as this has no long; its row is left out as one with an infinite entry is.
LARGEST = float(2**51)
#: Rows of a block, and entries.
ROWS, ENTRIES = 1 << 16, 1 << 23
#: Sums go through Spark as numbers of so many digits of so many bits: they add up without overflow over 2^31 blocks.
LIMBS, LIMB = 7, 32


def _planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block (rows x dimensions): packed bit planes, each plane's dimension and bit, the dimensions' shifts."""
    low = x.min(axis=0)
    rest = np.ascontiguousarray((x - low).T)
    packed, dims, bits = [], [], []
    for i, row in enumerate(rest):
        for a in range(int(row.max()).bit_length()):
            ones = np.packbits((row >> a & 1).astype(np.uint8))
            packed.append(np.pad(ones, (0, -len(ones) % 8)).view(np.uint64))
            dims.append(i)
            bits.append(a)
    words = -(-len(x) // 64)
    return np.array(packed, np.uint64).reshape(-1, words), np.array(dims, np.int64), np.array(bits, np.int64), low


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``x`` (long), with a column of ones before them, as Python integers."""
    x = np.column_stack([np.zeros(len(x), np.int64), x])
    planes, dims, bits, low = _planes(x)
    ones = np.packbits(np.ones(len(x), np.uint8))
    planes = np.concatenate([np.pad(ones, (0, -len(ones) % 8)).view(np.uint64)[None, :], planes])
    dims, bits = np.r_[0, dims], np.r_[0, bits]
    d = x.shape[1]
    total = np.zeros((d, d), object)
    starts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]])
    for p in range(len(planes)):
        i = int(dims[p])
        first = int(np.searchsorted(dims, i))  # planes of this dimension and later ones
        later = starts[starts >= first]
        count, weight = np.bitwise_count(planes[p] & planes[first:]).sum(axis=1, dtype=np.int64), bits[first:] + bits[p]
        if int(weight.max()) + len(x).bit_length() < 62:
            sums = np.add.reduceat(count << weight, later - first)
        else:  # very wide ranges
            sums = np.add.reduceat(count.astype(object) * 2 ** weight.astype(object), later - first)
        total[i, dims[later]] += sums.astype(object)
    m = low.astype(object)
    for i in range(1, d):
        for j in range(i, d):
            total[i, j] += m[i] * total[0, j] + m[j] * total[0, i] + m[i] * m[j] * total[0, 0]
    total[0, 1:] += m[1:] * total[0, 0]
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d) + SHIFT


def _limbs(v: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _sums(batches, d: int):
    """Cross-products of a task's rows, block by block."""
    total, held, rows = None, [], 0
    most = max(64, min(ROWS, ENTRIES // d // 64 * 64))

    def add(total, x):
        new = cross_products(x)
        return new if total is None else total + new

    for batch in batches:
        x = _matrix(batch.column(0), d)
        for a in range(0, len(x), most):
            held.append(x[a : a + most])
            rows += len(held[-1])
            if rows >= most:
                x_all = np.concatenate(held)
                total, held = add(total, x_all[:most]), [x_all[most:]]
                rows = len(held[0])
    if rows:
        total = add(total, np.concatenate(held))
    if total is None:
        return
    for i in range(d + 1):
        limbs = np.array([_limbs(int(v)) for v in total[i, i:]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([i] * len(limbs), pa.int32()), pa.array(range(i, d + 1), pa.int32()), *(pa.array(limbs[:, k]) for k in range(LIMBS))], ["i", "j", *(f"l{k}" for k in range(LIMBS))])


def _squares(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows, through digits of 24 bits."""
    high, rest = deviations >> 48, deviations & ((1 << 48) - 1)
    digits = [rest & 0xFFFFFF, rest >> 24, high]
    sums = {}
    for a in range(3):
        for b in range(a, 3):
            sums[a + b] = sums.get(a + b, 0) + (1 + (a != b)) * np.einsum("ij,ij->i", digits[a], digits[b]).astype(object)
    return sum(v * (1 << 24 * k) for k, v in sums.items()).tolist()


class Whitening:
    """What a fit holds: number of rows, sums, components (columns), their eigenvalues, trace."""

    def __init__(self, products: dict[tuple[int, int], int], d: int, most: int):
        n = self.n = products[0, 0]
        self.d, self.sums = d, [products[0, j] for j in range(1, d + 1)]
        centred = np.zeros((d, d))
        for (i, j), v in products.items():
            if i:
                exact = n * v - self.sums[i - 1] * self.sums[j - 1]
                centred[i - 1, j - 1] = centred[j - 1, i - 1] = exact / (n * n)
        self.trace = sum(n * products[i, i] - self.sums[i - 1] ** 2 for i in range(1, d + 1)) / (n * n)
        values, vectors = eigen(centred)
        k = min(most, d)
        self.values, self.vectors = values[:k], vectors[:, :k]
        self.proper = self.values > 0
        self.scaled = np.where(self.proper, self.vectors / np.sqrt(np.where(self.proper, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as long where that is certain to fit, else as Python integers."""
        reach = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums))
        if reach < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.scaled


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance. Dimensions that don't vary are set apart, with
    eigenvalues of zero; where the others' variances differ by so much that eigh would lose the small ones, Jacobi
    rotations are used, which keep relative precision. An eigenvalue that is rounding error of its matrix counts as zero."""
    size = np.sqrt(np.diag(v))
    some = np.flatnonzero(size > 0)
    d, k = len(v), len(some)
    values, vectors = np.zeros(d), np.zeros((d, d))
    rest = np.setdiff1d(np.arange(d), some)
    vectors[rest, np.arange(k, d)] = 1
    if k:
        part = v[np.ix_(some, some)]
        graded = size[some].max() > 1e4 * size[some].min()
        e, w = _jacobi(part) if graded else np.linalg.eigh(part)
        order = np.argsort(-e, kind="stable")
        e, w = e[order], w[:, order]
        noise = np.abs(w.T * size[some]).sum(axis=1) ** 2 if graded else np.full(k, e[0])
        values[:k] = np.where(e > 4 * k * np.finfo(float).eps * noise, e, 0)
        vectors[np.ix_(some, np.arange(k))] = w
    return values, vectors


def _jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Cyclic Jacobi rotations until every off-diagonal entry is rounding error of its two diagonal ones."""
    a, w, eps = v.copy(), np.eye(len(v)), np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) > eps * np.sqrt(abs(a[i, i] * a[j, j])):
                    turned = True
                    theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                    t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                    c = 1 / np.hypot(t, 1)
                    s = t * c
                    low, high = a[i, i] - t * a[i, j], a[j, j] + t * a[i, j]
                    ri, rj = a[i].copy(), a[j].copy()
                    a[i], a[j] = c * ri - s * rj, s * ri + c * rj
                    a[:, i], a[:, j] = a[i], a[j]
                    a[i, i], a[j, j], a[i, j], a[j, i] = low, high, 0, 0
                    wi, wj = w[:, i].copy(), w[:, j].copy()
                    w[:, i], w[:, j] = c * wi - s * wj, s * wi + c * wj
        if not turned:
            break
    return np.diag(a).copy(), w


def _moments(batches, fit: Whitening):
    """Sums of products of whitened values of a task's rows."""
    k = int(fit.proper.sum())
    total = np.zeros((k + 1, k + 1))
    for batch in batches:
        w = fit.whitened(fit.deviations(_matrix(batch.column(0), fit.d)))[:, fit.proper]
        w = np.column_stack([np.ones(len(w)), w])
        total += w.T @ w
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])


def _rows(batches, fit: Whitening, identity_error: float | None):
    k = len(fit.values)
    explained = [float(e / fit.trace) if fit.trace else None for e in fit.values]
    for batch in batches:
        x = _matrix(batch.column(1), fit.d)
        deviations = fit.deviations(x)
        w = fit.whitened(deviations)
        squares = _squares(deviations) if deviations.dtype == np.int64 else (deviations**2).sum(axis=1).tolist()
        rows = len(x)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, fit.n), pa.int64()),
                pa.array([s if s < 1 << 63 else None for s in squares for _ in range(k)], pa.int64()),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(explained * rows, pa.float64()),
                pa.array([identity_error] * (rows * k), pa.float64()),
                pa.array([str(s) for s in squares for _ in range(k)], pa.string()),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
        )


def usable(vectors: Column) -> Column:
    """Whether a vector has entries, all of them finite and within range."""
    return F.coalesce((F.size(vectors) > 0) & F.forall(vectors, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """For each usable row and each of the first ``components`` principal components: vec_id, component, n, deviation,
    whitened, explained, identity_error, deviation_digits.

    Rows with a null or empty vector, or a null, infinite or not-a-number entry or one of 2^51 or more, are left out, and so
    are those whose vector has not the most common number of entries (ties: the larger), as they lack entries.
    Repeated rows and rows without a vec_id count and are returned like others. ``deviation`` is null where the exact value
    is beyond a long; ``deviation_digits`` always has it. A component along which nothing varies has no
    whitened values (null) and takes no part in identity_error; that is null where nothing varies at all, and so is
    ``explained``. identity_error is measured on the whitened values themselves. An empty table gives an empty table;
    other columns are ignored.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(usable(F.col("x")))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return table.sparkSession.createDataFrame([], schema)
    d = length["d"]
    rows = rows.where(F.size("x") == d)
    sums = rows.select("x").mapInArrow(lambda b: _sums(b, d), ", ".join(["i int", "j int", *(f"l{k} long" for k in range(LIMBS))]))
    found = sums.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    fit = Whitening({(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in found}, d, components)
    error = None
    if fit.proper.any():
        k = int(fit.proper.sum()) + 1
        moments = np.zeros((k, k))
        for r in rows.select("x").mapInArrow(lambda b: _moments(b, fit), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            moments[r["i"], r["j"]] = r["v"] / fit.n
        error = float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(k - 1)).max())
    return rows.mapInArrow(lambda b: _rows(b, fit, error), schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings``, whitened along eight components fitted to all of them."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
