"""Whitening of embeddings: distributed exact covariance, and its leading components by classical steps.

Entries become integers x = floor(1024 c) + 100000. One pass sums x; a second one sums products of entries centred by
the rounded mean, and what rounding left is taken off afterwards (at most 1/4 an entry of the covariance). All sums are
integers, so that the covariance is the same however rows are dealt and whichever executor is lost. The covariance, which is bounded
by the number of dimensions, is tridiagonalised by Householder reflections; the leading eigenvalues come from bisection
by Sturm counts, the components from inverse iteration in which those of close eigenvalues are made orthogonal again.
The projection is broadcast to all rows.

Rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors of another length than most have
no place in the covariance and are left out, too (of equally frequent lengths the greatest counts). Entries so large that
1024 c leaves +-2^52 are taken as that bound. Equal rows and null ids get rows like all others. Components with an
eigenvalue that rounding can't tell from zero can't be whitened and are left out: fewer dimensions, equal rows or one row
alone give fewer components or none. Empty tables give empty results; extra columns are not read. deviation is null
where it doesn't fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import settle

SCALE, SHIFT = 1024, 100_000
BOUND = float(1 << 52)
#: Integers up to this are exact in doubles.
EXACT = float(1 << 53)
WHOLE = "decimal(38,0)"


# ---- passes over the rows


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def _matrices(batches: Iterator, column: str = "vector") -> Iterator[tuple]:
    """batch, places of rows, their entries x as a matrix of doubles that are integers: one for each length in a batch."""
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(column)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            c = flat[starts[at][:, None] + np.arange(d)].astype(np.float64)
            yield batch, at, np.clip(np.floor(SCALE * c), -BOUND, BOUND) + SHIFT


def _whole(numbers) -> list:
    import decimal

    return [decimal.Decimal(int(x)) for x in numbers]


def _added(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    return [int(v) for v in x.astype(np.int64).sum(0)] if len(x) < 512 else [sum(p) for p in zip(*(_added(x[k : k + 511]) for k in range(0, len(x), 511)))]


def moments(rows: DataFrame) -> DataFrame:
    """d, i, n, s: for each length of vectors and dimension the number of rows and the sum of x."""

    def partial(batches):
        import pyarrow as pa

        sums: dict[int, list] = {}
        for _, at, x in _matrices(batches):
            old = sums.get(x.shape[1], [0, [0] * x.shape[1]])
            sums[x.shape[1]] = [old[0] + len(at), [a + b for a, b in zip(old[1], _added(x))]]
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(_whole(s), pa.decimal128(38, 0))], names=["d", "i", "n", "s"])

    return rows.select("vector").mapInArrow(partial, f"d int, i int, n long, s {WHOLE}").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast(WHOLE).alias("s"))


def products(rows: DataFrame, centre: list[int]) -> DataFrame:
    """i, j, s: exact sums of (x_i - centre_i)(x_j - centre_j) for i >= j."""
    middle = np.array(centre, dtype=np.float64)

    def add(y: np.ndarray, total: np.ndarray) -> np.ndarray:
        """total plus y'y: by doubles where no sum leaves the integers they hold, by halves of the rows else, by Python's integers in the end."""
        if not len(y):
            return total
        top = np.abs(y).max()
        if top * top * len(y) < EXACT:
            return total + (y.T @ y).astype(np.int64).astype(object)
        if len(y) > 1:
            return add(y[len(y) // 2 :], add(y[: len(y) // 2], total))
        one = np.array([int(v) for v in y[0]], dtype=object)
        return total + one[:, None] * one[None, :]

    def partial(batches):
        import pyarrow as pa

        d = len(middle)
        total = np.zeros((d, d), dtype=object)
        for _, _, x in _matrices(batches):
            if x.shape[1] == d:
                total = add(x - middle, total)
        i, j = np.tril_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(_whole(total[i, j]), pa.decimal128(38, 0))], names=["i", "j", "s"])

    return rows.select("vector").mapInArrow(partial, f"i int, j int, s {WHOLE}").groupBy("i", "j").agg(F.sum("s").cast(WHOLE).alias("s"))


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, sums S of x by dimension, covariance (divisor n) of the vectors of the most frequent length."""
    found = moments(rows)
    lengths = found.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1)  # one row
    sums = sorted((r.i, r.n, int(r.s)) for r in found.join(F.broadcast(lengths.select("d")), "d", "left_semi").collect())  # a row for each dimension
    if not sums:
        return 0, [], np.zeros((0, 0))
    n, s = sums[0][1], [x for _, _, x in sums]
    centre = [(2 * x + n) // (2 * n) for x in s]
    rest = np.array([(x - n * m) / n for x, m in zip(s, centre)])
    v = np.zeros((len(s), len(s)))
    for r in products(rows, centre).collect():  # bounded by the square of the dimensions
        v[r.i, r.j] = v[r.j, r.i] = int(r.s) / n
    return n, s, v - rest[:, None] * rest[None, :]


# ---- leading components of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal and the unit vectors of the Householder reflections that lead there."""
    a, reflections = matrix.astype(np.float64).copy(), []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        if norm > 0:
            u[0] += np.copysign(norm, u[0])
            u /= np.linalg.norm(u)
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            w = 2 * p - 2 * (u @ p) * u
            block -= np.outer(u, w) + np.outer(w, u)
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each number."""
    tiny = np.finfo(float).tiny * max(1.0, 4 * (second**2).max(initial=0.0))
    count, pivot = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for k, a in enumerate(diagonal):
        pivot = a - at - (second[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """The greatest eigenvalues in falling order, by bisection until no double lies between the bounds."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], second])) + np.abs(np.concatenate([second, [0.0]]))
    slack = 4 * np.finfo(float).eps * (np.abs(diagonal).max() + reach.max()) + np.finfo(float).tiny
    wanted = d - 1 - np.arange(min(most, d))  # places from the smallest
    low, high = np.full(len(wanted), (diagonal - reach).min() - slack), np.full(len(wanted), (diagonal + reach).max() + slack)
    while True:
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high)).any():
            return high
        under = below(diagonal, second, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solve(diagonal: np.ndarray, second: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; pivots of zero become tiny."""
    d = len(diagonal)
    a, up, over, b = diagonal - shift, np.append(second, 0.0), np.zeros(d), b.copy()
    for k in range(d - 1):
        low, nxt, beyond = second[k], a[k + 1], up[k + 1]
        if abs(low) > abs(a[k]):  # the next row becomes the pivot's
            a[k], low = low, a[k]
            up[k], nxt = nxt, up[k]
            over[k], beyond = beyond, 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        a[k] = a[k] if abs(a[k]) > tiny else tiny
        f = low / a[k]
        a[k + 1], up[k + 1] = nxt - f * up[k], beyond - f * over[k]
        b[k + 1] -= f * b[k]
    a[d - 1] = a[d - 1] if abs(a[d - 1]) > tiny else tiny
    x = np.zeros(d + 2)
    for k in range(d - 1, -1, -1):
        x[k] = (b[k] - up[k] * x[k + 1] - over[k] * x[k + 2]) / a[k]
        if (size := abs(x[k])) > 1e200:  # only the direction matters
            x, b = x / size, b / size
    return x[:d]


def components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, and their unit eigenvectors as columns."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    diagonal, second, reflections = tridiagonal(matrix)
    values, scale = leading_values(diagonal, second, most), max(np.abs(diagonal).max(), np.abs(second).max(initial=0.0), np.finfo(float).tiny)
    rng, d = np.random.default_rng(12), len(diagonal)
    out = np.zeros((d, len(values)))
    for k, value in enumerate(values):
        near = [j for j in range(k) if values[j] - value <= 1e-3 * scale]
        shift = value + 2 * np.finfo(float).eps * scale * sum(values[j] - value <= 8 * np.finfo(float).eps * scale for j in near)
        x = rng.normal(size=d)
        for _ in range(6):
            x = _solve(diagonal, second, shift, x / np.abs(x).max(), np.finfo(float).eps * scale)
            x /= np.abs(x).max()
            for _ in range(2):
                for j in near:
                    x -= (out[:, j] @ x) * out[:, j]
            x /= np.linalg.norm(x)
        out[:, k] = x
    for k in reversed(range(len(reflections))):
        u = reflections[k]
        out[k + 1 :] -= 2 * np.outer(u, u @ out[k + 1 :])
    return values, out / np.linalg.norm(out, axis=0)


# ---- the operator


def whiten(embeddings: DataFrame, most: int = 8, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable row and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(f"`{ident}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    n, sums, v = covariance(rows)
    values, vectors = components(v, most)
    sound = values > len(v) * np.finfo(float).eps * max(values.max(initial=0.0), 1.0)
    values, vectors, trace = values[sound], vectors[:, sound], float(np.trace(v))
    shape = "vec_id long, deviation long, whitened array<double>"
    centre = [(2 * x + n) // (2 * n) for x in sums]
    plan = spark.sparkContext.broadcast((n, sums, np.array(centre, dtype=np.float64), np.array([(x - n * m) / max(n, 1) for x, m in zip(sums, centre)]), vectors / np.sqrt(values)))

    def project(batches):
        import pyarrow as pa

        n, sums, middle, rest, axes = plan.value
        d, k = axes.shape if sums else (0, 0)
        s = np.array(sums, dtype=object) if sums else None
        for batch, at, x in _matrices(batches):
            if x.shape[1] != d:
                continue
            y = x - middle
            off = n * (np.abs(y).max() + 1)
            if off * off * d < 2.0**62:
                far = n * y.astype(np.int64) - (s - n * np.array([int(m) for m in middle], dtype=object)).astype(np.int64)
                deviation = (far * far).sum(1).tolist()
            else:
                deviation = [q if (q := sum((n * int(e) - int(t)) ** 2 for e, t in zip(r, s))) < 1 << 63 else None for r in x]
            w = (y - rest) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)).cast(pa.int64()), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    done = settle(rows.mapInArrow(project, shape), "whitened")
    k = len(values)
    if k:
        means = done.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        cross = done.agg(*(F.avg((F.col("whitened")[i] - means[i]) * (F.col("whitened")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(cross, pairs))
    else:
        error = None
    explained = F.array(*(F.lit(float(x / trace)) for x in values)) if k else F.array().cast("array<double>")
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
