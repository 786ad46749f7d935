"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

The scatter matrix is summed in whole numbers, its characteristic polynomial is found modulo many
primes by reduction to Hessenberg form, one prime a row of a Spark job, and put together by the
Chinese remainder theorem. All roots are real, so the sign changes of a shifted polynomial count
them exactly, and bisection isolates each one. Components come from inverse iteration in fixed-point
arithmetic of some hundred digits. What runs outside tasks depends on the number of dimensions only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

SCALE, SHIFT = 64, 1_000_000
LONG = (1 << 63) - 1
WIDEST = 1 << 62  # floor(64 * c) is held within these limits
LIMB, LIMBS = 40, 6
ROOT_BITS = 120  # an eigenvalue is known to this many bits
DIGIT_BITS = 60  # fixed-point bits beyond twice the root's


# --- whole-number sums ----------------------------------------------------------------------------


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 as longs; beyond 2**62 held there."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    out = np.clip(scaled, -float(WIDEST), float(WIDEST)).astype(np.int64)
    return out + SHIFT


def products(rows: np.ndarray) -> np.ndarray:
    """rows' * rows in whole numbers, as Python integers."""
    top = int(np.abs(rows).max(initial=0)) if rows.dtype != object else 1 << 62
    if top * top * max(1, len(rows)) < 1 << 53:
        floats = rows.astype(float)
        return (floats.T @ floats).astype(np.int64).astype(object)
    if top < 1 << 52:
        # Three digits to base 2**18, whose products are exact, a few rows at a time.
        total = np.zeros((rows.shape[1],) * 2, object)
        for at in range(0, len(rows), 1 << 14):
            part = rows[at : at + (1 << 14)]
            digits = [part & 0x3FFFF, (part >> 18) & 0x3FFFF, part >> 36]
            digits = [d.astype(float) for d in digits]
            for (i, a), (j, b) in itertools.product(enumerate(digits), repeat=2):
                total += (a.T @ b).astype(np.int64).astype(object) << (18 * (i + j))
        return total
    big = rows.astype(object)
    return big.T.dot(big)


def limbs(value: int) -> list[int]:
    """A whole number as digits to base 2**40, each with its sign: sums of many such rows stay exact."""
    sign, rest = (-1, -value) if value < 0 else (1, value)
    return [sign * ((rest >> (LIMB * k)) & ((1 << LIMB) - 1)) for k in range(LIMBS)]


def unlimbed(row) -> int:
    return sum(int(row[f"l{k}"]) << (LIMB * k) for k in range(LIMBS))


_LIMB_SCHEMA = ", ".join(f"l{k} bigint" for k in range(LIMBS))


def _matrices(batches: Iterator[pa.RecordBatch], d: int, most: int = 4096):
    """Keys and whole-number rows, a bounded number at a time."""
    most = max(1, min(most, (1 << 22) // d))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            flat = part.column("vector").flatten().to_numpy()
            yield part.column("key"), whole(flat).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """One row a dimension: its sum; and, as dimension -1, the number of rows."""
    totals, count = [0] * d, 0
    for _, rows in _matrices(batches, d):
        count += len(rows)
        high, low = rows >> 32, rows & 0xFFFFFFFF
        for j, (h, w) in enumerate(zip(high.sum(0).tolist(), low.sum(0).tolist())):
            totals[j] += (h << 32) + w
    yield _limb_rows([(-1, -1, count)] + [(j, j, t) for j, t in enumerate(totals)])


def _scatter(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[pa.RecordBatch]:
    """The task's part of the scatter around a whole-number centre, upper half."""
    d, total = len(centre), 0
    narrow = np.array(centre, np.int64)
    for _, rows in _matrices(batches, d):
        near = np.abs(rows).max(initial=0) < 1 << 61
        moved = rows - narrow if near else rows.astype(object) - np.array(centre, object)
        total = total + products(moved)
    if d and not isinstance(total, int):
        yield _limb_rows([(i, j, int(total[i, j])) for i in range(d) for j in range(i, d)])


def _limb_rows(entries: list[tuple[int, int, int]]) -> pa.RecordBatch:
    digits = [limbs(v) for _, _, v in entries]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([e[0] for e in entries], pa.int32()),
            pa.array([e[1] for e in entries], pa.int32()),
            *(pa.array([x[k] for x in digits], pa.int64()) for k in range(LIMBS)),
        ],
        ["i", "j", *(f"l{k}" for k in range(LIMBS))],
    )


def _summed(rows: DataFrame, function) -> dict[tuple[int, int], int]:
    """Sums over all tasks by (i, j); as many rows as the matrix has entries."""
    parts = rows.mapInArrow(function, f"i int, j int, {_LIMB_SCHEMA}")
    merged = parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    return {(r["i"], r["j"]): unlimbed(r) for r in merged}


# --- characteristic polynomial --------------------------------------------------------------------


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - M) modulo a prime below 2**31, lowest first, by Hessenberg form."""
    h = matrix.copy()
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1][None, :] % p) % p
        # The inverse operation on columns.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            polys[k] = (polys[k] - chain * int(h[k - i - 1, k - 1]) % p * polys[k - i - 1]) % p
    return polys[n].tolist()


def primes_below(start: int) -> Iterator[int]:
    """Primes below ``start``, falling; start is at most 2**31."""
    sieve = np.ones(1 << 16, bool)
    sieve[:2] = False
    for i in range(2, 1 << 8):
        if sieve[i]:
            sieve[i * i :: i] = False
    small = np.flatnonzero(sieve)
    for n in range(start - 1, 1, -1):
        divisors = small[small * small <= n]
        if (n % divisors).all():
            yield n


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of det(x - M) of a positive semidefinite M is larger in size: the coefficients
    are elementary symmetric sums of the eigenvalues, whose sum is the trace."""
    n = len(matrix)
    trace = sum(matrix[i][i] for i in range(n))
    return max(math.comb(n, k) * -(-(trace**k) // n**k) for k in range(n + 1))


def combined(remainders: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers from their remainders, by the Chinese remainder theorem, within half the product."""
    product = math.prod(p for p, _ in remainders)
    out = [0] * len(remainders[0][1])
    for p, values in remainders:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        out = [o + unit * v for o, v in zip(out, values)]
    out = [o % product for o in out]
    return [o - product if o > product // 2 else o for o in out]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x - M) of a positive semidefinite whole-number matrix; primes are shared out over tasks."""
    bound, product, primes = 2 * coefficient_bound(matrix) + 1, 1, []
    for p in primes_below(1 << 31):
        if product > bound:
            break
        primes.append(p)
        product *= p
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.array(sent.value, object)
        for batch in batches:
            for p in batch.column("p").to_pylist():
                poly = charpoly_mod((entries % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([poly], pa.list_(pa.int64()))], ["p", "poly"]
                )

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks)
    done = rows.mapInArrow(run, "p bigint, poly array<bigint>").collect()
    return combined([(r["p"], r["poly"]) for r in done])


# --- roots ----------------------------------------------------------------------------------------


def roots_above(poly: list[int], at: int, power: int) -> int:
    """How many roots (counted as often as they occur) exceed at * 2**power, if all roots are real.

    By Descartes' rule, exact for such polynomials: the sign changes of the polynomial shifted there.
    """
    n = len(poly) - 1
    if power < 0:  # roots times 2**-power
        shifted = [c << (-power * (n - k)) for k, c in enumerate(poly)]
    else:
        at, shifted = at << power, list(poly)
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_sign(poly: list[int], at: int, power: int) -> int:
    """The sign of the polynomial at at * 2**power."""
    if power > 0:
        at, power = at << power, 0
    total = 0
    for k, c in enumerate(reversed(poly)):
        total = total * at + (c << (-power * k))
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """The ``count`` largest roots, falling, as (a, power, group): a * 2**power to ``ROOT_BITS`` bits.

    Roots that agree to so many bits share a group. Zero roots are left out; all roots must be real
    and none negative.
    """
    n = len(poly) - 1
    zeros = next(k for k, c in enumerate(poly) if c)
    count = min(count, n - zeros)
    if count == 0:
        return []
    top = (-poly[n - 1]).bit_length() + 1  # the trace is at least the largest root
    # Cells (a * 2**power, (a + 1) * 2**power] with the numbers of roots above their ends.
    cells = [(0, top, n - zeros, 0)]
    out: list[tuple[int, int, int]] = []
    while cells and len(out) < count:
        a, power, above_low, above_high = cells.pop()
        alone = above_low - above_high == 1
        if alone and a:
            a, power = _narrowed(poly, a, power, above_high)
        if a.bit_length() >= ROOT_BITS:
            group = len(out)
            out += [(2 * a + 1, power - 1, group)] * (above_low - above_high)
            continue
        middle = roots_above(poly, 2 * a + 1, power - 1)
        if above_low > middle:
            cells.append((2 * a, power - 1, above_low, middle))
        if middle > above_high:
            cells.append((2 * a + 1, power - 1, middle, above_high))
    return out[:count]


def _narrowed(poly: list[int], a: int, power: int, above: int) -> tuple[int, int]:
    """The cell of a single root halved to ``ROOT_BITS`` bits by the polynomial's sign, which just
    above the root is that of (-1) ** (roots above)."""
    upper = -1 if above % 2 else 1
    while a.bit_length() < ROOT_BITS:
        a, power = 2 * a, power - 1
        if value_sign(poly, a + 1, power) not in (upper, 0):
            a += 1
    return a, power


# --- components -----------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: tuple[int, int], many: int) -> list[list[float]]:
    """Orthonormal vectors that the matrix less the root sends to almost nothing.

    Inverse iteration in fixed point, scaled by the trace. Several vectors of one root are kept apart
    by taking away their parts along each other.
    """
    n = len(matrix)
    bits = 2 * ROOT_BITS + DIGIT_BITS
    size = max(1, sum(matrix[i][i] for i in range(n)).bit_length())
    fixed = np.array([[(v << bits) >> size for v in row] for row in matrix], object)
    a, power = root
    move = bits - size + power
    shift = a << move if move >= 0 else a >> -move
    for i in range(n):
        fixed[i, i] -= shift
    order, lower, upper = _eliminated(fixed, bits)
    found: list[np.ndarray] = []
    rng = np.random.default_rng(n)
    for _ in range(many):
        v = np.array([int(x) for x in rng.integers(1 << 30, 1 << 31, n)], object) << (bits - 31)
        for _ in range(3):
            v = _solved(order, lower, upper, v, bits)
            v = _unit(v, bits)
            for _ in range(2):
                for other in found:
                    v = v - (((v.dot(other) >> bits) * other) >> bits)
            v = _unit(v, bits)
        found.append(v)
    return [[_as_float(x, bits) for x in v] for v in found]


def _as_float(x: int, bits: int) -> float:
    return int(x) / (1 << bits)  # rounded once


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    room = max(0, max(abs(x) for x in v).bit_length() - 2 * bits)
    v = v >> room
    length = math.isqrt(int(v.dot(v)))
    return np.array([(x << bits) // length for x in v], object)


def _eliminated(m: np.ndarray, bits: int):
    """Rows in the order of their pivots, factors below and numbers above the diagonal."""
    n = len(m)
    m, order = m.copy(), np.arange(n)
    lower = np.zeros((n, n), object)
    for k in range(n):
        pivot = k + max(range(n - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]], order[[k, pivot]] = m[[pivot, k]], order[[pivot, k]]
            lower[[k, pivot], :k] = lower[[pivot, k], :k]
        if not m[k, k]:
            m[k, k] = 1  # exactly singular: the smallest number does as well
        factor = np.array([(x << bits) // m[k, k] for x in m[k + 1 :, k]], object)
        lower[k + 1 :, k] = factor
        if len(factor):
            m[k + 1 :, k:] = m[k + 1 :, k:] - ((factor[:, None] * m[k, k:][None, :]) >> bits)
    return order, lower, m


def _solved(order, lower, upper, v, bits: int) -> np.ndarray:
    n = len(v)
    x = v[order]
    for k in range(n):
        x[k + 1 :] = x[k + 1 :] - ((lower[k + 1 :, k] * x[k]) >> bits)
    for k in range(n - 1, -1, -1):
        rest = int(x[k]) - (int((upper[k, k + 1 :] * x[k + 1 :]).sum()) >> bits if k < n - 1 else 0)
        x[k] = (rest << bits) // upper[k, k]
    return x


def components(spark: SparkSession, matrix: list[list[int]], count: int):
    """Eigenvalues (as ratios to the trace and as floats) and unit vectors of the largest ``count``."""
    roots = largest_roots(characteristic_polynomial(spark, matrix), count)
    if not roots:
        return [], np.zeros((0, len(matrix)))
    groups: dict[int, list[int]] = {}
    for i, (_, _, group) in enumerate(roots):
        groups.setdefault(group, []).append(i)
    asked = [(min(at), len(at), str(roots[at[0]][0]), roots[at[0]][1]) for at in groups.values()]
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = null_vectors(sent.value, (int(row["a"]), row["power"]), row["many"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["first"] + i for i in range(len(vectors))], pa.int32()),
                        pa.array(vectors, pa.list_(pa.float64())),
                    ],
                    ["component", "vector"],
                )

    tasks = min(len(asked), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(asked, "first int, many int, a string, power int")
    done = rows.repartition(tasks).mapInArrow(run, "component int, vector array<double>").collect()
    vectors = np.zeros((len(roots), len(matrix)))
    for r in done:
        vectors[r["component"]] = r["vector"]
    return [(a, power) for a, power, _ in roots], vectors


# --- the operator ---------------------------------------------------------------------------------


def _ratio(a: int, power: int, below: int) -> float:
    """a * 2**power / below, rounded once."""
    return (a << power) / below if power >= 0 else a / (below << -power)


class Whitening:
    """A fitted map: sums, components and factors; bounded by the square of the dimensions."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, variances: list[float],
                 explained: list[float]):
        self.n, self.sums, self.vectors = n, sums, vectors
        self.variances, self.explained = variances, explained
        self.factors = vectors / np.sqrt(np.array(variances))[:, None] if len(vectors) else vectors

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, in floats where exact and else in whole numbers."""
        whole_limit = (1 << 62) // max(1, self.n)
        if np.abs(rows).max(initial=0) < whole_limit and max(map(abs, self.sums)) < 1 << 62:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        return (moved.astype(float) / self.n) @ self.factors.T


def _squares(moved: np.ndarray) -> np.ndarray:
    """Row sums of squares, exact, held at the limit of a long."""
    if moved.dtype != object:
        top = int(np.abs(moved).max(initial=0))
        if top * top * moved.shape[1] <= LONG:
            return (moved * moved).sum(1)
        moved = moved.astype(object)
    return np.array([min(LONG, int(s)) for s in (moved * moved).sum(1)], np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, vector) without nulls and non-finite entries, of the commonest length.

    The greater of two lengths that are equally common; empty vectors never take part.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    counts = rows.groupBy(F.size("vector").alias("d")).count()
    common = counts.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (common["d"] if common else 0))


def fit(rows: DataFrame, count: int) -> Whitening | None:
    """The map for rows of :func:`usable`; None without rows."""
    spark, first = rows.sparkSession, rows.select(F.size("vector")).first()
    if first is None:
        return None
    d = first[0]
    held = _summed(rows, lambda batches: _sums(batches, d))
    n, sums = held[(-1, -1)], [held[(j, j)] for j in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    part = _summed(rows, lambda batches: _scatter(batches, centre))
    # n * sum (x - c)(x - c)' less what the whole-number centre is off: n**2 times the covariance.
    off = [s - n * c for s, c in zip(sums, centre)]
    matrix = [
        [n * part[(min(i, j), max(i, j))] - off[i] * off[j] for j in range(d)] for i in range(d)
    ]
    trace = sum(matrix[i][i] for i in range(d))
    roots, vectors = components(spark, matrix, count)
    variances = [_ratio(a, power, n * n) for a, power in roots]
    explained = [_ratio(a, power, trace) for a, power in roots]
    return Whitening(n, sums, vectors, variances, explained)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity."""
    d, c = len(model.sums), len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, c + 1))
        for _, x in _matrices(batches, d):
            z = model.whitened(model.deviations(x))
            total += np.concatenate((z.T @ z, z.sum(0)[:, None]), 1)
        i, j = np.divmod(np.arange(total.size), c + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
            ["i", "j", "v"],
        )

    parts = rows.mapInArrow(run, "i int, j int, v double")
    total = np.zeros((c, c + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    means = total[:, c] / model.n
    return float(np.abs(total[:, :c] / model.n - np.outer(means, means) - np.eye(c)).max(initial=0))


def whiten(
    vectors: DataFrame, count: int = 32, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained,
    identity_error.

    A component c of a vector becomes the long floor(64 * c) + 1,000,000, the floor held within 2**62.
    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those that
    do not have the commonest length. All others, repeated and null keys included, are the fit list:
    n vectors with sums S. Components are the ``count`` unit eigenvectors of their covariance V (divisor
    n) with the largest eigenvalues e, from 1 on by falling e; equal ones in any orthonormal choice.
    ``deviation`` is the exact sum of (n * x - S)**2, held at the limit of a long; ``whitened`` is
    x - S / n projected on the component, over sqrt(e); ``explained`` is e / trace(V);
    ``identity_error`` compares the covariance of ``whitened`` with the identity. Components without
    variance (e = 0) cannot be whitened and have no rows, so a table of equal vectors gives none, and
    neither does an empty one. Columns of other names are ignored.

    Four passes over the vectors, each a sum of matrices in tasks: sums, scatter around the mean,
    check, output.
    """
    spark = vectors.sparkSession
    schema = (
        f"`{key}` bigint, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double"
    )
    rows = usable(vectors, key, vector)
    model = fit(rows, count)
    if model is None or not len(model.vectors):
        return spark.createDataFrame([], schema)
    error = identity_error(rows, model)
    d, c = len(model.sums), len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _matrices(batches, d):
            moved = model.deviations(x)
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.repeat(np.arange(size), c))),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * c, model.n)),
                    pa.array(np.repeat(_squares(moved), c)),
                    pa.array(model.whitened(moved).ravel()),
                    pa.array(np.tile(np.array(model.explained), size)),
                    pa.array(np.full(size * c, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
