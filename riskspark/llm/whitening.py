"""Whitening of embeddings by an exact characteristic polynomial.

1. Entries become integers; tasks sum them and their products exactly (limbs of a wide sum), Spark adds the
   limbs. The scatter ``A = n * sum(x x') - S S'`` is ``n**2`` times the covariance, in whole numbers.
2. Its characteristic polynomial is computed modulo many primes: each is one row of a Spark table, reduced to
   Hessenberg form and expanded in its task; Chinese remaindering of as many primes as the bound on the
   coefficients needs gives the exact integers.
3. All roots of the polynomial are real, so Descartes' rule is exact: the sign changes of ``p(x + a)`` count the
   roots above ``a``, multiplicities included. Bisection by that count separates the largest roots;
   one alone is then refined by the sign of ``p`` until ``ROOT_BITS`` relative bits are known.
4. A component spans the null space of ``A - e I``: inverse iteration on whole numbers with ``DIGITS`` binary
   digits. Equal roots get orthogonal vectors of their common space.
5. Rows are projected where they are read; one more pass sums the whitened columns' covariance.

The driver holds the d x d scatter and one polynomial, bounded by the dimension; rows never leave the tasks.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those of another length
than the most frequent one (of equally frequent ones the longest). Repeated rows and ids count and are
returned as they are. Directions without variance have no whitened value, so components are only those of
positive eigenvalues: none for one row, for equal rows, for an empty table. Entries beyond the range of a long
are clamped to it; a deviation beyond it is null. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SCALE, SHIFT = 1024, 100_000
ROOT_BITS, DIGITS = 90, 320
LIMB, LIMBS = 30, 6  # a sum of products in six limbs of 30 bits
FAR = 2**62 - 2**20
ROW = "{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) whole numbers floor(1024 c), without the shift, which no difference sees."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    y = np.floor(flat * SCALE)
    return np.clip(y, -FAR, FAR - 1).astype(np.int64).reshape(-1, d)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y with Python integers, from float products that are exact: digits of 20 bits, 4096 rows at a time."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    parts, rest = [], y
    while True:
        low = rest & 0xFFFFF
        high = rest >> 20
        last = not (high + (high < 0)).any()  # what is left is a sign
        parts.append((rest if last else low).astype(np.float64))
        if last:
            break
        rest = high
    for k in range(0, len(y), 4096):
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                product = (a[k:k + 4096].T @ b[k:k + 4096]).astype(np.int64)
                total += product.astype(object) << (20 * (i + j))
    return total


def limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def unlimbed(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, column sums S, n * sum(x x') - S S') of floor(1024 c), exact; the sums are added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = integers(batch.column(0), d)
            n += len(y)
            products += exact_products(y)
            sums += (y if not y.size or np.abs(y).max() < 2**31 else y.astype(object)).sum(axis=0).astype(object)
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        values = [products[i, j] for i, j in upper] + [*sums, n]
        keys = [*upper, *[(-1, j) for j in range(d)], (-2, 0)]
        split = np.array([limbs(int(v)) for v in values], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([k[0] for k in keys], np.int32)), pa.array(np.array([k[1] for k in keys], np.int32)), *[pa.array(split[:, q]) for q in range(LIMBS)]],
            names=["i", "j", *[f"l{q}" for q in range(LIMBS)]])

    names = [f"l{q}" for q in range(LIMBS)]
    rows = vectors.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"{q} long" for q in names))
    found = {(r.i, r.j): unlimbed(r[2:]) for r in rows.groupBy("i", "j").agg(*[F.sum(q).alias(q) for q in names]).collect()}
    n, sums = found.get((-2, 0), 0), [found.get((-1, j), 0) for j in range(d)]
    a = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            a[i, j] = a[j, i] = n * found.get((i, j), 0) - sums[i] * sums[j]
    return n, sums, a


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 2**32."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11):
        x = pow(base, odd, n)
        if n % base == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31, falling, whose product has more than ``bits`` bits."""
    out, size, p = [], 1, (1 << 31) - 1
    while size.bit_length() <= bits + 1:
        if is_prime(p):
            out.append(p)
            size *= p
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x I - a) modulo p: Hessenberg form by similarity, then its recurrence."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1][None, :] % p) % p
        # columns answer with the inverse operation; each product is reduced before it is added
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor[None, :] % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        out = np.zeros(d + 1, np.int64)
        out[1:] = poly[k - 1, :-1]
        weight = np.zeros(k, np.int64)  # of poly[i], i = 0 .. k - 1
        product = 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else product
        out -= (weight[:, None] * poly[:k] % p).sum(axis=0) % p
        poly[k] = out % p
    return poly[d]


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """Exact coefficients, constant first, of det(x I - a); a is symmetric."""
    d = len(a)
    # |coefficient of x^(d-k)| <= binomial(d, k) * norm^k, norm the Frobenius norm of a
    norm = isqrt(sum(int(x) ** 2 for x in a.ravel())) + 1
    moduli = primes(d + d * norm.bit_length() + 1)
    size = max(1, (max(abs(int(x)) for x in a.ravel()).bit_length() + 30) // 30)
    signs = np.where(np.array(a < 0, bool), -1, 1)
    digits = np.array([[[(abs(int(x)) >> (30 * q)) & ((1 << 30) - 1) for x in row] for row in a] for q in range(size)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps, polys = batch.column(0).to_pylist(), []
            for p in ps:
                value, power = np.zeros((d, d), np.int64), 1
                for q in range(size):
                    value, power = (value + digits[q] % p * power) % p, power * (1 << 30) % p
                polys.append(polynomial_mod(value * signs % p, p).tolist())
            yield pa.RecordBatch.from_pydict({"p": ps, "poly": pa.array(polys, pa.list_(pa.int64()))}, schema=pa.schema([("p", pa.int64()), ("poly", pa.list_(pa.int64()))]))

    tasks = max(1, min(len(moduli), spark.sparkContext.defaultParallelism * 2))
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    whole, size_of = [0] * (d + 1), 1
    for p, poly in sorted((r.p, r.poly) for r in rows.mapInArrow(run, "p long, poly array<long>").collect()):
        inverse = pow(size_of % p, -1, p)
        whole = [w + size_of * ((c - w) * inverse % p) for w, c in zip(whole, poly, strict=True)]
        size_of *= p
    return [w - size_of if 2 * w > size_of else w for w in whole]


def above(poly: list[int], at: int, bits: int) -> int:
    """Roots greater than at / 2**bits, with multiplicity, of a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [x << (bits * (d - k)) for k, x in enumerate(poly)]  # 2^(bits d) p(y / 2^bits)
    for k in range(d):  # shift by ``at``: repeated synthetic division
        for i in range(d - 1, k - 1, -1):
            c[i] += at * c[i + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], at: int, bits: int) -> int:
    value, scale = 0, 1
    for c in reversed(poly):
        value = value * at + c * scale
        scale <<= bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int]]:
    """The ``most`` largest positive roots with multiplicity, falling, as (numerator, binary digits), rounded to
    ROOT_BITS relative bits."""
    bound = 2 - poly[-2]  # no root is negative, so none is above their sum, the trace
    out: list[tuple[int, int]] = []
    # Intervals (low, high] in units of 2**-bits with the number of roots above their ends.
    todo = [(0, bound, 0, above(poly, 0, 0), 0)]
    while todo and len(out) < most:
        low, high, bits, n_low, n_high = todo.pop()
        if n_low == n_high:
            continue
        count = n_low - n_high
        # Where one root is alone, it changes the sign between the ends unless it is an end.
        alone = count == 1 and sign_at(poly, low, bits) * sign_at(poly, high, bits) < 0
        if low > 0 and (high - low) << ROOT_BITS <= high:
            out += [(low + high, bits + 1)] * count
            continue
        if alone and low > 0:
            side = sign_at(poly, low, bits)
            while (high - low) << ROOT_BITS > high:
                if high - low == 1:
                    low, high, bits = 2 * low, 2 * high, bits + 1
                middle = (low + high) // 2
                s = sign_at(poly, middle, bits)
                if s == 0:
                    low = high = middle
                elif s == side:
                    low = middle
                else:
                    high = middle
            out.append((low + high, bits + 1))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        if high > 4 * max(low, 1):  # many magnitudes: the middle is geometric
            middle = isqrt(max(low, 1) * high)
        else:
            middle = (low + high) // 2
        n_middle = above(poly, middle, bits)
        todo.append((low, middle, bits, n_low, n_middle))
        todo.append((middle, high, bits, n_middle, n_high))
    return out[:most]


def _factor(a: np.ndarray, root: tuple[int, int]) -> tuple[list[list[int]], list[int]]:
    """LU factors, in units of 2**-DIGITS, of (a - root) / scale with row exchanges."""
    d = len(a)
    scale = max(1, max(abs(int(x)) for x in a.ravel()))
    m = [[(int(x) << DIGITS) // scale for x in row] for row in a]
    shift = (root[0] << DIGITS) // (scale << root[1])
    for i in range(d):
        m[i][i] -= shift
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(m[i][k]))
        m[k], m[pivot], order[k], order[pivot] = m[pivot], m[k], order[pivot], order[k]
        if m[k][k] == 0:
            m[k][k] = 1  # the last digit instead of an exact zero
        head = m[k]
        for i in range(k + 1, d):
            if m[i][k]:
                f = (m[i][k] << DIGITS) // head[k]
                row = m[i]
                for j in range(k + 1, d):
                    row[j] -= f * head[j] >> DIGITS
                row[k] = f
    return m, order


def _unit(v: list[int]) -> list[int]:
    size = isqrt(sum(x * x for x in v))
    return [(x << DIGITS) // size for x in v]


def null_space(a: np.ndarray, root: tuple[int, int], count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of ``a - root``, by inverse iteration."""
    (m, order), d, found = _factor(a, root), len(a), []
    rng = np.random.default_rng(11)
    for _ in range(count):
        v = _unit([int(x) << DIGITS >> 20 for x in rng.integers(-2**20, 2**20, d)])
        for _ in range(4):
            x = [v[order[i]] for i in range(d)]
            for i in range(d):
                x[i] -= sum(m[i][j] * x[j] for j in range(i)) >> DIGITS
            for i in range(d - 1, -1, -1):
                x[i] = ((x[i] << DIGITS) - sum(m[i][j] * x[j] for j in range(i + 1, d))) // m[i][i]
            most = max(abs(t) for t in x).bit_length()
            x = [t >> most - DIGITS if most > DIGITS else t << DIGITS - most for t in x]
            for w in found:
                dot = sum(s * t for s, t in zip(x, w, strict=True)) >> DIGITS
                x = [s - (dot * t >> DIGITS) for s, t in zip(x, w, strict=True)]
            v = _unit(x)
        found.append(v)
    return [[t / (1 << DIGITS) for t in v] for v in found]


def null_vectors(spark, a: np.ndarray, roots: list[tuple[int, int]]) -> np.ndarray:
    """(components, d) unit vectors; the factorisation of each distinct root is a task of its own."""
    counts: dict[tuple[int, int], int] = {}
    for root in roots:
        counts[root] = counts.get(root, 0) + 1
    order = list(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_pylist()
            found = [null_space(a, order[k], counts[order[k]]) for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    rows = spark.range(len(order), numPartitions=len(order)).mapInArrow(run, "k long, v array<array<double>>").collect()
    return np.array([v for r in sorted(rows, key=lambda r: r.k) for v in r.v])


def fit_vectors(df: DataFrame, key: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(key, v) of the rows that count, v an array of double, and their dimension."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = df.select(F.col(key).alias("key"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    return fine.where(F.size("v") == d), d


def whiten(df: DataFrame, most: int = 8, key: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row and component (up to ``most``, by falling eigenvalue)."""
    spark = df.sparkSession
    schema = ROW.format(key="key", kind=df.schema[key].dataType.simpleString())
    rows, d = fit_vectors(df, key, vector_col)
    n, sums, a = scatter(rows, d) if d else (0, [], np.zeros((0, 0), object))
    trace = sum(int(a[i, i]) for i in range(d))
    roots = largest_roots(characteristic_polynomial(spark, a), min(most, d)) if trace else []
    if not roots:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    vectors = null_vectors(spark, a, roots)
    explained = np.array([root / (trace << bits) for root, bits in roots])
    # x - S/n over sqrt(e), e = root / n^2: (n x - S) over sqrt(root)
    scale = np.array([float(isqrt(root << 128 + bits % 2)) / 2.0 ** 64 / 2.0 ** (bits // 2 + bits % 2) for root, bits in roots])
    centre, most_sum = np.array(sums, object), max(abs(s) for s in sums)

    def differences(y: np.ndarray) -> np.ndarray:
        """n x - S, in longs where they hold it, else in Python integers."""
        if y.size and n * int(np.abs(y).max()) + most_sum < 2**62:
            return y * n - centre.astype(np.int64)
        return y.astype(object) * n - centre

    def project(y: np.ndarray) -> np.ndarray:
        return differences(y).astype(np.float64) @ vectors.T / scale

    def deviations(y: np.ndarray) -> list[int | None]:
        far = differences(y)
        if y.size and (far.dtype == object or int(np.abs(far).max()) ** 2 * d >= 2**63):
            far = far.astype(object)
        out = (far * far).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in out]

    k = len(roots)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(pairs))
        for batch in batches:
            w = project(integers(batch.column(0), d))
            total += np.concatenate([w.sum(axis=0), [w[:, i] @ w[:, j] for i, j in pairs]])
        yield pa.RecordBatch.from_pydict({f"m{q}": [v] for q, v in enumerate(total)})

    names = [f"m{q}" for q in range(k + len(pairs))]
    seen = rows.select("v").mapInArrow(moments, ", ".join(f"{m} double" for m in names)).agg(*[F.sum(m).alias(m) for m in names]).first()
    mean = np.array(seen[:k]) / n  # the rows were centred before: these are rounding errors
    error = max(abs(s / n - mean[i] * mean[j] - (i == j)) for s, (i, j) in zip(seen[k:], pairs, strict=True))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(batch.column(1), d)
            m = len(y)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(project(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema).withColumnRenamed("key", key)
