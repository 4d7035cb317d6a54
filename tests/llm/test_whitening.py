import math
import random
from fractions import Fraction

import numpy as np
import pytest

from riskspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, None) for i, v in rows], SCHEMA)


def brute(rows):
    """Every value from plain Python integers and numpy's symmetric solver."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    a = [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(a, float))
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[r[j] - Fraction(sums[j], n) for j in range(d)] for r in x], float)
    return kept, n, values[::-1], vectors[:, ::-1], deviation, centred, sum(a[i][i] for i in range(d))


def compare(got, rows, most=8, rank=None):
    kept, n, values, vectors, deviation, centred, trace = brute(rows)
    count = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(kept) * (rank or count)  # floats may not see the least eigenvalues
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(count):
        want = centred @ vectors[:, k] / math.sqrt(values[k] / n**2)
        mine = np.array([by[i, k + 1][0].whitened for i, _ in kept])
        alone = min(abs(values[k] - values[j]) for j in range(len(values)) if j != k) > 1e-6 * values[0] if len(values) > 1 else True
        if alone:
            sign = np.sign(mine @ want)
            assert np.allclose(mine, sign * want, atol=1e-7)
        assert abs(by[kept[0][0], k + 1][0].explained - values[k] / trace) <= 1e-9
        cov = np.mean((mine - mine.mean()) ** 2)
        assert abs(cov - 1) < 1e-8
    for (i, _), dev in zip(kept, deviation, strict=True):
        assert {r.deviation for c in range(count) for r in by[i, c + 1]} == {dev if dev < 2**63 else None}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query_against_a_plain_solver(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_exact_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), rows)


def test_bad_rows_clashing_columns_and_few_dimensions(spark):
    rnd = random.Random(0)
    rows = [(i, [rnd.gauss(0, 3), rnd.gauss(5, 1), rnd.random()]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 1.0, 2.0]), (105, [1.0, 2.0])]
    compare(whitening.whiten(frame(spark, rows + bad).repartition(5)).collect(), rows)


def test_repeated_and_missing_eigenvalues(spark):
    rows = [(i, [float(s) if j == k else 0.0 for j in range(4)] + [0.0]) for i, (k, s) in enumerate((k, s) for k in range(4) for s in (1, -1))]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 * 4  # four equal eigenvalues; the fifth direction has none
    w = np.zeros((8, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 8, np.eye(4), atol=1e-9) and {round(r.explained, 12) for r in got} == {0.25}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_variance_no_rows(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_wide_entries_and_one_hot_vector(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1e12), rnd.gauss(0, 1e9), 1.0 + rnd.random()]) for i in range(40)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, rows, rank=3)
    least = np.array([r.whitened for r in got if r.component == 3])
    assert abs(np.mean(least**2) - 1) < 1e-9


def test_exact_products():
    rng = np.random.default_rng(0)
    for size in (3, 2**19, 2**40, 2**61):
        y = rng.integers(-size, size, (50, 4))
        big = y.astype(object)
        assert (whitening.exact_products(y) == big.T @ big).all()
    assert [whitening.unlimbed(whitening.limbs(v)) for v in (0, -1, 2**140, -2**140 + 7)] == [0, -1, 2**140, -2**140 + 7]


def faddeev(a):
    d = len(a)
    m, c = [[0] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][q] * m[q][j] for q in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][q] * m[q][i] for i in range(d) for q in range(d)) / Fraction(k))
    return [int(x) for x in reversed(c)]


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 5, 7):
        x = rng.integers(-10**9, 10**9, (d + 2, d)).astype(object)
        if d == 5:
            x[:, 4] = x[:, 3]  # a root of zero
        a = x.T @ x
        poly = whitening.characteristic_polynomial(spark, a)
        assert poly == faddeev(a.tolist())
        for root, bits in whitening.largest_roots(poly, d):
            at, wide = root, max(1, root >> 80)
            assert whitening.above(poly, at - wide, bits) > whitening.above(poly, at + wide, bits)
    poly = [1]
    for r in (4, 4, 4, 9, 9, 10**12):  # (x - r) each
        poly = [b - r * a for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    assert [round(r / 2**b, 9) for r, b in whitening.largest_roots(poly, 6)] == [10**12, 9, 9, 4, 4, 4]
