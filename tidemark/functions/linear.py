"""Symmetric factorisation of one small matrix per row, as column expressions."""

from functools import reduce

from pyspark.sql import functions as F


def _sum(terms):
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def with_inverse(df, entry, n, inverse="inverse", definite="definite", prefix="_ldl"):
    """Add the inverse (array of rows) of a symmetric n x n matrix and whether it is positive definite.

    entry(i, j) is the Column of an entry with j <= i. The matrix is factored as L D L' with unit lower triangular L, so
    indefinite matrices have an inverse too; without a pivot (a singular leading block) the
    inverse is null. Every step is a projection of its own, so that no expression is repeated.
    """
    d, l, m = (lambda j: F.col(f"{prefix}_d{j}")), (lambda i, j: F.col(f"{prefix}_l{i}_{j}")), (lambda i, j: F.col(f"{prefix}_m{i}_{j}"))
    added = []

    def put(df, cols):
        added.extend(cols)
        return df.withColumns(cols)

    for j in range(n):
        df = put(df, {f"{prefix}_d{j}": entry(j, j) - _sum(l(j, k) * l(j, k) * d(k) for k in range(j))})
        df = put(df, {f"{prefix}_l{i}_{j}": F.try_divide(entry(i, j) - _sum(l(i, k) * l(j, k) * d(k) for k in range(j)), d(j)) for i in range(j + 1, n)}) if j + 1 < n else df
    for gap in range(1, n):
        df = put(df, {f"{prefix}_m{i}_{i - gap}": -l(i, i - gap) - _sum(l(i, k) * m(k, i - gap) for k in range(i - gap + 1, i)) for i in range(gap, n)})
    low = lambda k, i: F.lit(1.0) if k == i else m(k, i)
    cell = lambda i, j: _sum(F.try_divide(low(k, i) * low(k, j), d(k)) for k in range(max(i, j), n))
    rows = F.array(*[F.array(*[cell(i, j) for j in range(n)]) for i in range(n)])
    sure = reduce(lambda a, b: a & b, [d(j) > 0 for j in range(n)])
    return df.withColumns({inverse: rows, definite: F.coalesce(sure, F.lit(False))}).drop(*added)
