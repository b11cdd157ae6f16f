import numpy as np
import pytest

from tidemark.llm.whitening import _forward, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in r], 0) for i, r in enumerate(x)], SCHEMA)


def brute(x):
    """(vec x component values, shares, eigenvectors) of the distinct rows of an integer matrix."""
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    return e[::-1], v[:, ::-1], len(fit), fit.sum(axis=0), fit.mean(axis=0)


def test_equals_the_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 12)) * np.linspace(3, 0.01, 12)).astype("float32")
    x = np.concatenate([x, x[:50]])
    grid = np.floor(x.astype(float) * 256).astype(int)
    e, v, n, total, mean = brute(grid)
    got = whiten(vectors(spark, x)).collect()
    assert len(got) == len(x) * 4 and {r.n for r in got} == {n}
    for k in range(4):
        rows = sorted((r for r in got if r.component == k + 1), key=lambda r: r.id)
        want = (grid - mean) @ v[:, k] / np.sqrt(e[k])
        have = np.array([r.whitened for r in rows])
        assert np.allclose(have, want * np.sign(want @ have), atol=1e-8)
        assert abs(rows[0].explained / (e[k] / e.sum()) - 1) < 1e-9
        assert [r.deviation for r in rows] == [int(((n * g - total) ** 2).sum()) for g in grid]
    assert max(r.identity_error for r in got) < 1e-9


def test_badly_conditioned_and_deficient_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 2)) * 50
    x = np.column_stack([base[:, 0], base[:, 0] + 1 / 256, base[:, 1], np.full(80, 7.0), base[:, 0] * 2]).astype("float32")
    got = whiten(vectors(spark, x)).collect()
    e, v, *_ = brute(np.floor(x.astype(float) * 256).astype(int))
    found = {r.component: r.explained for r in got}
    for k, share in found.items():
        if e[k - 1] / e.sum() > 1e-9:
            assert abs(share * e.sum() / e[k - 1] - 1) < 1e-6
    assert max(r.identity_error for r in got) < 1e-4 and len(found) >= 2


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [-inf, 1.0], 0),
            (None, [3.0, 1.0], None), (8, [-0.0, 0.5], 0), (9, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whiten(df.selectExpr("*", "'clash' as x", "'clash' as id", "'clash' as n", "'clash' as component")).collect()
    assert sorted((r.id is None, r.id) for r in got if r.component == 1) == [(False, 1), (False, 1), (False, 8), (True, None)]
    assert {r.n for r in got} == {3}
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.where("vec_id = 1")).count() == 0                # one distinct vector has no variance
    assert whiten(spark.createDataFrame([(1, [1.0], 0), (2, [3.0], 0)], SCHEMA)).count() == 2


def test_entries_beyond_the_grid_are_refused(spark):
    with pytest.raises(Exception, match="beyond the grid"):
        whiten(spark.createDataFrame([(1, [1e20], 0), (2, [1.0], 0)], SCHEMA)).count()


def test_forward_substitution():
    rng = np.random.default_rng(6)
    r, z = np.triu(rng.normal(size=(150, 150))) + 20 * np.eye(150), rng.normal(size=(7, 150))
    assert np.allclose(_forward(r, z) @ r, z)
