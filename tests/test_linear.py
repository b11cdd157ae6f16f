import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.linear import with_inverse


@pytest.mark.parametrize("n", [1, 2, 4])
def test_inverse_and_definiteness(spark, n):
    rng = np.random.default_rng(n)
    mats = []
    for k in range(12):
        a = rng.normal(size=(n, n))
        mats.append(a @ a.T + 0.1 * np.eye(n) if k % 2 else a + a.T)
    mats.append(np.zeros((n, n)))
    df = spark.createDataFrame([(k, [[float(x) for x in r] for r in m]) for k, m in enumerate(mats)], "k long, a array<array<double>>")
    got = {r.k: r for r in with_inverse(df, lambda i, j: F.col("a")[i][j], n).collect()}
    assert set(got[0].asDict()) == {"k", "a", "inverse", "definite"}
    for k, m in enumerate(mats[:-1]):
        assert np.allclose(got[k].inverse, np.linalg.inv(m), rtol=1e-6, atol=1e-8)
        assert got[k].definite == (np.linalg.eigvalsh(m).min() > 0)
    assert not got[12].definite and got[12].inverse[0][0] is None
