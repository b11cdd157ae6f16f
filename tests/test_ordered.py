"""Ordered and quantile operators against pandas/NumPy, whole and chunked, with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.intervals import asof_join
from tidemark.operators.joins import tolerance_join
from tidemark.operators.ordered import numbered, previous_mean, running, top_n
from tidemark.operators.quantiles import quantiles
from tidemark.operators.whiteness import average_ranks


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    # One key holds most rows; times are uneven and some values are missing.
    k = np.where(rng.random(400) < 0.7, 0, rng.integers(1, 6, 400))
    d = pd.DataFrame({"k": k, "id": np.arange(400), "t": np.round(rng.gamma(2.0, 10.0, 400), 1), "v": rng.normal(size=400)})
    d["v"] = d["v"].where(rng.random(400) > 0.2)
    return d


def frame(spark, pdf):
    d = spark.createDataFrame(pdf)
    return d.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_running_values_match_pandas(spark, skewed, both_ways):
    d = running(frame(spark, skewed), ["k"], ["t", "id"], sums={"s": F.coalesce("v", F.lit(0.0))}, lags={"p": F.col("v")}, lasts={"f": F.col("v")})
    got = d.toPandas().sort_values("id").reset_index(drop=True)
    p = skewed.sort_values(["k", "t", "id"]).copy()
    p["s"] = p["v"].fillna(0).groupby(p["k"]).cumsum()
    p["p"] = p.groupby("k")["v"].shift()
    p["f"] = p.groupby("k")["v"].ffill()
    p = p.sort_values("id").reset_index(drop=True)
    for c in ("s", "p", "f"):
        np.testing.assert_allclose(got[c].astype(float), p[c].astype(float), rtol=1e-9, atol=1e-12)


def test_numbering_without_keys_is_dense(spark, skewed, both_ways):
    got = numbered(frame(spark, skewed), [], ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert got["idx"].tolist() == list(range(1, 401))


def test_previous_mean_excludes_the_row(spark, both_ways):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([4, 2, 6, 0, 1, 1, 3, 9])], "k int, t int, v double")
    got = [r["prev_mean"] for r in previous_mean(d, ["k"], ["t"], "v").orderBy("t").collect()]
    assert got == pytest.approx([0, 4, 3, 4, 3, 2.6, 14 / 6, 17 / 7])


def test_quantiles_match_numpy_on_a_hot_key(spark, skewed, both_ways):
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in quantiles(frame(spark, skewed), ["k"], "v", probs).collect()}
    for k, g in skewed.dropna().groupby("k"):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(g["v"], p), abs=1e-12)


def test_quantiles_with_ties_zeros_and_signs(spark, both_ways):
    vals = [0.0, 0.0, 0.0, -1.0, -1.0, 5.0, 5.0, 5.0, 1e-9, -1e12]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    for twice in (False, True):
        r = quantiles(d, [], "v", {"lo": 0.1, "m": 0.5, "hi": 0.95}, scan_twice=twice).first()
        got = [r["lo"], r["m"], r["hi"]]
        assert got == pytest.approx([np.quantile(vals, q) for q in (0.1, 0.5, 0.95)])


def test_top_n_is_exact(spark, skewed):
    got = top_n(frame(spark, skewed), ["k"], [F.col("t"), F.col("id")], 3).toPandas()
    want = skewed.sort_values(["t", "id"]).groupby("k").head(3)
    assert sorted(got["id"]) == sorted(want["id"])


def test_asof_is_strict_and_clamped(spark, both_ways):
    right = spark.createDataFrame([("s", float(t), t * 10) for t in range(1, 13)], "ses string, t double, v int")
    left = spark.createDataFrame([("s", 0.5), ("s", 1.0), ("s", 3.0), ("s", 3.1), ("s", 99.0)], "ses string, t double")
    got = {r["t"]: r["v"] for r in asof_join(left, right, ["ses"], "t", ["v"]).collect()}
    # Before the first row and at the first row: clamped; at 3.0 the row at 2.0; then 3.0.
    assert got == {0.5: 10, 1.0: 10, 3.0: 20, 3.1: 30, 99.0: 120}


def test_tolerance_join_takes_the_first_match(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.04), (2, 10.0)], "n int, x double")
    right = spark.createDataFrame([(1, 10.05, "a"), (1, 9.98, "b"), (1, 20.0, "c"), (2, 10.2, "d")], "n int, x double, tag string")
    got = {(r["n"], r["x"]): r["tag"] for r in tolerance_join(left, right, ["n"], {"x": 0.1}, ["x_r"]).collect()}
    assert got == {(1, 10.0): "b", (1, 20.04): "c"}


def test_average_ranks_share_ties(spark, both_ways):
    d = spark.createDataFrame([(0, float(v)) for v in [3, 1, 3, 2, 3, 1, 7, 8]], "k int, v double")
    got = sorted((r["v"], r["r"]) for r in average_ranks(d, ["k"], "v", "r").collect())
    assert got == [(1.0, 1.5), (1.0, 1.5), (2.0, 3.0), (3.0, 5.0), (3.0, 5.0), (3.0, 5.0), (7.0, 7.0), (8.0, 8.0)]


def test_equal_left_rows_of_a_tolerance_join_all_come_back(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 9.0)], "n long, x double")
    right = spark.createDataFrame([(1, 0.52, "near")], "n long, x double, tag string")
    assert [r["tag"] for r in tolerance_join(left, right, ["n"], {"x": 0.1}, ["x_r"]).collect()] == ["near", "near"]
    assert tolerance_join(left, right, ["n"], {"x": 0.1}, ["x_r"], first_only=False).count() == 2


def test_a_burst_and_text_order_are_cut_by_rows(spark):
    from tidemark.operators import ordered
    from tidemark.session import CHUNK_ROWS_KEY, DEFAULT_CHUNK_ROWS

    rows = [("k", 5.0 if i < 990 else float(i), f"id{i:04d}") for i in range(1000)]
    d = spark.createDataFrame(rows, "key string, t double, name string")
    spark.conf.set(CHUNK_ROWS_KEY, "100")
    try:
        chunks = ordered.with_chunks(d, ["key"], ["t", "name"], 100, 1000).groupBy("_chunk").count().collect()
        assert max(r["count"] for r in chunks) <= 250
        got = {r["name"]: r["idx"] for r in ordered.numbered(d, ["key"], ["name"]).collect()}
        assert got == {f"id{i:04d}": i + 1 for i in range(1000)}
        burst = {r["name"]: r["idx"] for r in ordered.numbered(d, ["key"], ["t", "name"]).collect()}
        assert burst == {f"id{i:04d}": i + 1 for i in range(1000)}
    finally:
        spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
