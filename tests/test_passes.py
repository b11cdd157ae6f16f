"""Streams past resident pieces give what plain products give, however small the pieces are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import memory as mm, passes, retrieval as rt

RNG = np.random.default_rng(7)
X = RNG.normal(size=(150, 8))
X[50:60] = X[40:50]                     # copies
X[100:130] = X[0] + 0.01 * RNG.normal(size=(30, 8))


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i * 3 - 60, r.tolist()) for i, r in enumerate(X)], "id long, v array<double>")


@pytest.fixture(params=["one slot", "many slots"])
def pieces(request, monkeypatch):
    if request.param == "many slots":
        monkeypatch.setattr(passes, "RESIDENT", 20)
        monkeypatch.setattr(passes, "WORK", 700)
        monkeypatch.setattr(passes, "BATCH", 7)


def cosines():
    u = X / np.linalg.norm(X, axis=1, keepdims=True)
    return u @ u.T


def test_novelty(items, pieces):
    c = np.tril(cosines(), -1) + np.triu(np.full((150, 150), -9.0))
    want = [1.0, *(1 - c[k, :k].max() for k in range(1, 150))]
    got = [r.novelty for r in mm.novelty(items).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_attention(items, pieces):
    z = X @ X.T * 0.3
    w = np.exp(z - z.max(axis=1, keepdims=True))
    q = items.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    i = items.select(F.col("id").alias("iid"), F.col("v").alias("iv"), F.col("v").alias("val"))
    got = rt.attention(q, i, 0.3).orderBy("qid").collect()
    assert np.allclose([r.out for r in got], (w / w.sum(axis=1, keepdims=True)) @ X)
    assert np.allclose([r.peak_weight for r in got], 1 / w.sum(axis=1))


def test_attention_sends_a_key_that_is_its_value_once(items, pieces):
    q = items.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    i = items.select(F.col("id").alias("iid"), F.col("v").alias("iv"))
    got, want = (rt.attention(q, x, 0.3).orderBy("qid").collect() for x in (i, i.withColumn("val", F.col("iv"))))
    assert got == want


def test_nearest_with_keys_and_ties(items, pieces):
    q = items.where("id % 2 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    i = items.select(F.col("id").alias("iid"), F.col("v").alias("iv"), (F.col("id") % 4 == 0).alias("kind"))
    got = {(r.qid, r.kind, r["rank"]): r.iid for r in mm.nearest(q, i, 2, "kind").collect()}
    ids, c = np.arange(150) * 3 - 60, np.round(cosines(), 12)
    for k, qid in enumerate(ids):
        if qid % 2:
            continue
        for kind in (True, False):
            best = sorted((-c[k, j], ids[j]) for j in range(150) if (ids[j] % 4 == 0) == kind)[:2]
            assert [got[qid, kind, r] for r in (1, 2)] == [b[1] for b in best]


def components(limit):
    c, label = cosines() > limit, np.arange(150)
    for _ in range(150):
        label = np.array([min(label[c[k]].min(), label[k]) for k in range(150)])
    return label * 3 - 60


def test_clusters(items, pieces):
    label = components(0.9)
    size = {k: (label == k).sum() for k in label}
    want = {(i * 3 - 60, label[i]) for i in range(150) if size[label[i]] >= 3}
    assert {(r.id, r.cluster) for r in mm.cosine_clusters(items, 0.9, 3).collect()} == want


def test_a_row_meets_only_ranges_up_to_its_own(items, monkeypatch):
    monkeypatch.setattr(passes, "RESIDENT", 30)
    rows = passes.whole_slots(items, items, triangle=True)
    n = rows.where("side = 1").count()
    assert n < 0.7 * 5 * 150 and rows.where("side = 0").count() == 150
    assert rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("slot").alias("n")).agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("bucket", [4096, 5])
def test_hashed_search_finds_what_is_near(items, monkeypatch, bucket):
    monkeypatch.setattr(passes, "BUCKET", bucket)
    tables, bits = passes.recall_shape(150, 0.95, per_bucket=16)
    shape = (tables, bits, "t", 8)
    exact = {r.id: r.novelty for r in mm.novelty(items).collect()}
    found = {r.id: r.novelty for r in mm.novelty(items, shape).collect()}
    near = [k for k, v in exact.items() if v < 0.05]
    assert np.mean([abs(found[k] - exact[k]) < 1e-9 for k in near]) >= 0.9
    assert all(found[k] >= exact[k] - 1e-9 for k in exact)
    close = mm.cosine_clusters(items, 0.95, 3, shape)
    label = components(0.95)
    assert all(label[(r.id + 60) // 3] == label[(r.cluster + 60) // 3] for r in close.collect())


def test_recall_on_the_given_vectors(spark):
    """Measured recall of the registered hash tables for the three nearest."""
    from tidemark.plans.memory_queries import HASHED

    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q, i = v.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), v.select(F.col("vec_id").alias("iid"), F.col("v").alias("iv"))
    exact, hashed = mm.nearest(q, i, 3), mm.nearest(q, i, 3, hashed=HASHED)
    both = exact.join(hashed, ["qid", "iid"]).count()
    assert both / exact.count() >= 0.9


def test_empty_sides(spark, items):
    none = items.limit(0)
    assert mm.novelty(none).count() == 0 and mm.novelty(none, (2, 2, "t", 8)).count() == 0
    q, i = items.select(F.col("id").alias("qid"), F.col("v").alias("qv")), none.select(F.col("id").alias("iid"), F.col("v").alias("iv"))
    assert mm.nearest(q, i, 2).count() == 0
    assert mm.novelty(items.limit(1)).first().novelty == 1.0


def test_top_looks_only_at_rows_that_a_batch_can_change(monkeypatch):
    rng = np.random.default_rng(3)
    q, v = rng.integers(-2, 3, (50, 4)).astype(float), rng.integers(-2, 3, (900, 4)).astype(float)
    sorted_rows, plain = [], np.argsort
    monkeypatch.setattr(passes.np, "argsort", lambda a, **k: sorted_rows.append(len(a)) or plain(a, **k))
    top = passes.Top(np.arange(50), q, 3, None)
    for a in range(0, 900, 100):
        top.take(pd.DataFrame({"id": np.arange(a, a + 100), "v": list(v[a:a + 100])}))
    got = top.result()
    c = np.round(passes.unit(q) @ passes.unit(v).T, 12)
    want = plain(-c, axis=1, kind="stable")[:, :3]
    assert got["iid"].to_numpy().reshape(50, 3).tolist() == want.tolist()
    assert sum(sorted_rows) < 50 * 9


def test_write_threshold_scores_its_vectors_once(spark):
    import __spark_entry__ as entry_module

    df = entry_module.queries()["mm3_write_threshold"](spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    assert df.count() == 1


def test_recall_is_attention_and_settled_queries_stay(spark):
    rng = np.random.default_rng(5)
    x = np.sign(rng.normal(size=(300, 64)))
    x[1], x[3] = x[0], x[2]
    x[3, :2] *= -1                           # 0 and 1 are copies, 2 and 3 lie close together
    q = x.copy()
    for k in range(len(q)):
        q[k, rng.choice(np.arange(2, 64), 6, replace=False)] *= -1
    q[2, 0] *= -1                            # as near to 2 as to 3
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "iid long, iv array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "qid long, qv array<double>")
    got = {r["qid"]: r for r in rt.recall(queries, items, 8.0).collect()}
    plain = {r["qid"]: r["out"] for r in rt.attention(queries, items, 8.0).collect()}
    assert all(np.allclose(got[k]["out"], plain[k], rtol=0, atol=1e-12) for k in plain)
    assert got[2]["tied"] and not got[0]["settled"] and not got[3]["settled"]
    settled = [k for k in got if got[k]["settled"]]
    assert len(settled) > 250 and all(got[k]["out"] == x[k].tolist() for k in settled)
    again = rt.recall(spark.createDataFrame([(k, got[k]["out"]) for k in settled], "qid long, qv array<double>"), items, 8.0)
    assert all(r["out"] == x[r["qid"]].tolist() for r in again.collect())
    end = {r["qid"]: r["state"] for r in rt.retrieve_iterated(queries, items).collect()}
    assert len(end) == 300 and all(end[k] == x[k].tolist() for k in settled)


@pytest.mark.parametrize("scale", [0.02, 0.05, 30.0])
def test_attention_of_few_dimensions(spark, scale, monkeypatch):
    rng = np.random.default_rng(11)
    q, k, v = rng.normal(size=(3, 120, 3))
    queries = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(q)], "qid long, qv array<double>")
    items = spark.createDataFrame([(n, r.tolist(), u.tolist()) for n, (r, u) in enumerate(zip(k, v))], "iid long, iv array<double>, val array<double>")
    z = scale * q @ k.T
    w = np.exp(z - z.max(axis=1, keepdims=True))
    met = []
    monkeypatch.setattr(rt, "_met", lambda *a, kept=rt._met: met.append(1) or kept(*a))
    got = {r["qid"]: r["out"] for r in rt.attention_low(queries, items, scale).collect()}
    assert np.allclose([got[n] for n in range(120)], w @ v / w.sum(axis=1, keepdims=True), rtol=0, atol=1e-13)
    assert bool(met) == (scale == 30.0)      # only large scores need every pair


def test_forest_decides_at_the_limit_in_double_precision():
    rng = np.random.default_rng(2)
    q = rng.normal(size=(60, 64))
    x = passes.unit(q[::2] + 0.3 * rng.normal(size=(30, 64)))
    exact = (x[:, None, :] * passes.unit(q)[None]).sum(axis=2)
    single = (x.astype(np.float32) @ passes.unit(q).astype(np.float32).T).astype(float)
    for limit in (np.sort(exact.ravel())[-40] - 1e-15, np.sort(exact.ravel())[-40] + 1e-15):
        f = passes.Forest(np.arange(60), q, limit)
        out = f.take(pd.DataFrame({"id": np.arange(100, 130), "v": list(x)}))
        assert f.single.dtype == np.float32 and (single != exact).any()
        linked = {j: set(np.flatnonzero(exact[j] > limit)) for j in range(30)}
        assert set(out["j"]) == {100 + j for j in linked if linked[j]}
        assert all(i in linked[j - 100] for i, j in zip(out["i"], out["j"]))
