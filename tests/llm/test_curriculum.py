"""Training positions of every pass of the mix."""

import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing

from .conftest import AWKWARD, DOCS


def mixed_rows():
    rng = np.random.default_rng(2)
    return [(i, "w " * int(rng.integers(0, 40)), None, s, None) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 300, p=[0.05, 0.55, 0.3, 0.1]))]


def demand(u, shape):
    """The share of a schedule's whole demand up to time u."""
    fine = np.linspace(0, 1, 20_001)
    w = np.interp(fine, np.linspace(0, 1, len(shape)), shape)
    cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    return np.interp(u, fine, cum / cum[-1])


def test_every_pass_has_its_position(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    got = mixing.mix_passes(docs).collect()
    for k, s in enumerate("abcd"):
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["position"])
        at = 0
        for r in mine:                                   # pass after pass, each where the words before it end
            assert abs(demand(r["position"], mixing.SHAPES[k % 3]) - at / r["target"]) < 1e-3
            at += r["taken"]
        assert at == math.floor(mine[0]["target"])
        assert [r["pass"] for r in mine] == sorted(r["pass"] for r in mine)
    full = [r for r in got if r["source"] == "a"]
    assert {r["pass"] for r in full} == {1, 2, 3} and max(r["position"] for r in full) > 0.9
    folded = {r["id"]: (r["taken"], r["passes"], r["position"]) for r in mixing.mix(docs).collect() if r["taken"]}
    want = {}
    for r in sorted(got, key=lambda r: (r["id"], r["pass"])):
        t, n, p = want.get(r["id"], (0, 0, r["position"]))
        want[r["id"]] = (t + r["taken"], n + 1, p)
    assert folded == want


def test_the_pipeline_stage_writes_in_order_of_position(spark, tmp_path):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    out = corpus_pipeline.mixture(spark, docs, None)
    placed = mixing.mix_passes(docs).orderBy("position", "id").collect()
    assert [r["doc_id"] for r in out.collect()] == [r["id"] for r in placed]
    out.write.parquet(f"file://{tmp_path}/mix")
    read = spark.read.parquet(f"file://{tmp_path}/mix").withColumn("file", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())
    assert [r["doc_id"] for r in sorted(read.collect(), key=lambda r: (r["file"].rsplit("/", 1)[1], r["row"]))] == [r["id"] for r in placed]


def test_passes_of_awkward_rows(spark, awkward, clashing, nothing):
    for table in (awkward, clashing):
        got = mixing.mix_passes(table).collect()
        assert all(0 < r["taken"] <= r["size"] and 0 <= r["position"] <= 1 for r in got)
        assert sum(r["taken"] for r in got) == sum(r["taken"] for r in mixing.mix(table).collect())
    assert mixing.mix_passes(nothing).count() == 0 and len(AWKWARD) == awkward.count()
