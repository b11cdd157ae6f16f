"""Stream jobs over many micro-batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources.files import flatten_json, scratch
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 1)


def one_file_each(spark, rows, order):
    """A stream that delivers one row per micro-batch, then a flush row."""
    base = scratch(spark)
    flush = (-1, -1, START + dt.timedelta(days=200), 0)
    for ses, eid, ts, code in [rows[i] for i in order] + [flush]:
        spark.createDataFrame([(ses, eid, ts, code)], "ses long, eid long, ts timestamp, code int").coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = spark.readStream.schema("ses long, eid long, ts timestamp, code int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return s, base


def at(days, hours=0.0):
    return START + dt.timedelta(days=days, hours=hours)


def test_probe_numbers_go_on_after_a_long_pause(spark):
    rows = [(1, 0, at(0), 128), (1, 1, at(0, 1), 2), (1, 2, at(4), 128), (1, 3, at(4, 1), 4), (1, 4, at(9), 8)]
    s, base = one_file_each(spark, rows, range(len(rows)))
    d = jobs.run_available(jobs.open_probe_machine(s, "1 hour", 24 * 3600.0), f"{base}/out", f"{base}/cp", spark).where("ses >= 0")
    best = d.groupBy("probe").agg(F.max("n_resp").alias("n"), F.max_by("codes", "n_resp").alias("codes"))
    assert sorted((r["probe"], r["n"], r["codes"]) for r in best.collect()) == [(1, 1, [2]), (2, 2, [4, 8])]


def test_rows_out_of_order_across_batches_are_handled_in_order(spark):
    rows = [(1, 0, at(0), 3), (1, 1, at(0, 1), 100), (1, 2, at(0, 2), 5), (1, 3, at(0, 3), 6), (1, 4, at(0, 4), 100), (1, 5, at(0, 5), 7), (1, 6, at(3), 9)]
    s, base = one_file_each(spark, rows, np.random.default_rng(0).permutation(len(rows)).tolist())
    d = jobs.run_available(jobs.probe_machine(s, "30 days", 36 * 3600.0), f"{base}/out", f"{base}/cp", spark).where("ses >= 0")
    got = {r["probe"]: (r["n"], r["late"], r["practice"]) for r in d.groupBy("probe").agg(F.max("n_codes").alias("n"), F.sum("n_late").alias("late"), F.max("n_practice").alias("practice")).collect()}
    assert got == {1: (2, 0, 1), 2: (1, 1, 0)}


def test_a_window_longer_than_the_bound_fails(spark):
    rows = [(1, 0, at(0), 1), (1, 1, at(0, 30), 2)]
    s, base = one_file_each(spark, rows, [0, 1])
    w = s.where("code = 1").withColumn("w_end", F.col("ts") + F.expr("interval 50 hours"))
    long = jobs.masked_epochs(s.where("code <> 1"), w, "1 hour", 3600, 60 * 3600)
    got = jobs.run_available(long, f"{base}/out", f"{base}/cp", spark).where("ses >= 0").collect()
    assert [r["w_start"] for r in got if r["eid"] == 1] == [at(0)]
    with pytest.raises(Exception, match="longer than longest_seconds"):
        jobs.run_available(jobs.masked_epochs(s.where("code <> 1"), w, "1 hour", 3600, 40 * 3600), f"{base}/out2", f"{base}/cp2", spark)


def test_json_is_flattened_to_any_depth(spark):
    d = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"x":2}'), (2, '{"l":[1,2]}'), (3, "broken")], "id long, doc string")
    got = {(r["id"], r["path"]): r["value"] for r in flatten_json(d, "id", F.col("doc")).collect()}
    assert got[1, "a.b.c.d.e.f"] == "1" and got[1, "x"] == "2" and got[2, "l[1]"] == "2.0"
