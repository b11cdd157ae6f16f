"""Hand-made marker logs with known answers."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as al, decode as dec, intervals as iv, signal as sg
from tidemark.sources import files as fs

LOG = """MW question asked at time  40.0 second
Key 3 (code 3) pressed at time  42.0 seconds, status 1
Key 9 (code 9) pressed at time  43.0 seconds, status 2
Key 1 (code 1) pressed at time  44.0 seconds, status 2
Key 0 (code 0) pressed at time  46.5 seconds, status 3
remark without meaning
MW question asked at time 130.0 second
Key 0 (code 0) pressed at time 133.0 seconds, status 1
Key 2 (code 2) pressed at time 134.0 seconds, status 2
Key 3 (code 3) pressed at time 135.0 seconds, status 3
MW question asked at time 220.0 second
Key 1 (code 1) pressed at time 222.0 seconds, status 1
Key 1 (code 1) pressed at time 223.0 seconds, status 2
Key 2 (code 2) pressed at time 224.0 seconds, status 3"""
SHIFT = 7.5
MARKERS = [(5.0, 4), (47.5, 128), (49.5, 8), (51.5, 2), (54.0, 16), (137.5, 128), (141.5, 4), (142.5, 8), (227.5, 128), (229.5, 2), (230.5, 2), (231.5, 4), (300.0, 254)]


def marker_log(spark, rows=MARKERS):
    return spark.createDataFrame([(1, k, float(t), c) for k, (t, c) in enumerate(rows)], "ses long, eid long, t double, code int")


def behaviour(spark):
    lines = spark.createDataFrame(list(enumerate(LOG.splitlines())), "line_no long, line string")
    d = fs.parse_log(lines)
    assert d.count() == 13
    rows = d.orderBy("line_no").collect()
    q, presses = -1, []
    qs = []
    for r in rows:
        if r["kind"] == "question":
            q += 1
            qs.append((1, q, r["t_q"]))
        else:
            presses.append((1, q, r["line_no"], r["key"], r["status"]))
    ans = dec.answers_from_presses(spark.createDataFrame(presses, "ses long, probe long, ord long, key int, status int"))
    return spark.createDataFrame(qs, "ses long, j long, t double"), ans.withColumnRenamed("probe", "j")


def test_decoding_with_the_second_clock(spark):
    logs, ans = behaviour(spark)
    p = dec.probes_a(marker_log(spark))
    marks = p.select("ses", (F.col("probe") - 1).alias("i"), F.col("onset").alias("o"))
    off, m = al.align(["ses"], marks, logs, 0.5)
    assert off.first()["offset"] == pytest.approx(SHIFT)
    assert sorted((r["i"], r["j"]) for r in m.collect()) == [(0, 0), (1, 1), (2, 2)]
    keys = m.join(ans, ["ses", "j"]).select("ses", (F.col("i") + 1).alias("probe"), F.col("j").alias("log_row"), "k1", "k2", "k3")
    d = dec.decode_a(p, keys).orderBy("probe").collect()
    assert [(r["q1"], r["q2"], r["q3"], r["rating"], r["source"]) for r in d] == [
        (3, 1, 0, 2.0, "behaviour"), (0, 2, 3, -2.0, "behaviour"), (1, 1, 2, 0.0, "behaviour")]
    assert [r["involuntary"] for r in d] == [1, 0, 0]
    s = dec.decode_diagnostics(dec.decode_a(p, keys)).where("ses is null").first()
    assert (s["n_probe"], s["n_matched"], s["key0_total"], s["code_agree"], s["code_total"]) == (3, 3, 2, 7, 7)
    alone = dec.decode_a(p).orderBy("probe").collect()
    assert [r["q1"] for r in alone] == [None, None, 1] and [r["source"] for r in alone] == ["none", "none", "events"]


def test_late_codes_practice_and_routing(spark, both_ways):
    rows = [(1.0, 3), (2.0, 5), (10.0, 100), (11.0, 1), (12.0, 5), (13.0, 2), (13.5, 0), (14.0, 4), (80.0, 6),
            (90.0, 100), (91.0, 2), (92.0, 7), (93.0, 1), (94.0, 6), (95.0, 3), (96.0, 2),
            (150.0, 100), (151.0, 3), (152.0, 9), (200.0, 100)]
    d = dec.decode_b(dec.probes_b(marker_log(spark, rows), 60.0)).orderBy("probe").collect()
    assert [(r["n_codes"], r["n_late"], r["n_practice"]) for r in d] == [(4, 1, 2), (6, 0, 0), (2, 0, 0), (0, 0, 0)]
    assert [r["rating"] for r in d] == [5.0, -7.0, None, None]
    assert d[0]["focus"] == 4 and d[0]["engagement"] is None
    assert (d[1]["engagement"], d[1]["visual"], d[1]["auditory"]) == (6, 3, 2)
    assert d[0]["resp_end"] == 14.0 and d[3]["resp_end"] is None


def test_epochs_masked_by_strict_overlap(spark):
    p = spark.createDataFrame([(1, 71.4, 79.8), (1, 125.6, None), (1, 180.0, 187.0)], "ses long, onset double, resp_end double")
    w = iv.probe_windows(p, 3.0, 15.0)
    g = iv.epoch_grid(spark.createDataFrame([(1, 208.0)], "ses long, dur double"), "dur", 10.0)
    off = [r["epoch"] for r in iv.masked_grid(g, w, 10.0).where("not observed").orderBy("epoch").collect()]
    # 180.0 touches epoch 18 (ends at 180) and 190.0 touches epoch 20 (starts at 190): not masked.
    assert g.count() == 20 and off == [8, 9, 13, 14, 15, 19]


def test_probe_schedule_needs_room(spark):
    s = spark.createDataFrame([(1, 10, 4), (2, 3, 4), (3, 5, 0)], "ses long, n long, p long")
    assert sorted((r["ses"], r["epoch"]) for r in iv.probe_schedule(s, "n", "p").collect()) == [(1, 3), (1, 7)]


def test_adaptive_rule_keeps_a_loud_recording(spark):
    rows = [(1, e, c, 0, -100.0) for e in range(20) for c in range(3)]
    rows += [(1, e, c, 1, 100.0 + e + (400.0 if (e, c) == (12, 1) else 0.0)) for e in range(20) for c in range(3)]
    s = spark.createDataFrame([(r, e * 2 + i, c, v) for r, e, c, i, v in rows], "rec int, i long, ch int, v double")
    p = sg.peak_to_peak(s, 2)
    assert sg.fixed_rule(p, 150.0).where("not reject").count() == 0
    assert [r["epoch"] for r in sg.adaptive_rule(p, (0, 1, 2), 150.0).where("reject").collect()] == [12]


def test_repeat_phase_and_tail(spark, both_ways):
    raw = [(1, i, float((i + 1) // 4), 0.0) for i in range(40)]
    d = spark.createDataFrame(raw, "rec int, i long, a double, b double")
    kept = sg.decimate(d, "rec", "i", ["a", "b"], 4).orderBy("i").collect()
    assert [r["i"] for r in kept][:3] == [3, 7, 11]
    t = d.withColumn("bad", F.col("i").isin(5, 38, 39))
    assert sg.trim_missing_tail(t, "rec", "i", F.col("bad")).count() == 5
    assert sg.trim_missing_tail(d.withColumn("bad", F.col("i") == 5), "rec", "i", F.col("bad")).count() == 40


def test_greedy_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 9), (1, 1, 2, 8), (1, 2, 1, 8), (1, 2, 2, 1), (1, 3, 3, 0), (2, 7, 8, 2)], "grp long, left long, right long, score long")
    got = sorted((r["grp"], r["left"], r["right"]) for r in al.assign_greedy(pairs).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 7, 8)]


def test_stage_lines_and_sidecars(spark, tmp_path):
    lines = spark.createDataFrame([("Stage onset dur",), ("W\t0\t30",), ("S2,30,30",), ("rem  60   30",), ("N9 1 2",), ("N3 x 30",), ("W 5",)], "line string")
    assert [(r["stage"], r["onset_s"]) for r in fs.read_stages(lines).collect()] == [("W", 0.0), ("N2", 30.0), ("R", 60.0)]
    (tmp_path / "a.json").write_text('{\n "RecordingDuration": 12.5\n}')
    (tmp_path / "b.json").write_text('{"RecordingDuration": 3, "SamplingFrequency": 512}')
    got = {r["name"]: (r["duration_s"], r["sfreq"]) for r in fs.read_sidecars(spark, str(tmp_path)).collect()}
    assert got == {"a": (12.5, 256.0), "b": (3.0, 512.0)}
    assert sorted(r["name"] for r in fs.file_listing(spark, str(tmp_path), "*.json").collect()) == ["a.json", "b.json"]
