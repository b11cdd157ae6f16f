"""Clock offsets by votes and one ordered pass equal the plain search over all candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as al


def plain(o, t, tol):
    """Candidate scores and the first best, over all differences of rows at most four places apart."""
    out = {}
    for i, a in enumerate(o):
        for j in range(max(0, i - 4), min(len(t), i + 5)):
            c = a - t[j]
            out[i, j] = int((np.abs((o - c)[:, None] - t[None, :]) < tol).any(axis=1).sum())
    best = max(out, key=lambda k: (out[k], -k[0], -k[1]))
    return out, best


def sessions(kind, n):
    rng = np.random.default_rng(11)
    for ses in range(n):
        o = np.sort(rng.uniform(0, 40, rng.integers(1, 25)))
        if kind == "related":
            keep = rng.random(len(o)) > 0.25
            keep[0] = True
            t = np.sort(o[keep] - 3.7 - ses * 0.31 + rng.normal(0, 0.01, keep.sum()))
        elif kind == "bursts":
            t = np.sort(np.concatenate([o - 1.0, o[:3] - 1.0 + 0.02, o[:3] - 1.0]))
        else:
            t = np.sort(rng.uniform(0, 40, rng.integers(1, 25)))
        yield ses, o, t


def frames(spark, data):
    marks = [(s, i, float(v)) for s, o, _ in data for i, v in enumerate(o)]
    logs = [(s, j, float(v)) for s, _, t in data for j, v in enumerate(t)]
    return spark.createDataFrame(marks, "ses long, i long, o double"), spark.createDataFrame(logs, "ses long, j long, t double")


@pytest.mark.parametrize("kind", ["related", "bursts", "unrelated"])
@pytest.mark.parametrize("parts", [4096, 3])
def test_best_offsets_and_scores(spark, monkeypatch, kind, parts):
    monkeypatch.setattr(al, "PART_ROWS", parts)
    data, tol = list(sessions(kind, 12)), 0.05
    got = al.offset_scores(["ses"], *al.sized(["ses"], *frames(spark, data)), tol).collect()
    for ses, o, t in data:
        scores, best = plain(o, t, tol)
        mine = {(r.i, r.j): r.n for r in got if r.ses == ses}
        assert all(scores[k] == n for k, n in mine.items())
        assert max(mine, key=lambda k: (mine[k], -k[0], -k[1])) == best


def test_one_long_session(spark):
    """20,000 markers, a fifth of them unlogged, so that equal events soon lie far more than four places apart."""
    rng = np.random.default_rng(2)
    o = np.cumsum(rng.exponential(2.0, 20_000))
    t = o[rng.random(20_000) > 0.2] - 812.5 + rng.normal(0, 0.004, 1)[0]
    marks, logs = frames(spark, [(0, o, t)])
    m, t2 = al.sized(["ses"], marks, logs)
    kept = al.offset_votes(["ses"], m, t2, al._candidates(["ses"], m, t2, 0.05), True, 0.05)
    assert kept.count() < 10
    off, m = al.align(["ses"], marks, logs, 0.05)
    assert off.first().offset == pytest.approx(o[0] - t[0] if abs(o[0] - t[0] - 812.5) < 1 else 812.5, abs=0.02)
    assert m.count() > 15_900


def test_parts_spread_one_session(spark):
    marks = spark.range(20_000).select(F.lit(0).alias("ses"), F.col("id").alias("i"), (F.col("id") * 2.0).alias("o"))
    m, t = al.sized(["ses"], marks, marks.select("ses", F.col("i").alias("j"), F.col("o").alias("t")))
    assert m.first().parts == 5
    per = al._met(m.where("i < 2"), t, ["ses"], "j", True).groupBy("part").count().collect()
    assert len(per) == 5 and max(r["count"] for r in per) < 10_000


def test_many_small_sessions_are_not_joined_in_one_task(spark):
    rows = [(s, i, float(i + s % 3)) for s in range(40) for i in range(6)]
    marks = spark.createDataFrame(rows, "ses int, i long, o double")
    logs = spark.createDataFrame(rows, "ses int, j long, t double")
    marks, logs = al.sized(["ses"], marks, logs)
    cand = al._candidates(["ses"], marks, logs, 0.05)
    met = al._met(marks, logs, ["ses"], "j", False)
    for d in (marks, logs, met):
        assert d.groupBy(F.spark_partition_id()).count().count() == 4
    assert met.count() == 40 * 36 and cand.count() == sum(abs(i - j) <= al.BAND for i in range(6) for j in range(6)) * 40


def rivals(n):
    """Sessions of 1,000 marks whose log has two clocks, one of which explains six marks more."""
    for ses in range(n):
        rng = np.random.default_rng(ses)
        o = np.cumsum(12 + rng.exponential(10.0, 1000))
        yield ses, o, np.sort(o - np.where(rng.permutation(1000) < 497 + 6 * (ses % 2), 10.9, 10.0))


@pytest.mark.parametrize("parts", [4096, 64])
def test_every_mark_of_a_long_session_votes(spark, monkeypatch, parts):
    monkeypatch.setattr(al, "PART_ROWS", parts)
    monkeypatch.setattr(al, "BLOCK", 256, raising=False)
    data = list(rivals(8))
    got = al.offset_scores(["ses"], *al.sized(["ses"], *frames(spark, data)), 0.05).collect()
    for ses, o, t in data:
        mine = [r for r in got if r.ses == ses]
        best = max(mine, key=lambda r: (r.n, -r.i, -r.j))
        assert best.n == (np.abs((o - best.c)[:, None] - t[None, :]) < 0.05).any(axis=1).sum() >= 503
        assert best.c == pytest.approx((10.0, 10.9)[ses % 2], abs=1e-6)


@pytest.mark.parametrize("parts", [4096, 12])
def test_sessions_and_files_of_a_group_are_scored_in_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(al, "PART_ROWS", parts)
    data, tol = list(sessions("related", 9)) + [(9, np.array([1.0, 2.0]), np.array([]))], 0.05
    marks, logs = frames(spark, data)
    grp = F.floor(F.col("ses") / 3).cast("long").alias("grp")
    got = al.pair_scores(marks.select("*", grp), logs.select(grp, F.col("ses").alias("file"), "j", "t"), tol).collect()
    want = {(s, f): plain(o, t, tol) for s, o, _ in data for f, _, t in data if s // 3 == f // 3 and len(t)}
    assert {(r.ses, r.file): r.score for r in got} == {k: scores[best] for k, (scores, best) in want.items()}
    assert all(r.grp == r.ses // 3 for r in got) and len(got) == len(want)


def test_a_match_at_the_very_limit_counts_as_in_sql(spark):
    """(o - c) - t is rounded to the limit or below it; only what stays below counts."""
    rng = np.random.default_rng(0)
    o = np.round(np.cumsum(rng.integers(1, 40, 120)) * 0.01, 2)
    t = np.round(o[rng.random(120) < 0.7] + 0.05 * rng.integers(-1, 2), 2)
    i, j, c, n = al.best_candidate(np.arange(120), o, np.arange(len(t)), t, 0.05)
    scores, best = plain(o, np.sort(t), 0.05) if (np.diff(t) >= 0).all() else plain(o, t, 0.05)
    assert (i, j) == best and n == scores[best] and c == o[i] - t[j]
