"""Statistics and state space against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kalman as kf, tails
from tidemark.operators import gates as gt, statespace as ss, stats as st
from tidemark.operators.resample import resampled
from tidemark.operators.whiteness import ljung_box
from tidemark.session import CHUNK_ROWS_KEY, DEFAULT_CHUNK_ROWS


def test_tail_probabilities():
    assert tails.t_upper(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert tails.t_upper(-1.0, 1) == pytest.approx(0.75)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(2.0, 2) == pytest.approx(math.exp(-1))
    assert tails.chi2_upper(60.0, 30) == pytest.approx(0.000921, abs=2e-6)
    assert tails.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)


def test_false_discovery_rate(spark, both_ways):
    p = [0.001, 0.02, 0.04, 0.5, 0.02, 0.9, 0.0301]
    got = st.fdr_bh(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id int, p double"), "p").orderBy("id").collect()
    order = np.argsort(p, kind="stable")
    v = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.empty(len(p))
    adj[order] = np.minimum(np.minimum.accumulate(v[::-1])[::-1], 1)
    assert [r["p_adj"] for r in got] == pytest.approx(list(adj))
    assert [r["reject"] for r in got] == list(adj <= 0.05)


def test_profile_interval_on_parabolas(spark):
    g1 = -0.5 + np.linspace(-0.4, 0.4, 9)
    g2 = 0.3 * np.exp(np.linspace(-0.8, 0.8, 9))
    rows = [("lin", float(g), float(-0.5 * ((g + 0.5) / 0.1) ** 2)) for g in g1[::-1]] + [("log", float(g), float(-0.5 * (math.log(g / 0.3) / 0.2) ** 2)) for g in g2]
    rows += [("open", float(g), float(-0.5 * (math.log(g / 0.3) / 2) ** 2)) for g in g2]
    d = spark.createDataFrame(rows, "param string, g double, ll double")
    r = {x["param"]: x for x in st.profile_interval(d, ["param"], "g", "ll").collect()}
    assert r["lin"]["scale"] == "linear" and r["lin"]["lo"] == pytest.approx(-0.696, abs=0.02) and r["lin"]["hi"] == pytest.approx(-0.304, abs=0.02)
    assert r["log"]["scale"] == "log" and r["log"]["se"] == pytest.approx(0.2, abs=0.02)
    assert r["open"]["lo"] is None and r["open"]["hi"] is None
    assert {x["param"]: x["unimodal"] for x in st.profile_unimodal(d, ["param"], "g", "ll").collect()} == {"lin": True, "log": True, "open": True}


def test_projection_in_units_of_the_shift(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 3.0, 0.0])], "s int, d array<double>")
    u = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    r = st.project(d, u, F.lit(2.0)).orderBy("s").collect()
    assert [x["c"] for x in r] == [0.5, 0.0] and [x["residual_norm"] for x in r] == [0.0, 3.0]


def test_sobol_of_an_additive_model(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 4000, 2))
    f = lambda x: x[:, 0] * 3 + x[:, 1]
    rows = []
    for p in range(2):
        ab = a.copy()
        ab[:, p] = b[:, p]
        rows += [("y", p, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(f(a), f(b), f(ab)))]
    r = {x["param"]: x for x in st.sobol(spark.createDataFrame(rows, "output string, param int, row int, y_a double, y_b double, y_ab double"), ["y"]).collect()}
    assert r[0]["s1"] == pytest.approx(0.9, abs=0.06) and r[0]["st"] == pytest.approx(0.9, abs=0.06) and r[1]["st"] == pytest.approx(0.1, abs=0.03)


def test_bootstrap_weights_repeat_and_average_one(spark):
    u = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, v double")
    get = lambda: resampled(u, [], "id", {"s": F.col("v")}, 50, "s").orderBy("rep").collect()
    a = get()
    assert a == get() and [r["rep"] for r in a] == list(range(1, 51)) and len({r["s"] for r in a}) > 30
    assert sum(r["w"] for r in a) / 1500 == pytest.approx(1, abs=0.1)


def sobol_rows(n, far=0.0):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, n, 2))
    f = lambda x: x[:, 0] * 3 + x[:, 1] + far
    rows = []
    for p in range(2):
        ab = a.copy()
        ab[:, p] = b[:, p]
        rows += [(p, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(f(a), f(b), f(ab)))]
    return rows


def test_sobol_intervals_hold_the_indices_and_shrink(spark):
    schema = "param int, row int, y_a double, y_b double, y_ab double"
    get = lambda n: {r["param"]: r for r in st.sobol_bootstrap(spark.createDataFrame(sobol_rows(n), schema), ["param"], "row", 200, "t").collect()}
    small, large = get(200), get(3200)
    for p, s1 in ((0, 0.9), (1, 0.1)):
        assert large[p]["s1_lo"] < s1 < large[p]["s1_hi"] and large[p]["st_lo"] < s1 < large[p]["st_hi"]
        assert large[p]["st_hi"] - large[p]["st_lo"] < 0.5 * (small[p]["st_hi"] - small[p]["st_lo"])


def test_total_sobol_interval_keeps_its_digits_far_from_zero(spark):
    schema = "param int, row int, y_a double, y_b double, y_ab double"
    get = lambda far: {r["param"]: r["st_lo"] for r in st.sobol_bootstrap(spark.createDataFrame(sobol_rows(200, far), schema), ["param"], "row", 40, "t").collect()}
    near, far = get(0.0), get(1e7)
    assert far == {p: pytest.approx(v, rel=1e-6) for p, v in near.items()}


def test_sobol_on_logarithms_leaves_out_outputs_below_zero(spark):
    schema = "param int, row int, y_a double, y_b double, y_ab double"
    rows = [(p, i, float(np.exp(a)), float(np.exp(b)), float(np.exp(c))) for p, i, a, b, c in sobol_rows(200)]
    good = [(0, 1000, None, None, None)]
    bad = [(0, 1000, -1.0, 0.0, -2.0)]
    got = [{r["param"]: r for r in st.sobol_bootstrap(spark.createDataFrame(rows + x, schema), ["param"], "row", 40, "t", scale="log").collect()} for x in (good, bad)]
    assert got[0] == got[1] and got[0][0]["st_lo"] > 0.7


def test_ljung_box_matches_numpy(spark, both_ways):
    x = np.random.default_rng(2).normal(size=60)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "ses int, t int, v double")
    q = ljung_box(d, ["ses"], "t", "v", 5).first()
    e = x - x.mean()
    r = [np.dot(e[:-k], e[k:]) / np.dot(e, e) for k in range(1, 6)]
    assert q["lags"] == 5 and q["q"] == pytest.approx(60 * 62 * sum(v * v / (60 - k) for k, v in enumerate(r, 1)))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    d = spark.createDataFrame([(1, i, f"x{i}") for i in range(20)], "k int, id int, v string")
    f = lambda x: gt.fingerprint(x, ["k"], "id", ["v"]).first()["fingerprint"]
    assert f(d) == f(d.repartition(7)) != f(d.withColumn("v", F.when(F.col("id") == 3, "y").otherwise(F.col("v"))))


def stacked_loglik(p, ev):
    """Density of all observations at once from the stationary Gaussian process."""
    s = kf.stationary(p)
    S = np.array([[s[0], s[1]], [s[1], s[2]]])
    H, R, y, at = [], [], [], []
    for t, kind, v0, v1 in ev:
        if kind == 0:
            for k, v in enumerate((v0, v1)):
                if v is not None:
                    H.append(np.eye(2)[k]), R.append(("A", "Phi")[k]), y.append(v), at.append(t)
        elif v0 is not None:
            H.append(np.array([-p["beta"], p["alpha"]])), R.append("Q"), y.append(v0), at.append(t)
    n = len(y)
    C = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            dt = abs(at[a] - at[b])
            f00, f10, f11 = kf.transition({k: np.float64(v) for k, v in p.items()}, dt)
            M = np.array([[f00, 0.0], [f10, f11]]) @ S
            C[a, b] = H[a] @ (M if at[a] >= at[b] else M.T) @ H[b]
            if a == b:
                C[a, b] += p["r_" + R[a]] ** 2
            elif at[a] == at[b] and {R[a], R[b]} == {"A", "Phi"}:
                C[a, b] += p["rho"] * p["r_A"] * p["r_Phi"]
    return -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(C)[1] + np.array(y) @ np.linalg.solve(C, y))


@pytest.mark.parametrize("rho", [0.0, 0.35])
@pytest.mark.parametrize("rows", [DEFAULT_CHUNK_ROWS, 700])
def test_filter_equals_the_stacked_density(spark, rho, rows):
    rng = np.random.default_rng(5)
    obs = []
    for ses in (1, 2):
        for k in range(18):
            v = [None if rng.random() < 0.25 else float(x) for x in rng.normal(size=2)]
            obs.append((ses, round(k / 6 + float(rng.random()) * 0.1, 3), 0, *v))
        obs += [(ses, float(t), 1, None if t == 2.0 else float(rng.normal()), None) for t in (0.9, 1.7, 2.0, 2.9)]
    p = {**kf.NOMINAL, "sigma_A": 0.6, "k_int": -0.4, "rho": rho}
    spark.conf.set(CHUNK_ROWS_KEY, str(rows))
    try:
        d = spark.createDataFrame(obs, "ses int, t double, kind int, v0 double, v1 double")
        got = {r["ses"]: r["ll"] for r in ss.score(d, ss.parameter_sets([p])).collect()}
        pred = ss.filtered(d, p).where("kind = 1").count()
    finally:
        spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
    for ses in (1, 2):
        ev = sorted([o[1:] for o in obs if o[0] == ses], key=lambda e: (e[0], e[1]))
        assert got[ses] == pytest.approx(stacked_loglik(p, ev), abs=1e-7)
    assert pred == 8


@pytest.mark.parametrize("rows", [DEFAULT_CHUNK_ROWS, 5000])
def test_simulated_sessions_have_the_stationary_law(spark, rows):
    obs = [(s, k / 6, 0, 1.0, 1.0) for s in range(20) for k in range(120)]
    p = {**kf.NOMINAL, "k_inh": 1.0, "k_d": 0.8, "k_int": 0.2, "sigma_A": 0.5, "sigma_Phi": 0.4, "r_A": 0.05, "r_Phi": 0.05}
    spark.conf.set(CHUNK_ROWS_KEY, str(rows))
    try:
        d = spark.createDataFrame(obs, "ses int, t double, kind int, v0 double, v1 double")
        sim = ss.replicates(d, p, 4, "sim").cache()
        wrong = [{**p, "k_inh": 3.0}, {**p, "k_d": 3.0}, {**p, "sigma_A": 1.2}, {**p, "sigma_Phi": 0.1}]
        ll = {r["pid"]: r["ll"] for r in ss.best_by_all(ss.score(sim, ss.parameter_sets([p, *wrong]), keys=("rep", "ses"))).collect()}
        m = sim.agg(F.var_pop("v0").alias("a"), F.var_pop("v1").alias("b"), F.covar_pop("v0", "v1").alias("c")).first()
    finally:
        spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
    s = kf.stationary(p)
    assert m["a"] == pytest.approx(s[0] + 0.0025, rel=0.15) and m["b"] == pytest.approx(s[2] + 0.0025, rel=0.15) and m["c"] == pytest.approx(s[1], abs=0.03)
    assert max(ll, key=ll.get) == 0


def test_rating_statistics_match_numpy(spark, both_ways):
    rng = np.random.default_rng(4)
    rows = [(rep, ses, float(k), int(v)) for rep in range(3) for ses in range(7) for k, v in enumerate(rng.integers(-2, 3, 2 + ses * (rep + 1)))]
    rows += [(1, 7, float(k), 1) for k in range(6)]                      # never varies: no correlation, an SD of zero
    got = {}
    d = spark.createDataFrame(rows, "rep int, ses long, t double, level int")
    for r in ss.rating_statistics(d, F.col("ses") % 2 == 1, -3, 3).collect():
        got[r["rep"], r["statistic"], r["level"]] = r["value"]
    for rep in range(3):
        x = {s: np.array([v for p, q, _, v in rows if (p, q) == (rep, s)]) for s in {q for p, q, _, _ in rows if p == rep}}
        every = np.concatenate(list(x.values()))
        for level in range(-3, 4):
            assert got[rep, "level_share", level] == pytest.approx(np.mean(every == level))
        ac = [np.corrcoef(v[:-1], v[1:])[0, 1] for v in x.values() if len(v) > 3 and np.std(v[:-1]) > 0 and np.std(v[1:]) > 0]
        assert got[rep, "lag1_median", None] == pytest.approx(np.median(ac))
        sd = [np.mean([np.std(v) for s, v in x.items() if s % 2 == g]) for g in (0, 1)]
        assert got[rep, "sd_difference", None] == pytest.approx(sd[1] - sd[0])


def test_predictive_bands_keep_the_data_out_of_the_band(spark):
    d = spark.createDataFrame([(rep, "x", 100.0 if rep == 0 else float(rep)) for rep in range(42)], "rep int, statistic string, value double")
    r = ss.predictive_bands(d, ["statistic"]).first()
    assert (r["observed"], r["sim_mean"], r["lo"], r["hi"]) == (100.0, 21.0, 2.0, 40.0)


def test_effect_interval_keeps_its_digits_far_from_zero(spark):
    x = np.random.default_rng(8).normal(size=60)
    get = lambda far, keys: st.effect_bootstrap(spark.createDataFrame([("k", i, float(far + v)) for i, v in enumerate(x)], "key string, id long, diff double"), keys, "id", 400, "e").first()
    near, far = get(0.0, []), get(1e8, ["key"])
    spread_lo, spread_hi = 1e8 / far["hi"], 1e8 / far["lo"]
    assert near["lo"] < x.mean() / x.std(ddof=1) < near["hi"]
    assert 0.7 * x.std() < spread_lo < x.std() < spread_hi < 1.3 * x.std()


def test_resampled_sums_equal_a_loop_over_units_without_a_row_per_draw(spark, capsys):
    from hashlib import md5

    from tidemark.operators.resample import POISSON

    rows = [(i % 20, str(i), None if i % 7 == 0 else float(i)) for i in range(60)] + [(0, "1", 5.0), (1, None, 2.0), (30, "2", None)]
    u = spark.createDataFrame(rows, "k int, id string, v double")
    r = resampled(u, ["k"], "id", {"s": F.col("v")}, 20, "z")
    r.explain()
    assert "Generate" not in capsys.readouterr().out
    want = {}
    for k, i, v in rows:
        for rep in range(1, 21):
            at = 4 * ((rep - 1) % 8)
            digits = md5("|".join(["z", str((rep - 1) // 8)] + ([] if i is None else [i])).encode()).hexdigest()[at:at + 4]
            w = sum(digits >= p for p in POISSON)
            if w:
                n, s = want.get((k, rep), (0, None))
                want[k, rep] = (n + w, s if v is None else (s or 0.0) + w * v)
    assert {(x["k"], x["rep"]): (x["w"], x["s"]) for x in r.collect()} == want
    odd = spark.createDataFrame([(str(i), float("inf") if i == 3 else 1.0) for i in range(5)], "id string, v double")
    got = resampled(odd, [], "id", {"s": F.col("v")}, 40, "z").collect()
    assert 0 < sum(math.isinf(x["s"]) for x in got) < len(got) and not any(math.isnan(x["s"]) for x in got)


def test_replicates_do_not_depend_on_the_chunks_of_a_session(spark):
    obs = [(s, k / 6, 0, None if k % 11 == 0 else 1.0, 1.0) for s in range(3) for k in range(60)] + [(s, k / 2 + 0.05, 1, 1.0, None) for s in range(3) for k in range(12)]
    d = spark.createDataFrame(obs, "ses int, t double, kind int, v0 double, v1 double")
    got = []
    try:
        for rows in (DEFAULT_CHUNK_ROWS, 2000):
            spark.conf.set(CHUNK_ROWS_KEY, str(rows))
            sim = ss.replicates(d, kf.NOMINAL, 27, "sim").collect()
            got.append({(r["rep"], r["ses"], r["t"], r["kind"]): (r["v0"], r["v1"]) for r in sim})
    finally:
        spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
    assert len(got[0]) == 27 * len(obs) and got[0].keys() == got[1].keys()
    for key, (v0, v1) in got[0].items():
        w0, w1 = got[1][key]
        assert (v0 is None) == (w0 is None) == (key[3] == 0 and round(key[2] * 6) % 11 == 0) and (v1 is None) == (w1 is None) == (key[3] == 1)
        assert v0 is None or w0 == pytest.approx(v0, abs=1e-9)
        assert v1 is None or w1 == pytest.approx(v1, abs=1e-9)
    assert len({v for v, _ in got[0].values()}) > 0.8 * len(got[0])


@pytest.mark.parametrize("sets", [1, 5])
def test_evidence_is_the_filters_log_likelihood(sets):
    rng = np.random.default_rng(3)
    n, size = 40, 12
    t, kind = np.sort(rng.uniform(0, 9, (n, size)), axis=1), (rng.random((n, size)) < 0.3).astype(float)
    t[5, 3] = t[5, 2]                                  # two events at one time
    v0, v1 = rng.normal(size=(2, n, size))
    v0[rng.random(v0.shape) < 0.2], v1[(rng.random(v1.shape) < 0.2) | (kind == 1)] = np.nan, np.nan
    for k, length in enumerate(np.sort(rng.integers(1, size + 1, n))):
        for a in (t, kind, v0, v1):
            a[k, length:] = np.nan
    each = {c: v * np.exp(0.1 * rng.normal(size=(n, sets))) for c, v in kf.NOMINAL.items()}
    shared = {c: v[:1] for c, v in each.items()}
    for p in (each, shared, {**each, "rho": np.full((n, sets), 0.2)}):
        for use in ({}, {"use_eeg": False}, {"use_rating": False}):
            want = kf.run_batch(t, kind, v0, v1, {c: np.broadcast_to(v, (n, sets)) for c, v in p.items()}, **use)[0].ll
            assert np.allclose(kf.evidence(t, kind, v0, v1, p, **use), want, rtol=1e-12, atol=1e-12)


def test_shared_sets_do_not_travel_with_the_sessions(spark):
    obs = spark.createDataFrame([(s, float(k), 0, 0.1 * k, 0.2) for s in range(4) for k in range(5)], "ses long, t double, kind int, v0 double, v1 double")
    scored = ss.score(obs, ss.parameter_sets([{"k_inh": 0.123456}, {"k_inh": 0.3}]))
    assert scored.count() == 8
    assert "0.123456" not in scored._jdf.queryExecution().executedPlan().toString()


def test_slopes_are_differences_of_the_log_likelihood():
    rng = np.random.default_rng(5)
    n, size, copies = 5, 11, 3
    t, kind = np.sort(rng.uniform(0, 9, (n, size)), axis=1), (rng.random((n, size)) < 0.3).astype(float)
    t[3, 4] = t[3, 3]
    seen = [rng.random((n, size)) > 0.2, (rng.random((n, size)) > 0.2) & (kind == 0)]
    for k, length in enumerate((11, 8, 11, 11, 1)):
        t[k, length:], kind[k, length:], seen[0][k, length:], seen[1][k, length:] = np.nan, np.nan, False, False
    y = rng.normal(size=(2, size, n, copies))
    p = {c: v * np.exp(0.1 * rng.normal(size=copies)) for c, v in kf.NOMINAL.items()}
    p["k_d"][1:] = p["k_inh"][1:] + [3e-5, 0.0]       # nearly and exactly equal rates

    def plain(p, r):
        shown = [np.where(s, v[:, :, r].T, np.nan) for s, v in zip(seen, y)]
        return kf.run_batch(t, kind, *shown, {c: np.broadcast_to(v[r], (n, 1)) for c, v in p.items()})[0].ll[:, 0]
    ll, g = kf.slopes(t, kind, seen, y, p)
    for r in range(copies):
        assert np.allclose(ll[:, r], plain(p, r), rtol=1e-10)
        for name, slope in zip(kf.SLOPES, g):
            far = [plain({**p, name: p[name] + h}, r) for h in (1e-5, -1e-5)]
            assert np.allclose(slope[:, r], (far[0] - far[1]) / 2e-5, rtol=1e-6, atol=2e-3)
    one = {c: v[:1] for c, v in p.items()}
    same = kf.slopes(t, kind, seen, y, {c: np.repeat(v, copies) for c, v in one.items()})
    shared = kf.slopes(t, kind, seen, y, one)
    assert np.allclose(shared[0], same[0]) and np.allclose(shared[1], same[1])


def test_every_replicate_gets_its_own_estimates_of_all_free_parameters(spark, monkeypatch):
    """The estimates of the copies that `replicates` draws: their slopes vanish there, however the sessions are cut."""
    rng = np.random.default_rng(6)
    obs = []
    for ses in range(12):
        obs += [(ses, k / 6, 0, *[None if rng.random() < 0.1 else 1.0 for _ in range(2)]) for k in range(40)]
        obs += [(ses, k / 2 + 0.05, 1, 1.0, None) for k in range(14)]
    d = spark.createDataFrame(obs, "ses int, t double, kind int, v0 double, v1 double")
    p = {**kf.NOMINAL, "k_inh": 1.0, "k_d": 0.6, "k_int": 0.5, "sigma_A": 0.6, "sigma_Phi": 0.5, "alpha": 0.8, "beta": 0.5, "r_A": 0.3, "r_Phi": 0.3, "r_Q": 0.3}
    got = []
    for rows, cells in ((DEFAULT_CHUNK_ROWS, kf.CELLS), (DEFAULT_CHUNK_ROWS, 300), (2000, kf.CELLS)):
        spark.conf.set(CHUNK_ROWS_KEY, str(rows))
        monkeypatch.setattr(kf, "CELLS", cells)
        try:
            got.append(np.array(ss.replicate_estimates(d, p, 3, "sim")))
        finally:
            spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
    assert np.allclose(got[0], got[1], rtol=1e-6) and np.allclose(got[0], got[2], rtol=5e-3)
    assert got[0].shape == (3, 2 + len(kf.SLOPES)) and all(len(set(c)) == 3 for c in got[0].T)
    sim = ss.replicates(d, p, 3, "sim").cache()
    for rep, *theta, ll in got[0]:
        best = {**p, **dict(zip(kf.SLOPES, theta))}
        near = [{**best, n: best[n] * f} for n in kf.SLOPES for f in (0.98, 1.02)]
        s = {r["pid"]: r["ll"] for r in ss.best_by_all(ss.score(sim.where(F.col("rep") == int(rep)).drop("rep"), ss.parameter_sets([best, p, *near]))).collect()}
        assert s[0] == pytest.approx(ll, abs=1e-6) and s[0] > s[1] + 1 and max(s, key=s.get) == 0
