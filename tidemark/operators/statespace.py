"""Scoring of sessions against parameter grids; every estimate is an aggregate of it.

obs(ses, t, kind, v0, v1): kind 0 carries the two features, kind 1 a rating in v0; NULL
is missing; at equal times features come before the rating.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from ..functions import kalman as kf
from ..functions.ascent import ascend
from ..session import chunk_rows, cut_lineage, spread
from .ordered import numbered, running
from .quantiles import quantiles

SESSION_ROWS_DIVISOR = 100  # a chunk of a session is this much smaller than a chunk of rows


def parameter_sets(rows):
    """Whole parameter sets of dicts over the nominal values."""
    return [{**kf.NOMINAL, **r} for r in rows]


def _literal(sets):
    return F.array(*[F.array(*[F.lit(float(r[n])) for n in kf.NAMES]) for r in sets])


def event_order(obs):
    """Events numbered per session, features before the rating at equal times."""
    return numbered(obs, ["ses"], ["t", "kind"], "n")


def packed(obs, keys=("ses",)):
    """Chunks of bounded length: (keys, chunk, t, kind, v0, v1, t_prev)."""
    keys = list(keys)
    size = max(2, chunk_rows(obs.sparkSession) // SESSION_ROWS_DIVISOR)
    d = numbered(obs, keys, ["t", "kind"], "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long"))
    g = d.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct(
        F.col("t").cast("double").alias("t"), F.col("kind").cast("double").alias("kind"), F.col("v0").cast("double").alias("v0"), F.col("v1").cast("double").alias("v1")))).alias("_e"))
    nan = F.lit(float("nan"))
    arr = lambda f, fill=False: F.transform("_e", lambda e: F.coalesce(e[f], nan) if fill else e[f])
    out = g.select(*keys, "chunk", arr("t").alias("t"), arr("kind").alias("kind"), arr("v0", True).alias("v0"), arr("v1", True).alias("v1"))
    # What a chunk needs of the others is a slim table: one time per chunk, not its rows.
    w = Window.partitionBy(*keys).orderBy("chunk")
    slim = g.select(*keys, "chunk", F.element_at("_e", -1)["t"].alias("_last")).select(
        *keys, "chunk", F.lag("_last").over(w).alias("t_prev"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n_chunks"))
    return spread(out.join(slim, [*keys, "chunk"]), *keys, "chunk")


def score(obs, sets, keys=("ses",), use_eeg=True, use_rating=True):
    """(keys, pid, ll): one row per session and parameter set.

    sets: parameter_sets, the same for all sessions.
    A session of one chunk is filtered directly.  A longer one is reduced chunk by chunk
    in parallel to its effect on an unknown start state; only those few summaries per
    session are chained in order.
    """
    keys, obs = list(keys), cut_lineage(obs)  # read by the size checks and by the scoring
    d = packed(obs, keys)
    out = d.where("n_chunks = 1").select(*keys, kf.loglik("t", "kind", "v0", "v1", sets, use_eeg, use_rating).alias("ll"))
    if _has_long(obs, keys):
        out = out.unionByName(_chained(d.withColumn("grid", _literal(sets)), keys, use_eeg, use_rating).select(*keys, "ll"))
    return out.select(*keys, F.posexplode("ll").alias("pid", "ll")).groupBy(*keys, F.col("pid").cast("long").alias("pid")).agg(F.sum("ll").alias("ll"))


def packed_scopes(obs):
    """(chunks, whether any session has several) of obs(scope, ses, ..), packed and kept once for many grids."""
    chunks = cut_lineage(packed(obs, ["scope", "ses"]))
    return chunks, not chunks.where("n_chunks > 1").isEmpty()


FEW_SCOPES = 250_000  # parameter sets of so many scopes travel to all tasks, about 200 bytes each


def score_scaled(chunks, several, thetas, name, factors, few=False):
    """(scope, ll array<double>) per session of packed_scopes: thetas(scope, theta), with one parameter times each of `factors`.

    The sets of a few scopes go to the chunks, which stay where they are.
    """
    keys = ["scope", "ses"]
    # Small rows would be joined in one or two tasks, but each is long work.
    d = chunks.join(F.broadcast(thetas), "scope") if few else spread(chunks.join(thetas, "scope"), *keys, "chunk")
    out = d.where("n_chunks = 1").select("scope", kf.loglik_scaled("t", "kind", "v0", "v1", "theta", name, factors).alias("ll"))
    if several:
        i = kf.NAMES.index(name)
        scaled = lambda f: F.transform("theta", lambda v, k: F.when(k == i, v * f).otherwise(v))
        grid = F.array(*[scaled(f) for f in factors])
        out = out.unionByName(_chained(d.withColumn("grid", grid), keys, True, True).select("scope", "ll"))
    return out


def _has_long(obs, keys):
    """Whether any session needs more than one chunk (one count per session)."""
    size = max(2, chunk_rows(obs.sparkSession) // SESSION_ROWS_DIVISOR)
    return not obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).isEmpty()


def _chained(d, keys, use_eeg, use_rating):
    """Chunk summaries of long sessions, chained: (keys, chunk, ll, start).

    Only the summaries of one session (its rows / chunk size of them) meet in one task.
    """
    e = d.where("n_chunks > 1").select(*keys, "chunk", "grid", kf.element("t", "kind", "v0", "v1", "grid", "t_prev", use_eeg, use_rating).alias("e")).select(*keys, "chunk", "grid", "e.*")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*keys, "chunk").schema) + ", ll array<double>, start array<double>"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        rows = [{c: np.asarray(r[c], float) for c in ("ll", "m", "p", "a", "eta", "j")} for _, r in pdf.iterrows()]
        steps = kf.chain(rows, np.stack([np.asarray(x, float) for x in pdf["grid"].iloc[0]]))
        out = [[*r, ll, np.array([m[0, 0], m[0, 1], c[0, 0, 0], c[0, 0, 1], c[0, 1, 1]])] for r, (ll, m, c) in zip(pdf[keys + ["chunk"]].to_numpy().tolist(), steps)]
        return pd.DataFrame(out, columns=keys + ["chunk", "ll", "start"])
    return e.groupBy(*keys).applyInPandas(walk, schema)


def best_by(scores, scope):
    """Summed log-likelihood per scope and parameter set, and its argmax."""
    s = scores.groupBy(*scope, "pid").agg(F.sum("ll").alias("ll"))
    return s.groupBy(*scope).agg(F.max_by("pid", F.struct("ll", -F.col("pid"))).alias("pid"), F.max("ll").alias("ll"))


def best_by_all(scores):
    """Pooled log-likelihood of every parameter set."""
    return scores.groupBy("pid").agg(F.sum("ll").alias("ll"))


def leave_one_out(scores):
    """Per session the best set of all other sessions: total minus own, no refit."""
    total = scores.groupBy("pid").agg(F.sum("ll").alias("_t"))
    d = scores.join(total, "pid").withColumn("train", F.col("_t") - F.col("ll"))
    return d.groupBy("ses").agg(F.max_by(F.struct("pid", "ll", "train"), F.struct("train", -F.col("pid"))).alias("b")).select("ses", "b.pid", F.col("b.ll").alias("test_ll"), F.col("b.train").alias("train_ll"))


def filtered(obs, params, keys=("ses",), use_eeg=True, use_rating=True):
    """Per event: predicted rating, standardised innovations and filtered state.

    A long session is filtered chunk by chunk in parallel, each chunk from the state the
    chained summaries of the earlier ones give.
    """
    keys, obs = list(keys), cut_lineage(obs)
    d = packed(obs, keys).withColumn("grid", _literal(parameter_sets([params])))
    if _has_long(obs, keys):
        d = d.join(_chained(d, keys, use_eeg, use_rating).where("chunk > 0").select(*keys, "chunk", "start"), keys + ["chunk"], "left")
    else:
        d = d.withColumn("start", F.lit(None).cast("array<double>"))
    first = d.withColumn("_from", F.col("chunk") * max(2, chunk_rows(obs.sparkSession) // SESSION_ROWS_DIVISOR))
    p = first.withColumn("_p", kf.path("t", "kind", "v0", "v1", "grid", "t_prev", "start", use_eeg, use_rating)).select(*keys, "_from", "t", "kind", "v0", "v1", "_p.*")
    cols = ["t", "kind", "v0", "v1", "pred", "pred_var", "z_a", "z_p", "z_q", "m0", "m1", "p00", "p01", "p11"]
    e = p.select(*keys, "_from", F.posexplode(F.arrays_zip(*cols)).alias("n", "q")).select(*keys, (F.col("n") + F.col("_from")).alias("n"), "q.*")
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return e.withColumns({"v0": null("v0"), "v1": null("v1"), "kind": F.col("kind").cast("int"), "n": (F.col("n") + 1).cast("long")})


REP_BLOCK = 25  # replicates that a task makes of one chunk


def replicate_chunks(obs, params, n_rep, seed, keys=("ses",)):
    """(chunks, whether any session has several): simulated copies of every session on its real schedule, missing
    kept missing, as `packed` gives them, with `rep`.

    Only the real chunks are shuffled and stored; a reader makes the copies of each where they are read.
    """
    keys, obs = list(keys), cut_lineage(obs)
    several = _has_long(obs, keys)
    return _copies(packed(obs, keys), several, params, int(n_rep), seed, keys), several


def _copies(chunks, several, params, n_rep, seed, keys):
    """`replicate_chunks` of packed chunks."""
    blocks = chunks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_rep - 1) // REP_BLOCK))))
    d = cut_lineage(spread(blocks, *keys, "chunk", "_block"))
    rep = F.explode(F.sequence(F.col("_block") * REP_BLOCK + 1, F.least(F.col("_block") * REP_BLOCK + REP_BLOCK, F.lit(n_rep))))
    size = max(2, chunk_rows(chunks.sparkSession) // SESSION_ROWS_DIVISOR)
    d = d.withColumn("rep", rep).drop("_block").withColumns({"grid": _literal(parameter_sets([params])), "_key": F.xxhash64(F.lit(seed), "rep", *keys), "_first": F.col("chunk") * size})
    d = d.withColumn("_x", kf.simulate("t", "_key", "_first", "grid", "t_prev"))
    if several:
        d = _carry_paths(d, keys, params)
    q = {**kf.NOMINAL, **params}
    e = F.arrays_zip(F.col("kind"), F.col("v0").alias("o0"), F.col("v1").alias("o1"), F.col("_x.x0").alias("x0"), F.col("_x.x1").alias("x1"), F.col("_x.n0").alias("n0"), F.col("_x.n1").alias("n1"))
    nan = F.lit(float("nan"))
    rating = lambda r: q["alpha"] * r["x1"] - q["beta"] * r["x0"] + q["r_Q"] * r["n0"]
    v0 = F.transform("_e", lambda r: F.when(F.isnan(r["o0"]), nan).when(r["kind"] == 0, r["x0"] + q["r_A"] * r["n0"]).otherwise(rating(r)))
    v1 = F.transform("_e", lambda r: F.when(F.isnan(r["o1"]) | (r["kind"] != 0), nan).otherwise(r["x1"] + q["r_Phi"] * r["n1"]))
    return d.withColumn("_e", e).select(*keys, "rep", "chunk", "t", "kind", v0.alias("v0"), v1.alias("v1"), "t_prev", "n_chunks")


class _ReplicateScores:
    """Log-likelihoods of replicates and their slopes, summed over the sessions: one job a call, with one row per replicate and number as its result.

    A session of one chunk is copied, filtered and followed back inside one task; copies are no rows. The slopes of longer ones are differences of
    their chained chunks' scores.
    """

    def __init__(self, obs, params, n_rep, seed, keys):
        self.problems, self.truth, self.seed, self.keys = int(n_rep), {**kf.NOMINAL, **params}, seed, list(keys)
        if self.truth["rho"] != 0:
            raise ValueError("slopes are for observation noises without correlation")
        obs = cut_lineage(obs)
        chunks = cut_lineage(packed(obs, self.keys))
        self.whole = chunks.where("n_chunks = 1")
        self.copies = _copies(chunks.where("n_chunks > 1"), True, params, self.problems, seed, self.keys) if _has_long(obs, self.keys) else None
        self.calls = 0

    def sets(self, points):
        """Whole parameter sets of points on the scale of the slopes."""
        out = np.tile([float(self.truth[n]) for n in kf.NAMES], (len(points), 1))
        for i, n in enumerate(kf.SLOPES):
            out[:, kf.NAMES.index(n)] = np.exp(points[:, i]) if n in kf.POSITIVE else points[:, i]
        return out

    def point(self, params):
        return [np.log(params[n]) if n in kf.POSITIVE else params[n] for n in kf.SLOPES]

    def __call__(self, points, which):
        which, points, wide = np.asarray(which), np.asarray(points, float), len(kf.SLOPES)
        information, self.calls = self.calls == 0, self.calls + 1
        parts = [self._whole(which, self.sets(points), information)]
        if self.copies is not None:
            parts.append(self._long(which, points, information))
        sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        got = {(r["rep"], r["at"]): r["v"] for r in sums.groupBy("rep", "at").agg(F.sum("v").alias("v")).collect()}
        cells = np.array([[got.get((int(i) + 1, k), 0.0) for k in range(wide + 1)] for i in which])
        matrix = np.array([got.get((0, k), 0.0) for k in range(wide * wide)]).reshape(wide, wide) / self.problems if information else None
        return cells[:, 0], cells[:, 1:], matrix

    def _whole(self, which, sets, information):
        truth = self.truth
        reps = F.array(*[F.lit(int(i) + 1) for i in which])
        stream = F.transform(reps, lambda rep: F.xxhash64(F.lit(self.seed), rep, *[F.col(k) for k in self.keys]))
        named = which.astype(np.int32) + 1

        def run(frames):
            yield _long_form(named, *kf.copy_slopes(frames, truth, sets, information))
        return self.whole.select("t", "kind", "v0", "v1", stream.alias("keys")).mapInPandas(run, "rep int, at int, v double")

    def _long(self, which, points, information):
        wide = len(kf.SLOPES)
        h = 1e-4 * np.maximum(1.0, np.abs(points))
        moved = [points] + [points + s * h * (np.arange(wide) == i) for i in range(wide) for s in (1, -1)]
        grids = np.stack([self.sets(p) for p in moved], axis=1)
        rows = [(int(i) + 1, g.tolist(), s.tolist()) for i, g, s in zip(which, grids, h)]
        spark, by = self.copies.sparkSession, self.keys + ["rep"]
        asked = spark.createDataFrame(rows, "rep int, grid array<array<double>>, h array<double>")
        scored = _chained(self.copies.join(F.broadcast(asked.select("rep", "grid")), "rep"), by, True, True)
        sums = scored.select(*by, F.posexplode("ll").alias("at", "ll")).groupBy(*by, "at").agg(F.sum("ll").alias("ll"))
        each = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ll"))), lambda e: e["ll"]).alias("ll"))

        def run(frames):
            named, ll, g, matrix = [], [], [], np.zeros((wide, wide))
            for df in frames:
                for rep, v, s in zip(df["rep"], df["ll"], df["h"]):
                    slope = (v[1::2] - v[2::2]) / (2 * s)
                    named.append(rep)
                    ll.append(v[0])
                    g.append(slope)
                    matrix += np.outer(slope, slope)
            if named:
                yield _long_form(np.array(named, dtype=np.int32), np.array(ll), np.array(g), matrix if information else None)
        return each.join(F.broadcast(asked.select("rep", "h")), "rep").select("rep", "ll", "h").mapInPandas(run, "rep int, at int, v double")


def _long_form(rep, ll, g, information):
    """Rows (rep, at, v): the log-likelihood at 0, the slopes behind it; the information as the cells of replicate 0."""
    cells = np.column_stack([ll, g])
    out = [(np.repeat(rep, cells.shape[1]), np.tile(np.arange(cells.shape[1]), len(rep)), cells.ravel())]
    if information is not None:
        out.append((np.zeros(information.size), np.arange(information.size), information.ravel()))
    rep, at, v = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"rep": rep.astype(np.int32), "at": at.astype(np.int32), "v": v})


def replicate_estimates(obs, params, n_rep, seed, keys=("ses",)):
    """Rows (rep, *SLOPES, ll): the maximum-likelihood estimates of every replicate of `replicates`, found from the parameters it was made with."""
    score = _ReplicateScores(obs, params, n_rep, seed, keys)
    points, ll = ascend(score, score.point(score.truth))
    sets = score.sets(points)
    return [(i + 1, *(float(s[kf.NAMES.index(n)]) for n in kf.SLOPES), float(v)) for i, (s, v) in enumerate(zip(sets, ll))]


def replicates(obs, params, n_rep, seed, keys=("ses",)):
    """The events of replicate_chunks: (keys, rep, t, kind, v0, v1)."""
    d, _ = replicate_chunks(obs, params, n_rep, seed, keys)
    e = d.select(*keys, "rep", F.inline(F.arrays_zip("t", "kind", "v0", "v1")))
    seen = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return e.select(*keys, "rep", "t", F.col("kind").cast("int").alias("kind"), seen("v0"), seen("v1"))


def _carry_paths(d, keys, params):
    """Add the earlier chunks' end state, moved by the transition, to later chunks."""
    by = list(keys) + ["rep"]
    p = {n: np.array([v]) for n, v in {**kf.NOMINAL, **params}.items()}
    ends = d.select(*by, "chunk", F.element_at("t", -1).alias("t1"), "t_prev", F.element_at("_x.x0", -1).alias("a"), F.element_at("_x.x1", -1).alias("b"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.select(*by, "chunk").schema) + ", c0 double, c1 double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        x, out = np.zeros(2), []
        for r in pdf.itertuples():
            out.append(x)
            f00, f10, f11 = (float(v[0]) for v in kf.transition(p, np.array([0.0 if r.t_prev != r.t_prev or r.t_prev is None else r.t1 - r.t_prev])))
            x = np.array([f00 * x[0] + r.a, f10 * x[0] + f11 * x[1] + r.b])
        return pdf[by + ["chunk"]].assign(c0=[v[0] for v in out], c1=[v[1] for v in out])

    c = d.join(ends.groupBy(*by).applyInPandas(walk, schema), by + ["chunk"])
    q = {**kf.NOMINAL, **params}
    k, kap, kd = q["k_inh"], q["k_int"], q["k_d"]
    gone = lambda t: t - F.coalesce(F.col("t_prev"), t)
    f10 = lambda g: -kap * (F.exp(-k * g) - F.exp(-kd * g)) / (kd - k) if abs(kd - k) > 1e-9 else -kap * g * F.exp(-k * g)
    x0 = F.zip_with("_x.x0", "t", lambda x, t: x + F.exp(-k * gone(t)) * F.col("c0"))
    x1 = F.zip_with("_x.x1", "t", lambda x, t: x + f10(gone(t)) * F.col("c0") + F.exp(-kd * gone(t)) * F.col("c1"))
    return c.withColumn("_x", F.struct(x0.alias("x0"), x1.alias("x1"), F.col("_x.n0").alias("n0"), F.col("_x.n1").alias("n1"))).drop("c0", "c1")


def discretise(steps, sets, dt="dt"):
    """Closed-form transition, step noise and stationary covariance per step and set."""
    k, kap, kd = F.col("k_inh"), F.col("k_int"), F.col("k_d")
    d = steps.select("*", F.inline(sets))
    e0, e1 = F.exp(-k * F.col(dt)), F.exp(-kd * F.col(dt))
    same = F.abs(kd - k) < 1e-9
    f10 = -kap * F.when(same, F.col(dt) * e0).otherwise((e0 - e1) / F.when(same, 1.0).otherwise(kd - k))
    d = d.withColumns({"f00": e0, "f10": f10, "f11": e1, "s00": F.col("sigma_A") ** 2 / (2 * k)})
    d = d.withColumn("s01", -kap * F.col("s00") / (k + kd)).withColumn("s11", (F.col("sigma_Phi") ** 2 - 2 * kap * F.col("s01")) / (2 * kd))
    c = F.col
    return d.withColumns({"q00": c("s00") - c("f00") ** 2 * c("s00"), "q01": c("s01") - c("f00") * (c("f10") * c("s00") + c("f11") * c("s01")),
                          "q11": c("s11") - (c("f10") ** 2 * c("s00") + 2 * c("f10") * c("f11") * c("s01") + c("f11") ** 2 * c("s11"))})


def rating_statistics(levels, second, low, high):
    """(rep, statistic, level, value) of levels(rep, ses, t, level), all of them for each rep.

    The share of each level; the median over sessions of the lag-1 correlation (sessions of four ratings and more
    that vary on both sides); the mean within-session SD of the group `second` minus that of the others.
    """
    per = levels.groupBy("rep", "level").agg(F.count(F.lit(1)).alias("c"))
    totals = per.groupBy("rep").agg(F.sum("c").alias("n"))
    asked = totals.select("rep", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level"))
    shares = asked.join(per, ["rep", "level"], "left").select("rep", F.lit("level_share").alias("statistic"), "level", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("value"))
    lagged = running(levels, ["rep", "ses"], ["t"], lags={"before": F.col("level")})
    pair = F.col("before").isNotNull()
    sds = [F.var_pop(F.when(pair, F.col(c))) for c in ("before", "level")]
    s = lagged.groupBy("rep", "ses").agg(
        F.stddev_pop("level").alias("sd"), F.when((F.count(F.lit(1)) > 3) & (sds[0] > 0) & (sds[1] > 0), F.covar_pop("before", "level") / F.sqrt(sds[0] * sds[1])).alias("ac"))
    s = cut_lineage(s)
    means = s.groupBy("rep").agg(*[F.avg(F.when(second if k else ~second, F.col("sd"))).alias(f"sd{k}") for k in (0, 1)])
    none = F.lit(None).cast("int").alias("level")
    lag = totals.select("rep").join(quantiles(s, ["rep"], "ac", {"value": 0.5}), "rep", "left").select("rep", F.lit("lag1_median").alias("statistic"), none, "value")
    return shares.unionByName(lag).unionByName(means.select("rep", F.lit("sd_difference").alias("statistic"), none, (F.col("sd1") - F.col("sd0")).alias("value")))


def predictive_bands(statistics, keys, probs=(0.025, 0.975)):
    """(keys, observed, sim_mean, lo, hi): replicate 0 is the data, the others give the band."""
    sim = F.when(F.col("rep") > 0, F.col("value"))
    return statistics.groupBy(*keys).agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("observed"), F.avg(sim).alias("sim_mean"),
                                         *[F.percentile(sim, F.lit(q)).alias(n) for n, q in zip(("lo", "hi"), probs)])
