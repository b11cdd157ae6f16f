"""State-space scoring, estimates, residual checks and predictive checks on `events`."""

import itertools
import math

from pyspark.sql import Window, functions as F

from ..functions import kalman as kf
from ..functions.draws import normal, sql_normal
from ..functions.linear import with_inverse
from ..functions.tails import chi2_sf
from ..operators import statespace as ss, stats as st
from ..operators.quantiles import quantiles
from ..operators.whiteness import ljung_box
from ..operators.ordered import gaps, numbered, running, union_all
from ..operators.resample import bootstrap_mean
from ..session import cut_lineage
from ..sources.tables import EV
from .decoding import KEPT, PB, keep_sessions
from .registry import query
from .relational import FS, feature_epochs, ratings_b, with_previous, LAGGED
from .statistics import CHI_SQL

R6 = lambda c: F.round(c, 6)
R4 = lambda c: F.round(c, 4)

# ---------------------------------------------------------------- observations
OBS = PB + f""", {FS},
cen AS (SELECT ses,epoch,y_a-avg(y_a) OVER (PARTITION BY ses) AS a, y_p-avg(y_p) OVER (PARTITION BY ses) AS p FROM fs), pool AS (SELECT sqrt(avg(a*a)) AS sa, sqrt(avg(p*p)) AS sp FROM cen),
rt AS (SELECT ses, round_even(onset/24*10/0.1,0)*0.1/60 AS t, max(rating) AS r FROM db WHERE rating IS NOT NULL GROUP BY 1,2), rc AS (SELECT ses,t,(r-avg(r) OVER (PARTITION BY ses))/4.0 AS r FROM rt),
obs AS (SELECT ses,(epoch+1)*10/60.0::DOUBLE AS t,0 AS kind,a/sa AS v0,p/sp AS v1 FROM cen, pool UNION ALL SELECT ses,t,1,r,NULL FROM rc),
evn AS (SELECT *, row_number() OVER (PARTITION BY ses ORDER BY t,kind) AS n FROM obs)"""


def observations(t):
    d = feature_epochs(t)
    s = d.groupBy("ses").agg(*[f(c).alias(f"{n}_{c}") for c in ("y_a", "y_p") for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))])
    g = s.agg(*[F.sqrt(F.sum(F.col(f"n_{c}") * F.col(f"v_{c}")) / F.sum(f"n_{c}")).alias(f"g_{c}") for c in ("y_a", "y_p")])
    e = d.join(s, "ses").join(F.broadcast(g)).select(
        "ses", ((F.col("epoch") + 1) * 10 / 60.0).alias("t"), F.lit(0).alias("kind"),
        *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"g_{c}")).alias(n) for c, n in (("y_a", "v0"), ("y_p", "v1"))])
    r = ratings_b(t).groupBy("ses", (F.bround(F.col("onset") / 24 * 10 / 0.1, 0) * 0.1 / 60).alias("t")).agg(F.max("rating").alias("r"))
    m = r.groupBy("ses").agg(F.avg("r").alias("m"))
    p = r.join(m, "ses").select("ses", "t", F.lit(1).alias("kind"), ((F.col("r") - F.col("m")) / 4.0).alias("v0"), F.lit(None).cast("double").alias("v1"))
    return e.unionByName(p)


def grid_rows(n):
    """Parameter sets around the nominal ones: k_inh x k_d x alpha levels."""
    base = {"sigma_A": 0.6, "sigma_Phi": 0.4, "r_A": 0.8, "r_Phi": 0.8, "r_Q": 0.9, "alpha": 0.4, "beta": 0.3}
    out = [{**base, "k_inh": k, "k_d": d} for k, d in itertools.product((0.1, 0.2, 0.4), (0.05, 0.15, 0.45))]
    return out[:n]


def sql_params(rows):
    names = ",".join(n.lower() for n in kf.NAMES)
    vals = ",".join("(" + ",".join([str(i)] + [repr(float({**kf.NOMINAL, **r}[n])) + "::DOUBLE" for n in kf.NAMES]) + ")" for i, r in enumerate(rows))
    return f"pr0(pid,{names}) AS (VALUES {vals}), pr AS (SELECT *, sigma_a^2/(2*k_inh) AS s00, -k_int*(sigma_a^2/(2*k_inh))/(k_inh+k_d) AS s01, (sigma_phi^2+2*k_int*k_int*(sigma_a^2/(2*k_inh))/(k_inh+k_d))/(2*k_d) AS s11 FROM pr0)"


def sql_filter(rows, use_eeg=True, use_rating=True, events="evn", keys="ses"):
    """One event per recursion step: predict, first feature, second feature, rating."""
    e = "true" if use_eeg else "false"
    r = "true" if use_rating else "false"

    def update(src, dst, seen, y, h0, h1, r2, extra):
        return f"""(SELECT {extra}, n, t, kind, v0, v1, pid,
 m0 + CASE WHEN {seen} THEN g0/s*er ELSE 0 END AS m0, m1 + CASE WHEN {seen} THEN g1/s*er ELSE 0 END AS m1,
 p00 - CASE WHEN {seen} THEN g0*g0/s ELSE 0 END AS p00, p01 - CASE WHEN {seen} THEN g0*g1/s ELSE 0 END AS p01, p11 - CASE WHEN {seen} THEN g1*g1/s ELSE 0 END AS p11,
 ll + CASE WHEN {seen} THEN -0.5*(ln(2*pi()*s)+er*er/s) ELSE 0 END AS ll, k_inh,k_int,k_d,alpha,beta,r_a,r_phi,r_q,rho, {dst}
 FROM (SELECT *, ({y})-(({h0})*m0+({h1})*m1) AS er, p00*({h0})+p01*({h1}) AS g0, p01*({h0})+p11*({h1}) AS g1,
  ({h0})*(p00*({h0})+p01*({h1}))+({h1})*(p01*({h0})+p11*({h1}))+({r2}) AS s FROM {src}))"""

    both = "(rho<>0 AND v0 IS NOT NULL AND v1 IS NOT NULL)"
    pred = f"""(SELECT e.{keys}, e.n, e.t, e.kind, e.v0, e.v1, f.pid, f00*m0 AS m0, f10*m0+f11*m1 AS m1,
 f00*f00*(p00-s00)+s00 AS p00, f00*(f10*(p00-s00)+f11*(p01-s01))+s01 AS p01, f10*f10*(p00-s00)+2*f10*f11*(p01-s01)+f11*f11*(p11-s11)+s11 AS p11, ll,
 k_inh,k_int,k_d,alpha,beta,r_a,r_phi,r_q,rho FROM (SELECT f.*, exp(-k_inh*(e2t-t)) AS f00, exp(-k_d*(e2t-t)) AS f11, CASE WHEN abs(k_d-k_inh)<1e-9 THEN -k_int*(e2t-t)*exp(-k_inh*(e2t-t)) ELSE -k_int*(exp(-k_inh*(e2t-t))-exp(-k_d*(e2t-t)))/(k_d-k_inh) END AS f10, pr.* EXCLUDE (pid)
  FROM (SELECT kfr.*, e.t AS e2t FROM kfr JOIN {events} e ON e.{keys}=kfr.{keys} AND e.n=kfr.n+1) f JOIN pr USING (pid)) f JOIN {events} e ON e.{keys}=f.{keys} AND e.n=f.n+1)"""
    sa = f"(kind=0 AND v0 IS NOT NULL AND {e})"
    sb = f"(kind=0 AND v1 IS NOT NULL AND {e})"
    sq = f"(kind=1 AND v0 IS NOT NULL AND {r})"
    u1 = update(pred, "0 AS z1", sa, "v0", "1.0", "0.0", "r_a^2", keys)
    u2 = update(u1, "0 AS z2", sb, f"CASE WHEN {both} THEN v1-rho*r_phi/r_a*v0 ELSE v1 END", f"CASE WHEN {both} THEN -rho*r_phi/r_a ELSE 0.0 END", "1.0", f"CASE WHEN {both} THEN (1-rho^2)*r_phi^2 ELSE r_phi^2 END", keys)
    u3 = update(u2, "0 AS z3", sq, "v0", "-beta", "alpha", "r_q^2", keys)
    return f"""{sql_params(rows)}, kfr({keys},pid,n,t,m0,m1,p00,p01,p11,ll) AS (
 SELECT q.{keys}, pid, 0::BIGINT, q.t, 0.0::DOUBLE, 0.0::DOUBLE, s00, s01, s11, 0.0::DOUBLE FROM (SELECT {keys}, min(t) AS t FROM {events} GROUP BY 1) q, pr
 UNION ALL SELECT {keys},pid,n,t,m0,m1,p00,p01,p11,ll FROM {u3}),
sc AS (SELECT {keys}, pid, arg_max(ll,n) AS ll FROM kfr GROUP BY 1,2)"""


GRID = grid_rows(9)
SC = f"{OBS}, {sql_filter(GRID)}"


def scores(t, **kw):
    return ss.score(observations(t), ss.parameter_sets(GRID), **kw)


@query("kf1_event_order", f"WITH {OBS} SELECT ses,n,round(t,6) AS t,kind,round(v0,6) AS v0,round(v1,6) AS v1 FROM evn")
def kf1(t):
    return ss.event_order(observations(t)).select("ses", "n", R6(F.col("t")).alias("t"), "kind", R6(F.col("v0")).alias("v0"), R6(F.col("v1")).alias("v1"))


@query("kf2_discretised_steps", f"""WITH {OBS}, {sql_params(GRID)}, dt AS (SELECT DISTINCT round(t-lag(t) OVER (PARTITION BY ses ORDER BY t,kind),7) AS dt FROM obs),
f AS (SELECT pid,dt,s00,s01,s11,exp(-k_inh*dt) AS f00,exp(-k_d*dt) AS f11,CASE WHEN abs(k_d-k_inh)<1e-9 THEN -k_int*dt*exp(-k_inh*dt) ELSE -k_int*(exp(-k_inh*dt)-exp(-k_d*dt))/(k_d-k_inh) END AS f10 FROM dt, pr WHERE dt>0)
SELECT pid,dt,round(f00,6) AS f00,round(f10,6) AS f10,round(f11,6) AS f11,round(s00-f00*f00*s00,6) AS q00,round(s01-f00*(f10*s00+f11*s01),6) AS q01,round(s11-(f10*f10*s00+2*f10*f11*s01+f11*f11*s11),6) AS q11 FROM f""")
def kf2(t):
    g = gaps(observations(t), ["ses"], ["t", "kind"]).where("gap is not null").select(F.round("gap", 7).alias("dt")).distinct().where("dt > 0")
    sets = F.array(*[F.struct(F.lit(i).cast("int").alias("pid"), *[F.lit(float({**kf.NOMINAL, **r}[n])).alias(n) for n in kf.NAMES]) for i, r in enumerate(GRID)])
    d = ss.discretise(g, sets)
    return d.select("pid", "dt", *[R6(F.col(c)).alias(c) for c in ("f00", "f10", "f11", "q00", "q01", "q11")])


@query("kf3_session_loglik", f"WITH RECURSIVE {SC} SELECT ses, pid, round(ll,6) AS ll FROM sc WHERE pid<3")
def kf3(t):
    return ss.score(observations(t), ss.parameter_sets(GRID[:3])).withColumn("ll", R6(F.col("ll")))


RHO = [{**GRID[4], "rho": r} for r in (0.2, -0.3)]


@query("kf4_correlated_noise_loglik", f"WITH RECURSIVE {OBS}, {sql_filter(RHO)} SELECT ses, pid, round(ll,6) AS ll FROM sc")
def kf4(t):
    return ss.score(observations(t), ss.parameter_sets(RHO)).withColumn("ll", R6(F.col("ll")))


@query("kf5_regular_epoch_loglik", f"WITH RECURSIVE {OBS}, rgl AS (SELECT e.* FROM (SELECT ses, min(epoch) AS a, max(epoch) AS b FROM fs GROUP BY 1) q JOIN (SELECT ses,t,0 AS kind,v0,v1,row_number() OVER (PARTITION BY ses ORDER BY t) AS n FROM obs WHERE kind=0) e USING (ses)), {sql_filter(GRID[3:5], events='rgl')} SELECT ses, pid, round(ll,6) AS ll FROM sc")
def kf5(t):
    """Regular epochs with gaps filled by missing rows; empty epochs do not change the value."""
    o = observations(t).where("kind = 0")
    ends = o.groupBy("ses").agg(F.round(F.min("t") * 6).cast("long").alias("a"), F.round(F.max("t") * 6).cast("long").alias("b"))
    full = ends.select("ses", F.explode(F.sequence("a", "b")).alias("k")).select("ses", (F.col("k") * 10 / 60.0).alias("t"), F.lit(0).alias("kind"))
    d = full.withColumn("k", F.round(F.col("t") * 6).cast("long")).join(
        o.withColumn("k", F.round(F.col("t") * 6).cast("long")).select("ses", "k", "v0", "v1"), ["ses", "k"], "left")
    return ss.score(d.select("ses", "t", "kind", "v0", "v1"), ss.parameter_sets(GRID[3:5])).withColumn("ll", R6(F.col("ll")))


@query("kf6_score_table", f"WITH RECURSIVE {SC} SELECT ses, pid, round(ll,6) AS ll FROM sc")
def kf6(t):
    return scores(t).withColumn("ll", R6(F.col("ll")))


def scopes(s):
    """Every score under its pooled, group and subject scope."""
    g = F.array(F.lit("all"), F.concat(F.lit("grp"), (F.col("ses") % 2).cast("string")), F.concat(F.lit("sub"), F.floor(F.col("ses") / 3).cast("string")))
    return s.withColumn("scope", F.explode(g))


@query("kf7_scope_estimates", f"""WITH RECURSIVE {SC}, x AS (SELECT unnest(['all',concat('grp',ses%2),concat('sub',ses//3)]) AS scope, pid, ll FROM sc), y AS (SELECT scope,pid,sum(ll) AS ll FROM x GROUP BY 1,2)
SELECT scope, pid, round(ll,5) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ll DESC, pid) r FROM y) WHERE r=1""")
def kf7(t):
    return ss.best_by(scopes(scores(t)), ["scope"]).withColumn("ll", F.round("ll", 5))


ZOOMED = ("k_inh", "k_d", "alpha", "beta", "sigma_A", "sigma_Phi", "r_A", "r_Phi", "r_Q")


def zoomed(chunks, several, names=ZOOMED, widths=(0.5, 0.2)):
    """(scope, theta, ll) of packed_scopes: a grid around each scope's current best, one parameter after the other.

    All scopes take a step in the same scoring pass; scopes may be groups, subjects or replicates.
    """
    best = cut_lineage(chunks.select("scope").distinct().select("scope", F.array(*[F.lit(float({**kf.NOMINAL, **GRID[4]}[n])) for n in kf.NAMES]).alias("theta"), F.lit(None).cast("double").alias("ll")))
    few, known = best.count() <= ss.FEW_SCOPES, False
    for width in widths:
        for n in names:
            i = kf.NAMES.index(n)
            # The middle of the grid is the best so far, whose value the step before has left.
            axis = [math.exp(width * k) for k in (-1.0, -0.5, 0.0, 0.5, 1.0)]
            tried = [f for f in axis if f != 1.0 or not known]
            s = ss.score_scaled(chunks, several, best.select("scope", "theta"), n, tried, few)
            sums = s.groupBy("scope").agg(*[F.sum(F.get("ll", F.lit(k))).alias(f"l{k}") for k in range(len(tried))])
            at = {f: F.col(f"l{k}") for k, f in enumerate(tried)}
            win = F.array_max(F.array(*[F.struct(at.get(f, F.col("ll")).alias("ll"), F.lit(-k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate(axis)]))
            moved = F.transform("theta", lambda v, k: F.when(k == i, v * F.col("win.f")).otherwise(v))  # noqa: B023
            best = cut_lineage(best.join(sums, "scope").withColumn("win", win).select("scope", moved.alias("theta"), F.col("win.ll").alias("ll")))
            known = True
    return best


def zoomed_columns(names=ZOOMED):
    return [*[R6(F.col("theta")[kf.NAMES.index(n)]).alias(n) for n in names], R4(F.col("ll")).alias("ll")]


@query("kf7_zoomed_estimates")
def kf7z(t):
    """Coordinate-wise zoom per pooled, group and subject scope, two rounds."""
    return zoomed(*ss.packed_scopes(scopes(observations(t)))).select("scope", *zoomed_columns())


@query("kf8_group_rates", f"""WITH RECURSIVE {SC}, x AS (SELECT ses%2 AS grp, pid//3 AS k, pid%3 AS shared, sum(ll) AS ll FROM sc GROUP BY 1,2,3), m AS (SELECT grp,shared,arg_max(k,ll) AS k,max(ll) AS ll FROM x GROUP BY 1,2), s AS (SELECT shared, sum(ll) AS ll FROM m GROUP BY 1), b AS (SELECT arg_max(shared,ll) AS shared, max(ll) AS ll FROM s)
SELECT m.grp, b.shared, m.k, round(m.ll,5) AS ll, round(b.ll,5) AS total_ll FROM m JOIN b USING (shared)""")
def kf8(t):
    x = scores(t).groupBy((F.col("ses") % 2).alias("grp"), F.floor(F.col("pid") / 3).alias("k"), (F.col("pid") % 3).alias("shared")).agg(F.sum("ll").alias("ll"))
    m = x.groupBy("grp", "shared").agg(F.max_by("k", "ll").alias("k"), F.max("ll").alias("ll"))
    b = m.groupBy("shared").agg(F.sum("ll").alias("total_ll")).agg(F.max_by("shared", "total_ll").alias("shared"), F.max("total_ll").alias("total_ll"))
    return m.join(F.broadcast(b), "shared").select("grp", "shared", "k", F.round("ll", 5).alias("ll"), F.round("total_ll", 5).alias("total_ll"))


@query("kf9_leave_one_session_out", f"""WITH RECURSIVE {SC}, t AS (SELECT pid,sum(ll) AS tot FROM sc GROUP BY 1), d AS (SELECT ses,sc.pid,ll,tot-ll AS train FROM sc JOIN t USING (pid))
SELECT ses,pid,round(ll,6) AS test_ll,round(train,5) AS train_ll FROM (SELECT *, row_number() OVER (PARTITION BY ses ORDER BY train DESC,pid) r FROM d) WHERE r=1""")
def kf9(t):
    return ss.leave_one_out(scores(t)).select("ses", "pid", R6(F.col("test_ll")).alias("test_ll"), F.round("train_ll", 5).alias("train_ll"))


@query("kf10_channel_variants", f"WITH RECURSIVE {OBS}, {sql_filter(GRID[4:5], use_eeg=False)} SELECT ses, round(ll,6) AS rating_only FROM sc")
def kf10(t):
    return ss.score(observations(t), ss.parameter_sets(GRID[4:5]), use_eeg=False).select("ses", R6(F.col("ll")).alias("rating_only"))


@query("kf10_features_only", f"WITH RECURSIVE {OBS}, {sql_filter(GRID[4:5], use_rating=False)} SELECT ses, round(ll,6) AS eeg_only FROM sc")
def kf10b(t):
    return ss.score(observations(t), ss.parameter_sets(GRID[4:5]), use_rating=False).select("ses", R6(F.col("ll")).alias("eeg_only"))


ONE = f"{OBS}, {sql_filter(GRID[4:5])}"
B, A, RQ = GRID[4]["beta"], GRID[4]["alpha"], GRID[4]["r_Q"]


def filtered(t):
    return ss.filtered(observations(t), GRID[4])


@query("kf11_probe_predictions", f"""WITH RECURSIVE {ONE}, st AS (SELECT kfr.*, e.kind, e.v0 FROM kfr JOIN evn e USING (ses,n)), nx AS (SELECT e.ses,e.n,e.t,e.v0,s.m0,s.m1,s.p00,s.p01,s.p11,e.t-s.t AS dt FROM evn e JOIN kfr s ON s.ses=e.ses AND s.n=e.n-1 WHERE e.kind=1),
f AS (SELECT nx.*, exp(-k_inh*dt) AS f00, exp(-k_d*dt) AS f11, -k_int*(exp(-k_inh*dt)-exp(-k_d*dt))/(k_d-k_inh) AS f10, s00,s01,s11 FROM nx, pr),
g AS (SELECT ses,n,t,v0, f00*m0 AS m0, f10*m0+f11*m1 AS m1, f00*f00*(p00-s00)+s00 AS p00, f00*(f10*(p00-s00)+f11*(p01-s01))+s01 AS p01, f10*f10*(p00-s00)+2*f10*f11*(p01-s01)+f11*f11*(p11-s11)+s11 AS p11 FROM f)
SELECT ses,n,round(v0,6) AS rating,round({A}*m1-{B}*m0,6) AS pred,round({B}*{B}*p00-2*{A}*{B}*p01+{A}*{A}*p11+{RQ}*{RQ},6) AS pred_var FROM g""")
def kf11(t):
    return filtered(t).where("kind = 1").select("ses", "n", R6(F.col("v0")).alias("rating"), R6(F.col("pred")).alias("pred"), R6(F.col("pred_var")).alias("pred_var"))


@query("kf22_state_bands", f"WITH RECURSIVE {ONE} SELECT ses, n, round(m0,6) AS a_mean, round(m0-2*sqrt(p00),6) AS a_lo, round(m0+2*sqrt(p00),6) AS a_hi, round(m1,6) AS p_mean, round(m1-2*sqrt(p11),6) AS p_lo, round(m1+2*sqrt(p11),6) AS p_hi FROM kfr WHERE n>0")
def kf22(t):
    band = lambda m, v, s: F.col(m) + s * 2 * F.sqrt(v)
    return filtered(t).select("ses", "n", R6(F.col("m0")).alias("a_mean"), R6(band("m0", "p00", -1)).alias("a_lo"), R6(band("m0", "p00", 1)).alias("a_hi"),
                              R6(F.col("m1")).alias("p_mean"), R6(band("m1", "p11", -1)).alias("p_lo"), R6(band("m1", "p11", 1)).alias("p_hi"))


@query("kf12_profile_likelihood", f"WITH RECURSIVE {SC}, x AS (SELECT pid, sum(ll) AS ll FROM sc GROUP BY 1) SELECT k_inh, round(max(x.ll),5) AS ll FROM x JOIN pr USING (pid) GROUP BY 1")
def kf12(t):
    x = scores(t).groupBy("pid").agg(F.sum("ll").alias("ll"))
    value = F.element_at(F.array(*[F.lit(r["k_inh"]) for r in GRID]), (F.col("pid") + 1).cast("int"))
    return x.groupBy(value.alias("k_inh")).agg(F.round(F.max("ll"), 5).alias("ll"))


def stencil(theta, names, h=1e-3):
    """Central-difference points: (i, j, sign, weight) with their parameter sets."""
    pts, sets = [(-1, -1, 1.0)], [dict(theta)]
    pos = lambda n: n in kf.POSITIVE
    th = {n: math.log(theta[n]) if pos(n) else theta[n] for n in names}
    step = {n: h * max(1.0, abs(th[n])) for n in names}

    def shifted(moves):
        v = dict(theta)
        for n, s in moves:
            x = th[n] + s * step[n]
            v[n] = math.exp(x) if pos(n) else x
        return v
    for i, a in enumerate(names):
        for s in (1, -1):
            pts.append((i, i, 1.0 / step[a] ** 2))
            sets.append(shifted([(a, s)]))
        for j, b in enumerate(names[:i]):
            for s, r in itertools.product((1, -1), repeat=2):
                pts.append((i, j, s * r / (4 * step[a] * step[b])))
                sets.append(shifted([(a, s), (b, r)]))
    return pts, sets, step


HN = ("k_inh", "k_d", "alpha")
PTS, HSETS, HSTEP = stencil({**kf.NOMINAL, **GRID[4]}, HN)


@query("kf13_observed_information", f"WITH RECURSIVE {OBS}, {sql_filter(HSETS)}, tt AS (SELECT pid, sum(ll) AS ll FROM sc GROUP BY 1), w(pid,i,j,w) AS (VALUES {','.join(f'({k},{i},{j},{w!r}::DOUBLE)' for k, (i, j, w) in enumerate(PTS) if i >= 0)}), c AS (SELECT ll AS f0 FROM tt WHERE pid=0) SELECT i, j, round(-(sum(w*ll)-CASE WHEN i=j THEN 2*max(f0)*max(w) ELSE 0 END),1) AS information FROM w JOIN tt USING (pid), c GROUP BY 1,2")
def kf13(t):
    tot = ss.score(observations(t), ss.parameter_sets(HSETS)).groupBy("pid").agg(F.sum("ll").alias("ll"))
    w = t.spark.createDataFrame([(k, i, j, float(x)) for k, (i, j, x) in enumerate(PTS) if i >= 0], "pid long, i int, j int, w double")
    f0 = tot.where("pid = 0").select(F.col("ll").alias("f0"))
    d = tot.join(F.broadcast(w), "pid").join(F.broadcast(f0))
    return d.groupBy("i", "j").agg(F.round(-(F.sum(F.col("w") * F.col("ll")) - F.when(F.col("i") == F.col("j"), 2 * F.max("f0") * F.max("w")).otherwise(0.0)), 1).alias("information"))


def _inverse_sql():
    j = lambda a, b: f"j{max(a, b)}{min(a, b)}"
    det = f"({j(0, 0)}*({j(1, 1)}*{j(2, 2)}-{j(2, 1)}*{j(2, 1)})-{j(1, 0)}*({j(1, 0)}*{j(2, 2)}-{j(2, 1)}*{j(2, 0)})+{j(2, 0)}*({j(1, 0)}*{j(2, 1)}-{j(1, 1)}*{j(2, 0)}))"
    minors = [f"({j(1, 1)}*{j(2, 2)}-{j(2, 1)}*{j(2, 1)})", f"({j(0, 0)}*{j(2, 2)}-{j(2, 0)}*{j(2, 0)})", f"({j(0, 0)}*{j(1, 1)}-{j(1, 0)}*{j(1, 0)})"]
    sure = f"j00>0 AND {minors[2]}>0 AND {det}>0"
    return " UNION ALL ".join(
        f"SELECT scope, '{n}' AS parameter, sqrt(greatest({minors[i]}/{det},0)) AS se, {1.0 if n in kf.POSITIVE else abs({**kf.NOMINAL, **GRID[4]}[n])!r}::DOUBLE AS unit, {sure} AS definite FROM jm" for i, n in enumerate(HN))


@query("kf13_standard_errors", f"""WITH RECURSIVE {OBS}, {sql_filter(HSETS)}, g AS (SELECT 'all' AS scope, pid, ll FROM sc UNION ALL SELECT concat('group ', ses%2), pid, ll FROM sc),
tt AS (SELECT scope, pid, sum(ll) AS ll FROM g GROUP BY 1,2), w(pid,i,j,w) AS (VALUES {','.join(f'({k},{i},{j},{w!r}::DOUBLE)' for k, (i, j, w) in enumerate(PTS) if i >= 0)}), c AS (SELECT scope, ll AS f0 FROM tt WHERE pid=0),
jj AS (SELECT scope, i, j, -(sum(w*ll)-CASE WHEN i=j THEN 2*max(f0)*max(w) ELSE 0 END) AS v FROM w JOIN tt USING (pid) JOIN c USING (scope) GROUP BY 1,2,3),
jm AS (SELECT scope, {', '.join(f'max(v) FILTER (WHERE i={i} AND j={j}) AS j{i}{j}' for i in range(3) for j in range(i + 1))} FROM jj GROUP BY 1), r AS ({_inverse_sql()})
SELECT scope, parameter, round(se,4) AS se, round(se/unit,4) AS rel_se, definite FROM r""")
def kf13b(t):
    """Standard errors from the observed information, for all sessions and by group."""
    sc = ss.score(observations(t), ss.parameter_sets(HSETS))
    scope = F.explode(F.array(F.lit("all"), F.concat(F.lit("group "), (F.col("ses") % 2).cast("string"))))
    # Few rows from here on: scopes times parameter sets.
    tot = cut_lineage(sc.select(scope.alias("scope"), "pid", "ll").groupBy("scope", "pid").agg(F.sum("ll").alias("ll")))
    w = t.spark.createDataFrame([(k, i, j, float(x)) for k, (i, j, x) in enumerate(PTS) if i >= 0], "pid long, i int, j int, w double")
    f0 = tot.where("pid = 0").select("scope", F.col("ll").alias("f0"))
    d = tot.join(F.broadcast(w), "pid").join(f0, "scope")
    twice = F.when(F.col("i") == F.col("j"), 2 * F.max("f0") * F.max("w")).otherwise(0.0)
    cells = d.groupBy("scope", "i", "j").agg((-(F.sum(F.col("w") * F.col("ll")) - twice)).alias("v"))
    n = len(HN)
    mat = cells.groupBy("scope").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(f"j{i}_{j}") for i in range(n) for j in range(i + 1)])
    inv = with_inverse(mat, lambda i, j: F.col(f"j{i}_{j}"), n)
    unit = {**kf.NOMINAL, **GRID[4]}
    rows = F.array(*[F.struct(F.lit(p).alias("parameter"), F.sqrt(F.greatest(F.col("inverse")[k][k], F.lit(0.0))).alias("se"), F.lit(1.0 if p in kf.POSITIVE else abs(unit[p])).alias("unit")) for k, p in enumerate(HN)])
    return inv.select("scope", "definite", F.inline(rows)).select("scope", "parameter", F.round("se", 4).alias("se"), F.round(F.col("se") / F.col("unit"), 4).alias("rel_se"), "definite")


def sql_ljung_box(src, value, out):
    """Relation `out`(ses, lags, q) of the non-null `value` of src(ses, n, ..), at most five lags."""
    return f"""o{out} AS (SELECT ses, row_number() OVER (PARTITION BY ses ORDER BY n) AS k, count(*) OVER (PARTITION BY ses) AS n, {value}-avg({value}) OVER (PARTITION BY ses) AS x FROM {src} WHERE {value} IS NOT NULL),
m{out} AS (SELECT ses, max(n) AS n, least(5,max(n)//4) AS m, avg(x*x) AS c0 FROM o{out} GROUP BY 1),
r{out} AS (SELECT m.ses, a.l, sum(p.x*q.x)/(max(m.n)*max(c0)) AS rk, max(m.n) AS n FROM m{out} m JOIN (SELECT l FROM range(1,6) z(l)) a ON a.l<=m.m JOIN o{out} p ON p.ses=m.ses JOIN o{out} q ON q.ses=m.ses AND q.k=p.k+a.l GROUP BY 1,2),
s{out} AS (SELECT ses, max(n)*(max(n)+2)*sum(rk*rk/(n-l)) AS q FROM r{out} GROUP BY 1),
{out} AS (SELECT m.ses, CASE WHEN m.m>=1 AND m.n>=10 THEN m.m END AS lags, CASE WHEN m.m>=1 AND m.n>=10 THEN CASE WHEN c0<=1e-15 THEN 0.0 ELSE q END END AS q FROM m{out} m LEFT JOIN s{out} USING (ses))"""


RA, RP = GRID[4]["r_A"], GRID[4]["r_Phi"]
# The state before each feature epoch, moved from the event before it; the second feature sees the first one's update.
WHITE_SQL = f"""{ONE}, nx AS (SELECT e.ses,e.n,e.v0,e.v1,s.m0,s.m1,s.p00,s.p01,s.p11,e.t-s.t AS dt FROM evn e JOIN kfr s ON s.ses=e.ses AND s.n=e.n-1 WHERE e.kind=0),
fx AS (SELECT nx.*, exp(-k_inh*dt) AS f00, exp(-k_d*dt) AS f11, -k_int*(exp(-k_inh*dt)-exp(-k_d*dt))/(k_d-k_inh) AS f10, s00,s01,s11 FROM nx, pr),
gx AS (SELECT ses,n,v0,v1, f00*m0 AS m0, f10*m0+f11*m1 AS m1, f00*f00*(p00-s00)+s00 AS p00, f00*(f10*(p00-s00)+f11*(p01-s01))+s01 AS p01, f10*f10*(p00-s00)+2*f10*f11*(p01-s01)+f11*f11*(p11-s11)+s11 AS p11 FROM fx),
inn AS (SELECT ses, n, (v0-m0)/sqrt(p00+{RA}*{RA}) AS z_a, (v1-m1-CASE WHEN v0 IS NULL THEN 0 ELSE p01/(p00+{RA}*{RA})*(v0-m0) END)/sqrt(p11-CASE WHEN v0 IS NULL THEN 0 ELSE p01*p01/(p00+{RA}*{RA}) END+{RP}*{RP}) AS z_p FROM gx),
{sql_ljung_box('inn', 'z_a', 'la')}, {sql_ljung_box('inn', 'z_p', 'lp')},
wc AS (SELECT ses, CASE WHEN count(*) FILTER (WHERE z_a IS NOT NULL AND z_p IS NOT NULL)>10 THEN corr(z_a,z_p) END AS ic FROM inn GROUP BY 1),
wh AS (SELECT ses, ic, (SELECT CASE WHEN q IS NOT NULL THEN {CHI_SQL} END FROM la WHERE la.ses=wc.ses) AS p_a, (SELECT CASE WHEN q IS NOT NULL THEN {CHI_SQL} END FROM lp WHERE lp.ses=wc.ses) AS p_p FROM wc)"""


def whiteness(t):
    """(ses, innovation_corr, p_a, p_p): Ljung-Box p of each feature's innovations and their correlation."""
    from ..functions.exprs import pearson

    f = cut_lineage(filtered(t).where("kind = 0").select("ses", "n", "z_a", "z_p"))
    lb = lambda c: ljung_box(f.where(F.col(c).isNotNull()), ["ses"], "n", c, 5).select("ses", chi2_sf(F.col("q"), F.col("lags").cast("double")).alias(f"p{c[1:]}"))
    c = f.groupBy("ses").agg(F.when(F.count_if(F.col("z_a").isNotNull() & F.col("z_p").isNotNull()) > 10, pearson("z_a", "z_p")).alias("innovation_corr"))
    return c.join(lb("z_a"), "ses", "left").join(lb("z_p"), "ses", "left")


@query("kf14_residual_whiteness", f"WITH RECURSIVE {WHITE_SQL} SELECT ses, round(ic,6) AS innovation_corr, round(p_a,6) AS p_a, round(p_p,6) AS p_p FROM wh")
def kf14(t):
    return whiteness(t).select("ses", *[R6(F.col(c)).alias(c) for c in ("innovation_corr", "p_a", "p_p")])


@query("kf14_whiteness_medians", f"WITH RECURSIVE {WHITE_SQL} SELECT count(*) AS n_sessions, {', '.join(f'round(quantile_cont({c},0.5),6) AS {n}' for c, n in (('p_a', 'p_a_median'), ('p_p', 'p_p_median'), ('ic', 'innovation_corr_median')))}, count(*) FILTER (WHERE p_a<0.05) AS below_a, count(*) FILTER (WHERE p_p<0.05) AS below_p FROM wh")
def kf14m(t):
    """Medians over the sessions, and how many sessions fall below 5 %."""
    w = cut_lineage(whiteness(t)).withColumn("_j", F.lit(0))
    n = w.groupBy("_j").agg(F.count(F.lit(1)).alias("n_sessions"), F.count_if(F.col("p_a") < 0.05).alias("below_a"), F.count_if(F.col("p_p") < 0.05).alias("below_p"))
    names = {"p_a": "p_a_median", "p_p": "p_p_median", "innovation_corr": "innovation_corr_median"}
    for c, out in names.items():
        n = n.join(quantiles(w, ["_j"], c, {out: 0.5}), "_j", "left")
    return n.select("n_sessions", *[R6(F.col(c)).alias(c) for c in names.values()], "below_a", "below_p")


# The parameters that are estimated, in the order of the nominal ones.
STARTS = ("k_inh", "k_d", "sigma_A", "sigma_Phi", "alpha", "beta", "r_A", "r_Phi", "r_Q", "rho")
START_NAMES = [n.lower() for n in STARTS]
KF15_SQL = f"""{OBS}{LAGGED[len(FS):]}, m AS (SELECT ses, avg(y_a) AS ma, avg(y_p) AS mp FROM fs GROUP BY 1), c AS (SELECT y_a-ma AS xa, pa-ma AS qa, y_p-mp AS xp, pp-mp AS qp FROM lg JOIN m USING (ses)),
r AS (SELECT least(greatest(sum(xa*qa)/sum(qa*qa) FILTER (WHERE xa IS NOT NULL),0.05),0.99) AS aa, least(greatest(sum(xp*qp)/sum(qp*qp) FILTER (WHERE xp IS NOT NULL),0.05),0.99) AS ap, avg(xa*xa) AS va, avg(xp*xp) AS vp FROM c),
ep AS (SELECT ses, t, v0, v1 FROM obs WHERE kind=0), fi AS (SELECT ses, arg_min({{'a': v0, 'p': v1}}, t) AS y FROM ep GROUP BY 1),
prb AS (SELECT q.ses, q.t, any_value(q.v0) AS r, arg_max({{'a': ep.v0, 'p': ep.v1}}, ep.t) FILTER (WHERE ep.t IS NOT NULL) AS y FROM obs q LEFT JOIN ep ON ep.ses=q.ses AND ep.t<q.t-1e-9 WHERE q.kind=1 AND q.v0 IS NOT NULL GROUP BY 1,2),
px AS (SELECT r, coalesce(prb.y, fi.y).a AS a, coalesce(prb.y, fi.y).p AS p FROM prb JOIN fi USING (ses)),
ps AS (SELECT count(*) AS n, sum(a*a) AS aa, sum(a*p) AS ap, sum(p*p) AS pp, sum(a*r) AS ar, sum(p*r) AS pr FROM px WHERE a IS NOT NULL AND p IS NOT NULL),
pc AS (SELECT CASE WHEN n>5 AND aa*pp-ap*ap<>0 THEN (pr*aa-ar*ap)/(aa*pp-ap*ap) ELSE {kf.NOMINAL['alpha']}::DOUBLE END AS alpha, CASE WHEN n>5 AND aa*pp-ap*ap<>0 THEN -(ar*pp-pr*ap)/(aa*pp-ap*ap) ELSE {kf.NOMINAL['beta']}::DOUBLE END AS beta FROM ps),
mo AS (SELECT -ln(aa)*6 AS k_inh, -ln(ap)*6 AS k_d, sqrt(greatest(2*(-ln(aa)*6)*va*0.7,1e-4)) AS sigma_a, sqrt(greatest(2*(-ln(ap)*6)*vp*0.7,1e-4)) AS sigma_phi, alpha, beta, {', '.join(f'{kf.NOMINAL[n]}::DOUBLE AS {n.lower()}' for n in STARTS[6:])} FROM r, pc)"""


def before_probes(o):
    """(r, a, p): each rating with the features of the last epoch that ends before it, of the first epoch if none does."""
    eeg = F.col("kind") == 0
    both = F.struct(F.col("v0").alias("a"), F.col("v1").alias("p"))
    # At equal times the rating comes first, so that it meets strictly earlier epochs.
    d = running(o.withColumn("turn", -F.col("kind")), ["ses"], ["t", "turn"], lasts={"y": F.when(eeg, both)})
    first = o.where(eeg).groupBy("ses").agg(F.min_by(both, "t").alias("y0"))
    return d.where(~eeg & F.col("v0").isNotNull()).join(first, "ses").select(F.col("v0").alias("r"), F.coalesce("y", "y0").alias("y")).select("r", "y.a", "y.p")


@query("kf15_starting_values", f"WITH {KF15_SQL} SELECT {', '.join(f'round({n},6) AS {n}' for n in START_NAMES)} FROM mo")
def kf15(t):
    """Rates and noises from lag ratios and variances, gains from the regression of the ratings, the rest nominal."""
    d = with_previous(t)
    m = d.groupBy("ses").agg(F.avg("y_a").alias("ma"), F.avg("y_p").alias("mp"))
    c = d.join(m, "ses").select((F.col("y_a") - F.col("ma")).alias("xa"), (F.col("pa") - F.col("ma")).alias("qa"), (F.col("y_p") - F.col("mp")).alias("xp"), (F.col("pp") - F.col("mp")).alias("qp"))
    ac = lambda s: F.least(F.greatest(F.sum(F.col(f"x{s}") * F.col(f"q{s}")) / F.sum(F.when(F.col(f"x{s}").isNotNull(), F.col(f"q{s}") ** 2)), F.lit(0.05)), F.lit(0.99))
    r = c.agg(ac("a").alias("aa"), ac("p").alias("ap"), F.avg(F.col("xa") ** 2).alias("va"), F.avg(F.col("xp") ** 2).alias("vp"), F.lit(0).alias("_j"))
    x = {"s": F.lit(1), "a": F.col("a"), "p": F.col("p"), "r": F.col("r")}
    g = before_probes(observations(t)).where("a is not null and p is not null").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in ("aa", "ap", "pp", "ar", "pr")], F.lit(0).alias("_j"))
    det = F.col("saa") * F.col("spp") - F.col("sap") ** 2
    usable = (F.col("n") > 5) & (det != 0)
    gain = {"alpha": (F.col("spr") * F.col("saa") - F.col("sar") * F.col("sap")) / det, "beta": -(F.col("sar") * F.col("spp") - F.col("spr") * F.col("sap")) / det}
    k = {s: -F.log(f"a{s}") * 6 for s in "ap"}
    sg = {s: F.sqrt(F.greatest(2 * k[s] * F.col(f"v{s}") * 0.7, F.lit(1e-4))) for s in "ap"}
    moments = {"k_inh": k["a"], "k_d": k["p"], "sigma_A": sg["a"], "sigma_Phi": sg["p"], **{n: F.when(usable, v).otherwise(kf.NOMINAL[n]) for n, v in gain.items()}}
    return r.join(g, "_j").select(*[R6(moments.get(n, F.lit(kf.NOMINAL[n]))).alias(n.lower()) for n in STARTS])


@query("kf15_jittered_starts", f"""WITH {KF15_SQL}, ms AS (SELECT [{','.join(f'round({n},6)' for n in START_NAMES)}] AS mom FROM mo),
o AS (SELECT s, i, CASE WHEN s%2=0 THEN [{','.join(repr(kf.NOMINAL[n]) for n in STARTS)}][i+1]::DOUBLE ELSE mom[i+1] END AS v, CASE WHEN s<2 THEN 0.0 ELSE {sql_normal("'kf15'", 's', 'i')} END AS z, CASE WHEN s<2 THEN 0.0 ELSE {sql_normal("'kf15+'", 's', 'i')} END AS z2 FROM ms, range(0,6) a(s), range(0,{len(STARTS)}) b(i)),
w AS (SELECT s, i, CASE WHEN i IN ({','.join(str(i) for i, n in enumerate(STARTS) if n in kf.POSITIVE)}) THEN v*exp(0.3*z) ELSE v+0.3*abs(v)*z+0.001*z2 END AS v FROM o)
SELECT s::INT AS start, {', '.join(f'round(max(v) FILTER (WHERE i={i}),6) AS {n}' for i, n in enumerate(START_NAMES))} FROM w GROUP BY 1""")
def kf15b(t):
    """Alternating copies of the nominal and the moment start, jittered on the log scale where a parameter is positive."""
    mom = kf15(t).select(F.array(*START_NAMES).alias("mom"))
    d = mom.select("mom", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("start"))
    nom = F.array(*[F.lit(float(kf.NOMINAL[n])) for n in STARTS])
    src = F.when(F.col("start") % 2 == 0, nom).otherwise(F.col("mom"))

    def moved(i, n):
        v, z, z2 = F.get("src", F.lit(i)), *[normal(F.lit(s), F.col("start"), F.lit(i)) for s in ("kf15", "kf15+")]
        return F.when(F.col("start") < 2, v).otherwise(v * F.exp(0.3 * z) if n in kf.POSITIVE else v + 0.3 * F.abs(v) * z + 0.001 * z2)
    return d.withColumn("src", src).select("start", *[R6(moved(i, n)).alias(n.lower()) for i, n in enumerate(STARTS)])


N_REP = 200


@query("kf16_parametric_bootstrap")
def kf16(t):
    """Replicates on the real schedules, and the maximum-likelihood estimates of all free parameters for each of them."""
    rows = ss.replicate_estimates(observations(t), GRID[4], N_REP, "kf16")
    d = t.spark.createDataFrame(rows, ", ".join(["rep int", *(f"{n} double" for n in kf.SLOPES), "ll double"]))
    return d.select("rep", *[R6(F.col(n)).alias(n) for n in kf.SLOPES], R4(F.col("ll")).alias("ll"))


@query("kf17_predictive_check")
def kf17(t):
    """Simulated ordinal ratings (95 % bands of the replicates) beside the observed ones: shares of the levels,
    median lag-1 autocorrelation of the sessions, and difference of the groups' mean within-session SD."""
    real = ratings_b(t)
    off = real.groupBy("ses").agg(F.avg("rating").alias("off"))
    level = F.least(F.greatest(F.bround(F.col("v0") * 4 + F.col("off"), 0), F.lit(-7.0)), F.lit(7.0)).cast("int")
    sim = ss.replicates(observations(t), GRID[4], N_REP, "kf16").where("kind = 1 and v0 is not null").join(off, "ses").select("rep", "ses", "t", level.alias("level"))
    both = cut_lineage(sim.unionByName(real.select(F.lit(0).alias("rep"), "ses", F.col("onset").cast("double").alias("t"), F.col("rating").cast("int").alias("level"))))
    c = ss.predictive_bands(ss.rating_statistics(both, F.col("ses") % 2 == 1, -7, 7), ["statistic", "level"])
    return c.select("statistic", "level", *[R6(F.col(x)).alias(x) for x in ("observed", "sim_mean", "lo", "hi")], F.col("observed").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("kf18_stop_checks", f"""WITH {KEPT}, {LAGGED}, a AS (SELECT ses, CASE WHEN count(*) FILTER (WHERE y_a IS NOT NULL AND pa IS NOT NULL)>=10 THEN corr(pa,y_a) END AS ac FROM lg GROUP BY 1),
k AS (SELECT coalesce(mf<=0.40 AND nr>=8, false) AS kept FROM kd)
SELECT round(quantile_cont(ac,0.5),6) AS median_ac, coalesce(quantile_cont(ac,0.5)<0.3,false) AS k2, (SELECT round(avg((NOT kept)::INT),6) FROM k) AS dropped, (SELECT avg((NOT kept)::INT)>0.5 FROM k) AS k3 FROM a""")
def kf18(t):
    from ..functions.exprs import pearson

    n = F.count_if(F.col("y_a").isNotNull() & F.col("pa").isNotNull())
    a = with_previous(t).groupBy("ses").agg(F.when(n >= 10, pearson("pa", "y_a")).alias("ac"))
    k = keep_sessions(t).agg(F.avg((~F.coalesce("kept", F.lit(False))).cast("int")).alias("dropped"), F.lit(0).alias("_j"))
    q = quantiles(a, [], "ac", {"median_ac": 0.5}).withColumn("_j", F.lit(0))
    d = k.join(q, "_j", "left")
    return d.select(R6(F.col("median_ac")).alias("median_ac"), F.coalesce(F.col("median_ac") < 0.3, F.lit(False)).alias("k2"), R6(F.col("dropped")).alias("dropped"), (F.col("dropped") > 0.5).alias("k3"))


VARIANTS = ("main", "feature_a_is_b", "feature_a_is_mean", "feature_b_is_a", "scaled_per_session", "missing_le_20pct", "first_20_probes", "other_artifact_rule")
N_VARIANTS = len(VARIANTS)
RATES, SIGNS = (0.05, 0.1, 0.2, 0.4, 0.8), tuple(itertools.product((1, -1), repeat=2))
# Rates first, then the signs of alpha and beta, so that pid // 4 is the rate and pid % 4 the signs.
SIGNED = [{**GRID[4], "k_inh": k, "alpha": a * GRID[4]["alpha"], "beta": b * GRID[4]["beta"]} for k in RATES for a, b in SIGNS]


def variants(o):
    """observations under every variant: (variant, ses, t, kind, v0, v1)."""
    eeg = F.col("kind") == 0
    gap = (F.col("v0").isNull() | F.col("v1").isNull()).cast("int")
    s = o.where(eeg).groupBy("ses").agg(F.stddev_pop("v0").alias("sd0"), F.stddev_pop("v1").alias("sd1"), F.avg(gap).alias("missing"))
    probes = numbered(o.where("kind = 1"), ["ses"], ["t"], "probe")
    d = o.where(eeg).withColumn("probe", F.lit(None).cast("long")).unionByName(probes.select(*o.columns, F.col("probe").cast("long").alias("probe"))).join(s, "ses", "left")
    d = d.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_VARIANTS - 1).cast("long"))))
    v, a, b = F.col("variant"), F.col("v0"), F.col("v1")
    d = d.where(((v != 5) | F.coalesce(F.col("missing") <= 0.2, F.lit(False))) & ((v != 6) | F.coalesce(F.col("probe") <= 20, eeg)))
    loud = (v == 7) & (F.abs(a) > 3)
    first = F.when(~eeg, a).when(v == 1, b).when(v == 2, (a + b) / 2).when(v == 4, a / F.nullif(F.col("sd0"), F.lit(0.0))).when(~F.coalesce(loud, F.lit(False)), a)
    second = F.when(~eeg, b).when(v == 3, a).when(v == 4, b / F.nullif(F.col("sd1"), F.lit(0.0))).when(~F.coalesce(loud, F.lit(False)), b)
    return d.select("variant", "ses", "t", "kind", first.alias("v0"), second.alias("v1"))


VARIANT_SQL = f"""{OBS}, sx AS (SELECT ses, stddev_pop(v0) AS sd0, stddev_pop(v1) AS sd1, avg((v0 IS NULL OR v1 IS NULL)::INT) AS miss FROM obs WHERE kind=0 GROUP BY 1),
ov AS (SELECT obs.*, sd0, sd1, miss, row_number() OVER (PARTITION BY ses, kind ORDER BY t) AS probe FROM obs LEFT JOIN sx USING (ses)),
vr AS (SELECT ses*10+v AS ses, v, t, kind, CASE WHEN kind=1 THEN v0 WHEN v=1 THEN v1 WHEN v=2 THEN (v0+v1)/2 WHEN v=4 THEN v0/nullif(sd0,0) WHEN v=7 AND abs(v0)>3 THEN NULL ELSE v0 END AS v0,
 CASE WHEN kind=1 THEN v1 WHEN v=3 THEN v0 WHEN v=4 THEN v1/nullif(sd1,0) WHEN v=7 AND abs(v0)>3 THEN NULL ELSE v1 END AS v1 FROM ov, range(0,{N_VARIANTS}) q(v) WHERE (v<>5 OR miss<=0.2) AND (v<>6 OR kind=0 OR probe<=20)),
vo AS (SELECT *, row_number() OVER (PARTITION BY ses ORDER BY t,kind) AS n FROM vr), {sql_filter(SIGNED, events='vo')},
y AS (SELECT ses%10 AS v, pid, sum(ll) AS ll, count(*) AS n FROM sc GROUP BY 1,2), b AS (SELECT v, arg_min(pid, (-ll, pid)) AS pid, max(ll) AS ll, max(n) AS n FROM y GROUP BY 1),
pf AS (SELECT pid//4 AS rate, max(ll) AS ll FROM y WHERE v=0 GROUP BY 1), m AS (SELECT pid FROM b WHERE v=0),
vd AS (SELECT q.v AS variant, [{','.join(repr(n) for n in VARIANTS)}][q.v+1] AS name, coalesce(b.n,0) AS n_sessions, [{','.join(f'{k}::DOUBLE' for k in RATES)}][b.pid//4+1] AS k_inh,
 (b.pid%4)//2=(m.pid%4)//2 AS alpha_sign_kept, b.pid%2=m.pid%2 AS beta_sign_kept, (SELECT max(ll) FROM pf)-pf.ll<=1.92 AS in_interval, round(b.ll,5) AS ll, b.pid IS NULL AS empty FROM range(0,{N_VARIANTS}) q(v) LEFT JOIN b ON b.v=q.v LEFT JOIN m ON true LEFT JOIN pf ON pf.rate=b.pid//4)"""


@query("kf19_sensitivity_variants", f"WITH RECURSIVE {VARIANT_SQL} SELECT * FROM vd")
def kf19(t):
    """Feature, mask and keep choices as one dimension of one job; per variant the rate, and whether the signs and
    the main profile's 95 % interval of the rate hold. An empty variant is kept."""
    s = ss.score(variants(observations(t)), ss.parameter_sets(SIGNED), keys=("variant", "ses"))
    # Few rows from here on: variants times parameter sets.
    y = cut_lineage(s.groupBy("variant", "pid").agg(F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("n_sessions")))
    b = y.groupBy("variant").agg(F.max_by("pid", F.struct("ll", -F.col("pid"))).alias("pid"), F.max("ll").alias("ll"), F.max("n_sessions").alias("n_sessions"))
    rate = lambda pid: F.get(F.array(*[F.lit(k) for k in RATES]), F.floor(pid / 4).cast("int"))
    curve = y.where("variant = 0").groupBy(F.lit(0).alias("one"), rate(F.col("pid")).alias("k")).agg(F.max("ll").alias("ll"))
    ends = st.profile_interval(curve, ["one"], "k", "ll").select("lo", "hi")
    main = b.where("variant = 0").select(F.col("pid").alias("main"))
    every = t.spark.range(0, N_VARIANTS).select(F.col("id").alias("variant"))
    d = every.join(F.broadcast(b), "variant", "left").join(F.broadcast(main), how="left").join(F.broadcast(ends), how="left").withColumn("k_inh", rate(F.col("pid")))
    sign = lambda pid, w: F.floor(pid % 4 / w) % 2
    within = (F.col("k_inh") >= F.coalesce("lo", F.lit(0.0))) & (F.col("k_inh") <= F.coalesce("hi", F.lit(float("inf"))))
    return d.select("variant", F.get(F.array(*[F.lit(n) for n in VARIANTS]), F.col("variant").cast("int")).alias("name"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "k_inh",
                    (sign(F.col("pid"), 2) == sign(F.col("main"), 2)).alias("alpha_sign_kept"), (sign(F.col("pid"), 1) == sign(F.col("main"), 1)).alias("beta_sign_kept"),
                    within.alias("in_interval"), F.round("ll", 5).alias("ll"), F.col("pid").isNull().alias("empty"))


@query("kf19_sensitivity_rule", f"""WITH RECURSIVE {VARIANT_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE alpha_sign_kept) AS a, count(*) FILTER (WHERE beta_sign_kept) AS b, count(*) FILTER (WHERE in_interval) AS i FROM vd WHERE variant BETWEEN 1 AND 6 AND NOT empty)
SELECT n AS n_variants, a AS alpha_sign_kept, b AS beta_sign_kept, i AS in_interval, n>0 AND least(a,b,i)>=0.8*n AS robust FROM c""")
def kf19b(t):
    """The rule over the variants fixed in advance: each verdict in four of five; the other artifact rule stays apart."""
    v = kf19(t).where("variant between 1 and 6 and not empty")
    c = v.agg(F.count(F.lit(1)).alias("n_variants"), *[F.count_if(F.col(x)).alias(x) for x in ("alpha_sign_kept", "beta_sign_kept", "in_interval")])
    return c.withColumn("robust", (F.col("n_variants") > 0) & (F.least("alpha_sign_kept", "beta_sign_kept", "in_interval") >= 0.8 * F.col("n_variants")))


@query("kf20_signal_to_noise", "WITH p AS (SELECT p_partkey, 0.05+p_size/100.0 AS k, 0.02+p_size/200.0 AS kd, p_retailprice/5000.0 AS sa, p_retailprice/9000.0 AS sp FROM part), s AS (SELECT *, sa^2/(2*k) AS s00, -0.081*(sa^2/(2*k))/(k+kd) AS s01 FROM p) SELECT p_partkey, round(sqrt(s00)/0.1,6) AS snr_a, round(sqrt((sp^2-2*0.081*s01)/(2*kd))/0.1,6) AS snr_phi FROM s")
def kf20(t):
    p = t.part.select("p_partkey", (0.05 + F.col("p_size") / 100.0).alias("k"), (0.02 + F.col("p_size") / 200.0).alias("kd"), (F.col("p_retailprice") / 5000.0).alias("sa"), (F.col("p_retailprice") / 9000.0).alias("sp"))
    s00 = F.col("sa") ** 2 / (2 * F.col("k"))
    s01 = -0.081 * s00 / (F.col("k") + F.col("kd"))
    return p.select("p_partkey", R6(F.sqrt(s00) / 0.1).alias("snr_a"), R6(F.sqrt((F.col("sp") ** 2 - 2 * 0.081 * s01) / (2 * F.col("kd"))) / 0.1).alias("snr_phi"))


@query("kf21_joint_datasets", f"""WITH RECURSIVE {OBS}, sd AS (SELECT ses%2 AS ds, sqrt(avg(v0*v0)) AS s FROM obs WHERE kind=1 GROUP BY 1), jo AS (SELECT ses,n,t,kind,CASE WHEN kind=1 THEN v0/s ELSE v0 END AS v0,v1 FROM evn JOIN sd ON ds=ses%2), {sql_filter(GRID, events='jo')},
x AS (SELECT ses%2 AS ds, pid//3 AS k, pid%3 AS shared, sum(ll) AS ll FROM sc GROUP BY 1,2,3), m AS (SELECT ds,shared,arg_max(k,ll) AS k,max(ll) AS ll FROM x GROUP BY 1,2), s2 AS (SELECT shared, sum(ll) AS ll FROM m GROUP BY 1), b AS (SELECT arg_max(shared,ll) AS shared, max(ll) AS ll FROM s2)
SELECT m.ds, b.shared, m.k, round(b.ll,5) AS total_ll FROM m JOIN b USING (shared)""")
def kf21(t):
    o = observations(t).withColumn("ds", F.col("ses") % 2)
    sd = o.where("kind = 1").groupBy("ds").agg(F.sqrt(F.avg(F.col("v0") ** 2)).alias("s"))
    o = o.join(F.broadcast(sd), "ds").withColumn("v0", F.when(F.col("kind") == 1, F.col("v0") / F.col("s")).otherwise(F.col("v0"))).select("ses", "t", "kind", "v0", "v1")
    x = ss.score(o, ss.parameter_sets(GRID)).groupBy((F.col("ses") % 2).alias("ds"), F.floor(F.col("pid") / 3).alias("k"), (F.col("pid") % 3).alias("shared")).agg(F.sum("ll").alias("ll"))
    m = x.groupBy("ds", "shared").agg(F.max_by("k", "ll").alias("k"), F.max("ll").alias("ll"))
    b = m.groupBy("shared").agg(F.sum("ll").alias("total_ll")).agg(F.max_by("shared", "total_ll").alias("shared"), F.max("total_ll").alias("total_ll"))
    return m.join(F.broadcast(b), "shared").select("ds", "shared", "k", F.round("total_ll", 5).alias("total_ll"))


@query("ss17_likelihood_ratio", f"""WITH RECURSIVE {SC}, g AS (SELECT ses%2 AS grp, pid, sum(ll) AS ll FROM sc GROUP BY 1,2), p AS (SELECT max(ll) AS ll FROM (SELECT pid,sum(ll) AS ll FROM sc GROUP BY 1)),
m AS (SELECT 'both' AS test, 2 AS df, (SELECT sum(m) FROM (SELECT max(ll) AS m FROM g GROUP BY grp)) AS ll
 UNION ALL SELECT 'k_inh', 1, (SELECT max(s) FROM (SELECT sum(m) AS s FROM (SELECT grp, pid%3 AS shared, max(ll) AS m FROM g GROUP BY 1,2) GROUP BY shared))
 UNION ALL SELECT 'k_d', 1, (SELECT max(s) FROM (SELECT sum(m) AS s FROM (SELECT grp, pid//3 AS shared, max(ll) AS m FROM g GROUP BY 1,2) GROUP BY shared))),
r AS (SELECT test, df, greatest(2*(m.ll-p.ll),0.0) AS lr FROM m, p)
SELECT test, df, round(lr,5) AS lr, round(CASE df WHEN 2 THEN exp(-lr/2) ELSE 1-2*sqrt(lr)/1200.0*(SELECT sum((CASE WHEN k=0 OR k=400 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*exp(-lr*k*k/320000.0)/sqrt(2*pi())) FROM range(0,401) q(k)) END,6) AS p FROM r""")
def ss17(t):
    """Group-specific rates against shared ones: both rates (2 df) and one rate at a time (1 df)."""
    g = cut_lineage(scores(t).groupBy((F.col("ses") % 2).alias("grp"), "pid").agg(F.sum("ll").alias("ll")))
    pool = g.groupBy("pid").agg(F.sum("ll").alias("ll")).agg(F.max("ll").alias("pooled"))

    def own(shared):
        each = g.groupBy("grp", shared.alias("shared")).agg(F.max("ll").alias("m"))
        return each.groupBy("shared").agg(F.sum("m").alias("s")).agg(F.max("s").alias("ll"))

    tests = union_all([own(c).select(F.lit(n).alias("test"), F.lit(df).alias("df"), "ll") for n, df, c in (
        ("both", 2, F.lit(0)), ("k_inh", 1, F.col("pid") % 3), ("k_d", 1, F.floor(F.col("pid") / 3)))])
    d = tests.join(F.broadcast(pool)).withColumn("lr", F.greatest(2 * (F.col("ll") - F.col("pooled")), F.lit(0.0)))
    return d.select("test", "df", F.round("lr", 5).alias("lr"), R6(chi2_sf(F.col("lr"), F.col("df").cast("double"))).alias("p"))

