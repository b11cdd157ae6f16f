"""Effect sizes, tests, meta-analysis, axes and sensitivity indices."""

from pyspark.sql import Window, functions as F

from ..functions.draws import normal, sql_normal, sql_uniform, uniform
from ..functions.exprs import dot, let
from ..functions.tails import chi2_sf, norm_cdf, t_quantile, t_sf
from ..operators import stats as st
from ..operators.joins import tolerance_join
from ..operators.ordered import running
from ..operators.quantiles import quantiles
from ..operators.resample import bootstrap_mean, resampled, sign_flips, sql_poisson, sql_resampled, sql_sign
from .registry import query
from .relational import DSG, FEAT, FS, LAGGED, METRICS, PAIR, crb_table, feature_epochs, features, matched_designs, mle_table, order_pairs, with_previous
from ..sources.tables import EV, MC

R6 = lambda c: F.round(c, 6)
R4 = lambda c: F.round(c, 4)
# The replicate counts of the studies.
N_EFFECT, N_META, N_AXIS, N_SESSIONS, N_SOBOL = 10_000, 2_000, 10_000, 2_000, 1_000

# Tail areas by Simpson's rule over the density, independent of the Spark side.
T_PDF = "exp(lgamma(({d}+1)/2.0)-lgamma({d}/2.0))/sqrt({d}*pi())*pow(1+({x})*({x})/{d},-({d}+1)/2.0)"


def sql_t_upper(t, d):
    """P(T > t) as 0.5 - integral(0..t) with 400 Simpson steps."""
    x = f"(({t})*k/400.0)"
    w = "(CASE WHEN k=0 OR k=400 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)"
    return f"(0.5-(SELECT sum({w}*{T_PDF.format(d='('+d+')::DOUBLE', x=x)}) FROM range(0,401) kk(k))*({t})/1200.0)"


@query("ss1_paired_effect", f"""WITH {PAIR}, d AS (SELECT subject, a-b AS diff FROM pr),
s AS (SELECT count(*) AS n, avg(diff) AS m, stddev_samp(diff) AS sd FROM d),
z AS (SELECT * FROM {st.sql_effects('d', 'subject', N_EFFECT, 'ss1')})
SELECT n, round(m,6) AS mean_diff, round(m/sd,6) AS dz, round(m/(sd/sqrt(n)),6) AS t, round(2*{sql_t_upper('abs(m/(sd/sqrt(n)))', 'n-1')},6) AS p,
 (SELECT round(quantile_cont(dz,0.025),4) FROM z) AS lo, (SELECT round(quantile_cont(dz,0.975),4) FROM z) AS hi FROM s""")
def ss1(t):
    p = order_pairs(t)
    e = st.paired_effect(p).withColumn("_j", F.lit(0))
    b = st.effect_bootstrap(p, [], "subject", N_EFFECT, "ss1").withColumn("_j", F.lit(0))
    d = e.join(F.broadcast(b), "_j")
    return d.select("n", R6(F.col("mean_diff")).alias("mean_diff"), R6(F.col("dz")).alias("dz"), R6(F.col("t")).alias("t"),
                    R6(2 * t_sf(F.abs("t"), (F.col("n") - 1).cast("double"))).alias("p"), R4(F.col("lo")).alias("lo"), R4(F.col("hi")).alias("hi"))


@query("ss2_equivalence_test", f"""WITH {PAIR}, s AS (SELECT count(*) AS n, avg(a-b) AS m, stddev_samp(a-b) AS sd FROM pr)
SELECT round(0.2*sd,6) AS bound, round(greatest({sql_t_upper('(m+0.2*sd)/(sd/sqrt(n))', 'n-1')},1-{sql_t_upper('(m-0.2*sd)/(sd/sqrt(n))', 'n-1')}),6) AS p_tost FROM s""")
def ss2(t):
    e = st.equivalence(order_pairs(t))
    df = (F.col("n") - 1).cast("double")
    e = e.withColumns({"p1": t_sf("t_lower", df), "p2": 1 - t_sf("t_upper", df)})
    return e.select(R6(F.col("bound")).alias("bound"), R6(F.greatest("p1", "p2")).alias("p_tost"))


PVALS = """pv AS (SELECT unit, ('0x'||substr(md5(concat_ws('|','p',unit)),1,8))::BIGINT/4294967296.0 AS u FROM (SELECT o_orderkey AS unit FROM orders)), tp AS (SELECT unit, round(u*u,5) AS p FROM pv)"""


@query("ss3_false_discovery_rate", f"""WITH {PVALS}, r AS (SELECT unit,p, p*count(*) OVER ()/(rank() OVER (ORDER BY p)+count(*) OVER (PARTITION BY p)-1) AS v FROM tp)
SELECT unit, p, round(least(min(v) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),1.0),6) AS p_adj, least(min(v) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),1.0)<=0.05 AS reject FROM r""")
def ss3(t):
    u = uniform(F.lit("p"), F.col("o_orderkey"))
    d = t.orders.select(F.col("o_orderkey").alias("unit"), F.round(u * u, 5).alias("p"))
    return st.fdr_bh(d, "p").withColumn("p_adj", R6(F.col("p_adj")))


@query("ss5_condition_contrasts", f"""WITH {FEAT}, m AS (SELECT subject,cond,avg(m_price)/1000 AS y FROM feat GROUP BY 1,2), w AS (SELECT subject FROM m GROUP BY 1 HAVING count(*)=3), b AS (SELECT m.* FROM m JOIN w USING (subject)),
g AS (SELECT count(DISTINCT subject) AS n, avg(y) AS gm FROM b), sm AS (SELECT subject, avg(y) AS sy FROM b GROUP BY 1), cm AS (SELECT cond, avg(y) AS cy FROM b GROUP BY 1),
e AS (SELECT sum((y-sy-cy+gm)^2)/((max(n)-1)*2) AS ms FROM b JOIN sm USING (subject) JOIN cm USING (cond), g)
SELECT cond, round(cy-(SELECT cy FROM cm WHERE cond='A'),6) AS coef, round(sqrt(2*ms/n),6) AS se, n AS n_groups FROM cm, e, g WHERE cond<>'A'""")
def ss5(t):
    m = features(t).groupBy("subject", "cond").agg((F.avg("m_price") / 1000).alias("y"))
    s = m.groupBy("subject").agg(F.avg("y").alias("sy"), F.count(F.lit(1)).alias("k")).where("k = 3")
    b = m.join(s, "subject")
    c = b.groupBy("cond").agg(F.avg("y").alias("cy"))
    g = b.agg(F.avg("y").alias("gm"), F.count_distinct("subject").alias("n"))
    ref = c.where("cond = 'A'").select(F.col("cy").alias("ref"))
    j = b.join(F.broadcast(c), "cond").join(F.broadcast(g))
    e = j.agg((F.sum((F.col("y") - F.col("sy") - F.col("cy") + F.col("gm")) ** 2) / ((F.max("n") - 1) * 2)).alias("ms"), F.max("n").alias("n"))
    return c.where("cond <> 'A'").join(F.broadcast(ref)).join(F.broadcast(e)).select(
        "cond", R6(F.col("cy") - F.col("ref")).alias("coef"), R6(F.sqrt(2 * F.col("ms") / F.col("n"))).alias("se"), F.col("n").alias("n_groups"))


# ---------------------------------------------------------------- meta-analysis
STUD = """stu AS (SELECT p_brand AS study, p_type AS type, count(*) AS n, avg(ln(p_retailprice)) AS delta, stddev_samp(ln(p_retailprice)) AS sd, (avg(ln(p_retailprice))-6.0)/stddev_samp(ln(p_retailprice)) AS d FROM part GROUP BY 1,2 HAVING count(*)>=3 AND stddev_samp(ln(p_retailprice))>0)"""


def studies(t):
    lv = F.log("p_retailprice")
    g = t.part.groupBy(F.col("p_brand").alias("study"), F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.avg(lv).alias("delta"), F.stddev_samp(lv).alias("sd"))
    return g.where("n >= 3 and sd > 0").withColumn("d", (F.col("delta") - 6.0) / F.col("sd"))


def meta_sql(where="", key=""):
    k, kg, kj = (f"{key},", f"GROUP BY {key}", f"USING ({key})") if key else ("", "", "ON true")
    k1 = f"a.{key}," if key else ""
    return f"""v AS (SELECT *, 1.0/n+d*d/(2.0*n) AS v FROM stu {where}), a AS (SELECT {k} count(*) AS k, sum(n)::BIGINT AS total_n, sum(1/v) AS sw, sum(1/v/v) AS sw2, sum(d/v)/sum(1/v) AS fx FROM v {kg}),
q AS (SELECT {k1} sum((d-fx)^2/v) AS q FROM v JOIN a {kj} GROUP BY {k1[:-1] if key else 'ALL'}),
t2 AS (SELECT a.*, q.q, CASE WHEN q>0 THEN greatest((q-(k-1))/q*100,0.0) ELSE 0.0 END AS i2, CASE WHEN sw-sw2/sw>0 THEN greatest((q-(k-1))/(sw-sw2/sw),0.0) ELSE 0.0 END AS tau2 FROM a JOIN q {kj}),
re AS (SELECT {'t2.'+key+',' if key else ''} sum(d/(v+tau2))/sum(1/(v+tau2)) AS pooled, sqrt(1/sum(1/(v+tau2))) AS se FROM v JOIN t2 {kj} GROUP BY {'t2.'+key if key else 'ALL'})"""


META_SEL = "k, total_n, round(fx,6) AS fixed, round(q,4) AS q, round(i2,4) AS i2, round(tau2,6) AS tau2, round(pooled,6) AS pooled, round(se,6) AS se, round(pooled-1.96*se,6) AS lo, round(pooled+1.96*se,6) AS hi"


def meta_out(d, keys=()):
    return d.select(*keys, "k", "total_n", *[(R4 if c in ("q", "i2") else R6)(F.col(c)).alias(c) for c in ("fixed", "q", "i2", "tau2", "pooled", "se", "lo", "hi")])


@query("ss6_random_effects", f"WITH {STUD}, {meta_sql()} SELECT {META_SEL} FROM t2, re")
def ss6(t):
    return meta_out(st.random_effects(studies(t))[0])


@query("ss6_study_weights", f"WITH {STUD}, {meta_sql()} SELECT study, type, round(1/(v+tau2),6) AS weight FROM v, t2")
def ss6w(t):
    return st.random_effects(studies(t))[1].select("study", "type", R6(F.col("weight")).alias("weight"))


@query("ss7_pooled_change", f"WITH {STUD} SELECT round(sum(delta*n/(sd*sd))/sum(n/(sd*sd)),6) AS pooled, round(sqrt(1/sum(n/(sd*sd))),6) AS se FROM stu")
def ss7(t):
    w = F.col("n") / (F.col("sd") ** 2)
    return studies(t).agg(R6(F.sum(F.col("delta") * w) / F.sum(w)).alias("pooled"), R6(F.sqrt(1 / F.sum(w))).alias("se"))


@query("ss8_meta_bootstrap", f"""WITH {STUD}, v AS (SELECT *, 1.0/n+d*d/(2.0*n) AS v FROM stu),
b AS (SELECT rep, sum((d+sqrt(v)*{sql_normal("'ss8'", 'rep', 'study', 'type')})/v)/sum(1/v) AS pd FROM v, range(1,{N_META + 1}) r(rep) GROUP BY 1)
SELECT rep, round(pd,4) AS pooled FROM b""")
def ss8(t):
    v = 1.0 / F.col("n") + F.col("d") ** 2 / (2.0 * F.col("n"))
    return st.pooled_draws(studies(t).withColumn("v", v), [], ["study", "type"], N_META, "ss8").select("rep", R4(F.col("pooled")).alias("pooled"))


@query("ss9_subset_meta", f"""WITH {STUD}, {meta_sql(key='type')},
bt AS (SELECT type, rep, sum((d+sqrt(v)*{sql_normal("'ss9'", 'rep', 'study', 'type')})/v)/sum(1/v) AS pd FROM v, range(1,{N_META + 1}) r(rep) GROUP BY 1,2),
ci AS (SELECT type, round(quantile_cont(pd,0.025),4) AS boot_lo, round(quantile_cont(pd,0.975),4) AS boot_hi FROM bt GROUP BY 1)
SELECT t2.type, {META_SEL}, boot_lo, boot_hi FROM t2 JOIN re USING (type) JOIN ci USING (type)""")
def ss9(t):
    """Meta-analysis of the studies of one type, with the percentile interval of a parametric bootstrap."""
    s = studies(t)
    pooled = st.pooled_draws(s.withColumn("v", 1.0 / F.col("n") + F.col("d") ** 2 / (2.0 * F.col("n"))), ["type"], ["study", "type"], N_META, "ss9")
    ci = pooled.groupBy("type").agg(R4(F.percentile("pooled", F.lit(0.025))).alias("boot_lo"), R4(F.percentile("pooled", F.lit(0.975))).alias("boot_hi"))
    return meta_out(st.random_effects(s, ["type"])[0], ["type"]).join(ci, "type")


REML_SE = """est AS (SELECT type AS unit0, study AS unit, d AS y, sqrt(1.0/n+d*d/(2.0*n)) AS se FROM stu)"""


def reml_grid(units, lo, step):
    """Objective of 41 ln tau^2 values per key: one explode and one aggregate."""
    g = units.withColumn("lt", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.least(F.greatest(lo + step * k, F.lit(-15.0)), F.lit(5.0)))))
    w = 1.0 / (F.col("v") + F.exp("lt"))
    s = g.groupBy("key", "lt").agg(F.sum(-F.log(w)).alias("a"), F.sum(w).alias("sw"), F.sum(w * F.col("y")).alias("swy"), F.sum(w * F.col("y") ** 2).alias("swyy"))
    nll = 0.5 * (F.col("a") + F.col("swyy") - F.col("swy") ** 2 / F.col("sw") + F.log("sw"))
    return s.groupBy("key").agg(F.min_by("lt", F.struct(nll, F.col("lt"))).alias("lt"))


def reml(units):
    """units(key, y, v) -> tau^2 by a grid over ln tau^2 in [-15, 5], zoomed twice."""
    best = reml_grid(units, F.lit(-15.0), F.lit(0.5))
    for h in (0.5, 0.025):
        best = reml_grid(units.join(best, "key"), F.col("lt") - h, F.lit(h / 20))
    t2 = units.join(best, "key").withColumn("tau2", F.exp("lt"))
    w = 1.0 / (F.col("v") + F.col("tau2"))
    return t2.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("lt").alias("log_tau2"), (F.sum(w * F.col("y")) / F.sum(w)).alias("mu"), (1 / F.sqrt(F.sum(w))).alias("se_mu"),
        F.greatest(1 - F.count(F.lit(1)) / F.sum(1 / F.col("v")) / F.greatest(F.max("tau2") + F.avg("v"), F.lit(1e-12)), F.lit(0.0)).alias("i2"))


def reml_sql():
    step = lambda src, lo, h, out: f"""g{out} AS (SELECT key,y,v,least(greatest({lo}+{h}*k::DOUBLE,-15.0),5.0)::DOUBLE AS lt FROM {src}, range(0,41) r(k)),
o{out} AS (SELECT key,lt,0.5*(sum(ln(v+exp(lt)))+sum(y*y/(v+exp(lt)))-sum(y/(v+exp(lt)))^2/sum(1/(v+exp(lt)))+ln(sum(1/(v+exp(lt))))) AS f FROM g{out} GROUP BY 1,2),
b{out} AS (SELECT key, lt FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY f,lt) r FROM o{out}) WHERE r=1)"""  # noqa: E731
    j = lambda b: f"(SELECT u.*, {b}.lt AS l0 FROM u JOIN {b} USING (key))"
    return ", ".join([step("u", "-15.0", "0.5", 1), step(j("b1"), "l0-0.5", "0.025", 2), step(j("b2"), "l0-0.025", "0.00125", 3)])


UN = "u AS (SELECT study AS key, d AS y, 1.0/n+d*d/(2.0*n) AS v FROM stu WHERE sqrt(1.0/n+d*d/(2.0*n))<5)"


@query("ss10_reml_meta", f"""WITH {STUD}, {UN}, {reml_sql()}, ex AS (SELECT study AS key, count(*) FILTER (WHERE NOT sqrt(1.0/n+d*d/(2.0*n))<5) AS n_excluded FROM stu GROUP BY 1)
SELECT key, count(*) AS n, max(n_excluded) AS n_excluded, round(max(lt),4) AS log_tau2, max(lt)<=-15 OR max(lt)>=5 AS at_boundary, round(sum(y/(v+exp(lt)))/sum(1/(v+exp(lt))),6) AS mu, round(1/sqrt(sum(1/(v+exp(lt)))),6) AS se_mu,
 round(greatest(1-count(*)/sum(1/v)/greatest(exp(max(lt))+avg(v),1e-12),0.0),6) AS i2 FROM u JOIN b3 USING (key) JOIN ex USING (key) GROUP BY 1 HAVING count(*)>=3""")
def ss10(t):
    """Units without a usable error are left out and counted; a variance at an end of its range is flagged."""
    v = 1.0 / F.col("n") + F.col("d") ** 2 / (2.0 * F.col("n"))
    every = studies(t).select(F.col("study").alias("key"), F.col("d").alias("y"), v.alias("v"))
    usable = F.coalesce(F.sqrt("v") < 5, F.lit(False))
    left_out = every.groupBy("key").agg(F.count_if(~usable).alias("n_excluded"))
    r = reml(every.where(usable)).where("n >= 3").join(left_out, "key")
    ends = (F.col("log_tau2") <= -15) | (F.col("log_tau2") >= 5)
    return r.select("key", "n", "n_excluded", R4(F.col("log_tau2")).alias("log_tau2"), ends.alias("at_boundary"), *[R6(F.col(c)).alias(c) for c in ("mu", "se_mu", "i2")])


# ---------------------------------------------------------------- reference axis
DELTA = f"""{FEAT}, z AS (SELECT subject,cond,avg((m_qty-25)/15) AS v1, avg((m_price-30000)/20000) AS v2, avg((m_disc-0.05)/0.03) AS v3, avg((m_tax-0.04)/0.03) AS v4 FROM feat GROUP BY 1,2),
dl AS (SELECT a.subject, [a.v1-b.v1,a.v2-b.v2,a.v3-b.v3,a.v4-b.v4] AS d FROM z a JOIN z b ON a.subject=b.subject AND a.cond='A' AND b.cond='R')"""


def deltas(t):
    z = [(F.avg((F.col(c) - m) / s)).alias(f"v{k}") for k, (c, m, s) in enumerate((("m_qty", 25, 15), ("m_price", 30000, 20000), ("m_disc", 0.05, 0.03), ("m_tax", 0.04, 0.03)), 1)]
    g = features(t).groupBy("subject", "cond").agg(*z)
    a, b = [g.where(F.col("cond") == c).select("subject", F.array("v1", "v2", "v3", "v4").alias(n)) for c, n in (("A", "x"), ("R", "y"))]
    return a.join(b, "subject").select("subject", F.zip_with("x", "y", lambda p, q: p - q).alias("d"))


@query("ss14_reference_deltas", f"WITH {DELTA} SELECT subject, round(d[1],6) AS d1, round(d[2],6) AS d2, round(d[3],6) AS d3, round(d[4],6) AS d4 FROM dl")
def ss14(t):
    return deltas(t).select("subject", *[R6(F.col("d")[k]).alias(f"d{k + 1}") for k in range(4)])


def axis_row(t):
    """Second moments of the deltas (one small row), then the dominant direction by
    repeated multiplication inside that row."""
    d = deltas(t)
    k = 4
    m = d.agg(*[F.sum(F.col("d")[i] * F.col("d")[j]).alias(f"m{i}{j}") for i in range(k) for j in range(k)], *[F.avg(F.col("d")[i]).alias(f"mu{i}") for i in range(k)],
              *[F.avg(F.when(F.col("subject") % 2 == g, F.col("d")[i])).alias(f"g{g}{i}") for g in range(2) for i in range(k)])
    rows = F.array(*[F.array(*[F.col(f"m{i}{j}") for j in range(k)]) for i in range(k)])
    m = m.select(rows.alias("mat"), F.array(*[F.col(f"mu{i}") for i in range(k)]).alias("mu"), *[F.array(*[F.col(f"g{g}{i}") for i in range(k)]).alias(f"g{g}") for g in range(2)])
    agreement = dot(F.col("g0"), F.col("g1")) / F.sqrt(dot(F.col("g0"), F.col("g0")) * dot(F.col("g1"), F.col("g1")))
    step = lambda u, _: F.transform(F.col("mat"), lambda r: dot(r, u))
    unit = lambda u: let(u, lambda w: let(F.sqrt(dot(w, w)), lambda n: F.transform(w, lambda x: x / n)))
    it = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.col("mu"), lambda u, s: unit(step(u, s)))
    m = m.withColumn("u0", unit(it))
    sign = F.when(dot(F.col("u0"), F.col("mu")) < 0, -1.0).otherwise(1.0)
    m = m.withColumn("u", F.transform("u0", lambda x: x * sign))
    trace = F.aggregate(F.transform("mat", lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, b: a + b)
    return m.select("u", dot(F.col("u"), F.col("mu")).alias("shift"), (dot(F.col("u"), F.transform("mat", lambda r: dot(r, F.col("u")))) / trace).alias("explained"), agreement.alias("agreement"))


AXIS_SQL = f"""WITH RECURSIVE {DELTA}, mm AS (SELECT i, j, sum(d[i]*d[j]) AS v FROM dl, range(1,5) a(i), range(1,5) b(j) GROUP BY 1,2), mt AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM mm GROUP BY 1)),
mu AS (SELECT [avg(d[1]),avg(d[2]),avg(d[3]),avg(d[4])] AS mu FROM dl),
it(k,u) AS (SELECT 0, mu FROM mu UNION ALL SELECT k+1, list_transform(w, lambda x: x/sqrt(list_dot_product(w,w))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r,u)) AS w FROM it, mt WHERE k<200)),
ax AS (SELECT list_transform(u, lambda x: CASE WHEN list_dot_product(u,mu)<0 THEN -x ELSE x END) AS u, mu, m FROM it, mu, mt WHERE k=200)"""


@query("ss11_reference_axis", f"{AXIS_SQL}, gm AS (SELECT subject%2 AS g, [avg(d[1]),avg(d[2]),avg(d[3]),avg(d[4])] AS v FROM dl GROUP BY 1), ag AS (SELECT list_cosine_similarity(p.v,q.v) AS agreement FROM gm p JOIN gm q ON p.g=0 AND q.g=1) SELECT round(u[1],6) AS u1, round(u[2],6) AS u2, round(u[3],6) AS u3, round(u[4],6) AS u4, round(list_dot_product(u,mu),6) AS shift, round(list_dot_product(u,list_transform(m, lambda r: list_dot_product(r,u)))/(m[1][1]+m[2][2]+m[3][3]+m[4][4]),6) AS explained, round(agreement,6) AS agreement FROM ax, ag")
def ss11(t):
    """The axis, and the cosine between the mean deltas of the two reference groups (even and odd subjects)."""
    return axis_row(t).select(*[R6(F.col("u")[k]).alias(f"u{k + 1}") for k in range(4)], *[R6(F.col(c)).alias(c) for c in ("shift", "explained", "agreement")])


@query("ss12_axis_projection", f"{AXIS_SQL}, p AS (SELECT subject, d, u, list_dot_product(d,u) AS al, list_dot_product(u,mu) AS sh FROM dl, ax) SELECT subject, round(al/sh,4) AS c, round(sqrt(list_sum(list_transform(range(1,5), lambda k: (d[k]-al*u[k])^2))),6) AS residual_norm FROM p")
def ss12(t):
    d = deltas(t).join(F.broadcast(axis_row(t)))
    p = st.project(d, F.col("u"), F.col("shift"))
    return p.select("subject", R4(F.col("c")).alias("c"), R6(F.col("residual_norm")).alias("residual_norm"))


@query("ss13_projection_bootstrap", f"""{AXIS_SQL}, p AS (SELECT subject, list_dot_product(d,u)/list_dot_product(u,mu) AS c, [d[1]-list_dot_product(d,u)*u[1],d[2]-list_dot_product(d,u)*u[2],d[3]-list_dot_product(d,u)*u[3],d[4]-list_dot_product(d,u)*u[4]] AS r FROM dl, ax),
bs AS (SELECT rep, c/w AS c, sqrt((r0/w)^2+(r1/w)^2+(r2/w)^2+(r3/w)^2) AS rn FROM {sql_resampled('p', 'subject', {'c': 'c', 'r0': 'r[1]', 'r1': 'r[2]', 'r2': 'r[3]', 'r3': 'r[4]'}, N_AXIS, 'ss13')}),
ob AS (SELECT avg(c) AS c, sqrt(avg(r[1])^2+avg(r[2])^2+avg(r[3])^2+avg(r[4])^2) AS rn FROM p),
nu AS (SELECT rep, sqrt(avg(s*r[1])^2+avg(s*r[2])^2+avg(s*r[3])^2+avg(s*r[4])^2) AS rn FROM (SELECT rep, r, {sql_sign('subject', 'ss13s')} AS s FROM p, range(1,{N_AXIS + 1}) q(rep)) GROUP BY 1)
SELECT round(c,4) AS c_mean, round(rn,6) AS residual, (SELECT round(quantile_cont(c,0.025),4) FROM bs) AS c_lo, (SELECT round(quantile_cont(c,0.975),4) FROM bs) AS c_hi, (SELECT round(quantile_cont(rn,0.025),4) FROM bs) AS r_lo, (SELECT round(quantile_cont(rn,0.975),4) FROM bs) AS r_hi,
 round(((SELECT count(*) FROM nu WHERE nu.rn>=ob.rn)+1)/({N_AXIS}+1.0),6) AS residual_p FROM ob""")
def ss13(t):
    d = deltas(t).join(F.broadcast(axis_row(t)))
    al = dot(F.col("d"), F.col("u"))
    p = d.select("subject", (al / F.col("shift")).alias("c"), *[(F.col("d")[k] - al * F.col("u")[k]).alias(f"r{k}") for k in range(4)])
    rs = [f"r{k}" for k in range(4)]
    norm = lambda cs: F.sqrt(sum((F.avg(c) ** 2 for c in cs), F.lit(0.0)))
    ob = p.agg(F.avg("c").alias("c_mean"), norm([F.col(r) for r in rs]).alias("residual")).withColumn("_j", F.lit(0))
    length = lambda cs: F.sqrt(sum((c ** 2 for c in cs), F.lit(0.0)))
    bs = resampled(p, [], "subject", {c: F.col(c) for c in ("c", *rs)}, N_AXIS, "ss13").select("rep", (F.col("c") / F.col("w")).alias("c"), length([F.col(r) / F.col("w") for r in rs]).alias("rn"))
    ci = bs.agg(*[F.percentile(c, F.lit(q)).alias(n) for c, q, n in (("c", 0.025, "c_lo"), ("c", 0.975, "c_hi"), ("rn", 0.025, "r_lo"), ("rn", 0.975, "r_hi"))]).withColumn("_j", F.lit(0))
    nu = sign_flips(p, "subject", rs, N_AXIS, "ss13s").select("rep", length([F.col(r) for r in rs]).alias("nr"))
    pv = nu.join(F.broadcast(ob.select("residual"))).agg(((F.count_if(F.col("nr") >= F.col("residual")) + 1) / (N_AXIS + 1.0)).alias("residual_p")).withColumn("_j", F.lit(0))
    o = ob.join(ci, "_j").join(pv, "_j")
    return o.select(R4(F.col("c_mean")).alias("c_mean"), R6(F.col("residual")).alias("residual"), *[R4(F.col(c)).alias(c) for c in ("c_lo", "c_hi", "r_lo", "r_hi")], R6(F.col("residual_p")).alias("residual_p"))


# ---------------------------------------------------------------- whiteness, tails, ranks
LB_SQL = f"""{EV}, {FS}, o AS (SELECT ses, y_a, row_number() OVER (PARTITION BY ses ORDER BY epoch) AS k, count(*) OVER (PARTITION BY ses) AS n, y_a-avg(y_a) OVER (PARTITION BY ses) AS x FROM fs WHERE y_a IS NOT NULL),
m AS (SELECT ses, max(n) AS n, least(5,max(n)//4) AS m, avg(x*x) AS c0 FROM o GROUP BY 1),
r AS (SELECT m.ses, a.l, sum(p.x*q.x)/(max(m.n)*max(c0)) AS rk, max(m.n) AS n FROM m JOIN (SELECT l FROM range(1,6) z(l)) a ON a.l<=m.m JOIN o p ON p.ses=m.ses JOIN o q ON q.ses=m.ses AND q.k=p.k+a.l GROUP BY 1,2),
s AS (SELECT ses, max(n)*(max(n)+2)*sum(rk*rk/(n-l)) AS q FROM r GROUP BY 1)"""


@query("wn5_ljung_box", f"""WITH {LB_SQL}
SELECT m.ses, m.n, CASE WHEN m.m<1 OR m.n<10 THEN NULL ELSE m.m END AS lags, round(CASE WHEN m.m<1 OR m.n<10 THEN NULL WHEN c0<=1e-15 THEN 0.0 ELSE q END,6) AS q FROM m LEFT JOIN s USING (ses)""")
def wn5(t):
    from ..operators.whiteness import ljung_box

    d = feature_epochs(t).where("y_a is not null").select("ses", "epoch", "y_a")
    return ljung_box(d, ["ses"], "epoch", "y_a", 5).select("ses", "n", "lags", R6(F.col("q")).alias("q"))


# Upper chi-square tail: Simpson over u with x = u*u, which is smooth at zero.
CHI_SQL = "(1-(SELECT sum((CASE WHEN k=0 OR k=400 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*2*pow(sqrt(q)*k/400.0,lags-1)*exp(-0.5*q*pow(k/400.0,2))) FROM range(0,401) kk(k))*sqrt(q)/1200.0/(pow(2,lags/2.0)*gamma(lags/2.0)))"


@query("wn5_ljung_box_p", f"""WITH {LB_SQL}, r2 AS (SELECT m.ses, CASE WHEN m.m<1 OR m.n<10 THEN NULL ELSE m.m END AS lags, CASE WHEN m.m<1 OR m.n<10 THEN NULL WHEN c0<=1e-15 THEN 0.0 ELSE q END AS q FROM m LEFT JOIN s USING (ses))
SELECT ses, round(CASE WHEN q IS NOT NULL THEN {CHI_SQL} END,6) AS p FROM r2""")
def wn5p(t):
    from ..operators.whiteness import ljung_box

    d = feature_epochs(t).where("y_a is not null").select("ses", "epoch", "y_a")
    b = ljung_box(d, ["ses"], "epoch", "y_a", 5)
    return b.select("ses", R6(chi2_sf(F.col("q"), F.col("lags").cast("double"))).alias("p"))


@query("ss16_group_contrast", f"""WITH {FEAT}, g AS (SELECT subject, avg(ln(m_price)) FILTER (WHERE cond='A') AS a, avg(ln(m_price)) FILTER (WHERE cond='R') AS b, sqrt(var_samp(ln(m_price)) FILTER (WHERE cond='A')/count(*) FILTER (WHERE cond='A')+var_samp(ln(m_price)) FILTER (WHERE cond='R')/count(*) FILTER (WHERE cond='R')) AS se FROM feat GROUP BY 1)
SELECT subject, round(a-b,6) AS diff, round(se,6) AS se, round(a-b-1.96*se,6) AS lo, round(a-b+1.96*se,6) AS hi, a-b-1.96*se>0 AS supported, a-b+1.96*se<0 AS opposite, a-b-1.96*se<=0 AND a-b+1.96*se>=0 AS contains_zero, round(2.80*se,6) AS mde FROM g""")
def ss16(t):
    lv = F.log("m_price")
    side = lambda f, c: f(F.when(F.col("cond") == c, lv))
    g = features(t).groupBy("subject").agg((side(F.avg, "A") - side(F.avg, "R")).alias("diff"),
                                           F.sqrt(side(F.var_samp, "A") / side(F.count, "A") + side(F.var_samp, "R") / side(F.count, "R")).alias("se"))
    lo, hi = F.col("diff") - 1.96 * F.col("se"), F.col("diff") + 1.96 * F.col("se")
    return g.select("subject", R6(F.col("diff")).alias("diff"), R6(F.col("se")).alias("se"), R6(lo).alias("lo"), R6(hi).alias("hi"),
                    (lo > 0).alias("supported"), (hi < 0).alias("opposite"), ((lo <= 0) & (hi >= 0)).alias("contains_zero"), R6(2.80 * F.col("se")).alias("mde"))


@query("ss18_error_ratio", f"WITH {DSG} SELECT n, round(sqrt(avg(mle_k*mle_k)),6) AS rmse, round(avg(crb_k),6) AS se, round(sqrt(avg(mle_k*mle_k))/avg(crb_k),6) AS ratio, sqrt(avg(mle_k*mle_k))/avg(crb_k) BETWEEN 0.5 AND 2.0 AS inside FROM tj GROUP BY 1")
def ss18(t):
    rm, se = F.sqrt(F.avg(F.col("mle_k") ** 2)), F.avg("crb_k")
    return matched_designs(t).groupBy("n").agg(R6(rm).alias("rmse"), R6(se).alias("se"), R6(rm / se).alias("ratio"), (rm / se).between(0.5, 2.0).alias("inside"))


@query("ss19_error_bound_match", f"""WITH {DSG}, u AS (SELECT n,session_min,probe_every,r_obs,mle_k/crb_k AS r FROM tj UNION ALL SELECT n,session_min,probe_every,r_obs,mle_a/crb_a FROM tj),
c AS (SELECT avg((r BETWEEN 0.5 AND 2.0)::INT)>=0.5 AS ok FROM u GROUP BY n,session_min,probe_every,r_obs)
SELECT (SELECT count(*) FROM c) AS n_cells, round((SELECT avg(ok::INT) FROM c),6) AS fraction, round(quantile_cont(r,0.5),6) AS ratio_median, round(quantile_cont(r,0.1),6) AS q10, round(quantile_cont(r,0.9),6) AS q90, (SELECT avg(ok::INT) FROM c)>=0.8 AS passed FROM u""")
def ss19(t):
    cell = ["n", "session_min", "probe_every", "r_obs"]
    u = matched_designs(t).select(*cell, F.inline(F.array(*[F.struct(F.lit(p).alias("param"), (F.col(f"mle_{p}") / F.col(f"crb_{p}")).alias("r")) for p in ("k", "a")])))
    c = u.groupBy(*cell).agg((F.avg(F.col("r").between(0.5, 2.0).cast("int")) >= 0.5).alias("ok"))
    f = c.agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("ok").cast("int")).alias("fraction"), F.lit(0).alias("_j"))
    q = quantiles(u, [], "r", {"ratio_median": 0.5, "q10": 0.1, "q90": 0.9}).withColumn("_j", F.lit(0))
    return f.join(q, "_j").select("n_cells", *[R6(F.col(x)).alias(x) for x in ("fraction", "ratio_median", "q10", "q90")], (F.col("fraction") >= 0.8).alias("passed"))


SOB = """se AS (SELECT l_linenumber AS param, l_orderkey AS row, ln(avg(l_extendedprice)) AS y_a, ln(avg(l_extendedprice*(1+l_tax))) AS y_b, ln(avg(l_extendedprice*(1-l_discount))) AS y_ab FROM lineitem GROUP BY 1,2)"""


def outputs(t):
    p = F.col("l_extendedprice")
    return t.lineitem.groupBy(F.col("l_linenumber").alias("param"), F.col("l_orderkey").alias("row")).agg(
        F.avg(p).alias("y_a"), F.avg(p * (1 + F.col("l_tax"))).alias("y_b"), F.avg(p * (1 - F.col("l_discount"))).alias("y_ab"))


def evaluations(t):
    return outputs(t).select("param", "row", *[F.log(c).alias(c) for c in ("y_a", "y_b", "y_ab")], F.lit("y").alias("output"))


@query("ss20_sobol_indices", f"""WITH {SOB}, v AS (SELECT param, var_pop(y) AS v FROM (SELECT param,y_a AS y FROM se UNION ALL SELECT param,y_b FROM se) GROUP BY 1)
SELECT param, count(*) AS n_rows, round(max(v),6) AS var_y, round(avg(y_b*(y_ab-y_a))/max(v),6) AS s1, round(avg((y_a-y_ab)^2)/(2*max(v)),6) AS st FROM se JOIN v USING (param) GROUP BY 1""")
def ss20(t):
    return st.sobol(evaluations(t), ["y"]).select("param", "n_rows", *[R6(F.col(c)).alias(c) for c in ("var_y", "s1", "st")])


def sql_sobol_bootstrap(n):
    """Draws are cut from one digest per unit and block of eight replicates."""
    weight = sql_poisson("substr(h,4*j+1,4)")
    return f"""WITH {SOB.replace('ln(', '(')}, y AS (SELECT param, row, CASE WHEN y_a>0 THEN ln(y_a) END AS y_a, CASE WHEN y_b>0 THEN ln(y_b) END AS y_b, CASE WHEN y_ab>0 THEN ln(y_ab) END AS y_ab FROM se),
m AS (SELECT param, avg(v) AS m FROM (SELECT param,y_a AS v FROM y UNION ALL SELECT param,y_b FROM y) GROUP BY 1),
c AS (SELECT param, row, y_a-m AS a, y_b-m AS b, y_b*(y_ab-y_a) AS f, (y_a-y_ab)^2 AS t FROM y JOIN m USING (param)), h AS (SELECT *, md5(concat_ws('|','ss20',k,row)) AS h FROM c, range(0,{(n + 7) // 8}) q(k)),
d AS (SELECT param, k*8+j+1 AS rep, {weight} AS w, a, b, f, t FROM h, range(0,8) z(j)),
g AS (SELECT param, rep, sum(w*f) FILTER (WHERE f IS NOT NULL)/sum(w) FILTER (WHERE f IS NOT NULL) AS f, sum(w*t)/sum(w) FILTER (WHERE t IS NOT NULL) AS t, sum(w*((a IS NOT NULL)::INT+(b IS NOT NULL)::INT)) AS n, sum(w*(coalesce(a,0)+coalesce(b,0))) AS s, sum(w*(coalesce(a*a,0)+coalesce(b*b,0))) AS q FROM d WHERE rep<={n} AND w>0 GROUP BY 1,2),
i AS (SELECT param, f/(q/n-(s/n)^2) AS s1, t/(2*(q/n-(s/n)^2)) AS st FROM g)
SELECT param, round(quantile_cont(s1,0.025),4) AS s1_lo, round(quantile_cont(s1,0.975),4) AS s1_hi, round(quantile_cont(st,0.025),4) AS st_lo, round(quantile_cont(st,0.975),4) AS st_hi FROM i GROUP BY 1"""


@query("ss20_sobol_bootstrap", sql_sobol_bootstrap(N_SOBOL))
def ss20b(t):
    b = st.sobol_bootstrap(outputs(t), ["param"], "row", N_SOBOL, "ss20", scale="log")
    return b.select("param", *[R4(F.col(c)).alias(c) for c in ("s1_lo", "s1_hi", "st_lo", "st_hi")])


@query("ss21_sample_design", f"""WITH b AS (SELECT o_orderkey AS row, {sql_uniform("'A'", "'1'", 'o_orderkey')} AS a1, {sql_uniform("'A'", "'2'", 'o_orderkey')} AS a2, {sql_uniform("'B'", "'1'", 'o_orderkey')} AS b1, {sql_uniform("'B'", "'2'", 'o_orderkey')} AS b2 FROM orders)
SELECT row, block, round(ln(0.25)+(ln(4.0)-ln(0.25))*(CASE WHEN block IN ('B','AB_1') THEN b1 ELSE a1 END),6) AS f_1, round(ln(0.25)+(ln(4.0)-ln(0.25))*(CASE WHEN block IN ('B','AB_2') THEN b2 ELSE a2 END),6) AS f_2 FROM b, (VALUES ('A'),('B'),('AB_1'),('AB_2')) k(block)""")
def ss21(t):
    import math

    lo, hi = math.log(0.25), math.log(4.0)
    u = {f"{s.lower()}{k}": uniform(F.lit(s), F.lit(str(k)), F.col("o_orderkey")) for s in "AB" for k in (1, 2)}
    b = t.orders.select(F.col("o_orderkey").alias("row"), *[v.alias(k) for k, v in u.items()]).withColumn("block", F.explode(F.array(*[F.lit(x) for x in ("A", "B", "AB_1", "AB_2")])))
    f = lambda k: R6(lo + (hi - lo) * F.when(F.col("block").isin("B", f"AB_{k}"), F.col(f"b{k}")).otherwise(F.col(f"a{k}")))
    return b.select("row", "block", f(1).alias("f_1"), f(2).alias("f_2"))


NCDF = "(0.5+(SELECT sum((CASE WHEN k=0 OR k=200 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END)*exp(-0.5*pow(z*k/200.0,2))) FROM range(0,201) kk(k))*z/600.0/sqrt(2*pi()))"


@query("ss22_normal_fit", f"""WITH x AS (SELECT c_nationkey AS g, c_acctbal AS v FROM customer), s AS (SELECT g, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM x GROUP BY 1),
r AS (SELECT x.g, (v-m)/sd AS z, row_number() OVER (PARTITION BY x.g ORDER BY v) AS k, n FROM x JOIN s USING (g)), c AS (SELECT g,k,n,{NCDF} AS f FROM r)
SELECT g, max(n) AS n, round(max(greatest(k/n::DOUBLE-f, f-(k-1)/n::DOUBLE)),6) AS ks, round((max(m)-(SELECT avg(v) FROM x))/((SELECT stddev_pop(v) FROM x)/sqrt(max(n))),6) AS mean_z FROM c JOIN s USING (g,n) GROUP BY 1""")
def ss22(t):
    """Distance from the normal distribution of the group's own moments, and z of its mean against that of all values."""
    x = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    s = x.groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    c = x.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    every = x.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))
    r = running(c, ["g"], ["v"], sums={"k": F.col("c")}).join(s.join(F.broadcast(every)), "g").withColumn("f", norm_cdf((F.col("v") - F.col("m")) / F.col("sd")))
    return r.groupBy("g").agg(F.max("n").alias("n"), R6(F.max(F.greatest(F.col("k") / F.col("n") - F.col("f"), F.col("f") - (F.col("k") - F.col("c")) / F.col("n")))).alias("ks"),
                              R6((F.max("m") - F.max("mu")) / (F.max("sigma") / F.sqrt(F.max("n")))).alias("mean_z"))


RK = "(rank() OVER (PARTITION BY g ORDER BY {c})+(count(*) OVER (PARTITION BY g,{c})-1)/2.0)"


@query("ss23_spearman", f"WITH x AS (SELECT l_suppkey AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT g, {RK.format(c='a')} AS ra, {RK.format(c='b')} AS rb FROM x) SELECT g, count(*) AS n, round(corr(ra,rb),6) AS rho FROM r GROUP BY 1")
def ss23(t):
    from ..operators.whiteness import average_ranks

    x = t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    r = average_ranks(average_ranks(x, ["g"], "a", "ra"), ["g"], "b", "rb")
    return r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), R6(F.corr("ra", "rb")).alias("rho"))


@query("ss24_efficiency_loss", "WITH c AS (SELECT l_suppkey AS n, l_linenumber AS m, (l_extendedprice*(1+l_tax)-l_extendedprice*(1-l_discount))/(l_extendedprice*(1-l_discount))*100 AS loss FROM lineitem) SELECT n, m, round(quantile_cont(loss,0.5),6) AS loss_median, round(quantile_cont(loss,0.9),6) AS loss_q90 FROM c GROUP BY 1,2")
def ss24(t):
    p = F.col("l_extendedprice")
    true, est = p * (1 - F.col("l_discount")), p * (1 + F.col("l_tax"))
    c = t.lineitem.select(F.col("l_suppkey").alias("n"), F.col("l_linenumber").alias("m"), ((est - true) / true * 100).alias("loss"))
    q = quantiles(c, ["n", "m"], "loss", {"loss_median": 0.5, "loss_q90": 0.9})
    return q.select("n", "m", R6(F.col("loss_median")).alias("loss_median"), R6(F.col("loss_q90")).alias("loss_q90"))


def regression_sums(t):
    """Products of (1, y_a, y_p, rating) per session at the as-of epochs."""
    o = with_previous(t).where("y_a is not null and y_p is not null and pa is not null")
    x = {"s0": F.lit(1.0), "sa": F.col("pa"), "sp": F.col("y_p"), "sr": F.col("y_a")}
    a, p, r = F.col("pa"), F.col("y_p"), F.col("y_a")
    return o.groupBy("ses").agg(*[F.sum(v).alias(k) for k, v in {**x, "saa": a * a, "sap": a * p, "spp": p * p, "sar": a * r, "spr": p * r, "srr": r * r}.items()])


def solve3(s):
    """Closed-form normal equations of rating ~ 1 + a + p from the sums."""
    c = F.col
    vaa, vpp, vap = c("saa") - c("sa") ** 2 / c("s0"), c("spp") - c("sp") ** 2 / c("s0"), c("sap") - c("sa") * c("sp") / c("s0")
    var_, vpr, vrr = c("sar") - c("sa") * c("sr") / c("s0"), c("spr") - c("sp") * c("sr") / c("s0"), c("srr") - c("sr") ** 2 / c("s0")
    d = s.withColumns({"vaa": vaa, "vpp": vpp, "vap": vap, "var_": var_, "vpr": vpr, "vrr": vrr})
    det = c("vaa") * c("vpp") - c("vap") ** 2
    d = d.withColumns({"b_a": (c("var_") * c("vpp") - c("vpr") * c("vap")) / det, "b_p": (c("vpr") * c("vaa") - c("var_") * c("vap")) / det})
    return d.withColumns({"b_0": (c("sr") - c("b_a") * c("sa") - c("b_p") * c("sp")) / c("s0"),
                          "resid_var": (c("vrr") - c("b_a") * c("var_") - c("b_p") * c("vpr")) / c("s0")})


@query("ss25_instant_regression_folds", f"""WITH {EV}, {LAGGED}, o AS (SELECT ses, pa AS a, y_p AS p, y_a AS r FROM lg WHERE y_a IS NOT NULL AND y_p IS NOT NULL AND pa IS NOT NULL), f AS (SELECT DISTINCT ses AS fold FROM o),
s AS (SELECT fold, count(*)::DOUBLE AS n, covar_pop(a,a) AS aa, covar_pop(p,p) AS pp, covar_pop(a,p) AS ap, covar_pop(a,r) AS ar, covar_pop(p,r) AS pr, covar_pop(r,r) AS rr, avg(a) AS ma, avg(p) AS mp, avg(r) AS mr FROM o JOIN f ON o.ses<>f.fold GROUP BY 1),
b AS (SELECT *, (ar*pp-pr*ap)/(aa*pp-ap*ap) AS ba, (pr*aa-ar*ap)/(aa*pp-ap*ap) AS bp FROM s)
SELECT fold, round(mr-ba*ma-bp*mp,6) AS b_0, round(ba,6) AS b_a, round(bp,6) AS b_p, round(rr-ba*ar-bp*pr,6) AS resid_var FROM b""")
def ss25(t):
    own = regression_sums(t)
    cols = [c for c in own.columns if c != "ses"]
    tot = own.agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    folds = own.join(F.broadcast(tot)).select(F.col("ses").alias("fold"), *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in cols])
    return solve3(folds).select("fold", *[R6(F.col(c)).alias(c) for c in ("b_0", "b_a", "b_p", "resid_var")])


@query("ss15_session_bootstrap", f"""WITH {EV}, {LAGGED}, l AS (SELECT ses, abs(y_a-pa)-abs(y_a-4.0) AS d FROM lg WHERE y_a IS NOT NULL AND pa IS NOT NULL),
s AS (SELECT ses, avg(d) AS m FROM l GROUP BY 1), z AS (SELECT rep, x/w AS m FROM {sql_resampled('s', 'ses', {'x': 'm'}, N_SESSIONS, 'ss15')})
SELECT (SELECT round(avg(m),6) FROM s) AS mean_diff, round(quantile_cont(m,0.025),4) AS lo, round(quantile_cont(m,0.975),4) AS hi, quantile_cont(m,0.025)>0 AS wins FROM z""")
def ss15(t):
    l = with_previous(t).where("y_a is not null and pa is not null").select("ses", (F.abs(F.col("y_a") - F.col("pa")) - F.abs(F.col("y_a") - 4.0)).alias("d"))
    s = l.groupBy("ses").agg(F.avg("d").alias("m"))
    b = bootstrap_mean(s, [], "ses", "m", N_SESSIONS, "ss15").withColumn("_j", F.lit(0))
    return s.agg(F.avg("m").alias("mean_diff"), F.lit(0).alias("_j")).join(b, "_j").select(R6(F.col("mean_diff")).alias("mean_diff"), R4(F.col("lo")).alias("lo"), R4(F.col("hi")).alias("hi"), (F.col("lo") > 0).alias("wins"))


N_FLIPS = 5_000
# Critical t of 5 % at n-1 degrees of freedom, by bisection on Simpson sums of the density.
SQL_T = """thr AS (SELECT test, hi AS thr FROM bis WHERE k=60)"""
SQL_BIS = """bis(test,v,k,lo,hi) AS (SELECT test, (n-1)::DOUBLE, 0, 0.0::DOUBLE, 60.0::DOUBLE FROM nt UNION ALL
 SELECT test, v, k+1, CASE WHEN p<0.475 THEN m ELSE lo END, CASE WHEN p<0.475 THEN hi ELSE m END FROM (SELECT *, (lo+hi)/2 AS m,
  exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(v*pi())*(lo+hi)/2/400/3*list_sum(list_transform(range(0,401), lambda i: (CASE WHEN i=0 OR i=400 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*pow(1+pow((lo+hi)/2*i/400,2)/v,-(v+1)/2))) AS p
  FROM bis WHERE k<60))"""


@query("ss4_cluster_permutation", f"""WITH RECURSIVE {MC}, df AS (SELECT cond%2 AS test, unit AS subject, ch, sum(x)/8 AS diff FROM mc GROUP BY 1,2,3), nt AS (SELECT test, count(DISTINCT subject) AS n FROM df GROUP BY 1), {SQL_BIS}, {SQL_T},
fl AS (SELECT test, rep, ch, sum(diff*{sql_sign('subject', 'ss4')}) AS s, count(*) AS n, sum(diff*diff) AS q FROM df, range(1,{N_FLIPS + 1}) r(rep) GROUP BY 1,2,3 UNION ALL SELECT test, 0, ch, sum(diff), count(*), sum(diff*diff) FROM df GROUP BY 1,3),
tv AS (SELECT test, rep, ch, (s/n)/sqrt((q-s*s/n)/(n-1)/n) AS t FROM fl), lv AS (SELECT tv.*, sign(t)::INT AS sgn FROM tv JOIN thr USING (test) WHERE abs(t)>thr.thr),
e AS (SELECT a.test, a.rep, a.sgn, a.ch AS i, b.ch AS j FROM lv a JOIN lv b ON a.test=b.test AND a.rep=b.rep AND a.sgn=b.sgn AND (a.ch-b.ch+8)%8 IN (1,7)),
rc(test,rep,sgn,ch,root) AS (SELECT test,rep,sgn,ch,ch FROM lv UNION SELECT e.test,e.rep,e.sgn,e.j,rc.root FROM rc JOIN e ON e.test=rc.test AND e.rep=rc.rep AND e.sgn=rc.sgn AND e.i=rc.ch WHERE rc.root<e.j),
lb AS (SELECT test,rep,sgn,ch,min(root) AS root FROM rc GROUP BY 1,2,3,4), ms AS (SELECT test,rep,sgn,root,sum(t) AS mass,count(*) AS n_channels FROM lb JOIN lv USING (test,rep,sgn,ch) GROUP BY 1,2,3,4),
tp AS (SELECT test,rep,max(abs(mass)) AS mx FROM ms WHERE rep>0 GROUP BY 1,2)
SELECT test, root::INT AS root, n_channels::INT AS n_channels, round(mass,6) AS mass, round((1+(SELECT count(*) FROM tp WHERE tp.test=ms.test AND mx>=abs(mass)))/{N_FLIPS + 1}.0::DOUBLE,6) AS p FROM ms WHERE rep=0""")
def ss4(t):
    """Sign-flip cluster test over a ring of eight channels, one test per condition."""
    from ..operators.clusters import cluster_permutation

    d = t.multichannel().select((F.col("cond") % 2).alias("test"), F.col("unit").alias("subject"), "ch", (F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / 8).alias("diff"))
    edges = [(c, (c + 1) % 8) for c in range(8)]
    return cluster_permutation(d, edges, N_FLIPS, "ss4").select("test", "root", "n_channels", R6(F.col("mass")).alias("mass"), R6(F.col("p")).alias("p"))
