"""Per-epoch complexity, spectral, synchrony and network features on `embeddings`."""

import math

from pyspark.sql import functions as F

from ..functions.draws import sql_uniform
from ..functions.exprs import bit_entropy, let
from ..functions.fourier import analytic, envelope, welch
from ..operators import complexity as cx, network as nw, spectral as sp
from ..operators.clusters import components
from ..session import cut_lineage
from ..sources.tables import MC
from .registry import ORACLES, query

R6 = lambda c: F.round(c, 6)
NCH, NT = 8, 8
FS = 64.0

# ---------------------------------------------------------------- oracle text
S64 = """s64 AS (SELECT vec_id AS unit, label AS cond, k-1 AS i, embedding[k]::DOUBLE AS x FROM embeddings, range(1,65) r(k)),
bs AS (SELECT unit, cond, string_agg(CASE WHEN x>m THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM (SELECT *, avg(x) OVER (PARTITION BY unit) AS m FROM s64) GROUP BY 1,2)"""


def lz_sql(src, key="unit", col="s", out="lz"):
    """Recursive phrase scan of every string of a relation."""
    return f"""{out}r({key},s,i,p,c) AS (SELECT {key},{col},0,1,0 FROM {src} UNION ALL SELECT {key},s,i+1,
 CASE WHEN strpos(substr(s,1,i),substr(s,p,i+1-p+1))>0 THEN p ELSE i+2 END, CASE WHEN strpos(substr(s,1,i),substr(s,p,i+1-p+1))>0 THEN c ELSE c+1 END FROM {out}r WHERE i<length(s)),
{out} AS (SELECT {key}, s, (c+CASE WHEN p<=length(s) THEN 1 ELSE 0 END)::BIGINT AS c FROM {out}r WHERE i=length(s))"""


def norm_sql(c="c", s="s"):
    p = f"(length(replace({s},'0',''))/length({s})::DOUBLE)"
    return f"(CASE WHEN length({s})<2 OR {p}<=0 OR {p}>=1 THEN 0.0 ELSE {c}*log2(length({s}))/(length({s})*(-{p}*log2({p})-(1-{p})*log2(1-{p}))) END)"


AN = MC + """, mx AS (SELECT *, x-avg(x) OVER (PARTITION BY unit,ch) AS y FROM (SELECT unit,cond,ch,i,x FROM mc)),
ft AS (SELECT unit,ch,k,sum(y*cos(2*pi()*k*i/8.0)) AS re, -sum(y*sin(2*pi()*k*i/8.0)) AS im FROM mx, range(0,5) f(k) GROUP BY 1,2,3),
an AS (SELECT unit,ch,i,sum(h*(re*cos(2*pi()*k*i/8.0)-im*sin(2*pi()*k*i/8.0)))/8.0 AS re, sum(h*(re*sin(2*pi()*k*i/8.0)+im*cos(2*pi()*k*i/8.0)))/8.0 AS im
 FROM (SELECT *, CASE WHEN k IN (0,4) THEN 1.0 ELSE 2.0 END AS h FROM ft) ft, range(0,8) t(i) {where} GROUP BY 1,2,3)"""
ALL_BAND = AN.replace("FROM mc)),", "FROM mc)),").replace("{where}", "")
MID_BAND = AN.replace("{where}", "WHERE k BETWEEN 1 AND 3")
ENV = ALL_BAND.replace("SELECT unit,cond,ch,i,x FROM mc", "SELECT unit,cond,ch,i,x FROM mc") + """,
ev0 AS (SELECT unit,ch,i,sqrt(re*re+im*im) AS e FROM an), bit AS (SELECT unit,ch,i,CASE WHEN e>avg(e) OVER (PARTITION BY unit,ch) THEN 1 ELSE 0 END AS b FROM ev0)"""


# ---------------------------------------------------------------- frames
def packed_mc(t):
    """One row per unit with its 8 channels x 8 samples, channel-major."""
    return t.packed()


def bits64(t):
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return t.packed().select("unit", "cond", let(mean(F.col("x")), lambda m: F.transform("x", lambda v: (v > m).cast("int"))).alias("bits"))


def strings64(t):
    return bits64(t).select("unit", "cond", cx.bit_string(F.col("bits")).alias("s"))


@query("pf17_bit_strings", f"WITH {MC}, m AS (SELECT unit, ch, i, CASE WHEN x>avg(x) OVER (PARTITION BY unit) THEN 1 ELSE 0 END AS b FROM mc) SELECT unit, string_agg(b::VARCHAR,'' ORDER BY ch,i) AS channel_major, string_agg(b::VARCHAR,'' ORDER BY i,ch) AS interleaved FROM m GROUP BY 1")
def pf17(t):
    b = bits64(t)
    m = cx.channels(F.col("bits"), NCH)
    return b.select("unit", cx.bit_string(F.flatten(m)).alias("channel_major"), cx.bit_string(cx.interleave(m)).alias("interleaved"))


@query("pf18_source_entropy", f"WITH {S64}, p AS (SELECT unit, length(replace(s,'0',''))/64.0::DOUBLE AS p FROM bs) SELECT unit, round(CASE WHEN p<=0 OR p>=1 THEN 0.0 ELSE -p*log2(p)-(1-p)*log2(1-p) END,6) AS h FROM p")
def pf18(t):
    return strings64(t).select("unit", R6(bit_entropy(cx.share_of_ones(F.col("s")))).alias("h"))


@query("fe1_phrase_count", f"WITH RECURSIVE {S64}, {lz_sql('bs')} SELECT unit, c AS phrases FROM lz")
def fe1(t):
    return strings64(t).select("unit", cx.phrase_count(F.col("s")).alias("phrases"))


@query("fe1_phrase_count_text", "WITH RECURSIVE d AS (SELECT item_id AS unit, text AS s FROM benchmark), " + lz_sql("d") + " SELECT unit, c AS phrases FROM lz")
def fe1t(t):
    """Long symbol strings (whole texts) by the linear-time counter."""
    return t.benchmark.select(F.col("item_id").alias("unit"), cx.phrase_count_long(F.col("text")).cast("long").alias("phrases"))


@query("fe1_phrase_count_documents")
def fe1d(t):
    """Whole documents; a recursive SQL twin would be quadratic in their length."""
    return t.documents.select("doc_id", cx.phrase_count_long(F.col("text")).cast("long").alias("phrases"))


@query("fe3_normalised_complexity", f"WITH RECURSIVE {S64}, sh AS (SELECT unit, string_agg(substr(s,k,1),'' ORDER BY md5(concat_ws('|','fe3',unit,k)), substr(s,k,1)) AS s FROM bs, range(1,65) r(k) GROUP BY 1), {lz_sql('bs')}, {lz_sql('sh', out='ls')} SELECT lz.unit, round({norm_sql('lz.c', 'lz.s')},6) AS entropy_norm, round(lz.c/ls.c::DOUBLE,6) AS shuffle_norm FROM lz JOIN ls USING (unit)")
def fe3(t):
    s = F.col("s")
    sh = cx.shuffled(s, F.lit("fe3"), F.col("unit").cast("string"))
    d = strings64(t).withColumn("sh", sh)
    return d.select("unit", R6(cx.normalised(s)).alias("entropy_norm"), R6(cx.phrase_count(s) / cx.phrase_count(F.col("sh"))).alias("shuffle_norm"))


@query("fe4_perturbational_index", f"WITH RECURSIVE {S64}, {lz_sql('bs')} SELECT unit, round({norm_sql()},6) AS pci, round(c*pow(log2(64),2)/64,6) AS literal FROM lz")
def fe4(t):
    s = F.col("s")
    return strings64(t).select("unit", R6(cx.normalised(s)).alias("pci"), R6(cx.literal_index(s)).alias("literal"))


@query("fe5_envelope_bits", f"WITH {ENV} SELECT unit, ch, string_agg(b::VARCHAR,'' ORDER BY i) AS bits FROM bit GROUP BY 1,2")
def fe5(t):
    d = cx.with_bits(packed_mc(t), NCH)
    return d.select("unit", F.posexplode(F.transform("bits", cx.bit_string)).alias("ch", "bits")).withColumn("ch", F.col("ch").cast("long"))


LZC = f"""{ENV}, il AS (SELECT unit, string_agg(b::VARCHAR,'' ORDER BY i,ch) AS s FROM bit GROUP BY 1), pc AS (SELECT unit*8+ch AS uc, string_agg(b::VARCHAR,'' ORDER BY i) AS s FROM bit GROUP BY 1), {lz_sql('il', out='li')}, {lz_sql('pc', 'uc', out='lp')}"""


@query("fe6_multichannel_complexity", f"WITH RECURSIVE {LZC} SELECT li.unit, round({norm_sql('li.c', 'li.s')},6) AS lzc, round((SELECT avg({norm_sql('lp.c', 'lp.s')}) FROM lp WHERE lp.uc//8=li.unit),6) AS lzs FROM li")
def fe6(t):
    d = cx.multichannel_complexity(packed_mc(t), NCH)
    return d.select("unit", R6(F.col("lzc")).alias("lzc"), R6(F.col("lzs")).alias("lzs"))


N_SURR = 20          # surrogates per unit
SUR = MC + f""", ft AS (SELECT unit,ch,k,sum(x*cos(2*pi()*k*i/8.0)) AS re, -sum(x*sin(2*pi()*k*i/8.0)) AS im FROM mc, range(0,5) f(k) GROUP BY 1,2,3),
ph AS (SELECT *, CASE WHEN k IN (0,4) THEN 0.0 ELSE 2*pi()*{sql_uniform("'fe7'", 'unit', 'sr', 'k')} END AS p FROM ft, range(1,{N_SURR + 1}) q(sr)),
su AS (SELECT unit,sr,ch,i,sum((CASE WHEN k IN (0,4) THEN 1.0 ELSE 2.0 END)*(re*cos(p+2*pi()*k*i/8.0)-im*sin(p+2*pi()*k*i/8.0)))/8.0 AS x FROM ph, range(0,8) t(i) GROUP BY 1,2,3,4)"""


@query("fe7_surrogates", f"WITH {SUR} SELECT unit, sr AS surr, ch, round(sum(x*(i+1)),6) AS weighted, round(sum(x*x),6) AS energy FROM su GROUP BY 1,2,3")
def fe7(t):
    s = cx.surrogates(packed_mc(t), "unit", NCH, NT, N_SURR, "fe7")
    add = lambda a, v: a + v
    d = s.select("unit", F.col("surr").cast("long").alias("surr"), F.posexplode(cx.channels(F.col("x"), NCH)).alias("ch", "c"))
    return d.select("unit", "surr", F.col("ch").cast("long").alias("ch"), R6(F.aggregate(F.transform("c", lambda v, k: v * (k + 1)), F.lit(0.0), add)).alias("weighted"),
                    R6(F.aggregate(F.transform("c", lambda v: v * v), F.lit(0.0), add)).alias("energy"))


# Complexity of every unit and of each of its surrogates, which are numbered from 1 (0: the unit itself).
SLZ = f"""{SUR}, every AS (SELECT unit*100 AS unit, cond, ch, i, x FROM mc UNION ALL SELECT unit*100+sr, 0, ch, i, x FROM su),
slz AS (WITH RECURSIVE mc AS (SELECT * FROM every){ENV[len(MC):]}, il AS (SELECT unit, string_agg(b::VARCHAR,'' ORDER BY i,ch) AS s FROM bit GROUP BY 1), {lz_sql('il', out='li')}
 SELECT unit//100 AS unit, unit%100 AS sr, {norm_sql('c', 's')} AS v FROM li),
ctl AS (SELECT unit, max(v) FILTER (WHERE sr=0) AS raw, avg(v) FILTER (WHERE sr>0) AS m, stddev_samp(v) FILTER (WHERE sr>0) AS sd FROM slz GROUP BY 1)"""


def spectrum_controlled(t):
    """(unit, raw, surr_mean, surr_sd, z, diff) of the multichannel complexity against surrogates of equal spectrum."""
    def value(d):
        q = d.select("unit", cx.interleaved_phrases(envelope(F.col("x"), NCH), NCH).alias("q"))
        return q.select("unit", cx.normalised(F.col("q.s"), F.col("q.phrases")).alias("v"))
    return cx.controlled(value(packed_mc(t)), value(cx.surrogates(packed_mc(t), "unit", NCH, NT, N_SURR, "fe7")), "unit", "v")


@query("fe8_spectrum_controlled", f"""WITH RECURSIVE {SLZ}
SELECT unit, round(raw,6) AS raw, round(m,6) AS surr_mean, round(sd,6) AS surr_sd, CASE WHEN sd>1e-9 THEN round((raw-m)/sd,4) END AS z, round(raw-m,6) AS diff FROM ctl""")
def fe8(t):
    d = spectrum_controlled(t).withColumn("z", F.when(F.col("surr_sd") > 1e-9, F.col("z")))
    return d.select("unit", *[F.round(c, 4 if c == "z" else 6).alias(c) for c in ("raw", "surr_mean", "surr_sd", "z", "diff")])


PSD = """s64 AS (SELECT vec_id AS unit, label AS cond, k-1 AS i, embedding[k]::DOUBLE AS x FROM embeddings, range(1,65) r(k)),
sg AS (SELECT unit,cond,g,i-16*g AS j,x-avg(x) OVER (PARTITION BY unit,g) AS y FROM s64, range(0,3) q(g) WHERE i>=16*g AND i<16*g+32),
wd AS (SELECT unit,cond,g,j,y*0.5*(1-cos(2*pi()*j/32.0)) AS y FROM sg), wn AS (SELECT sum(pow(0.5*(1-cos(2*pi()*j/32.0)),2)) AS w2 FROM range(0,32) q(j)),
fq AS (SELECT unit,cond,g,k,pow(sum(y*cos(2*pi()*k*j/32.0)),2)+pow(sum(y*sin(2*pi()*k*j/32.0)),2) AS p FROM wd, range(0,17) f(k) GROUP BY 1,2,3,4),
psd AS (SELECT unit,cond,k,k*2.0::DOUBLE AS f,avg(p/(64.0*w2)*(CASE WHEN k IN (0,16) THEN 1 ELSE 2 END)) AS p FROM fq, wn GROUP BY 1,2,3)"""
DF = 2.0


def psd(t):
    return t.packed().withColumn("psd", welch(F.col("x"), FS, 32, 16))


@query("fe9_power_density", f"WITH {PSD} SELECT unit,k,round(p,9) AS power FROM psd")
def fe9(t):
    return psd(t).select("unit", F.posexplode("psd").alias("k", "power")).select("unit", F.col("k").cast("long").alias("k"), F.round("power", 9).alias("power"))


def robust_sql():
    """Five unrolled refit rounds with a frozen flag per unit."""
    out = """l0 AS (SELECT unit,log10(f) AS x,log10(p) AS y,true AS m FROM psd WHERE f>=1 AND f<=40),
c0 AS (SELECT unit,regr_slope(y,x) AS b,regr_intercept(y,x) AS a,false AS done FROM l0 GROUP BY 1)"""
    for r in range(1, 6):
        q = r - 1
        out += f""",
n{r} AS (SELECT l.unit,x,y,m,a,b,done,CASE WHEN sd>0 THEN y-(a+b*x)<sd ELSE m END AS nm FROM l{q} l JOIN c{q} USING (unit) JOIN (SELECT l.unit, stddev_pop(y-(a+b*x)) FILTER (WHERE m) AS sd FROM l{q} l JOIN c{q} USING (unit) GROUP BY 1) USING (unit)),
d{r} AS (SELECT unit, bool_or(done) OR count(*) FILTER (WHERE nm)<3 OR bool_and(nm=m) AS done, any_value(a) AS a, any_value(b) AS b FROM n{r} GROUP BY 1),
l{r} AS (SELECT n.unit,x,y,CASE WHEN d.done THEN m ELSE nm END AS m FROM n{r} n JOIN d{r} d USING (unit)),
c{r} AS (SELECT l.unit, CASE WHEN any_value(d.done) THEN any_value(d.b) ELSE regr_slope(y,x) FILTER (WHERE m) END AS b, CASE WHEN any_value(d.done) THEN any_value(d.a) ELSE regr_intercept(y,x) FILTER (WHERE m) END AS a, any_value(d.done) AS done FROM l{r} l JOIN d{r} d USING (unit) GROUP BY 1)"""
    return out


APER = f"{PSD}, {robust_sql()}"


@query("fe10_aperiodic_fit", f"WITH {APER} SELECT unit, round(-b,6) AS exponent, round(a,6) AS offset_ FROM c5")
def fe10(t):
    d = sp.aperiodic_fit(psd(t), F.col("psd"), DF)
    return d.select("unit", R6(F.col("exponent")).alias("exponent"), R6(F.col("offset")).alias("offset_"))


# The observation bands in Hz.
ALPHA, THETA = (8.0, 12.0), (4.0, 7.0)

BP = PSD + """, tr AS (SELECT unit,cond,f,lead(f) OVER w AS f2,(p+lead(p) OVER w)/2*2.0 AS a FROM psd WINDOW w AS (PARTITION BY unit ORDER BY k)),
bp AS (SELECT unit,cond,sum(a) FILTER (WHERE f>=1 AND f2<=40) AS tot,coalesce(sum(a) FILTER (WHERE f>=1 AND f2<4),0) AS delta,coalesce(sum(a) FILTER (WHERE f>=4 AND f2<8),0) AS theta,coalesce(sum(a) FILTER (WHERE f>=8 AND f2<13),0) AS alpha,coalesce(sum(a) FILTER (WHERE f>=13 AND f2<30),0) AS beta,
 coalesce(sum(a) FILTER (WHERE f>=8 AND f2<12),0) AS al, coalesce(sum(a) FILTER (WHERE f>=4 AND f2<7),0) AS th FROM tr GROUP BY 1,2)"""


@query("fe11_relative_band_power", f"WITH {BP} SELECT unit, round(delta/tot,6) AS delta, round(theta/tot,6) AS theta, round(alpha/tot,6) AS alpha, round(beta/tot,6) AS beta FROM bp")
def fe11(t):
    r = sp.relative_power(F.col("psd"), DF)
    return psd(t).select("unit", *[R6(r[b]).alias(b) for b in ("delta", "theta", "alpha", "beta")])


@query("fe12_log_band_power", f"WITH {BP} SELECT unit, round(ln(al+1e-30),6) AS alpha_post, round(ln(th+1e-30),6) AS theta_front FROM bp")
def fe12(t):
    return psd(t).select("unit", R6(sp.log_band(F.col("psd"), DF, *ALPHA)).alias("alpha_post"), R6(sp.log_band(F.col("psd"), DF, *THETA)).alias("theta_front"))


@query("fe13_periodic_alpha", f"WITH {APER}, {BP[len(PSD) + 2:]} SELECT unit, round(ln(al+1e-30)-ln(10)*(a+b*log10(10)),6) AS alpha_periodic FROM bp JOIN c5 USING (unit)")
def fe13(t):
    d = sp.aperiodic_fit(psd(t), F.col("psd"), DF)
    return d.select("unit", R6(sp.log_band(F.col("psd"), DF, *ALPHA) - math.log(10) * (F.col("offset") - F.col("exponent"))).alias("alpha_periodic"))


@query("fe14_negative_exponent", f"WITH {APER} SELECT cond, round(avg(b),6) AS exponent_neg FROM c5 JOIN (SELECT DISTINCT unit,cond FROM s64) USING (unit) GROUP BY 1")
def fe14(t):
    return sp.aperiodic_fit(psd(t), F.col("psd"), DF).groupBy("cond").agg(R6(-F.avg("exponent")).alias("exponent_neg"))


@query("fe15_band_analytic_signal", f"WITH {MID_BAND} SELECT unit, ch, round(sum(re*(i+1)),6) AS re_w, round(sum(im*(i+1)),6) AS im_w FROM an GROUP BY 1,2")
def fe15(t):
    d = packed_mc(t).withColumn("z", analytic(F.col("x"), NCH, 8.0, (1.0, 3.0)))
    w = lambda c: F.aggregate(F.transform(c, lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v)
    e = d.select("unit", F.posexplode(F.arrays_zip(cx.channels(F.col("z")["re"], NCH).alias("re"), cx.channels(F.col("z")["im"], NCH).alias("im"))).alias("ch", "q"))
    return e.select("unit", F.col("ch").cast("long").alias("ch"), R6(w(F.col("q")["re"])).alias("re_w"), R6(w(F.col("q")["im"])).alias("im_w"))


@query("fe16_kuramoto_order", f"WITH {MID_BAND}, r AS (SELECT unit,i,sqrt(pow(avg(re/sqrt(re*re+im*im)),2)+pow(avg(im/sqrt(re*re+im*im)),2)) AS r FROM an WHERE i BETWEEN 1 AND 6 GROUP BY 1,2) SELECT unit, round(avg(r),6) AS kuramoto_r, round(stddev_pop(r),6) AS metastability FROM r GROUP BY 1")
def fe16(t):
    d = sp.kuramoto(packed_mc(t), NCH, 8.0, (1.0, 3.0), trim=1)
    return d.select("unit", R6(F.col("kuramoto_r")).alias("kuramoto_r"), R6(F.col("metastability")).alias("metastability"))


WP = MID_BAND + """, cd AS (SELECT vec_id AS unit, label AS cond FROM embeddings), wp AS (SELECT cond,i0 AS i,j0 AS j,CASE WHEN sum(abs(v))>0 THEN abs(sum(v))/sum(abs(v)) ELSE 0 END AS w
 FROM (SELECT a.unit, a.ch AS i0, b.ch AS j0, a.im*b.re-a.re*b.im AS v FROM an a JOIN an b ON a.unit=b.unit AND a.i=b.i AND a.ch<b.ch) JOIN cd USING (unit) GROUP BY 1,2,3)"""


def wpli(t):
    return sp.phase_lag_edges(packed_mc(t), ["cond"], NCH, 8.0, (1.0, 3.0))


@query("fe17_phase_lag_index", f"WITH {WP} SELECT cond, i, j, round(w,6) AS w FROM wp")
def fe17(t):
    return wpli(t).select("cond", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R6(F.col("w")).alias("w"))


@query("fe18_mean_weight", f"WITH {WP} SELECT cond, round(avg(w),6) AS mean_weight FROM wp GROUP BY 1")
def fe18(t):
    return wpli(t).groupBy("cond").agg(R6(F.avg("w")).alias("mean_weight"))


TH = WP + """, th AS (SELECT cond,i,j,w FROM (SELECT *, max(CASE WHEN r=greatest(1,round_even(d*n,0)) THEN w END) OVER (PARTITION BY cond) AS cut FROM (SELECT *, 0.5 AS d, count(*) OVER (PARTITION BY cond) AS n, row_number() OVER (PARTITION BY cond ORDER BY w DESC) AS r FROM wp)) WHERE w>=cut)"""


def strong(t):
    return nw.strongest(wpli(t), "cond", 0.5)


@query("fe19_proportional_threshold", f"WITH {TH} SELECT cond, i, j, round(w,6) AS w FROM th")
def fe19(t):
    return strong(t).select("cond", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R6(F.col("w")).alias("w"))


# The same eigenvalue by repeated squaring in SQL; u, c and l as in the operator.
def sql_fiedler(name, c, u, lap):
    return f"""{name}0 AS (SELECT cond, ({c})::DOUBLE AS c, [[CASE WHEN i=j THEN ({c}) ELSE 0.0 END - ({lap}) - ({c})*({u('i')})*({u('j')}) FOR j IN range(1,{NCH + 1})] FOR i IN range(1,{NCH + 1})] AS b FROM lapl),
{name}(cond,c,b,p,k) AS (SELECT cond,c,b,b,0 FROM {name}0 UNION ALL SELECT cond,c,b,[[x/list_sum([q[i][i] FOR i IN range(1,{NCH + 1})]) FOR x IN r] FOR r IN q],k+1
 FROM (SELECT cond,c,b,k,[[list_dot_product(r1,r2) FOR r2 IN p] FOR r1 IN p] AS q FROM {name} WHERE k<40)),
{name}9 AS (SELECT cond, greatest(c-list_sum([list_dot_product(b[i],p[i]) FOR i IN range(1,{NCH + 1})])/list_sum([p[i][i] FOR i IN range(1,{NCH + 1})]),0.0) AS f FROM {name} WHERE k=40)"""


LAPL = f"""sym AS (SELECT cond,i,j,w FROM wp UNION ALL SELECT cond,j,i,w FROM wp),
cell AS (SELECT q.cond, n.r AS i, o.r AS j, coalesce(max(w),0.0)::DOUBLE AS w FROM (SELECT DISTINCT cond FROM wp) q CROSS JOIN range(0,{NCH}) n(r) CROSS JOIN range(0,{NCH}) o(r) LEFT JOIN sym ON sym.cond=q.cond AND sym.i=n.r AND sym.j=o.r GROUP BY 1,2,3),
mrow AS (SELECT cond,i,list(w ORDER BY j) AS r, sum(w) AS d FROM cell GROUP BY 1,2),
lapl AS (SELECT cond, list(r ORDER BY i) AS a, list(d ORDER BY i) AS d FROM mrow GROUP BY 1)"""
PLAIN = sql_fiedler("fp", "2.0*list_max(d)", lambda i: f"1.0/sqrt({NCH}.0)", "CASE WHEN i=j THEN d[i] ELSE -a[i][j] END")
NORMED = sql_fiedler("fn", "2.0", lambda i: f"sqrt(d[{i}]/list_sum(d))", "CASE WHEN i=j THEN CASE WHEN d[i]>0 THEN 1.0 ELSE 0.0 END WHEN d[i]>0 AND d[j]>0 THEN -a[i][j]/sqrt(d[i])/sqrt(d[j]) ELSE 0.0 END")


@query("fe20_fiedler_value", f"WITH RECURSIVE {TH}, {LAPL}, {PLAIN}, {NORMED} SELECT cond, round(fp9.f,6) AS fiedler, round(fn9.f,6) AS fiedler_norm FROM fp9 JOIN fn9 USING (cond)")
def fe20(t):
    m = cut_lineage(nw.matrices(wpli(t), "cond", NCH))
    a, b = nw.fiedler(m, "cond"), nw.fiedler(m, "cond", True).withColumnRenamed("fiedler", "fiedler_norm")
    return a.join(b, "cond").select("cond", R6(F.col("fiedler")).alias("fiedler"), R6(F.col("fiedler_norm")).alias("fiedler_norm"))


RCH = TH + """, nd AS (SELECT DISTINCT cond, n FROM wp, range(0,8) q(n)), bt AS (SELECT cond,i,j FROM th UNION ALL SELECT cond,j,i FROM th),
rc(cond,a,b,d) AS (SELECT cond,n,n,0 FROM nd UNION SELECT r.cond,r.a,bt.j,r.d+1 FROM rc r JOIN bt ON bt.cond=r.cond AND bt.i=r.b WHERE r.d<8),
dm AS (SELECT cond,a,b,min(d) AS d FROM rc GROUP BY 1,2,3)"""


@query("fe21_connected_components", f"WITH RECURSIVE {RCH}, l AS (SELECT cond,a,min(b) AS root FROM dm GROUP BY 1,2) SELECT cond, count(DISTINCT root) AS n_components, count(DISTINCT root)=1 AS connected FROM l GROUP BY 1")
def fe21(t):
    nodes = t.packed().select("cond").distinct().select("cond", F.explode(F.sequence(F.lit(0), F.lit(NCH - 1))).alias("node"))
    lab = components(nodes, strong(t), ["cond"])
    g = lab.groupBy("cond").agg(F.count_distinct("root").alias("n_components"))
    return g.withColumn("connected", F.col("n_components") == 1)


CLU = """, dg AS (SELECT cond,i,count(*) AS k FROM bt GROUP BY 1,2), tg AS (SELECT a.cond,a.i,count(*) AS t2 FROM bt a JOIN bt b ON a.cond=b.cond AND a.i=b.i AND a.j<>b.j JOIN bt c ON c.cond=a.cond AND c.i=a.j AND c.j=b.j GROUP BY 1,2),
cl AS (SELECT dg.cond, sum(CASE WHEN k>=2 THEN coalesce(t2,0)/(k*(k-1))::DOUBLE ELSE 0 END)/8 AS c FROM dg LEFT JOIN tg USING (cond,i) GROUP BY 1),
pl AS (SELECT cond, CASE WHEN count(*)=64 THEN sum(d)/56.0 END AS l, sum(CASE WHEN d>0 THEN 1.0/d ELSE 0 END)/56.0 AS e, count(*)=64 AS connected FROM dm GROUP BY 1)"""


@query("fe22_average_clustering", f"WITH RECURSIVE {RCH}{CLU} SELECT cond, round(c,6) AS clustering FROM cl")
def fe22(t):
    return nw.clustering(strong(t), "cond", NCH).withColumn("clustering", R6(F.col("clustering")))


@query("fe23_path_measures", f"WITH RECURSIVE {RCH}{CLU} SELECT cond, round(l,6) AS path_length, round(e,6) AS efficiency, connected FROM pl")
def fe23(t):
    d = nw.path_measures(nw.matrices(strong(t), "cond", NCH), "cond")
    return d.select("cond", R6(F.col("path_length")).alias("path_length"), R6(F.col("efficiency")).alias("efficiency"), "connected")


@query("fe24_small_world", f"WITH RECURSIVE {RCH}{CLU}, rf AS (SELECT cond, avg(w)+0.1 AS c_ref, 1+avg(w) AS l_ref FROM wp GROUP BY 1) SELECT cl.cond, round((c/c_ref)/(l/l_ref),6) AS sigma FROM cl JOIN pl USING (cond) JOIN rf USING (cond)")
def fe24(t):
    s = strong(t)
    m = nw.clustering(s, "cond", NCH).join(nw.path_measures(nw.matrices(s, "cond", NCH), "cond"), "cond")
    ref = wpli(t).groupBy("cond").agg((F.avg("w") + 0.1).alias("c_ref"), (1 + F.avg("w")).alias("l_ref"))
    return nw.small_world(m, ref, "cond").select("cond", R6(F.col("sigma")).alias("sigma"))


@query("fe25_density_sweep", "WITH RECURSIVE " + WP + """, sw AS (SELECT q.p*100+cond AS cond,p,i,j,w FROM wp, (VALUES (4),(6),(8)) q(p)),
th AS (SELECT cond,i,j,w FROM (SELECT *, max(CASE WHEN r=greatest(1,round_even(p/10.0*n,0)) THEN w END) OVER (PARTITION BY cond) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY cond) AS n, row_number() OVER (PARTITION BY cond ORDER BY w DESC) AS r FROM sw)) WHERE w>=cut)""" +
       RCH[len(TH):].replace("FROM wp, range", "FROM sw, range") + CLU + """, f AS (SELECT cl.cond%100 AS cond, cl.cond//100 AS p, c, l FROM cl JOIN pl USING (cond))
SELECT cond, p::BIGINT AS density_tenths, round(c/first_value(c) OVER w,6) AS c_rel, round(l/first_value(l) OVER w,6) AS l_rel FROM f WINDOW w AS (PARTITION BY cond ORDER BY p DESC)""")
def fe25(t):
    """C and L along a density sweep, relative to the densest graph."""
    from functools import reduce

    from pyspark.sql import Window

    from ..session import cut_lineage

    e = cut_lineage(wpli(t))
    parts = []
    for p in (4, 6, 8):
        s = nw.strongest(e, "cond", p / 10.0)
        m = nw.clustering(s, "cond", NCH).join(nw.path_measures(nw.matrices(s, "cond", NCH), "cond"), "cond")
        parts.append(m.select("cond", F.lit(p).cast("long").alias("density_tenths"), "clustering", "path_length"))
    d = reduce(lambda a, b: a.unionByName(b), parts)
    w = Window.partitionBy("cond").orderBy(F.desc("density_tenths"))
    return d.select("cond", "density_tenths", R6(F.try_divide("clustering", F.first("clustering").over(w))).alias("c_rel"), R6(F.try_divide("path_length", F.first("path_length").over(w))).alias("l_rel"))


ENT = "log2(sum(n))-sum(n*log2(n))/sum(n)"


@query("fe26_coalition_entropy", f"""WITH {ENV}, sh AS (SELECT unit,ch,b,row_number() OVER (PARTITION BY unit,ch ORDER BY md5(concat_ws('|','fe26',unit,ch,i)))-1 AS i FROM bit),
p AS (SELECT unit,i,string_agg(b::VARCHAR,'' ORDER BY ch) AS pt FROM bit GROUP BY 1,2), q AS (SELECT unit,i,string_agg(b::VARCHAR,'' ORDER BY ch) AS pt FROM sh GROUP BY 1,2),
h AS (SELECT unit,{ENT} AS h FROM (SELECT unit,pt,count(*)::DOUBLE AS n FROM p GROUP BY 1,2) GROUP BY 1), h0 AS (SELECT unit,{ENT} AS h0 FROM (SELECT unit,pt,count(*)::DOUBLE AS n FROM q GROUP BY 1,2) GROUP BY 1)
SELECT unit, round(CASE WHEN h0>0 THEN h/h0 ELSE 0 END,6) AS ace FROM h JOIN h0 USING (unit)""")
def fe26(t):
    return cx.coalition_entropy(packed_mc(t), "unit", NCH, "fe26").withColumn("ace", R6(F.col("ace")))


@query("fe27_synchrony_entropy", f"""WITH {ALL_BAND}, f AS (SELECT unit,ch,i,atan2(im,re) AS ph FROM an),
pr AS (SELECT a.unit,a.ch,b.ch AS o,a.i,CASE WHEN abs(atan2(sin(a.ph-b.ph),cos(a.ph-b.ph)))<0.8 THEN 1 ELSE 0 END AS b FROM f a JOIN f b ON a.unit=b.unit AND a.i=b.i AND a.ch<>b.ch),
rk AS (SELECT *, row_number() OVER (PARTITION BY unit,ch,i ORDER BY o)-1 AS pos FROM pr),
sh AS (SELECT unit,ch,pos,b,row_number() OVER (PARTITION BY unit,ch,pos ORDER BY md5(concat_ws('|','fe27',unit,ch,pos,i)))-1 AS i FROM rk),
p AS (SELECT unit,ch,i,string_agg(b::VARCHAR,'' ORDER BY pos) AS pt FROM rk GROUP BY 1,2,3), q AS (SELECT unit,ch,i,string_agg(b::VARCHAR,'' ORDER BY pos) AS pt FROM sh GROUP BY 1,2,3),
h AS (SELECT unit,ch,{ENT} AS h FROM (SELECT unit,ch,pt,count(*)::DOUBLE AS n FROM p GROUP BY 1,2,3) GROUP BY 1,2), h0 AS (SELECT unit,ch,{ENT} AS h0 FROM (SELECT unit,ch,pt,count(*)::DOUBLE AS n FROM q GROUP BY 1,2,3) GROUP BY 1,2)
SELECT unit, round(avg(CASE WHEN h0>0 THEN h/h0 ELSE 0 END),6) AS sce FROM h JOIN h0 USING (unit,ch) GROUP BY 1""")
def fe27(t):
    return cx.synchrony_entropy(packed_mc(t), "unit", NCH, "fe27").withColumn("sce", R6(F.col("sce")))


@query("fe28_lagged_covariance", """WITH m AS (SELECT vec_id AS unit,(k-1)//16 AS ch,(k-1)%16 AS i,embedding[k]::DOUBLE AS x FROM embeddings, range(1,65) r(k)), c AS (SELECT unit,ch,i,x-avg(x) OVER (PARTITION BY unit,ch) AS x FROM m),
s AS (SELECT a.unit,a.ch AS i,b.ch AS j,sum(a.x*b.x)/16 AS s0 FROM c a JOIN c b ON a.unit=b.unit AND a.i=b.i GROUP BY 1,2,3), l AS (SELECT a.unit,a.ch AS i,b.ch AS j,sum(a.x*b.x)/15 AS sl FROM c a JOIN c b ON a.unit=b.unit AND a.i=b.i+1 GROUP BY 1,2,3),
t AS (SELECT unit,sum(s0) AS tr FROM s WHERE i=j GROUP BY 1) SELECT s.unit,s.i,s.j,round(s0+CASE WHEN s.i=s.j THEN 1e-10*tr/4 ELSE 0 END,9) AS s0,round(sl,9) AS s_lag FROM s JOIN l USING (unit,i,j) JOIN t USING (unit)""")
def fe28(t):
    d = sp.lagged_covariance(packed_mc(t), 4, 1)
    e = d.select("unit", F.posexplode(F.arrays_zip("s0", "s_lag")).alias("k", "q"))
    return e.select("unit", F.floor(F.col("k") / 4).cast("long").alias("i"), (F.col("k") % 4).cast("long").alias("j"), F.round(F.col("q.s0"), 9).alias("s0"), F.round(F.col("q.s_lag"), 9).alias("s_lag"))


@query("fe29_integrated_information")
def fe29(t):
    d = sp.lagged_covariance(packed_mc(t), 4, 1).select("unit", "s0", "s_lag")
    p = sp.integration(d, "unit", 4)
    return p.select("unit", "mask", *[R6(F.col(c)).alias(c) for c in ("phi_r", "phi_wms", "phi_norm")])


@query("fe30_spread_channels", "WITH c AS (SELECT l_suppkey AS rec, l_partkey AS ch, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey)-1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey,l_partkey FROM lineitem)) SELECT DISTINCT rec, ch FROM c, range(0,8) q(m) WHERE k=round_even(m*(n-1)/7.0,0)::BIGINT")
def fe30(t):
    from ..operators.ordered import numbered

    c = numbered(t.lineitem.select(F.col("l_suppkey").alias("rec"), F.col("l_partkey").alias("ch")).distinct(), ["rec"], ["ch"], "k")
    n = c.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).select("rec", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: F.bround(m * (F.col("n") - 1) / 7.0, 0).cast("long") + 1)).alias("k")).distinct()
    return c.join(n, ["rec", "k"], "left_semi").select("rec", "ch")


# Phase-lag weights and normalised Fiedler value of every unit; `cond` stands for the unit in the shared text.
UNIT_WP = MID_BAND + """, wp AS (SELECT unit AS cond,i0 AS i,j0 AS j,CASE WHEN sum(abs(v))>0 THEN abs(sum(v))/sum(abs(v)) ELSE 0 END AS w
 FROM (SELECT a.unit, a.ch AS i0, b.ch AS j0, a.im*b.re-a.re*b.im AS v FROM an a JOIN an b ON a.unit=b.unit AND a.i=b.i AND a.ch<b.ch) GROUP BY 1,2,3)"""
UNIT_NET = f"WITH RECURSIVE {UNIT_WP}, {LAPL}, {NORMED} SELECT cond AS unit, round(avg(w),6) AS theta_wpli_mean, round(max(f),5) AS theta_fiedler FROM wp JOIN fn9 USING (cond) GROUP BY 1"


@query("fe31_feature_rows", f"""SELECT unit, cond, raw AS lzc, z AS lzc_si, surr_mean AS lzc_surr_mean, exponent, offset_, delta AS rel_delta, theta AS rel_theta, alpha AS rel_alpha, beta AS rel_beta,
 alpha_post, theta_front, alpha_periodic, -exponent AS exponent_neg, kuramoto_r AS theta_r, metastability AS theta_meta, theta_fiedler, theta_wpli_mean, ace, sce
FROM (SELECT vec_id AS unit, label AS cond FROM embeddings) """ + " ".join(f"JOIN ({ORACLES[k]}) USING (unit)" for k in (
    "fe8_spectrum_controlled", "fe10_aperiodic_fit", "fe11_relative_band_power", "fe12_log_band_power", "fe13_periodic_alpha", "fe16_kuramoto_order", "fe26_coalition_entropy", "fe27_synchrony_entropy"))
       + f" JOIN ({UNIT_NET}) USING (unit)")
def fe31(t):
    """All features of a unit. What one row holds comes from one pass; entropies and surrogates are joined by unit."""
    r = sp.relative_power(F.col("psd"), DF)
    d = psd(t).withColumns({**{f"_{b}": r[b] for b in ("delta", "theta", "alpha", "beta")}, "alpha_post": sp.log_band(F.col("psd"), DF, *ALPHA), "theta_front": sp.log_band(F.col("psd"), DF, *THETA)})
    d = sp.aperiodic_fit(d, F.col("psd"), DF)
    row = d.select("unit", "cond", R6(F.col("exponent")).alias("exponent"), R6(F.col("offset")).alias("offset_"), *[R6(F.col(f"_{b}")).alias(f"rel_{b}") for b in ("delta", "theta", "alpha", "beta")],
                   R6(F.col("alpha_post")).alias("alpha_post"), R6(F.col("theta_front")).alias("theta_front"),
                   R6(F.col("alpha_post") - math.log(10) * (F.col("offset") - F.col("exponent"))).alias("alpha_periodic"), (-R6(F.col("exponent"))).alias("exponent_neg"))
    edges = cut_lineage(sp.phase_lag_edges(packed_mc(t), ["unit"], NCH, 8.0, (1.0, 3.0)))
    net = edges.groupBy("unit").agg(R6(F.avg("w")).alias("theta_wpli_mean")).join(
        nw.fiedler(nw.matrices(edges, "unit", NCH), "unit", True).select("unit", F.round("fiedler", 5).alias("theta_fiedler")), "unit")
    lz = fe8(t).select("unit", F.col("raw").alias("lzc"), F.col("z").alias("lzc_si"), F.col("surr_mean").alias("lzc_surr_mean"))
    sync = fe16(t).select("unit", F.col("kuramoto_r").alias("theta_r"), F.col("metastability").alias("theta_meta"))
    for part in (lz, sync, net, fe26(t), fe27(t)):
        row = row.join(part, "unit")
    return row
