"""Marker decoding, clock alignment, probe windows and epoch grids on `events`."""

from pyspark.sql import functions as F

from ..operators import align as al, decode as dec, intervals as iv
from ..operators.ordered import gaps, previous_mean, running
from ..operators.quantiles import quantiles
from ..session import cut_lineage
from ..sources.tables import EPOCH_H, EV, LATE_H, NO_RESPONSE_H, PAD_H
from .registry import query

TOL = 0.05
R6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- shared oracle text
PA = EV + """,
p0 AS (SELECT *, (sum(CASE WHEN code=128 THEN 1 ELSE 0 END) OVER (PARTITION BY ses ORDER BY t,eid))::BIGINT AS probe FROM ev),
p1 AS (SELECT *, CASE WHEN code IN (2,4,8) THEN row_number() OVER (PARTITION BY ses,probe,code IN (2,4,8) ORDER BY t,eid) END AS rk
 FROM p0 WHERE probe>0),
pa AS (SELECT ses, probe, min(t) FILTER (WHERE code=128) AS onset, max(t) FILTER (WHERE code IN (2,4,8)) AS resp_end,
 count(*) FILTER (WHERE code IN (2,4,8)) AS n_resp, count(*) FILTER (WHERE code=16) AS involuntary,
 max(code) FILTER (WHERE rk=1) AS c1, max(code) FILTER (WHERE rk=2) AS c2, max(code) FILTER (WHERE rk=3) AS c3
 FROM p1 GROUP BY 1,2)"""
BEH = """,
mk AS (SELECT ses, probe, eid, t AS o, row_number() OVER (PARTITION BY ses ORDER BY t,eid)-1 AS i FROM p0 WHERE code=128),
pr AS (SELECT ses, probe, eid, eid%5 AS key, 1+(eid//5)%4 AS status FROM p0 WHERE probe>0 AND code<>128),
ans AS (SELECT ses, probe, arg_min(key,eid) FILTER (WHERE status=1) AS k1, arg_min(key,eid) FILTER (WHERE status=2) AS k2,
 arg_min(key,eid) FILTER (WHERE status=3) AS k3 FROM pr WHERE key<=3 AND status<=3 GROUP BY 1,2),
beh AS (SELECT m.ses, row_number() OVER (PARTITION BY m.ses ORDER BY o,m.eid)-1 AS j, o-(5.5+(m.ses%7)*0.25) AS t, k1,k2,k3
 FROM mk m LEFT JOIN ans USING (ses,probe) WHERE m.eid%5<>0)"""
ALIGN = BEH + """,
cand AS (SELECT m.ses, m.i, b.j, m.o-b.t AS c FROM mk m JOIN beh b ON m.ses=b.ses AND abs(m.i-b.j)<=4),
sc AS (SELECT c.ses,c.i,c.j,c.c, count(DISTINCT m.i) AS n FROM cand c JOIN mk m ON m.ses=c.ses
 JOIN beh b ON b.ses=c.ses AND abs(m.o-c.c-b.t)<0.05 GROUP BY 1,2,3,4),
b0 AS (SELECT ses, c AS off FROM (SELECT *, row_number() OVER (PARTITION BY ses ORDER BY n DESC,i,j) r FROM sc) WHERE r=1),
n0 AS (SELECT m.ses,m.i,b.j,m.o-b.t-b0.off AS d, row_number() OVER (PARTITION BY m.ses,m.i ORDER BY abs(m.o-b.t-b0.off),b.j) r
 FROM mk m JOIN b0 USING (ses) JOIN beh b ON b.ses=m.ses),
b1 AS (SELECT ses, off+coalesce(q,0) AS off FROM b0 LEFT JOIN (SELECT ses, quantile_cont(d,0.5) q FROM n0 WHERE r=1 AND abs(d)<0.05 GROUP BY 1) USING (ses)),
n1 AS (SELECT m.ses,m.i,b.j,m.o-b.t-b1.off AS d, row_number() OVER (PARTITION BY m.ses,m.i ORDER BY abs(m.o-b.t-b1.off),b.j) r
 FROM mk m JOIN b1 USING (ses) JOIN beh b ON b.ses=m.ses),
b2 AS (SELECT ses, off+coalesce(q,0) AS off FROM b1 LEFT JOIN (SELECT ses, quantile_cont(d,0.5) q FROM n1 WHERE r=1 AND abs(d)<0.05 GROUP BY 1) USING (ses)),
n2 AS (SELECT m.ses,m.i,b.j,m.o-b.t-b2.off AS d, row_number() OVER (PARTITION BY m.ses,m.i ORDER BY abs(m.o-b.t-b2.off),b.j) r
 FROM mk m JOIN b2 USING (ses) JOIN beh b ON b.ses=m.ses),
mt AS (SELECT ses, min(i) AS i, j FROM n2 WHERE r=1 AND abs(d)<0.05 GROUP BY ses,j)"""
DEC = ALIGN + """,
dc0 AS (SELECT pa.*, mt.j AS log_row, beh.k1, beh.k2, beh.k3 FROM pa LEFT JOIN mt ON mt.ses=pa.ses AND mt.i=pa.probe-1
 LEFT JOIN beh ON beh.ses=mt.ses AND beh.j=mt.j),
dc AS (SELECT *, CASE WHEN log_row IS NOT NULL THEN k1 WHEN n_resp=3 THEN log2(c1)::INT END AS q1,
 CASE WHEN log_row IS NOT NULL THEN k2 WHEN n_resp=3 THEN log2(c2)::INT END AS q2,
 CASE WHEN log_row IS NOT NULL THEN k3 WHEN n_resp=3 THEN log2(c3)::INT END AS q3,
 CASE WHEN log_row IS NOT NULL THEN 'behaviour' WHEN n_resp=3 THEN 'events' ELSE 'none' END AS source FROM dc0),
probes AS (SELECT *, (q1-q2)::DOUBLE AS rating FROM dc),
sess AS (SELECT ses, max(t) AS dur FROM ev GROUP BY 1)"""
PB = EV + """,
l0 AS (SELECT ses,eid,t,code_b AS code FROM ev WHERE code_b<>0),
l1 AS (SELECT *, (sum(CASE WHEN code=100 THEN 1 ELSE 0 END) OVER (PARTITION BY ses ORDER BY t,eid))::BIGINT AS probe FROM l0),
l2 AS (SELECT *, min(CASE WHEN code=100 THEN t END) OVER (PARTITION BY ses,probe) AS onset FROM l1),
l3 AS (SELECT *, code<>100 AND probe>0 AND t-onset<=36 AS ok, code<>100 AND probe>0 AND t-onset>36 AS late FROM l2),
l4 AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY ses,probe,ok ORDER BY t,eid) END AS rk FROM l3),
pb AS (SELECT ses, probe, min(onset) AS onset, max(t) FILTER (WHERE ok) AS resp_end, count(*) FILTER (WHERE ok) AS n_codes,
 count(*) FILTER (WHERE late) AS n_late,
 CASE WHEN probe=1 THEN coalesce((SELECT count(*) FROM l4 x WHERE x.ses=l4.ses AND x.probe=0),0) ELSE 0 END AS n_practice,
 max(code) FILTER (WHERE rk=1) AS c1, max(code) FILTER (WHERE rk=2) AS c2, max(code) FILTER (WHERE rk=3) AS c3,
 max(code) FILTER (WHERE rk=4) AS c4, max(code) FILTER (WHERE rk=5) AS c5, max(code) FILTER (WHERE rk=6) AS c6
 FROM l4 WHERE probe>0 GROUP BY ses,probe),
db AS (SELECT *, c1 AS answer, c2 AS confidence, c3 AS sleepiness, CASE WHEN c1=1 THEN c4 END AS focus,
 CASE WHEN c1=2 THEN c4 END AS engagement, CASE WHEN c1=2 THEN c5 END AS visual, CASE WHEN c1=2 THEN c6 END AS auditory,
 CASE WHEN c1=3 THEN c4 END AS sensation, coalesce(c1 IN (1,2,3) AND c2 BETWEEN 1 AND 7,false) AS valid,
 CASE WHEN c1 IN (1,2,3) AND c2 BETWEEN 1 AND 7 THEN (CASE WHEN c1=1 THEN c2 ELSE -c2 END)::DOUBLE END AS rating FROM pb)"""


# ---------------------------------------------------------------- shared frames
def log_a(t):
    return t.markers().select("ses", "eid", "t", "code")


def log_b(t):
    return t.markers().select("ses", "eid", "t", F.col("code_b").alias("code"))


def marks(t):
    d = running(log_a(t), ["ses"], ["t", "eid"], sums={"probe": F.when(F.col("code") == 128, 1).otherwise(0)})
    return d, d.where("code = 128").select("ses", "probe", "eid", F.col("t").alias("o"), (F.col("probe") - 1).cast("long").alias("i"))


def behaviour_log(t):
    """The second clock: kept markers shifted per session, with decoded presses."""
    d, mk = marks(t)
    presses = d.where("probe > 0 and code <> 128").select(
        "ses", "probe", F.col("eid").alias("ord"), (F.col("eid") % 5).alias("key"),
        (1 + F.floor(F.col("eid") / 5) % 4).alias("status"))
    kept = mk.where("eid % 5 <> 0")
    logs = al.ordinals(kept, "o", "eid", "j").join(dec.answers_from_presses(presses), ["ses", "probe"], "left")
    logs = logs.select("ses", "j", (F.col("o") - (5.5 + (F.col("ses") % 7) * 0.25)).alias("t"), "k1", "k2", "k3")
    return mk.select("ses", "i", "o"), logs


def matched_keys(t):
    mk, logs = behaviour_log(t)
    _, m = al.align(["ses"], mk, logs.select("ses", "j", "t"), TOL)
    return m.join(logs, ["ses", "j"]).select(
        "ses", (F.col("i") + 1).alias("probe"), F.col("j").alias("log_row"), "k1", "k2", "k3")


def decoded(t):
    return dec.decode_a(dec.probes_a(log_a(t)), matched_keys(t))


def sessions(t):
    return t.markers().groupBy("ses").agg(F.max("t").alias("dur"))


def probe_table(t):
    """Probes decoded from the codes alone (no second clock)."""
    return dec.decode_a(dec.probes_a(log_a(t)))


def grid(t):
    return iv.epoch_grid(sessions(t), "dur", EPOCH_H)


def observed_grid(t):
    w = iv.probe_windows(dec.probes_a(log_a(t)), PAD_H, NO_RESPONSE_H)
    return iv.masked_grid(grid(t), w, EPOCH_H)


GRID = """,
win AS (SELECT ses, onset AS ws, coalesce(resp_end+2.0, onset+9.0) AS we FROM pa),
ses1 AS (SELECT ses, max(t) AS dur FROM ev GROUP BY 1),
g AS (SELECT ses, k AS epoch, k*6.0::DOUBLE AS t_end FROM ses1, range(1,100000) r(k) WHERE k<=floor(dur/6.0)),
mg AS (SELECT g.*, NOT EXISTS (SELECT 1 FROM win w WHERE w.ses=g.ses AND g.t_end>w.ws AND g.t_end-6.0<w.we) AS observed FROM g)"""
SEL_PA = "SELECT ses,probe,round(onset,6) AS onset,round(resp_end,6) AS resp_end,n_resp,involuntary,c1,c2,c3 FROM pa"


# ---------------------------------------------------------------- queries
@query("ev1_marker_probes", f"WITH {PA} {SEL_PA}")
def ev1(t):
    return dec.probes_a(log_a(t)).withColumns({"onset": R6(F.col("onset")), "resp_end": R6(F.col("resp_end"))})


@query("ev2_marker_probes_late_rule", f"WITH {PB} SELECT ses,probe,round(onset,6) AS onset,round(resp_end,6) AS resp_end,n_codes,n_late,n_practice,c1,c2,c3,c4,c5,c6 FROM pb")
def ev2(t):
    return dec.probes_b(log_b(t), LATE_H).withColumns({"onset": R6(F.col("onset")), "resp_end": R6(F.col("resp_end"))})


@query("ev4_press_answers", f"WITH {PA}{BEH} SELECT ses,probe,k1,k2,k3 FROM ans")
def ev4(t):
    d, _ = marks(t)
    presses = d.where("probe > 0 and code <> 128").select(
        "ses", "probe", F.col("eid").alias("ord"), (F.col("eid") % 5).alias("key"),
        (1 + F.floor(F.col("eid") / 5) % 4).alias("status"))
    return dec.answers_from_presses(presses)


@query("ev5_clock_offsets", f"WITH {PA}{ALIGN} SELECT b2.ses, round(off,6) AS offset_h, (SELECT count(*) FROM mt WHERE mt.ses=b2.ses) AS n_matched FROM b2")
def ev5(t):
    mk, logs = behaviour_log(t)
    off, m = al.align(["ses"], mk, logs.select("ses", "j", "t"), TOL)
    n = m.groupBy("ses").agg(F.count(F.lit(1)).alias("n"))
    return off.join(n, "ses", "left").select("ses", R6(F.col("offset")).alias("offset_h"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matched"))


@query("jn7_nearest_matches", f"WITH {PA}{ALIGN} SELECT ses,i,j FROM mt")
def jn7(t):
    mk, logs = behaviour_log(t)
    return al.align(["ses"], mk, logs.select("ses", "j", "t"), TOL)[1]


@query("jn9_band_candidates", f"WITH {PA}{ALIGN} SELECT ses,i,j,round(c,6) AS delta FROM cand")
def jn9(t):
    mk, logs = behaviour_log(t)
    near = mk.withColumn("j", F.explode(F.sequence(F.col("i") - al.BAND, F.col("i") + al.BAND)))
    return near.join(logs, ["ses", "j"]).select("ses", "i", "j", R6(F.col("o") - F.col("t")).alias("delta"))


EV6 = PA + BEH + """,
fl AS (SELECT ses AS file, j, t-(ses%3)*0.01 AS t FROM beh),
cand AS (SELECT m.ses, f.file, m.i, f.j, m.o-f.t AS c FROM mk m JOIN fl f ON m.ses//3=f.file//3 AND abs(m.i-f.j)<=4),
sc AS (SELECT c.ses,c.file,c.i,c.j,c.c, count(DISTINCT m.i) AS n FROM cand c JOIN mk m ON m.ses=c.ses
 JOIN fl b ON b.file=c.file AND abs(m.o-c.c-b.t)<0.05 GROUP BY 1,2,3,4,5),
prs AS (SELECT ses//3 AS grp, ses AS l, file AS r, max(n) AS score FROM sc GROUP BY 1,2,3),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp,l ORDER BY score DESC,l,r) a, row_number() OVER (PARTITION BY grp,r ORDER BY score DESC,l,r) b FROM prs) WHERE a=1 AND b=1),
q1 AS (SELECT p.* FROM prs p WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.grp=p.grp AND (r1.l=p.l OR r1.r=p.r))),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp,l ORDER BY score DESC,l,r) a, row_number() OVER (PARTITION BY grp,r ORDER BY score DESC,l,r) b FROM q1) WHERE a=1 AND b=1),
q2 AS (SELECT p.* FROM q1 p WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.grp=p.grp AND (r2.l=p.l OR r2.r=p.r))),
r3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp,l ORDER BY score DESC,l,r) a, row_number() OVER (PARTITION BY grp,r ORDER BY score DESC,l,r) b FROM q2) WHERE a=1 AND b=1)
SELECT grp AS sub, l AS ses, r AS log_file, score FROM r1 UNION ALL SELECT grp,l,r,score FROM r2 UNION ALL SELECT grp,l,r,score FROM r3"""


@query("ev6_log_assignment", f"WITH {EV6}")
def ev6(t):
    mk, logs = behaviour_log(t)
    sub = lambda c: F.floor(F.col(c) / 3).cast("long")
    files = logs.select(sub("ses").alias("grp"), F.col("ses").alias("file"), "j", (F.col("t") - (F.col("ses") % 3) * 0.01).alias("t"))
    best = al.pair_scores(cut_lineage(mk.withColumn("grp", sub("ses"))), cut_lineage(files), TOL)
    won = al.assign_greedy(best.select("grp", F.col("ses").alias("left"), F.col("file").alias("right"), "score"))
    return won.select(F.col("grp").alias("sub"), F.col("left").alias("ses"), F.col("right").alias("log_file"), "score")


@query("ev6b_file_names", """
WITH f AS (SELECT doc_id, concat('log_', lang, '_', lpad((doc_id%37)::VARCHAR,3,'0'), CASE WHEN doc_id%3=0 THEN '' ELSE concat('_',(doc_id%3+1)::VARCHAR) END,
 CASE WHEN doc_id%11=0 THEN '_old' ELSE '' END, '.txt') AS name FROM documents)
SELECT doc_id, name, lpad(regexp_extract(name,'log_[a-z]+_([0-9]+)',1),3,'0') AS sub,
 coalesce(try_cast(nullif(regexp_extract(name,'log_[a-z]+_[0-9]+_([0-9]+)[.]txt$',1),'') AS INT),1) AS session_no FROM f WHERE name NOT LIKE '%\\_old.txt' ESCAPE '\\'""")
def ev6b(t):
    name = F.concat(F.lit("log_"), "lang", F.lit("_"), F.lpad((F.col("doc_id") % 37).cast("string"), 3, "0"),
                    F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), (F.col("doc_id") % 3 + 1).cast("string"))),
                    F.when(F.col("doc_id") % 11 == 0, "_old").otherwise(""), F.lit(".txt"))
    f = t.documents.select("doc_id", name.alias("name")).where(~F.col("name").endswith("_old.txt"))
    idx = F.nullif(F.regexp_extract("name", r"log_[a-z]+_[0-9]+_([0-9]+)\.txt$", 1), F.lit("")).try_cast("int")
    return f.select("doc_id", "name", F.lpad(F.regexp_extract("name", r"log_[a-z]+_([0-9]+)", 1), 3, "0").alias("sub"),
                    F.coalesce(idx, F.lit(1)).alias("session_no"))


@query("ev7_decoded_probes", f"WITH {PA}{DEC} SELECT ses,probe,round(onset,6) AS onset,n_resp,q1,q2,q3,source,rating FROM probes")
def ev7(t):
    return decoded(t).select("ses", "probe", R6(F.col("onset")).alias("onset"), "n_resp", "q1", "q2", "q3", "source", "rating")


EV8 = """,
e8 AS (SELECT ses, log_row IS NOT NULL AS m, q1 IS NOT NULL AND q2 IS NOT NULL AS known, n_resp,
 list_filter([k1,k2,k3], lambda x: x IS NOT NULL) AS ks, list_filter([c1,c2,c3], lambda x: x IS NOT NULL) AS cs FROM probes),
f8 AS (SELECT *, list_transform(list_filter(ks, lambda x: x<>0), lambda x: (1<<x::INT)) AS nz FROM e8),
h8 AS (SELECT ses,m,known, CASE WHEN m THEN len(list_filter(range(1,4), lambda k: k<=len(nz) AND k<=len(cs) AND nz[k]=cs[k])) ELSE 0 END AS agree,
 CASE WHEN m THEN len(nz) ELSE 0 END AS nzn, CASE WHEN m THEN len(ks)-len(nz) ELSE 0 END AS zero, CASE WHEN m THEN n_resp-len(nz) ELSE 0 END AS ex FROM f8),
s8 AS (SELECT ses, count(*) AS n_probe, count(*) FILTER (WHERE m) AS n_matched, count(*) FILTER (WHERE known) AS n_known,
 sum(agree)::BIGINT AS code_agree, sum(nzn)::BIGINT AS code_total, sum(zero)::BIGINT AS key0_total,
 sum(greatest(ex,0))::BIGINT AS key0_with_trigger, sum(greatest(-ex,0))::BIGINT AS nonzero_without_trigger FROM h8 GROUP BY ROLLUP(ses))"""
EV8_SEL = """SELECT *, round(n_matched/greatest(n_probe,1),6) AS match_rate, round(n_known/greatest(n_probe,1),6) AS known_rate,
 round(code_agree/greatest(code_total,1),6) AS code_agreement, round(key0_with_trigger/greatest(key0_total,1),6) AS key0_rate FROM s8"""


@query("ev8_decode_diagnostics", f"WITH {PA}{DEC}{EV8} {EV8_SEL}")
def ev8(t):
    return dec.decode_diagnostics(decoded(t))


EV9 = PB + """,
gp AS (SELECT ses, onset - lag(onset) OVER (PARTITION BY ses ORDER BY onset,probe) AS gap FROM db),
g9 AS (SELECT ses, min(gap) AS gap_min, quantile_cont(gap,0.5) AS gap_med, max(gap) AS gap_max FROM gp WHERE gap IS NOT NULL GROUP BY 1),
l9 AS (SELECT ses, quantile_cont(resp_end-onset,0.5) AS lat_med FROM db WHERE resp_end IS NOT NULL GROUP BY 1)"""


@query("ev9_session_decode_stats", f"""WITH {EV9}
SELECT d.ses, count(*) AS n_probes, count(*) FILTER (WHERE valid) AS n_valid, round(count(*) FILTER (WHERE valid)/count(*)::DOUBLE,6) AS valid_share,
 count(*) FILTER (WHERE n_codes>=3) AS n_three, sum(n_late)::BIGINT AS n_late, sum(n_practice)::BIGINT AS n_practice,
 count(*) FILTER (WHERE answer=1) AS n_a1, count(*) FILTER (WHERE answer=2) AS n_a2, count(*) FILTER (WHERE answer=3) AS n_a3,
 min(confidence) AS conf_min, max(confidence) AS conf_max, round(any_value(gap_min),6) AS gap_min, round(any_value(gap_med),6) AS gap_median,
 round(any_value(gap_max),6) AS gap_max, round(any_value(lat_med),6) AS latency_median
FROM db d LEFT JOIN g9 USING (ses) LEFT JOIN l9 USING (ses) GROUP BY d.ses""")
def ev9(t):
    d = dec.decode_b(dec.probes_b(log_b(t), LATE_H))
    g = gaps(d.select("ses", "onset", "probe"), ["ses"], ["onset", "probe"]).where("gap is not null")
    gm = g.groupBy("ses").agg(F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max")).join(quantiles(g, ["ses"], "gap", {"gap_median": 0.5}), "ses")
    lm = quantiles(d.withColumn("lat", F.col("resp_end") - F.col("onset")), ["ses"], "lat", {"latency_median": 0.5})
    s = d.groupBy("ses").agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_if("valid").alias("n_valid"), R6(F.avg(F.col("valid").cast("int"))).alias("valid_share"),
        F.count_if(F.col("n_codes") >= 3).alias("n_three"), F.sum("n_late").alias("n_late"), F.sum("n_practice").alias("n_practice"),
        *[F.count_if(F.col("answer") == a).alias(f"n_a{a}") for a in (1, 2, 3)],
        F.min("confidence").alias("conf_min"), F.max("confidence").alias("conf_max"))
    d = s.join(gm, "ses", "left").join(lm, "ses", "left")
    return d.withColumns({c: R6(F.col(c)) for c in ("gap_min", "gap_median", "gap_max", "latency_median")})


@query("ev10_marker_inventory", f"""WITH {EV}, m AS (SELECT ses, t - lag(t) OVER (PARTITION BY ses ORDER BY t,eid) AS gap FROM ev WHERE code=128),
gm AS (SELECT ses, round(quantile_cont(gap,0.5),6) AS median_gap FROM m WHERE gap IS NOT NULL GROUP BY 1)
SELECT ev.ses, count(*) FILTER (WHERE code=128) AS n_probe, count(*) FILTER (WHERE code IN (2,4,8)) AS n_resp,
 array_to_string(list_sort(list(DISTINCT code)),',') AS codes, any_value(median_gap) AS median_gap FROM ev LEFT JOIN gm USING (ses) GROUP BY 1""")
def ev10(t):
    d = log_a(t)
    g = gaps(d.where("code = 128"), ["ses"], ["t", "eid"]).where("gap is not null")
    s = d.groupBy("ses").agg(
        F.count_if(F.col("code") == 128).alias("n_probe"), F.count_if(F.col("code").isin(2, 4, 8)).alias("n_resp"),
        F.array_join(F.transform(F.sort_array(F.collect_set("code")), lambda c: c.cast("string")), ",").alias("codes"))
    return s.join(quantiles(g, ["ses"], "gap", {"median_gap": 0.5}).withColumn("median_gap", R6(F.col("median_gap"))), "ses", "left")


@query("ev11_probe_windows", f"WITH {PA}{GRID} SELECT ses, round(ws,6) AS w_start, round(we,6) AS w_end FROM win")
def ev11(t):
    w = iv.probe_windows(dec.probes_a(log_a(t)), PAD_H, NO_RESPONSE_H)
    return w.withColumns({c: R6(F.col(c)) for c in ("w_start", "w_end")})


@query("ev12_epoch_grid", f"WITH {PA}{GRID} SELECT ses,epoch,t_end FROM g")
def ev12(t):
    return grid(t)


@query("ev13_interval_mask", f"WITH {PA}{GRID} SELECT ses,epoch,t_end,observed FROM mg")
def ev13(t):
    return observed_grid(t)


@query("jn8_interval_anti_join", f"WITH {PA}{GRID} SELECT ses,epoch FROM mg WHERE observed")
def jn8(t):
    w = iv.probe_windows(dec.probes_a(log_a(t)), PAD_H, NO_RESPONSE_H)
    return grid(t).join(iv.covered_epochs(w, EPOCH_H), ["ses", "epoch"], "left_anti").select("ses", "epoch")


@query("ev14_session_design", f"""WITH {PA}{DEC}{GRID}
SELECT s.ses, coalesce((SELECT count(*) FROM mg WHERE mg.ses=s.ses),0) AS n_epochs, coalesce((SELECT count(*) FROM mg WHERE mg.ses=s.ses AND NOT observed),0) AS n_masked,
 (SELECT count(*) FROM probes p WHERE p.ses=s.ses AND rating IS NOT NULL) AS n_probes,
 round((SELECT count(*) FROM mg WHERE mg.ses=s.ses AND NOT observed)/nullif((SELECT count(*) FROM mg WHERE mg.ses=s.ses),0)::DOUBLE,6) AS missing_frac,
 round(dur*60,4) AS duration_min FROM sess s""")
def ev14(t):
    d = iv.session_design(observed_grid(t), decoded(t), sessions(t), rated_only=True)
    return d.select("ses", "n_epochs", "n_masked", "n_probes", R6(F.col("missing_frac")).alias("missing_frac"), F.round(F.col("dur") * 60, 4).alias("duration_min"))


@query("ag15_design_totals", f"""WITH {PA}{GRID}, d AS (SELECT ses, count(*) AS n, avg(CASE WHEN observed THEN 0.0 ELSE 1.0 END) AS mf FROM mg GROUP BY 1)
SELECT count(*) AS n_sessions, (SELECT count(*) FROM pa) AS n_probes, round((SELECT sum(dur)*60 FROM ses1),4) AS subject_minutes, round(avg(mf),6) AS mean_missing FROM ses1 LEFT JOIN d USING (ses)""")
def ag15(t):
    d = iv.session_design(observed_grid(t), dec.probes_a(log_a(t)).withColumn("rating", F.lit(None).cast("double")), sessions(t))
    return d.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_probes").alias("n_probes"), F.round(F.sum("dur") * 60, 4).alias("subject_minutes"),
                 R6(F.avg("missing_frac")).alias("mean_missing"))


@query("ev15_stage_windows", f"""WITH {EV}, st AS (SELECT ses, eid, t, code, value, md5(concat_ws('|','ev15',eid)) AS h FROM ev WHERE value>=30),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ses,code ORDER BY h,eid) r FROM st) WHERE r<=3),
b AS (SELECT k.*, dur FROM k JOIN (SELECT ses, max(t) AS dur FROM ev GROUP BY 1) USING (ses) WHERE t-2>=0 AND t+30+2<=dur)
SELECT ses, eid, code, s AS third, round(t+10*s,6) AS w_start, round(t+10*(s+1),6) AS w_end FROM b, range(0,3) r(s)""")
def ev15(t):
    from ..operators.ordered import top_n

    st = t.markers().where("value >= 30").withColumn("h", F.md5(F.concat_ws("|", F.lit("ev15"), F.col("eid").cast("string"))))
    k = top_n(st.select("ses", "eid", "t", "code", "h"), ["ses", "code"], ["h", "eid"], 3)
    b = k.join(sessions(t), "ses").where((F.col("t") - 2 >= 0) & (F.col("t") + 32 <= F.col("dur")))
    e = b.withColumn("third", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return e.select("ses", "eid", "code", "third", R6(F.col("t") + 10 * F.col("third")).alias("w_start"), R6(F.col("t") + 10 * (F.col("third") + 1)).alias("w_end"))


@query("ev16_probe_schedule", f"""WITH {EV}, s AS (SELECT ses, floor(max(t)/6.0)::BIGINT AS n, (ses%12+2)::BIGINT AS p FROM ev GROUP BY 1)
SELECT ses, (k*p-1)::BIGINT AS epoch FROM s, range(1,100000) r(k) WHERE k*p-1<n""")
def ev16(t):
    s = sessions(t).select("ses", F.floor(F.col("dur") / EPOCH_H).cast("long").alias("n"), (F.col("ses") % 12 + 2).alias("p"))
    return iv.probe_schedule(s, "n", "p")


@query("pf1_trigger_codes", f"""WITH {EV}, x AS (SELECT eid, CASE WHEN code=16 THEN concat('noise ',code_b) ELSE concat('RS232 Trigger: ',code_b,' (T)') END AS text FROM ev)
SELECT eid, try_cast(nullif(regexp_extract(text,'^RS232 Trigger: ([0-9]+)',1),'') AS INT) AS trigger_code FROM x""")
def pf1(t):
    text = F.when(F.col("code") == 16, F.concat(F.lit("noise "), F.col("code_b").cast("string"))).otherwise(
        F.concat(F.lit("RS232 Trigger: "), F.col("code_b").cast("string"), F.lit(" (T)")))
    return t.markers().select("eid", dec.trigger_code(text).alias("trigger_code"))


@query("pf2_response_keys", f"WITH {EV} SELECT eid, log2(code)::INT AS key FROM ev WHERE code IN (2,4,8)")
def pf2(t):
    return t.markers().where(F.col("code").isin(2, 4, 8)).select("eid", dec.key_of(F.col("code")).alias("key"))


@query("pf3_rating_difference", f"WITH {PA} SELECT ses,probe,CASE WHEN n_resp=3 THEN log2(c1)-log2(c2) END AS rating FROM pa")
def pf3(t):
    return probe_table(t).select("ses", "probe", "rating")


@query("pf4_signed_confidence", f"WITH {PB} SELECT ses,probe,answer,confidence,valid,rating FROM db")
def pf4(t):
    return dec.decode_b(dec.probes_b(log_b(t), LATE_H)).select("ses", "probe", "answer", "confidence", "valid", "rating")


@query("pf5_item_routing", f"WITH {PB} SELECT ses,probe,answer,sleepiness,focus,engagement,visual,auditory,sensation FROM db")
def pf5(t):
    return dec.decode_b(dec.probes_b(log_b(t), LATE_H)).select("ses", "probe", "answer", "sleepiness", "focus", "engagement", "visual", "auditory", "sensation")


@query("pf7_time_rounding", f"WITH {EV} SELECT eid, round(round_even(t*3600/0.1,0)*0.1/60,6) AS t_min FROM ev")
def pf7(t):
    return t.markers().select("eid", F.round(F.bround(F.col("t") * 3600 / 0.1, 0) * 0.1 / 60, 6).alias("t_min"))


KEEP = """,
kd AS (SELECT s.ses, avg(CASE WHEN observed THEN 0.0 ELSE 1.0 END) AS mf, (SELECT count(*) FROM pb p WHERE p.ses=s.ses AND p.c1 IN (1,2,3) AND p.c2 BETWEEN 1 AND 7) AS nr FROM ses1 s LEFT JOIN mg USING (ses) GROUP BY 1)"""


KEPT = f"{PA}{GRID}, {PB[len(EV) + 2:]}{KEEP}"


def keep_sessions(t):
    """(ses, missing_frac, n_epochs, n_rated, kept): at most 40 % of the epochs missing and eight rated probes."""
    p = dec.decode_b(dec.probes_b(log_b(t), LATE_H))
    d = iv.session_design(observed_grid(t), p, sessions(t), rated_only=True)
    kept = (F.col("missing_frac") <= 0.40) & (F.col("n_probes") >= 8)
    return d.select("ses", "missing_frac", "n_epochs", F.col("n_probes").alias("n_rated"), kept.alias("kept"))


@query("pf8_keep_sessions", f"WITH {KEPT} SELECT ses, round(mf,6) AS missing_frac, nr AS n_rated, mf<=0.40 AND nr>=8 AS kept FROM kd")
def pf8(t):
    return keep_sessions(t).select("ses", R6(F.col("missing_frac")).alias("missing_frac"), "n_rated", "kept")


@query("pf10_first_probes", f"WITH {PA} SELECT ses,probe,round(onset,6) AS onset FROM pa WHERE probe<=5")
def pf10(t):
    return dec.probes_a(log_a(t)).where("probe <= 5").select("ses", "probe", R6(F.col("onset")).alias("onset"))


@query("pf11_after_first_probe", f"""WITH {EV}, f AS (SELECT ses, min(t) AS t0 FROM ev WHERE code=128 GROUP BY 1)
SELECT eid, CASE WHEN t0 IS NOT NULL AND t<t0-1.0 THEN NULL ELSE value END AS y FROM ev LEFT JOIN f USING (ses)""")
def pf11(t):
    m = t.markers()
    first = m.where("code = 128").groupBy("ses").agg(F.min("t").alias("t0"))
    return m.join(first, "ses", "left").select("eid", F.when(F.col("t0").isNotNull() & (F.col("t") < F.col("t0") - 1.0), None).otherwise(F.col("value")).alias("y"))


@query("wn1_marker_gaps", f"WITH {EV} SELECT eid, round(t - lag(t) OVER (PARTITION BY ses ORDER BY t,eid),6) AS gap FROM ev WHERE code=128")
def wn1(t):
    return gaps(log_a(t).where("code = 128"), ["ses"], ["t", "eid"]).select("eid", R6(F.col("gap")).alias("gap"))


@query("wn6_previous_rating_mean", f"""WITH {PB} SELECT ses,probe,rating, round(coalesce(avg(rating) OVER (PARTITION BY ses ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),6) AS prev_mean FROM db""")
def wn6(t):
    d = dec.decode_b(dec.probes_b(log_b(t), LATE_H)).select("ses", "probe", "rating")
    return previous_mean(d, ["ses"], ["probe"], "rating").withColumn("prev_mean", R6(F.col("prev_mean")))


@query("jn6_asof_epoch", f"""WITH {EV}, m AS (SELECT ses,eid,t FROM ev WHERE code=128), o AS (SELECT ses,t AS ot,max(value) AS v FROM ev WHERE code<>128 GROUP BY 1,2)
SELECT m.ses, m.eid, round(coalesce((SELECT max(ot) FROM o WHERE o.ses=m.ses AND ot<m.t-1e-9), (SELECT min(ot) FROM o WHERE o.ses=m.ses)),6) AS asof_t,
 coalesce((SELECT arg_max(v,ot) FROM o WHERE o.ses=m.ses AND ot<m.t-1e-9), (SELECT arg_min(v,ot) FROM o WHERE o.ses=m.ses)) AS v FROM m""")
def jn6(t):
    d = t.markers()
    left = d.where("code = 128").select("ses", "eid", "t")
    right = d.where("code <> 128").groupBy("ses", "t").agg(F.max("value").alias("v"))
    return iv.asof_join(left, right, ["ses"], "t", ["v"]).select("ses", "eid", R6(F.col("asof_t")).alias("asof_t"), "v")


@query("ag5_answer_counts", f"WITH {PB} SELECT answer, count(*) AS n FROM db GROUP BY 1")
def ag5(t):
    return dec.decode_b(dec.probes_b(log_b(t), LATE_H)).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


@query("tk10_distinct_steps", f"WITH {EV} SELECT DISTINCT round(d,7) AS step FROM (SELECT t - lag(t) OVER (PARTITION BY ses ORDER BY t,eid) AS d FROM (SELECT ses,eid,round(t,1) AS t FROM ev)) WHERE d>0")
def tk10(t):
    d = log_a(t).withColumn("t", F.round("t", 1))
    return gaps(d, ["ses"], ["t", "eid"]).where("gap > 0").select(F.round("gap", 7).alias("step")).distinct()
