"""Artifact rules, epoching and channel mapping on the sampled signal."""

from pyspark.sql import functions as F

from ..operators import intervals as iv, signal as sg
from ..operators.quantiles import quantiles
from ..sources.tables import BLOCK, EPOCH_SAMPLES, SIG
from .registry import query

R6 = lambda c: F.round(c, 6)
LIMIT = 90.0
FEATURE_CH = (1, 2, 3, 4, 5)
# Channel names of the stand-in's line numbers.
NAMES = {1: "PZ", 2: "T3", 3: "Fz", 4: "t7", 5: "O1", 6: "POz", 7: "A1"}
NAMES_SQL = "CASE ch WHEN 1 THEN 'PZ' WHEN 2 THEN 'T3' WHEN 3 THEN 'Fz' WHEN 4 THEN 't7' WHEN 5 THEN 'O1' WHEN 6 THEN 'POz' ELSE 'A1' END"

PTP = SIG + ", ptp AS (SELECT rec, i//32 AS epoch, ch, max(v)-min(v) AS ptp FROM sig GROUP BY 1,2,3)"
ADA = PTP + """, mx AS (SELECT rec,epoch,max(ptp) AS mx FROM ptp WHERE ch<=5 GROUP BY 1,2),
md AS (SELECT rec, quantile_cont(mx,0.5) AS med FROM mx GROUP BY 1),
ma AS (SELECT rec, quantile_cont(abs(mx-med),0.5) AS mad FROM mx JOIN md USING (rec) GROUP BY 1),
ad AS (SELECT rec,epoch,mx,greatest(90.0,med+5.0*1.4826*mad) AS cut, mx>greatest(90.0,med+5.0*1.4826*mad) AS reject FROM mx JOIN md USING (rec) JOIN ma USING (rec))"""
MASK = ADA + """, pw AS (SELECT DISTINCT o_orderkey//512 AS rec, (o_orderkey%512)::DOUBLE AS ws FROM orders WHERE o_orderstatus='P'),
fx AS (SELECT rec,epoch,bool_or(ptp>90.0) AS locked, bool_and(ptp<90.0) AS keep FROM ptp GROUP BY 1,2),
ep AS (SELECT fx.rec,fx.epoch,locked,coalesce(ad.reject,false) AS adaptive, mx,
 EXISTS (SELECT 1 FROM pw WHERE pw.rec=fx.rec AND (fx.epoch+1)*32.0>ws AND (fx.epoch+1)*32.0-32.0<ws+3.0) AS masked FROM fx LEFT JOIN ad USING (rec,epoch))"""


def ptp(t):
    return sg.peak_to_peak(t.samples(), EPOCH_SAMPLES)


def epochs(t):
    """Every epoch with its three rejection flags."""
    p = ptp(t)
    marks = t.orders.where("o_orderstatus = 'P'").select(
        F.floor(F.col("o_orderkey") / BLOCK).cast("long").alias("ses"), F.pmod("o_orderkey", F.lit(BLOCK)).cast("double").alias("w_start"))
    hit = iv.covered_epochs(marks.withColumn("w_end", F.col("w_start") + 3.0), float(EPOCH_SAMPLES)).select(
        F.col("ses").alias("rec"), (F.col("epoch") - 1).alias("epoch"), F.lit(True).alias("masked"))
    f = sg.fixed_rule(p, LIMIT).select("rec", "epoch", F.col("reject").alias("locked"))
    a = sg.adaptive_rule(p, FEATURE_CH, LIMIT).select("rec", "epoch", "mx", F.col("reject").alias("adaptive"))
    d = f.join(a, ["rec", "epoch"], "left").join(hit, ["rec", "epoch"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("masked", "adaptive")})


def channel_names(t):
    n = F.coalesce(*[F.when(F.col("l_linenumber") == k, v) for k, v in NAMES.items()])
    return t.lineitem.select(F.floor(F.col("l_orderkey") / BLOCK).cast("long").alias("rec"), n.alias("name")).distinct()


@query("sg1_epoched_samples", f"""WITH {SIG}, k AS (SELECT rec, i//32 AS epoch, ch, v, row_number() OVER (PARTITION BY rec,i//32,ch ORDER BY i) AS k FROM sig)
SELECT rec,epoch,ch,count(*) AS n, round(sum(v),5) AS total, round(sum(k*v),5) AS weighted FROM k GROUP BY 1,2,3""")
def sg1(t):
    p = sg.epoch_samples(t.samples(), EPOCH_SAMPLES)
    add = lambda a, v: a + v
    return p.select("rec", "epoch", "ch", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), add), 5).alias("total"),
                    F.round(F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), add), 5).alias("weighted"))


@query("sg2_peak_to_peak", f"WITH {PTP} SELECT rec,epoch,ch,round(ptp,6) AS ptp FROM ptp")
def sg2(t):
    return ptp(t).withColumn("ptp", R6(F.col("ptp")))


@query("sg3_fixed_rule", f"WITH {MASK} SELECT rec,epoch,locked AS reject,keep FROM fx")
def sg3(t):
    return sg.fixed_rule(ptp(t), LIMIT)


@query("sg4_adaptive_rule", f"WITH {ADA} SELECT rec,epoch,round(mx,6) AS mx,round(cut,6) AS cut,reject FROM ad")
def sg4(t):
    return sg.adaptive_rule(ptp(t), FEATURE_CH, LIMIT).withColumns({"mx": R6(F.col("mx")), "cut": R6(F.col("cut"))})


@query("sg5_mask_reasons", f"""WITH {MASK} SELECT rec, count(*) AS n_epochs, count(*) FILTER (WHERE masked) AS probe_window,
 count(*) FILTER (WHERE NOT masked AND locked) AS amplitude, count(*) FILTER (WHERE NOT masked AND adaptive) AS amplitude_adaptive,
 count(*) FILTER (WHERE NOT masked AND NOT locked) AS observed FROM ep GROUP BY 1""")
def sg5(t):
    return sg.reason_counts(epochs(t))


@query("sg15_artifact_survey", f"""WITH {MASK} SELECT rec, round(avg(masked::INT),6) AS probe_only, round(avg((masked OR locked)::INT),6) AS fixed,
 round(avg((masked OR adaptive)::INT),6) AS adaptive, round(avg((masked OR locked OR adaptive)::INT),6) AS either, round(quantile_cont(mx,0.5),6) AS median_ptp FROM ep GROUP BY 1""")
def sg15(t):
    d = sg.artifact_survey(epochs(t))
    return d.withColumns({c: R6(F.col(c)) for c in d.columns if c != "rec"})


@query("sg16_preparation_rollup", f"""WITH {MASK}, b AS (SELECT rec, count(*) FILTER (WHERE locked)::DOUBLE AS nl, avg((masked OR locked)::INT) AS ml, avg((masked OR adaptive)::INT) AS ma,
 CASE WHEN bool_or(adaptive) THEN 'adaptive' ELSE 'plain' END AS method FROM ep GROUP BY 1)
SELECT count(*) AS n_sessions, round(quantile_cont(nl,0.5),6) AS locked_median, min(nl) AS locked_min, max(nl) AS locked_max, round(quantile_cont(ml,0.5),6) AS missing_locked_median,
 round(quantile_cont(ma,0.5),6) AS missing_adaptive_median, array_to_string(list_sort(list(DISTINCT method)),',') AS methods FROM b""")
def sg16(t):
    b = epochs(t).groupBy("rec").agg(
        F.count_if("locked").cast("double").alias("nl"), F.avg((F.col("masked") | F.col("locked")).cast("int")).alias("ml"),
        F.avg((F.col("masked") | F.col("adaptive")).cast("int")).alias("ma"),
        F.when(F.bool_or("adaptive"), "adaptive").otherwise("plain").alias("method"))
    s = b.agg(F.count(F.lit(1)).alias("n_sessions"), F.min("nl").alias("locked_min"), F.max("nl").alias("locked_max"),
              F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods")).withColumn("_j", F.lit(0))
    u = b.unpivot(["rec"], ["nl", "ml", "ma"], "metric", "v")
    names = {"nl": "locked_median", "ml": "missing_locked_median", "ma": "missing_adaptive_median"}
    q = quantiles(u, ["metric"], "v", {"m": 0.5}).groupBy(F.lit(0).alias("_j")).agg(
        *[R6(F.max(F.when(F.col("metric") == k, F.col("m")))).alias(v) for k, v in names.items()])
    return s.join(q, "_j").drop("_j")


@query("sg6_feature_channels", f"""WITH {SIG}, nm AS (SELECT DISTINCT rec, {NAMES_SQL} AS name FROM sig)
SELECT rec, name FROM nm WHERE name IN ('Pz','POz','P3','P4','PO3','PO4','O1','O2','Oz','AFz','Fz','FCz','Cz','Fp1','Fp2','F7','F3','F4','F8','T7','C3','C4','T8','P7','P8')""")
def sg6(t):
    wanted = t.spark.createDataFrame([(c,) for c in sorted(set(sg.POSTERIOR) | set(sg.FRONTAL) | set(sg.COMMON))], "name string")
    return channel_names(t).join(F.broadcast(wanted), "name", "left_semi").select("rec", "name")


BADCH = SIG + """, lv AS (SELECT rec,ch,ln(var_pop(v)+1e-30) AS lv FROM sig GROUP BY 1,2), md AS (SELECT rec,quantile_cont(lv,0.5) AS med FROM lv GROUP BY 1),
ma AS (SELECT rec,quantile_cont(abs(lv-med),0.5) AS mad FROM lv JOIN md USING (rec) GROUP BY 1),
bz AS (SELECT rec,ch,abs(lv-med)/(1.4826*mad+1e-12) AS z FROM lv JOIN md USING (rec) JOIN ma USING (rec))"""


@query("sg7_bad_channels", f"WITH {BADCH} SELECT rec,ch,round(z,4) AS z,z>2.0 AS bad FROM bz")
def sg7(t):
    return sg.bad_channels(t.samples(), 2.0).withColumn("z", F.round("z", 4))


@query("sg8_recording_exclusion", f"WITH {BADCH} SELECT rec, count(*) FILTER (WHERE z>2.0) AS n_bad, count(*) AS n_ch, count(*) FILTER (WHERE z>2.0)>0.2*count(*) AS excluded FROM bz GROUP BY 1")
def sg8(t):
    b = sg.bad_channels(t.samples(), 2.0)
    return b.groupBy("rec").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n_ch")).withColumn("excluded", F.col("n_bad") > 0.2 * F.col("n_ch"))


@query("sg9_average_reference", f"WITH {SIG} SELECT rec,i,ch,round(v-avg(v) OVER (PARTITION BY rec,i),9) AS v FROM sig")
def sg9(t):
    return sg.average_reference(t.samples()).select("rec", "i", "ch", F.round("v", 9).alias("v"))


@query("sg10_nearest_electrode", """WITH p AS (SELECT vec_id AS unit, c AS ch, embedding[c*8+1]::DOUBLE AS x, embedding[c*8+2]::DOUBLE AS y, embedding[c*8+3]::DOUBLE AS z FROM embeddings, range(0,8) r(c)),
c AS (SELECT unit, avg(x) mx, avg(y) my, avg(z) mz FROM p WHERE ch>=3 GROUP BY 1),
u AS (SELECT unit, ch, (x-mx)/n AS x, (y-my)/n AS y, (z-mz)/n AS z FROM (SELECT p.*, mx,my,mz, sqrt((x-mx)^2+(y-my)^2+(z-mz)^2) AS n FROM p JOIN c USING (unit))),
k AS (SELECT t.unit, t.ch AS target, s.ch AS source, t.x*s.x+t.y*s.y+t.z*s.z AS cosine FROM u t JOIN u s ON t.unit=s.unit AND t.ch<3 AND s.ch>=3)
SELECT unit,target,source,round(cosine,6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY unit,target ORDER BY cosine DESC, source) r FROM k) WHERE r=1""")
def sg10(t):
    p = t.multichannel().select("unit", "ch", *[F.col("x")[k].alias(a) for k, a in enumerate("xyz")])
    d = sg.nearest_electrodes(p.where("ch >= 3"), p.where("ch < 3"), "unit")
    return d.withColumn("cosine", R6(F.col("cosine")))


NET = "'E22','E9','E33','E24','E11','E124','E122','E45','E36','Cz','E104','E108','E58','E52','E62','E92','E96','E70','E83'"
STD = "'Fp1','Fp2','F7','F3','Fz','F4','F8','T7','C3','Cz','C4','T8','P7','P3','Pz','P4','P8','O1','O2'"


@query("sg11_net_channels", f"""WITH nm AS (SELECT DISTINCT l_suppkey AS rec, CASE WHEN l_suppkey%2=0 OR l_quantity<10 THEN concat('E',(l_partkey%128)::VARCHAR) ELSE concat('X',(l_partkey%128)::VARCHAR) END AS name FROM lineitem),
sh AS (SELECT rec FROM nm GROUP BY 1 HAVING avg(regexp_matches(name,'^E[0-9]+$')::INT)>0.5)
SELECT rec, name AS source, [{STD}][list_position([{NET}],name)] AS target FROM nm JOIN sh USING (rec) WHERE list_position([{NET}],name) IS NOT NULL AND list_position([{NET}],name)>0""")
def sg11(t):
    e = F.concat(F.when((F.col("l_suppkey") % 2 == 0) | (F.col("l_quantity") < 10), "E").otherwise("X"), (F.col("l_partkey") % 128).cast("string"))
    return sg.net_channels(t.lineitem.select(F.col("l_suppkey").alias("rec"), e.alias("name")).distinct(), "rec")


@query("pf6_channel_rename", f"""WITH {SIG}, nm AS (SELECT DISTINCT rec, {NAMES_SQL} AS name FROM sig),
x AS (SELECT rec,name,CASE upper(name) WHEN 'PZ' THEN 'Pz' WHEN 'FZ' THEN 'Fz' WHEN 'T7' THEN 'T7' WHEN 'O1' THEN 'O1' WHEN 'T3' THEN 'T7' END AS target, CASE WHEN upper(name)='T3' THEN 1 ELSE 0 END AS rk FROM nm)
SELECT rec,target,name AS source FROM (SELECT *, row_number() OVER (PARTITION BY rec,target ORDER BY rk,name) r FROM x WHERE target IS NOT NULL) WHERE r=1""")
def pf6(t):
    return sg.rename_channels(channel_names(t), "rec")


REP = """raw0 AS (SELECT user_id AS ses, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS k, round(value,2) AS a, event_type AS b FROM events),
raw AS (SELECT ses, 4*k+r-(1+ses%3) AS i, a, b FROM raw0, range(0,4) q(r) WHERE 4*k+r-(1+ses%3)>=0)"""


def repeated(t):
    """Every marker row repeated four times with a per-session phase shift."""
    from ..operators.ordered import numbered

    d = numbered(t.markers().join(t.events.select(F.col("event_id").alias("eid"), F.col("event_type").alias("b")), "eid"), ["ses"], ["t", "eid"], "k")
    e = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "ses", (4 * (F.col("k") - 1) + F.col("r") - (1 + F.col("ses") % 3)).cast("long").alias("i"), F.round("value", 2).alias("a"), "b")
    return e.where("i >= 0")


PH = """, lg AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(i) OVER w AS pi FROM raw WINDOW w AS (PARTITION BY ses ORDER BY i)),
pc AS (SELECT ses, i%4 AS phase, count(*) AS n FROM lg WHERE pi IS NOT NULL AND (pa<>a OR pb<>b) GROUP BY 1,2),
ph AS (SELECT ses, phase FROM (SELECT *, row_number() OVER (PARTITION BY ses ORDER BY n DESC, phase) r FROM pc) WHERE r=1)"""


@query("sg12_repeat_decimation", f"WITH {REP}{PH} SELECT ses,i,a,b FROM raw LEFT JOIN ph USING (ses) WHERE i%4=coalesce(phase,0)")
def sg12(t):
    return sg.decimate(repeated(t), "ses", "i", ["a", "b"], 4)


@query("sg13_trim_missing_tail", """WITH s AS (SELECT l_suppkey AS rec, l_orderkey AS i, count(*) AS n, bool_or(l_discount>=0.05) AS bad FROM lineitem GROUP BY 1,2),
e AS (SELECT rec, min(i) FILTER (WHERE bad) AS f, max(i) FILTER (WHERE bad) AS lb, max(i) AS la FROM s GROUP BY 1)
SELECT s.rec,i,n FROM s JOIN e USING (rec) WHERE lb IS NULL OR lb<la OR i<f""")
def sg13(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("rec"), F.col("l_orderkey").alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_discount") >= 0.05).alias("bad"))
    return sg.trim_missing_tail(s, "rec", "i", F.col("bad")).select("rec", "i", "n")


@query("sg14_equalised_conditions", """WITH h AS (SELECT c_custkey, c_mktsegment AS cond, ('0x'||substr(md5(concat_ws('|','sg14',c_custkey)),1,8))::BIGINT AS u FROM customer),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM h GROUP BY cond))
SELECT cond, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY u,c_custkey) r FROM h), m WHERE r<=m""")
def sg14(t):
    return sg.equalise(t.customer.select("c_custkey", F.col("c_mktsegment").alias("cond")), "cond", "c_custkey", "sg14").select("cond", "c_custkey")


@query("pf21_channel_dictionary", f"""WITH {SIG} SELECT rec, count(DISTINCT ch) AS n_channels, count(DISTINCT ch)=7 AS complete FROM sig GROUP BY 1""")
def pf21(t):
    d = t.samples().select("rec", "ch").distinct()
    return d.groupBy("rec").agg(F.count(F.lit(1)).alias("n_channels")).withColumn("complete", F.col("n_channels") == 7)
