"""Structured Streaming jobs over `events`, each equal to its batch twin.

The stream is the events table written once as a folder of files, with one more file
holding a far-future marker row that moves the watermark past all real rows.
"""

from pyspark.sql import functions as F

from ..sources import files as fs
from ..sources.tables import EV, Tables
from ..streaming import jobs
from .decoding import PA, PB
from .registry import query
from .relational import ratings_b
from .statespace_queries import GRID, A, B, ONE, RQ, observations

R6 = lambda c: F.round(c, 6)
FLUSH = "2024-06-01 00:00:00"


def event_stream(t, repeat=False, code="code_b"):
    """Streaming (ses, eid, ts, code, value) of the real rows and the flush row."""
    base = fs.scratch(t.spark)
    m = t.markers().join(t.events.select(F.col("event_id").alias("eid"), F.col("ts").cast("timestamp").alias("ts")), "eid")
    m = m.select("ses", "eid", "ts", F.col(code).cast("int").alias("code"), "value")
    if repeat:
        m = m.unionByName(m.where("eid % 4 = 0"))
    m.write.parquet(f"{base}/in")
    flush = t.spark.range(1).select(F.lit(-1).cast("long").alias("ses"), F.lit(-1).cast("long").alias("eid"), F.lit(FLUSH).cast("timestamp").alias("ts"), F.lit(100).alias("code"), F.lit(0.0).alias("value"))
    read = lambda p: t.spark.readStream.schema(m.schema).parquet(p)
    flush.write.mode("append").parquet(f"{base}/in")
    return read(f"{base}/in"), base


def finish(t, stream, base, name="out"):
    return jobs.run_available(stream, f"{base}/{name}", f"{base}/{name}_cp", t.spark).where("ses >= 0")


HOUR = "(epoch_us(ts)-1704067200000000)/3600000000.0"


@query("st1_tumbling_epochs", "SELECT user_id AS ses, (epoch_us(ts)//21600000000)::BIGINT AS slot, round(max(value)-min(value),6) AS ptp, count(*) AS n FROM events GROUP BY 1,2")
def st1(t):
    s, base = event_stream(t)
    d = finish(t, jobs.epoch_amplitude(s, "1 hour", "6 hours"), base)
    return d.select("ses", F.floor(F.unix_micros("start") / 21600000000).cast("long").alias("slot"), R6(F.col("ptp")).alias("ptp"), "n")


@query("st2_sliding_power", "SELECT user_id AS ses, (epoch_us(ts)//21600000000-k)::BIGINT AS slot, round(sqrt(avg(value*value)),6) AS rms, count(*) AS n FROM events, range(0,2) q(k) GROUP BY 1,2")
def st2(t):
    s, base = event_stream(t)
    d = finish(t, jobs.segment_power(s, "1 hour", "12 hours", "6 hours"), base)
    return d.select("ses", F.floor(F.unix_micros("start") / 21600000000).cast("long").alias("slot"), R6(F.sqrt("power")).alias("rms"), "n")


@query("st3_probe_machine", f"WITH {PB} SELECT ses, probe, n_codes, n_late, n_practice, c1, c2, c3 FROM pb")
def st3(t):
    """Probe rows and late-only rows of a closed probe are summed to the final table."""
    s, base = event_stream(t)
    d = finish(t, jobs.probe_machine(s, "1 hour", 36 * 3600.0), base)
    return d.groupBy("ses", "probe").agg(
        F.max("n_codes").alias("n_codes"), F.sum("n_late").alias("n_late"), F.max("n_practice").alias("n_practice"),
        *[F.max(F.get("codes", F.lit(k))).alias(f"c{k + 1}") for k in range(3)])


@query("ev3_live_probes", f"WITH {PA} SELECT ses, probe, round(onset,4) AS onset, round(resp_end,4) AS resp_end, n_resp, involuntary, c1, c2, c3 FROM pa")
def ev3(t):
    """The marker sessionisation of the batch job on a live stream."""
    s, base = event_stream(t, code="code")
    d = finish(t, jobs.open_probe_machine(s, "1 hour", 24 * 3600.0), base)
    best = d.groupBy("ses", "probe").agg(F.max_by(F.struct("onset", "resp_end", "n_resp", "involuntary", "codes"), F.col("n_resp") + F.col("involuntary")).alias("b"))
    d = best.select("ses", "probe", "b.*")
    hours = lambda c: F.round((F.col(c) - 1704067200.0) / 3600.0, 4).alias(c)
    return d.select("ses", "probe", hours("onset"), hours("resp_end"), "n_resp", "involuntary", *[F.get("codes", F.lit(k)).alias(f"c{k + 1}") for k in range(3)])


@query("st4_inactivity_sessions", f"WITH {EV}, g AS (SELECT ses,t, CASE WHEN t-lag(t) OVER (PARTITION BY ses ORDER BY t)<8 THEN 0 ELSE 1 END AS b FROM ev), s AS (SELECT *, sum(b) OVER (PARTITION BY ses ORDER BY t) AS k FROM g) SELECT ses, round(min(t),4) AS start_h, round(max(t)+8,4) AS end_h, count(*) AS n FROM s GROUP BY ses,k")
def st4(t):
    s, base = event_stream(t)
    d = finish(t, jobs.inactivity_sessions(s, "1 hour", "8 hours"), base)
    h = lambda c: F.round((F.unix_micros(c) - 1704067200000000) / 3600000000.0, 4)
    return d.select("ses", h("start").alias("start_h"), h("end").alias("end_h"), "n")


@query("st5_online_filter", f"WITH RECURSIVE {ONE}, nx AS (SELECT e.ses,e.t,e.v0,s.m0,s.m1,s.p00,s.p01,s.p11,e.t-s.t AS dt FROM evn e JOIN kfr s ON s.ses=e.ses AND s.n=e.n-1 WHERE e.kind=1), f AS (SELECT nx.*, exp(-k_inh*dt) AS f00, exp(-k_d*dt) AS f11, -k_int*(exp(-k_inh*dt)-exp(-k_d*dt))/(k_d-k_inh) AS f10, s00,s01,s11 FROM nx, pr), g AS (SELECT ses,t,v0, f00*m0 AS m0, f10*m0+f11*m1 AS m1, f00*f00*(p00-s00)+s00 AS p00, f00*(f10*(p00-s00)+f11*(p01-s01))+s01 AS p01, f10*f10*(p00-s00)+2*f10*f11*(p01-s01)+f11*f11*(p11-s11)+s11 AS p11 FROM f), h AS (SELECT *, {A}*m1-{B}*m0 AS pm, {B}*{B}*p00-2*{A}*{B}*p01+{A}*{A}*p11+{RQ}*{RQ} AS pv FROM g) SELECT ses, round(t,6) AS t, round(v0,6) AS rating, round(pm,6) AS pred, round(pv,6) AS pred_var, round((v0-pm)/sqrt(pv),6) AS z FROM h")
def st5(t):
    base = fs.scratch(t.spark)
    observations(t).write.parquet(f"{base}/in")
    s = t.spark.readStream.schema("ses long, t double, kind int, v0 double, v1 double").parquet(f"{base}/in")
    d = finish(t, jobs.online_filter(s, GRID[4]), base)
    return d.select("ses", *[R6(F.col(c)).alias(c) for c in ("t", "rating", "pred", "pred_var", "z")])


@query("st6_masked_epochs", f"WITH {EV}, g AS (SELECT ses, eid, t FROM ev WHERE code<>128), w AS (SELECT ses, t AS ws, t+9 AS we FROM ev WHERE code=128) SELECT g.ses, g.eid, count(w.ws) AS n_windows FROM g LEFT JOIN w ON w.ses=g.ses AND g.t>ws AND g.t-6<we GROUP BY 1,2")
def st6(t):
    """Every non-marker row as an epoch end; windows open at markers for nine hours."""
    s, base = event_stream(t)
    e = s.where("code <> 100 or ses < 0")
    w = s.where("code = 100").withColumn("w_end", F.col("ts") + F.expr("interval 9 hours"))
    d = finish(t, jobs.masked_epochs(e, w, "1 hour", 6 * 3600, 9 * 3600), base)
    return d.groupBy("ses", "eid").agg(F.count("w_start").alias("n_windows"))


@query("st7_repeat_delivery", "SELECT user_id AS ses, event_id AS eid FROM events")
def st7(t):
    s, base = event_stream(t, repeat=True)
    return finish(t, jobs.drop_repeats(s, "1 hour", ["ses", "eid"]), base).select("ses", "eid")


@query("st8_running_rating_mean", f"WITH {PB} SELECT ses,probe,rating, round(coalesce(avg(rating) OVER (PARTITION BY ses ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),6) AS prev_mean FROM db WHERE rating IS NOT NULL")
def st8(t):
    base = fs.scratch(t.spark)
    ratings_b(t).select("ses", F.col("probe").cast("long").alias("probe"), "rating").write.parquet(f"{base}/in")
    s = t.spark.readStream.schema("ses long, probe long, rating double").parquet(f"{base}/in")
    return finish(t, jobs.running_rating_mean(s), base).withColumn("prev_mean", R6(F.col("prev_mean")))
