"""Grouped summaries, joins, top-k, set operations and ordered analytics."""

from pyspark.sql import Window, functions as F

from ..functions.exprs import pearson
from ..operators import decode as dec
from ..operators.joins import paired, tolerance_join
from ..operators.ordered import numbered, running, top_n, union_all
from ..operators.quantiles import quantiles
from ..sources.tables import EV, LATE_H
from .decoding import KEPT, PB, keep_sessions, log_a, log_b
from .registry import query

R6 = lambda c: F.round(c, 6)
METRICS = {"m_qty": "l_quantity", "m_price": "l_extendedprice", "m_disc": "l_discount", "m_tax": "l_tax"}


def features(t):
    """Feature rows: subject = supplier, condition = return flag, four measures."""
    return t.lineitem.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("cond"), *[F.col(c).alias(n) for n, c in METRICS.items()])


FEAT = "feat AS (SELECT l_suppkey AS subject, l_returnflag AS cond, l_quantity AS m_qty, l_extendedprice AS m_price, l_discount AS m_disc, l_tax AS m_tax FROM lineitem)"


@query("ag1_subject_means", f"WITH {FEAT} SELECT subject,cond,count(*) AS n_epochs,round(avg(m_qty),6) AS m_qty,round(avg(m_price),4) AS m_price,round(avg(m_disc),6) AS m_disc,round(avg(m_tax),6) AS m_tax FROM feat GROUP BY 1,2")
def ag1(t):
    return features(t).groupBy("subject", "cond").agg(F.count(F.lit(1)).alias("n_epochs"), *[F.round(F.avg(m), 4 if m == "m_price" else 6).alias(m) for m in METRICS])


@query("ag2_state_ranking", "SELECT o_orderpriority AS state, round(avg(o_totalprice),4) AS mean_value, row_number() OVER (ORDER BY avg(o_totalprice) DESC) AS rank FROM orders GROUP BY 1")
def ag2(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("state")).agg(F.avg("o_totalprice").alias("m"))
    return g.select("state", F.round("m", 4).alias("mean_value"), F.row_number().over(Window.orderBy(F.desc("m"))).alias("rank"))


@query("ag3_two_key_ratio", "SELECT l_returnflag, l_linestatus, round(avg(l_tax/(l_discount+0.01)),6) AS ratio_mean, round(stddev_samp(l_tax/(l_discount+0.01)),6) AS ratio_sd, count(*) AS n FROM lineitem GROUP BY 1,2")
def ag3(t):
    r = F.col("l_tax") / (F.col("l_discount") + 0.01)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(R6(F.avg(r)).alias("ratio_mean"), R6(F.stddev_samp(r)).alias("ratio_sd"), F.count(F.lit(1)).alias("n"))


@query("ag4_pivot_means", f"WITH {FEAT} SELECT subject, round(avg(m_qty) FILTER (WHERE cond='A'),6) AS a, round(avg(m_qty) FILTER (WHERE cond='N'),6) AS n, round(avg(m_qty) FILTER (WHERE cond='R'),6) AS r FROM feat GROUP BY 1")
def ag4(t):
    p = features(t).groupBy("subject").pivot("cond", ["A", "N", "R"]).agg(F.avg("m_qty"))
    return p.select("subject", *[R6(F.col(c)).alias(c.lower()) for c in "ANR"])


@query("ag6_percentile_interval", f"WITH {FEAT} SELECT cond, round(quantile_cont(m_price,0.025),4) AS lo, round(quantile_cont(m_price,0.1),4) AS q10, round(quantile_cont(m_price,0.5),4) AS med, round(quantile_cont(m_price,0.9),4) AS q90, round(quantile_cont(m_price,0.975),4) AS hi FROM feat GROUP BY 1")
def ag6(t):
    q = quantiles(features(t), ["cond"], "m_price", {"lo": 0.025, "q10": 0.1, "med": 0.5, "q90": 0.9, "hi": 0.975}, scan_twice=True)
    return q.select("cond", *[F.round(c, 4).alias(c) for c in ("lo", "q10", "med", "q90", "hi")])


def ratings_b(t):
    return dec.decode_b(dec.probes_b(log_b(t), LATE_H)).select("ses", "probe", "onset", "rating").where("rating is not null")


@query("ag7_level_proportions", f"WITH {PB}, n AS (SELECT count(*) AS n FROM db WHERE rating IS NOT NULL) SELECT l::INT AS level, round((SELECT count(*) FROM db WHERE rating=l)/nullif(n,0)::DOUBLE,6) AS share FROM range(-7,8) r(l), n")
def ag7(t):
    counts = ratings_b(t).groupBy(F.col("rating").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("c"))
    levels = t.spark.range(-7, 8).select(F.col("id").cast("int").alias("level"))
    d = levels.join(F.broadcast(counts), "level", "left")
    return d.select("level", R6(F.coalesce("c", F.lit(0)) / F.sum("c").over(Window.partitionBy())).alias("share"))


SDG = PB + ", sd AS (SELECT ses, ses%2 AS grp, stddev_pop(rating) AS sd FROM db WHERE rating IS NOT NULL GROUP BY 1)"


@query("ag8_within_session_sd", f"WITH {SDG} SELECT round(avg(sd) FILTER (WHERE grp=0),6) AS sd_expert, round(avg(sd) FILTER (WHERE grp=1),6) AS sd_novice, round(avg(sd) FILTER (WHERE grp=0)-avg(sd) FILTER (WHERE grp=1),6) AS diff FROM sd")
def ag8(t):
    s = ratings_b(t).groupBy("ses").agg(F.stddev_pop("rating").alias("sd")).withColumn("grp", F.col("ses") % 2)
    e, n = [F.avg(F.when(F.col("grp") == g, F.col("sd"))) for g in (0, 1)]
    return s.agg(R6(e).alias("sd_expert"), R6(n).alias("sd_novice"), R6(e - n).alias("diff"))


@query("ag9_session_totals_by_group", f"""WITH {KEPT}, p AS (SELECT ses, count(*) AS n_probes, avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END) AS missing FROM db GROUP BY 1),
e AS (SELECT ses, count(*) AS n_epochs FROM mg GROUP BY 1),
s AS (SELECT kd.ses, kd.ses%2 AS grp, kd.ses//3 AS sub, coalesce(mf<=0.40 AND nr>=8, false) AS kept, n_probes, n_epochs, missing FROM kd LEFT JOIN p USING (ses) LEFT JOIN e USING (ses))
SELECT grp, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped, count(DISTINCT sub) AS n_subjects, coalesce(sum(n_probes),0)::BIGINT AS n_probes, coalesce(sum(n_epochs),0)::BIGINT AS n_epochs, round(quantile_cont(missing,0.5),6) AS missing_median FROM s GROUP BY 1""")
def ag9(t):
    p = dec.decode_b(dec.probes_b(log_b(t), LATE_H)).groupBy("ses").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("valid")).cast("int")).alias("missing"))
    s = keep_sessions(t).select("ses", "n_epochs", F.coalesce("kept", F.lit(False)).alias("kept")).join(p, "ses", "left")
    s = s.withColumns({"grp": F.col("ses") % 2, "sub": F.floor(F.col("ses") / 3)})
    a = s.groupBy("grp").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"), F.count_distinct("sub").alias("n_subjects"),
                             F.coalesce(F.sum("n"), F.lit(0)).alias("n_probes"), F.coalesce(F.sum("n_epochs"), F.lit(0)).alias("n_epochs"))
    return a.join(quantiles(s, ["grp"], "missing", {"missing_median": 0.5}), "grp").withColumn("missing_median", R6(F.col("missing_median")))


@query("ag10_pooled_within_sd", f"WITH {PB}, c AS (SELECT rating - avg(rating) OVER (PARTITION BY ses) AS d FROM db WHERE rating IS NOT NULL) SELECT round(sqrt(avg(d*d)),6) AS pooled_sd FROM c")
def ag10(t):
    # Sums of squares per session need no window: sum(x^2) - n * mean^2.
    s = ratings_b(t).groupBy("ses").agg(F.count(F.lit(1)).alias("n"), F.var_pop("rating").alias("v"))
    return s.agg(R6(F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n"))).alias("pooled_sd"))


@query("ag11_matched_scale_rmse", """WITH e AS (SELECT l_linenumber AS param, avg(l_extendedprice) OVER (PARTITION BY l_linenumber) AS truth, l_extendedprice AS est FROM lineitem)
SELECT param, CASE WHEN param<=4 THEN 'log' ELSE 'relative' END AS scale, round(CASE WHEN param<=4 THEN sqrt(avg((ln(abs(est))-ln(abs(truth)))^2)) ELSE sqrt(avg((est-truth)^2))/greatest(abs(max(truth)),1e-12) END,6) AS rmse FROM e GROUP BY 1""")
def ag11(t):
    truth = t.lineitem.groupBy(F.col("l_linenumber").alias("param")).agg(F.avg("l_extendedprice").alias("truth"))
    e = t.lineitem.select(F.col("l_linenumber").alias("param"), F.col("l_extendedprice").alias("est")).join(F.broadcast(truth), "param")
    log = F.col("param") <= 4
    err = F.when(log, F.log(F.abs("est")) - F.log(F.abs("truth"))).otherwise(F.col("est") - F.col("truth"))
    g = e.groupBy("param").agg(F.sqrt(F.avg(err * err)).alias("r"), F.max("truth").alias("truth"))
    return g.select("param", F.when(log, "log").otherwise("relative").alias("scale"),
                    R6(F.when(log, F.col("r")).otherwise(F.col("r") / F.greatest(F.abs("truth"), F.lit(1e-12)))).alias("rmse"))


@query("ag12_running_bytes", "SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS cum_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents")
def ag12(t):
    return running(t.documents.select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], sums={"cum_chars": F.col("n_chars"), "pos": F.lit(1).cast("long")}).select("doc_id", "cum_chars", "pos")


@query("ag13_progress", "SELECT r_name AS dataset, count(DISTINCT c_custkey) AS n_subjects, count(o_orderkey) AS n_units FROM region LEFT JOIN nation ON n_regionkey=r_regionkey LEFT JOIN customer ON c_nationkey=n_nationkey LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def ag13(t):
    units = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = t.customer.join(units, "c_custkey", "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("u"))
    d = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return d.groupBy(F.col("r_name").alias("dataset")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_subjects"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_units"))


@query("ag14_quantile_band", "WITH d AS (SELECT date_diff('day',TIMESTAMP '2024-01-01',ts) AS day, user_id, avg(value) AS v FROM events GROUP BY 1,2) SELECT day, round(quantile_cont(v,0.05),6) AS q05, round(quantile_cont(v,0.5),6) AS q50, round(quantile_cont(v,0.95),6) AS q95 FROM d GROUP BY 1")
def ag14(t):
    d = t.markers().groupBy(F.floor(F.col("t") / 24).cast("long").alias("day"), "ses").agg(F.avg("value").alias("v"))
    q = quantiles(d, ["day"], "v", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return q.select("day", *[R6(F.col(c)).alias(c) for c in ("q05", "q50", "q95")])


# ---------------------------------------------------------------- joins
def designs(t, flags):
    p = t.lineitem.where(F.col("l_returnflag").isin(*flags))
    return p.groupBy(F.col("l_suppkey").alias("n"), F.col("l_quantity").alias("session_min"), (F.col("l_linenumber") * 0.5).alias("probe_every"), F.col("l_tax").alias("r_obs"))


def crb_table(t):
    return designs(t, ["A", "N"]).agg((F.avg("l_extendedprice") / 1e5).alias("crb_k"), (F.avg("l_discount") + 0.01).alias("crb_a"))


def mle_table(t):
    d = designs(t, ["R"]).agg((F.avg("l_extendedprice") / 1e5).alias("mle_k"), (F.avg("l_discount") + 0.01).alias("mle_a"))
    return d.withColumn("session_min", F.col("session_min") + 0.03)


DSG = """crb AS (SELECT l_suppkey AS n, l_quantity AS session_min, l_linenumber*0.5::DOUBLE AS probe_every, l_tax AS r_obs, avg(l_extendedprice)/1e5 AS crb_k, avg(l_discount)+0.01 AS crb_a FROM lineitem WHERE l_returnflag IN ('A','N') GROUP BY 1,2,3,4),
mle AS (SELECT l_suppkey AS n, l_quantity+0.03 AS session_min, l_linenumber*0.5::DOUBLE AS probe_every, l_tax AS r_obs, avg(l_extendedprice)/1e5 AS mle_k, avg(l_discount)+0.01 AS mle_a FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2,3,4),
tj AS (SELECT * FROM (SELECT m.*, c.crb_k, c.crb_a, row_number() OVER (PARTITION BY m.n,m.session_min,m.probe_every,m.r_obs ORDER BY c.session_min,c.probe_every,c.r_obs) AS r
 FROM mle m JOIN crb c ON c.n=m.n AND abs(c.session_min-m.session_min)<0.1 AND abs(c.probe_every-m.probe_every)<0.01 AND abs(c.r_obs-m.r_obs)<1e-9) WHERE r=1)"""


def matched_designs(t):
    return tolerance_join(mle_table(t), crb_table(t), ["n"], {"session_min": 0.1, "probe_every": 0.01, "r_obs": 1e-9}, ["session_min_r", "probe_every_r", "r_obs_r"])


@query("jn1_composite_equi_join", """WITH a AS (SELECT l_suppkey,l_linenumber,sum(l_quantity) AS qa FROM lineitem WHERE l_returnflag='A' GROUP BY 1,2), b AS (SELECT l_suppkey,l_linenumber,sum(l_quantity) AS qb FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2)
SELECT l_suppkey,l_linenumber,qa,qb,round(qa/qb,6) AS ratio FROM a JOIN b USING (l_suppkey,l_linenumber)""")
def jn1(t):
    side = lambda f, n: t.lineitem.where(F.col("l_returnflag") == f).groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias(n))
    return side("A", "qa").join(side("R", "qb"), ["l_suppkey", "l_linenumber"]).withColumn("ratio", R6(F.col("qa") / F.col("qb")))


@query("jn2_tolerance_join", f"WITH {DSG} SELECT n, round(session_min,2) AS session_min, probe_every, r_obs, round(mle_k/crb_k,6) AS ratio_k FROM tj")
def jn2(t):
    return matched_designs(t).select("n", F.round("session_min", 2).alias("session_min"), "probe_every", "r_obs", R6(F.col("mle_k") / F.col("crb_k")).alias("ratio_k"))


@query("jn3_dimension_lookup", "SELECT event_id, coalesce(CASE WHEN u%7=0 THEN NULL ELSE c_mktsegment END,'n/a') AS grp FROM (SELECT event_id, user_id AS u FROM events) LEFT JOIN customer ON c_custkey=u")
def jn3(t):
    dim = t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return t.events.select("event_id", "user_id").join(dim, "user_id", "left").select("event_id", F.coalesce("c_mktsegment", F.lit("n/a")).alias("grp"))


@query("jn4_condition_difference", f"WITH {FEAT}, a AS (SELECT subject,avg(m_price) AS p,avg(m_qty) AS q FROM feat WHERE cond='A' GROUP BY 1), b AS (SELECT subject,avg(m_price) AS p,avg(m_qty) AS q FROM feat WHERE cond='R' GROUP BY 1) SELECT subject, round(a.p-b.p,4) AS d_price, round(a.q-b.q,6) AS d_qty FROM a JOIN b USING (subject)")
def jn4(t):
    side = lambda c, s: features(t).where(F.col("cond") == c).groupBy("subject").agg(F.avg("m_price").alias(f"p{s}"), F.avg("m_qty").alias(f"q{s}"))
    return side("A", 1).join(side("R", 2), "subject").select("subject", F.round(F.col("p1") - F.col("p2"), 4).alias("d_price"), R6(F.col("q1") - F.col("q2")).alias("d_qty"))


PAIR = """pr AS (SELECT * FROM (SELECT o_custkey AS subject, avg(ln(o_totalprice)) FILTER (WHERE o_orderstatus='F') AS a, avg(ln(o_totalprice)) FILTER (WHERE o_orderstatus='O') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL)"""


def order_pairs(t):
    return paired(t.orders.select(F.col("o_custkey").alias("subject"), "o_orderstatus", F.log("o_totalprice").alias("v")), "subject", "o_orderstatus", "v", "F", "O")


@query("jn5_paired_pivot", f"WITH {PAIR} SELECT subject, round(a,6) AS a, round(b,6) AS b FROM pr")
def jn5(t):
    return order_pairs(t).select("subject", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("jn10_channel_pairs", "WITH m AS (SELECT vec_id AS unit, c AS ch, embedding[c*8+1]::DOUBLE AS x FROM embeddings, range(0,8) r(c)) SELECT a.unit, a.ch AS i, b.ch AS j, round(a.x*b.x,6) AS prod FROM m a JOIN m b ON a.unit=b.unit AND a.ch<b.ch")
def jn10(t):
    m = t.multichannel().select("unit", "ch", F.col("x")[0].alias("x"))
    return m.select("unit", F.col("ch").alias("i"), F.col("x").alias("xi")).join(m.select("unit", F.col("ch").alias("j"), F.col("x").alias("xj")), "unit").where("i < j").select(
        "unit", "i", "j", R6(F.col("xi") * F.col("xj")).alias("prod"))


@query("jn11_design_axes", "WITH a AS (SELECT DISTINCT l_suppkey%8 AS n FROM lineitem), b AS (SELECT DISTINCT l_linenumber AS session_no FROM lineitem), c AS (SELECT DISTINCT o_orderpriority AS probe FROM orders) SELECT n, session_no, probe FROM a, b, c")
def jn11(t):
    # Each axis is a set of distinct literals; the product is expanded from one row.
    axes = t.lineitem.agg(F.collect_set(F.col("l_suppkey") % 8).alias("a"), F.collect_set("l_linenumber").alias("b")).withColumn("_j", F.lit(0))
    pr = t.orders.agg(F.collect_set("o_orderpriority").alias("c")).withColumn("_j", F.lit(0))
    d = axes.join(F.broadcast(pr), "_j")
    return d.select(F.explode("a").alias("n"), "b", "c").select("n", F.explode("b").alias("session_no"), "c").select("n", "session_no", F.explode("c").alias("probe"))


@query("jn12_unfinished_units", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_suppkey=l.l_suppkey AND d.l_returnflag=l.l_returnflag AND d.l_quantity=50 AND d.l_linenumber=1)")
def jn12(t):
    units = t.lineitem.select("l_suppkey", "l_returnflag").distinct()
    done = t.lineitem.where("l_quantity = 50 and l_linenumber = 1").select("l_suppkey", "l_returnflag").distinct()
    return units.join(done, ["l_suppkey", "l_returnflag"], "left_anti")


@query("jn13_reference_side_by_side", "WITH m AS (SELECT p_brand AS state, avg(p_retailprice) AS measured FROM part GROUP BY 1), r AS (SELECT p_brand AS state, max(p_retailprice) AS reference FROM part WHERE p_size>40 GROUP BY 1) SELECT state, round(measured,6) AS measured, reference, row_number() OVER (ORDER BY measured DESC, state) AS rank FROM m LEFT JOIN r USING (state)")
def jn13(t):
    m = t.part.groupBy(F.col("p_brand").alias("state")).agg(F.avg("p_retailprice").alias("m"))
    r = t.part.where("p_size > 40").groupBy(F.col("p_brand").alias("state")).agg(F.max("p_retailprice").alias("reference"))
    return m.join(r, "state", "left").select("state", R6(F.col("m")).alias("measured"), "reference", F.row_number().over(Window.orderBy(F.desc("m"), "state")).alias("rank"))


# ---------------------------------------------------------------- top-k and sets
@query("tk1_cheapest_designs", f"WITH {DSG} SELECT n, session_min, probe_every, r_obs, round(crb_k,6) AS crb_k, n*session_min AS cost FROM crb WHERE crb_k<=0.20 AND n>0 ORDER BY cost, n, session_min, probe_every, r_obs LIMIT 10")
def tk1(t):
    ok = crb_table(t).where("crb_k <= 0.20 and n > 0").withColumn("cost", F.col("n") * F.col("session_min"))
    return ok.orderBy("cost", "n", "session_min", "probe_every", "r_obs").limit(10).select("n", "session_min", "probe_every", "r_obs", R6(F.col("crb_k")).alias("crb_k"), "cost")


@query("tk2_cheapest_per_parameter", f"""WITH {DSG}, u AS (SELECT 'k' AS param, n*session_min AS cost, crb_k AS crb, n, session_min FROM crb WHERE crb_k<=0.2 UNION ALL SELECT 'a', n*session_min, crb_a, n, session_min FROM crb WHERE crb_a<=0.02 UNION ALL SELECT 'z', n*session_min, crb_a, n, session_min FROM crb WHERE crb_a<0),
b AS (SELECT param, min(cost) AS cost FROM u GROUP BY 1), m AS (SELECT param, cost, min(crb) AS crb FROM u JOIN b USING (param,cost) GROUP BY 1,2)
SELECT p.param, cost, round(crb,6) AS crb, cost IS NULL AS placeholder FROM (VALUES ('k'),('a'),('z')) p(param) LEFT JOIN m USING (param)""")
def tk2(t):
    c = crb_table(t).withColumn("cost", F.col("n") * F.col("session_min"))
    u = c.select("cost", F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(x).alias("crb"), F.lit(lim).alias("lim")) for p, x, lim in (("k", "crb_k", 0.2), ("a", "crb_a", 0.02), ("z", "crb_a", -1e-300))])))
    m = u.where("crb <= lim").groupBy("param").agg(F.min(F.struct("cost", "crb")).alias("b"))
    params = t.spark.createDataFrame([("k",), ("a",), ("z",)], "param string")
    return params.join(F.broadcast(m), "param", "left").select("param", "b.cost", R6(F.col("b.crb")).alias("crb"), F.col("b").isNull().alias("placeholder"))


@query("tk3_top_parameters", "SELECT output, param, round(total,4) AS total, rank FROM (SELECT l_returnflag AS output, l_suppkey AS param, sum(l_extendedprice) AS total, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_extendedprice) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1,2) WHERE rank<=3")
def tk3(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("output"), F.col("l_suppkey").alias("param")).agg(F.sum("l_extendedprice").alias("total"))
    return top_n(g, ["output"], [F.desc("total"), F.col("param")], 3).select("output", "param", F.round("total", 4).alias("total"), "rank")


@query("tk4_top_mechanisms", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def tk4(t):
    return t.part.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("tk5_best_schedule", "WITH s AS (SELECT l_suppkey AS family, l_linenumber AS sched, avg(l_extendedprice)/1e4 AS score FROM lineitem GROUP BY 1,2), b AS (SELECT family, arg_min(sched,score) AS best, min(score) AS best_score FROM s GROUP BY 1), u AS (SELECT family, score AS uni FROM s WHERE sched=1) SELECT family, best, round(best_score,6) AS best_score, round(exp(-(best_score-uni)/4.0),6) AS efficiency FROM b LEFT JOIN u USING (family)")
def tk5(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("sched")).agg((F.avg("l_extendedprice") / 1e4).alias("score"))
    b = s.groupBy("family").agg(F.min_by("sched", "score").alias("best"), F.min("score").alias("best_score"), F.max(F.when(F.col("sched") == 1, F.col("score"))).alias("uni"))
    return b.select("family", "best", R6(F.col("best_score")).alias("best_score"), R6(F.exp(-(F.col("best_score") - F.col("uni")) / 4.0)).alias("efficiency"))


@query("tk6_custom_order", "SELECT s_suppkey, row_number() OVER (ORDER BY CASE s_nationkey%3 WHEN 2 THEN 0 ELSE 1 END, s_name LIKE '%5', s_suppkey) AS pos FROM supplier")
def tk6(t):
    d = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") % 3 == 2, 0).otherwise(1).alias("g"), F.col("s_name").endswith("5").cast("int").alias("f"))
    # Positions per (group, flag) block plus the sizes of the blocks before it.
    n = numbered(d, ["g", "f"], ["s_suppkey"], "_k")
    w = Window.orderBy("g", "f").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("g", "f").agg(F.count(F.lit(1)).alias("c")).select("g", "f", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("b"))
    return n.join(F.broadcast(blocks), ["g", "f"]).select("s_suppkey", (F.col("_k") + F.col("b")).alias("pos"))


@query("tk7_union_by_name", "SELECT 'c' AS kind, c_custkey AS id, c_mktsegment AS seg, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_brand FROM part")
def tk7(t):
    return union_all([t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg")),
                      t.part.select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))])


@query("tk8_distinct_units", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def tk8(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("tk9_channel_difference", "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem EXCEPT SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity>=40")
def tk9(t):
    c = t.lineitem.select("l_suppkey", "l_linenumber").distinct()
    return c.join(t.lineitem.where("l_quantity >= 40").select("l_suppkey", "l_linenumber").distinct(), ["l_suppkey", "l_linenumber"], "left_anti")


# ---------------------------------------------------------------- ordered analytics
FS = """fs AS (SELECT ses, k AS epoch, avg(ln(1+value)) FILTER (WHERE code IN (2,4)) AS y_a, avg(ln(1+value)) FILTER (WHERE code IN (8,16)) AS y_p
 FROM (SELECT *, floor(t/24)::BIGINT AS k FROM ev) GROUP BY 1,2)"""


def feature_epochs(t):
    """One row per session and day with two features (NULL where unobserved)."""
    c, lv = F.col("code"), F.log(1 + F.col("value"))
    return t.markers().groupBy("ses", F.floor(F.col("t") / 24).cast("long").alias("epoch")).agg(
        F.avg(F.when(c.isin(2, 4), lv)).alias("y_a"), F.avg(F.when(c.isin(8, 16), lv)).alias("y_p"))


def with_previous(t):
    d = feature_epochs(t)
    d = running(d, ["ses"], ["epoch"], lags={"pa": F.col("y_a"), "pp": F.col("y_p"), "pe": F.col("epoch")})
    near = F.col("pe") == F.col("epoch") - 1
    return d.withColumns({"pa": F.when(near, F.col("pa")), "pp": F.when(near, F.col("pp"))})


LAGGED = FS + """, lg0 AS (SELECT *, lag(y_a) OVER w AS pa0, lag(y_p) OVER w AS pp0, lag(epoch) OVER w AS pe FROM fs WINDOW w AS (PARTITION BY ses ORDER BY epoch)),
lg AS (SELECT ses,epoch,y_a,y_p, CASE WHEN pe=epoch-1 THEN pa0 END AS pa, CASE WHEN pe=epoch-1 THEN pp0 END AS pp FROM lg0)"""


@query("wn2_lag1_autocorrelation", f"WITH {EV}, {LAGGED} SELECT ses, count(*) FILTER (WHERE y_a IS NOT NULL AND pa IS NOT NULL) AS n_pairs, round(CASE WHEN count(*) FILTER (WHERE y_a IS NOT NULL AND pa IS NOT NULL)>=10 THEN corr(pa,y_a) END,6) AS ac FROM lg GROUP BY 1")
def wn2(t):
    n = F.count_if(F.col("y_a").isNotNull() & F.col("pa").isNotNull())
    return with_previous(t).groupBy("ses").agg(n.alias("n_pairs"), R6(F.when(n >= 10, pearson("pa", "y_a"))).alias("ac"))


@query("wn3_lag_ratio_rate", f"""WITH {EV}, {LAGGED}, m AS (SELECT ses, avg(y_a) AS ma FROM fs GROUP BY 1),
c AS (SELECT y_a-ma AS x, pa-ma AS p FROM lg JOIN m USING (ses) WHERE y_a IS NOT NULL AND pa IS NOT NULL),
r AS (SELECT least(greatest(sum(x*p)/greatest(sum(p*p),1e-12),0.05),0.99) AS ac FROM c) SELECT round(ac,6) AS ac, round(-ln(ac)/(1/6.0),6) AS rate FROM r""")
def wn3(t):
    d = with_previous(t)
    m = d.groupBy("ses").agg(F.avg("y_a").alias("m"))
    c = d.join(m, "ses").where("y_a is not null and pa is not null").select((F.col("y_a") - F.col("m")).alias("x"), (F.col("pa") - F.col("m")).alias("p"))
    ac = F.least(F.greatest(F.sum(F.col("x") * F.col("p")) / F.greatest(F.sum(F.col("p") ** 2), F.lit(1e-12)), F.lit(0.05)), F.lit(0.99))
    return c.agg(ac.alias("ac")).select(R6(F.col("ac")).alias("ac"), R6(-F.log("ac") / (1 / 6.0)).alias("rate"))


@query("wn4_rating_autocorrelation", f"""WITH {PB}, r AS (SELECT ses, probe, rating, lag(rating) OVER (PARTITION BY ses ORDER BY probe) AS p FROM db WHERE rating IS NOT NULL),
a AS (SELECT ses, corr(p,rating) AS ac FROM r GROUP BY 1 HAVING count(*)>3 AND stddev_pop(rating) FILTER (WHERE p IS NOT NULL)>1e-12 AND stddev_pop(p)>1e-12)
SELECT count(*) AS n_sessions, round(quantile_cont(ac,0.5),6) AS median_ac FROM a""")
def wn4(t):
    r = running(ratings_b(t), ["ses"], ["probe"], lags={"p": F.col("rating")})
    a = r.groupBy("ses").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.when(F.col("p").isNotNull(), F.col("rating"))).alias("s1"), F.stddev_pop("p").alias("s2"),
                             pearson("p", "rating").alias("ac")).where("n > 3 and s1 > 1e-12 and s2 > 1e-12")
    return a.agg(F.count(F.lit(1)).alias("n_sessions"), F.lit(0).alias("_j")).join(quantiles(a, [], "ac", {"median_ac": 0.5}).withColumn("_j", F.lit(0)), "_j", "left").select("n_sessions", R6(F.col("median_ac")).alias("median_ac"))


@query("wn7_session_centring", f"""WITH {EV}, {FS}, c AS (SELECT ses,epoch,y_a-avg(y_a) OVER (PARTITION BY ses) AS a, y_p-avg(y_p) OVER (PARTITION BY ses) AS p, avg(y_a) OVER (PARTITION BY ses) AS off FROM fs),
g AS (SELECT sqrt(avg(a*a)) AS sa, sqrt(avg(p*p)) AS sp FROM c), s AS (SELECT ses, sqrt(avg(a*a)) AS za FROM c GROUP BY 1)
SELECT c.ses, epoch, round(a/(CASE WHEN sa>0 THEN sa ELSE 1 END),6) AS y_a, round(p/(CASE WHEN sp>0 THEN sp ELSE 1 END),6) AS y_p, round(off,6) AS y_offset, round(a/(CASE WHEN za>1e-12 THEN za ELSE 1 END),6) AS z_a FROM c, g, s WHERE s.ses=c.ses""")
def wn7(t):
    d = feature_epochs(t)
    s = d.groupBy("ses").agg(*[f(c).alias(f"{n}_{c}") for c in ("y_a", "y_p") for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))])
    g = s.agg(*[F.sqrt(F.sum(F.col(f"n_{c}") * F.col(f"v_{c}")) / F.sum(f"n_{c}")).alias(f"g_{c}") for c in ("y_a", "y_p")])
    x = d.join(s, "ses").join(F.broadcast(g))
    unit = lambda c, lim: F.when(c > lim, c).otherwise(1.0)
    return x.select("ses", "epoch", *[R6((F.col(c) - F.col(f"m_{c}")) / unit(F.col(f"g_{c}"), 0)).alias(c) for c in ("y_a", "y_p")],
                    R6(F.col("m_y_a")).alias("y_offset"), R6((F.col("y_a") - F.col("m_y_a")) / unit(F.sqrt("v_y_a"), 1e-12)).alias("z_a"))


@query("wn8_dataset_zscore", "WITH s AS (SELECT l_returnflag AS dataset, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1) SELECT l_returnflag AS dataset, l_suppkey, round(avg((l_extendedprice-m)/sd),6) AS mean_z FROM lineitem JOIN s ON dataset=l_returnflag GROUP BY 1,2")
def wn8(t):
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("dataset")).agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"))
    d = t.lineitem.select(F.col("l_returnflag").alias("dataset"), "l_suppkey", "l_extendedprice").join(F.broadcast(s), "dataset")
    return d.groupBy("dataset", "l_suppkey").agg(R6(F.avg((F.col("l_extendedprice") - F.col("m")) / F.col("sd"))).alias("mean_z"))


PROF = "pf AS (SELECT l_suppkey AS param, l_quantity AS g, -abs(avg(l_extendedprice)-30000)/8000.0 AS ll FROM lineitem GROUP BY 1,2)"


def profile_curves(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("param"), F.col("l_quantity").alias("g")).agg((-F.abs(F.avg("l_extendedprice") - 30000) / 8000.0).alias("ll"))


@query("wn9_profile_interval", f"""WITH {PROF}, m AS (SELECT param, max(ll) AS mx, arg_max(g,ll) AS g0, min(g)>0 AS lg FROM pf GROUP BY 1),
d AS (SELECT param, g, mx-ll AS dr, g0, CASE WHEN lg THEN ln(g) ELSE g END AS x FROM pf JOIN m USING (param)),
n AS (SELECT *, lead(dr) OVER w AS dn, lead(x) OVER w AS xn, lag(dr) OVER w AS dp, lag(x) OVER w AS xp FROM d WINDOW w AS (PARTITION BY param ORDER BY g)),
lo AS (SELECT param, arg_max(x + (1.92-dr)/(dn-dr)*(xn-x), g) AS v FROM n WHERE g<g0 AND dr>=1.92 AND dn<1.92 GROUP BY 1),
hi AS (SELECT param, arg_min(x + (1.92-dr)/(dp-dr)*(xp-x), g) AS v FROM n WHERE g>g0 AND dr>=1.92 AND dp<1.92 GROUP BY 1),
e AS (SELECT param, arg_min(dr,g) AS d0, arg_max(dr,g) AS d1 FROM d GROUP BY 1)
SELECT m.param, g0 AS mle_grid, round(exp(CASE WHEN d0>=1.92 THEN lo.v END),6) AS lo, round(exp(CASE WHEN d1>=1.92 THEN hi.v END),6) AS hi,
 round((CASE WHEN d1>=1.92 THEN hi.v END - CASE WHEN d0>=1.92 THEN lo.v END)/3.92,6) AS se_log FROM m JOIN e USING (param) LEFT JOIN lo USING (param) LEFT JOIN hi USING (param)""")
def wn9(t):
    from ..operators.stats import profile_interval

    d = profile_interval(profile_curves(t), ["param"], "g", "ll")
    return d.select("param", "mle_grid", R6(F.col("lo")).alias("lo"), R6(F.col("hi")).alias("hi"), R6(F.col("se")).alias("se_log"))


@query("wn10_profile_unimodality", f"""WITH {PROF}, w AS (SELECT param,g,ll,lag(ll) OVER w AS p, lead(ll) OVER w AS n, row_number() OVER w AS k, count(*) OVER (PARTITION BY param) AS c FROM pf WINDOW w AS (PARTITION BY param ORDER BY g))
SELECT param, count(*) FILTER (WHERE ll>=p AND ll>=n) AS n_peaks, count(*) FILTER (WHERE ll>=p AND ll>=n)=1 AND arg_max(k,ll)>1 AND arg_max(k,ll)<max(c) AS unimodal FROM w GROUP BY 1""")
def wn10(t):
    from ..operators.stats import profile_unimodal

    return profile_unimodal(profile_curves(t), ["param"], "g", "ll")


@query("wn11_thinned_chain", f"WITH {EV} SELECT eid FROM (SELECT eid, row_number() OVER (PARTITION BY ses ORDER BY t,eid)-1 AS k FROM ev) WHERE k%ceil(5*(1/0.25)/7.0)::INT=0")
def wn11(t):
    import math

    stride = math.ceil(5 * (1 / 0.25) / 7.0)
    return numbered(log_a(t), ["ses"], ["t", "eid"], "k").where((F.col("k") - 1) % stride == 0).select("eid")


@query("wn12_example_session", f"WITH {PB} SELECT ses, count(*) AS n_rated FROM db WHERE rating IS NOT NULL GROUP BY 1 ORDER BY n_rated DESC, ses LIMIT 1")
def wn12(t):
    return ratings_b(t).groupBy("ses").agg(F.count(F.lit(1)).alias("n_rated")).orderBy(F.desc("n_rated"), "ses").limit(1)


@query("wn13_half_sample_check", "WITH r AS (SELECT o_orderpriority AS output, o_totalprice AS v, o_orderkey < (SELECT (max(o_orderkey)+1)//2 FROM orders) AS half FROM orders) SELECT output, round(avg(v),4) AS full_mean, round(avg(v) FILTER (WHERE half),4) AS half_mean, round(abs(avg(v) FILTER (WHERE half)-avg(v)),4) AS delta FROM r GROUP BY 1")
def wn13(t):
    cut = t.orders.agg(F.floor((F.max("o_orderkey") + 1) / 2).alias("_c"))
    d = t.orders.join(F.broadcast(cut))
    h = F.avg(F.when(F.col("o_orderkey") < F.col("_c"), F.col("o_totalprice")))
    return d.groupBy(F.col("o_orderpriority").alias("output")).agg(F.round(F.avg("o_totalprice"), 4).alias("full_mean"), F.round(h, 4).alias("half_mean"), F.round(F.abs(h - F.avg("o_totalprice")), 4).alias("delta"))


# ---------------------------------------------------------------- filters and expressions
@query("pf9_primary_subjects", "SELECT o_custkey AS subject, round(avg(ln(o_totalprice)),6) AS mean_value FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 100) GROUP BY 1")
def pf9(t):
    first = t.orders.select("o_custkey").distinct().orderBy("o_custkey").limit(100)
    return t.orders.join(F.broadcast(first), "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("subject")).agg(R6(F.avg(F.log("o_totalprice"))).alias("mean_value"))


@query("pf12_masked_channels", f"WITH {EV}, {FS}, cf(config,use_a,use_p) AS (VALUES ('a',true,false),('b',false,true),('c',false,false),('d',true,true)) SELECT config, count(*) AS n, round(avg(CASE WHEN use_a THEN y_a END),6) AS mean_a, round(avg(CASE WHEN use_p THEN y_p END),6) AS mean_p FROM fs, cf GROUP BY 1")
def pf12(t):
    # Four fixed configurations, expanded in place.
    cfg = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(a).alias("use_a"), F.lit(p).alias("use_p")) for n, a, p in (("a", True, False), ("b", False, True), ("c", False, False), ("d", True, True))])
    d = feature_epochs(t).select("*", F.inline(cfg))
    return d.groupBy("config").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.when(F.col("use_a"), F.col("y_a")))).alias("mean_a"), R6(F.avg(F.when(F.col("use_p"), F.col("y_p")))).alias("mean_p"))


@query("pf13_finite_rows", f"WITH {EV}, {FS} SELECT ses, epoch FROM fs WHERE y_a IS NOT NULL AND y_p IS NOT NULL")
def pf13(t):
    return feature_epochs(t).dropna(subset=["y_a", "y_p"]).where(~F.isnan("y_a") & ~F.isnan("y_p")).select("ses", "epoch")


@query("pf14_log_transform", "SELECT c_custkey, round(CASE WHEN c_acctbal>0 THEN ln(c_acctbal) END,6) AS log_v, round(CASE WHEN c_acctbal>0 THEN exp(ln(c_acctbal)) END,4) AS back FROM customer")
def pf14(t):
    lv = F.when(F.col("c_acctbal") > 0, F.log("c_acctbal"))
    return t.customer.select("c_custkey", R6(lv).alias("log_v"), F.round(F.exp(lv), 4).alias("back"))


@query("pf15_domain_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND regexp_replace(lower(concat(CASE WHEN c_custkey%2=0 THEN 'sub-' ELSE '' END, c_custkey%50)),'^sub-','') IN ('1','2','3','7','12')")
def pf15(t):
    raw = F.lower(F.concat(F.when(F.col("c_custkey") % 2 == 0, "sub-").otherwise(""), (F.col("c_custkey") % 50).cast("string")))
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.regexp_replace(raw, "^sub-", "").isin("1", "2", "3", "7", "12")).select("c_custkey")


@query("pf16_unit_seeds", "SELECT l_suppkey, l_linenumber, count(*) AS n, 42+7919*l_linenumber AS seed, round(avg(('0x'||substr(md5(concat_ws('|',42+7919*l_linenumber,l_suppkey)),1,8))::BIGINT/4294967296.0),6) AS u FROM lineitem GROUP BY 1,2")
def pf16(t):
    from ..functions.draws import uniform

    g = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", 42 + 7919 * F.col("l_linenumber"))
    return g.withColumn("u", R6(uniform(F.col("seed"), F.col("l_suppkey"))))


@query("pf19_log_predictive_density", "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, round(avg(-0.5*(ln(2*pi()*v)+(l_quantity-m)^2/v)),6) AS lpd, round(avg(abs(l_quantity-m)),6) AS mae FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1")
def pf19(t):
    from ..functions.exprs import log_density

    m = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v"))
    d = t.lineitem.select("l_suppkey", "l_quantity").join(m, "l_suppkey")
    return d.groupBy("l_suppkey").agg(R6(F.avg(log_density(F.col("l_quantity"), F.col("m"), F.col("v")))).alias("lpd"), R6(F.avg(F.abs(F.col("l_quantity") - F.col("m")))).alias("mae"))


@query("pf20_relative_error", "SELECT l_linenumber AS param, round(CASE WHEN l_linenumber<=4 THEN stddev_samp(l_tax)/sqrt(count(*)) ELSE (stddev_samp(l_tax)/sqrt(count(*)))/nullif(abs(avg(l_tax)-CASE WHEN l_linenumber=7 THEN avg(l_tax) ELSE 0 END),0) END,8) AS rel_se FROM lineitem GROUP BY 1")
def pf20(t):
    from ..functions.exprs import relative_se

    g = t.lineitem.groupBy(F.col("l_linenumber").alias("param")).agg((F.stddev_samp("l_tax") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg("l_tax").alias("v"))
    v = F.col("v") - F.when(F.col("param") == 7, F.col("v")).otherwise(0)
    return g.select("param", F.round(relative_se(F.col("se"), v, F.col("param") <= 4), 8).alias("rel_se"))
