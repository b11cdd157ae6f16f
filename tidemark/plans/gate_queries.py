"""Gates, dataset comparisons and report tables."""

from pyspark.sql import functions as F

from ..operators import gates as gt, stats as st
from ..operators.quantiles import quantiles
from ..operators.resample import bootstrap_mean
from ..functions.draws import sql_uniform
from .registry import query
from .relational import FEAT, PAIR, features, order_pairs

R6 = lambda c: F.round(c, 6)
NOW = "2024-02-01T00:00:00+00:00"
MET = "m AS (SELECT l_suppkey AS gate, avg((l_discount<0.05)::INT) AS match_rate, avg((l_tax<0.04)::INT) AS known_rate, avg(ln(l_extendedprice)) AS level FROM lineitem GROUP BY 1)"


def metrics(t):
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("gate")).agg(F.avg((F.col("l_discount") < 0.05).cast("int")).alias("match_rate"), F.avg((F.col("l_tax") < 0.04).cast("int")).alias("known_rate"), F.avg(F.log("l_extendedprice")).alias("level"))
    return d


THR = [("match_rate", ">=", 0.45), ("known_rate", ">=", 0.43), ("level", "<=", 9.95)]


@query("gt1_threshold_gate", f"WITH {MET}, r AS (SELECT gate, match_rate>=0.45 AS a, known_rate>=0.43 AS b, level<=9.95 AS c FROM m) SELECT gate, a AND b AND c AS passed, ((NOT a)::INT+(NOT b)::INT+(NOT c)::INT)::BIGINT AS n_failed, '{NOW}' AS time_utc FROM r")
def gt1(t):
    th = t.spark.createDataFrame(THR, "metric string, op string, bound double")
    long = metrics(t).unpivot(["gate"], ["match_rate", "known_rate", "level"], "metric", "value")
    return gt.gate(long, th, ["gate"], NOW).drop("details")


@query("gt3_content_lock", "SELECT doc_id, CASE WHEN doc_id%10=3 THEN 'unlocked' WHEN doc_id%10=5 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def gt3(t):
    d = t.documents.select("doc_id", "text")
    rec = d.where("doc_id % 10 <> 3").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return gt.content_lock(d, rec, "doc_id", "text")


FPR = """h AS (SELECT {k} AS k, md5(concat_ws(chr(9247),{id}::VARCHAR,{cols})) AS h FROM {src})
SELECT k, count(*) AS n_rows, sha256(concat_ws('|',count(*)::VARCHAR,{lanes})) AS fingerprint FROM h GROUP BY 1"""
LANES = ",".join(f"sum(('0x'||substr(h,{8 * k + 1},8))::BIGINT)::BIGINT::VARCHAR" for k in range(4))


@query("gt4_set_fingerprint", "WITH " + FPR.format(k="o_custkey", id="o_orderkey", cols="o_orderstatus,o_orderpriority", src="orders", lanes=LANES).replace("SELECT k,", "SELECT k AS o_custkey,"))
def gt4(t):
    return gt.fingerprint(t.orders, ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("gt4_reusable_items", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey%97=0)>0")
def gt4b(t):
    """Items whose fingerprint differs from the saved one must be recomputed."""
    now = gt.fingerprint(t.orders, ["o_custkey"], "o_orderkey", ["o_orderstatus"])
    saved = gt.fingerprint(t.orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "?").otherwise(F.col("o_orderstatus"))), ["o_custkey"], "o_orderkey", ["o_orderstatus"])
    return now.join(saved, ["o_custkey", "fingerprint"], "left_anti").select("o_custkey")


CON = f"""{FEAT}, p AS (SELECT subject, avg(ln(m_price)) FILTER (WHERE cond='A') AS a, avg(ln(m_price)) FILTER (WHERE cond='N') AS n, avg(ln(m_price)) FILTER (WHERE cond='R') AS r FROM feat GROUP BY 1),
d AS (SELECT 'A>N' AS contrast, subject, a-n AS diff FROM p WHERE a IS NOT NULL AND n IS NOT NULL UNION ALL SELECT 'A>R', subject, a-r FROM p WHERE a IS NOT NULL AND r IS NOT NULL),
z AS (SELECT * FROM {st.sql_effects('d', 'subject', 10_000, 'gt5', ['contrast'])}),
g AS (SELECT contrast, quantile_cont(dz,0.025) AS lo FROM z GROUP BY 1)"""


@query("gt5_contrast_gate", f"WITH {CON} SELECT e.contrast, round(lo,4) AS lo, CASE WHEN lo IS NULL THEN 'pending' WHEN lo>0 THEN 'passed' ELSE 'failed' END AS status FROM (VALUES ('A>N'),('A>R'),('A>X')) e(contrast) LEFT JOIN g USING (contrast)")
def gt5(t):
    p = features(t).groupBy("subject").agg(*[F.avg(F.when(F.col("cond") == c, F.log("m_price"))).alias(c.lower()) for c in "ANR"])
    d = p.select("subject", F.inline(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col("a") - F.col(c)).alias("diff")) for n, c in (("A>N", "n"), ("A>R", "r"))]))).where("diff is not null")
    g = st.effect_bootstrap(d, ["contrast"], "subject", 10_000, "gt5")
    want = t.spark.createDataFrame([("A>N",), ("A>R",), ("A>X",)], "contrast string")
    j = want.join(F.broadcast(g), "contrast", "left")
    return j.select("contrast", F.round("lo", 4).alias("lo"), F.when(F.col("lo").isNull(), "pending").when(F.col("lo") > 0, "passed").otherwise("failed").alias("status"))


@query("gt15_recovery_gate", "WITH e AS (SELECT l_linenumber AS param, abs(ln(l_extendedprice)-10)/10 AS rel FROM lineitem) SELECT param, round(quantile_cont(rel,0.5),6) AS median_rel, quantile_cont(rel,0.5)<=0.20 AS passed FROM e GROUP BY 1")
def gt15(t):
    e = t.lineitem.select(F.col("l_linenumber").alias("param"), (F.abs(F.log("l_extendedprice") - 10) / 10).alias("rel"))
    q = quantiles(e, ["param"], "rel", {"m": 0.5}, scan_twice=True)
    return q.select("param", R6(F.col("m")).alias("median_rel"), (F.col("m") <= 0.20).alias("passed"))


@query("gt6_tool_checks", "WITH c AS (SELECT 'no_negative_price' AS name, count(*) FILTER (WHERE l_extendedprice<0)=0 AS passed FROM lineitem UNION ALL SELECT 'orders_have_customers', count(*) FILTER (WHERE c_custkey IS NULL)=0 FROM orders LEFT JOIN customer ON c_custkey=o_custkey UNION ALL SELECT 'unit_vectors', bool_and(abs(sqrt(list_dot_product(embedding,embedding))-1)<0.001) FROM embeddings) SELECT name, passed, bool_and(passed) OVER () AS all_passed FROM c")
def gt6(t):
    from ..functions.exprs import vec_norm

    a = t.lineitem.agg((F.count_if(F.col("l_extendedprice") < 0) == 0).alias("passed")).withColumn("name", F.lit("no_negative_price"))
    b = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg((F.count(F.lit(1)) == 0).alias("passed")).withColumn("name", F.lit("orders_have_customers"))
    c = t.packed().agg(F.bool_and(F.abs(vec_norm(F.col("x")) - 1) < 0.001).alias("passed")).withColumn("name", F.lit("unit_vectors"))
    d = a.unionByName(b).unionByName(c)
    # Three check rows: the overall verdict is a window over them.
    from pyspark.sql import Window

    return d.select("name", "passed", F.bool_and("passed").over(Window.partitionBy()).alias("all_passed"))


CMP = "c AS (SELECT o_orderstatus AS ds, count(*)::DOUBLE AS n_rows, avg(ln(o_totalprice)) AS level, stddev_samp(ln(o_totalprice)) AS sd FROM orders GROUP BY 1)"


@query("gt7_side_by_side", f"WITH {CMP}, l AS (SELECT ds,'level' AS metric,level AS v FROM c UNION ALL SELECT ds,'level_per_sd',level/nullif(sd,0) FROM c UNION ALL SELECT ds,'n_rows',n_rows FROM c UNION ALL SELECT ds,'sd',sd FROM c) SELECT metric, round(max(v) FILTER (WHERE ds='F'),6) AS f, round(max(v) FILTER (WHERE ds='O'),6) AS o, round(max(v) FILTER (WHERE ds='P'),6) AS p, concat(count(v),'/3') AS n_of_m FROM l GROUP BY 1")
def gt7(t):
    lv = F.log("o_totalprice")
    c = t.orders.groupBy(F.col("o_orderstatus").alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg(lv).alias("level"), F.stddev_samp(lv).alias("sd"))
    c = c.withColumn("level_per_sd", F.try_divide("level", F.nullif(F.col("sd"), F.lit(0.0))))
    l = c.unpivot(["ds"], ["n_rows", "level", "sd", "level_per_sd"], "metric", "v")
    p = l.groupBy("metric").pivot("ds", ["F", "O", "P"]).agg(F.max("v"))
    n = sum((F.col(x).isNotNull().cast("int") for x in "FOP"), F.lit(0))
    return p.select("metric", *[R6(F.col(x)).alias(x.lower()) for x in "FOP"], F.concat(n.cast("string"), F.lit("/3")).alias("n_of_m"))


REP = "s AS (SELECT l_suppkey AS unit, avg(ln(l_extendedprice)) FILTER (WHERE l_returnflag='A') AS e1, avg(ln(l_extendedprice)) FILTER (WHERE l_returnflag='R') AS e2, stddev_samp(ln(l_extendedprice)) FILTER (WHERE l_returnflag='A')/sqrt(count(*) FILTER (WHERE l_returnflag='A')) AS s1, stddev_samp(ln(l_extendedprice)) FILTER (WHERE l_returnflag='R')/sqrt(count(*) FILTER (WHERE l_returnflag='R')) AS s2 FROM lineitem GROUP BY 1)"


@query("gt8_replication_checks", f"WITH {REP} SELECT unit, coalesce(e2-s2<=e1+s1 AND e1-s1<=e2+s2,false) AS overlap, round(e2/e1,6) AS ratio, e2/e1 BETWEEN 0.99 AND 1.01 AS in_bounds, sign(e1-10)=sign(e2-10) AS same_sign FROM s")
def gt8(t):
    lv = F.log("l_extendedprice")
    side = lambda f, c: f(F.when(F.col("l_returnflag") == c, lv))
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("unit")).agg(*[x.alias(n) for c, k in (("A", 1), ("R", 2)) for n, x in ((f"e{k}", side(F.avg, c)), (f"s{k}", side(F.stddev_samp, c) / F.sqrt(side(F.count, c))))])
    c = F.col
    return s.select("unit", gt.intervals_overlap(c("e1") - c("s1"), c("e1") + c("s1"), c("e2") - c("s2"), c("e2") + c("s2")).alias("overlap"),
                    R6(c("e2") / c("e1")).alias("ratio"), (c("e2") / c("e1")).between(0.99, 1.01).alias("in_bounds"), (F.signum(c("e1") - 10) == F.signum(c("e2") - 10)).alias("same_sign"))


@query("gt9_error_table", "WITH a AS (SELECT l_linenumber AS param, avg(ln(l_extendedprice)) AS est, stddev_samp(ln(l_extendedprice)) AS se FROM lineitem GROUP BY 1), b AS (SELECT l_linenumber AS param, avg(l_discount) AS crb FROM lineitem WHERE l_returnflag='R' GROUP BY 1), q AS (SELECT l_linenumber AS param, quantile_cont(ln(l_extendedprice),0.025) AS lo, quantile_cont(ln(l_extendedprice),0.975) AS hi FROM lineitem GROUP BY 1) SELECT param, round(est,6) AS est, round(se,6) AS se, round(crb,6) AS crb, round(se/crb,6) AS ratio, round(lo,6) AS lo, round(hi,6) AS hi FROM a LEFT JOIN b USING (param) LEFT JOIN q USING (param)")
def gt9(t):
    lv = F.log("l_extendedprice")
    d = t.lineitem.select(F.col("l_linenumber").alias("param"), lv.alias("v"), "l_discount", "l_returnflag")
    a = d.groupBy("param").agg(F.avg("v").alias("est"), F.stddev_samp("v").alias("se"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("crb"))
    j = a.join(quantiles(d, ["param"], "v", {"lo": 0.025, "hi": 0.975}, scan_twice=True), "param", "left").withColumn("ratio", F.col("se") / F.col("crb"))
    return j.select("param", *[R6(F.col(c)).alias(c) for c in ("est", "se", "crb", "ratio", "lo", "hi")])


@query("gt10_report_rows", "WITH a AS (SELECT o_orderpriority AS model, avg(ln(o_totalprice)) AS lpd, avg(abs(ln(o_totalprice)-12)) AS mae FROM orders GROUP BY 1) SELECT model, 'lpd' AS metric, round(lpd,6) AS value FROM a UNION ALL SELECT model, 'mae', round(mae,6) FROM a")
def gt10(t):
    lv = F.log("o_totalprice")
    a = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(R6(F.avg(lv)).alias("lpd"), R6(F.avg(F.abs(lv - 12))).alias("mae"))
    return a.unpivot(["model"], ["lpd", "mae"], "metric", "value")


@query("gt13_tidy_index_table", "WITH a AS (SELECT l_returnflag AS output, avg(ln(l_extendedprice)) AS s1, avg(l_tax) AS st, avg(ln(l_extendedprice)) FILTER (WHERE l_orderkey<(SELECT (max(l_orderkey)+1)//2 FROM lineitem)) AS h1, avg(l_tax) FILTER (WHERE l_orderkey<(SELECT (max(l_orderkey)+1)//2 FROM lineitem)) AS ht FROM lineitem GROUP BY 1) SELECT output, 'S1' AS param, round(s1,6) AS point, round(h1,6) AS half, 'log' AS scale FROM a UNION ALL SELECT output, 'ST', round(st,6), round(ht,6), 'raw' FROM a")
def gt13(t):
    cut = t.lineitem.agg(F.floor((F.max("l_orderkey") + 1) / 2).alias("_c"))
    d = t.lineitem.join(F.broadcast(cut)).withColumn("h", F.col("l_orderkey") < F.col("_c"))
    lv, tx = F.log("l_extendedprice"), F.col("l_tax")
    half = lambda v: F.avg(F.when(F.col("h"), v))
    a = d.groupBy(F.col("l_returnflag").alias("output")).agg(F.array(F.lit("S1"), F.lit("ST")).alias("param"), F.array(R6(F.avg(lv)), R6(F.avg(tx))).alias("point"), F.array(R6(half(lv)), R6(half(tx))).alias("half"), F.array(F.lit("log"), F.lit("raw")).alias("scale"))
    return a.select("output", F.inline(F.arrays_zip("param", "point", "half", "scale")))


@query("gt14_gate_status", "WITH r AS (SELECT o_custkey AS gate, o_orderstatus<>'F' AS passed, o_orderdate AS time, o_orderkey FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY time DESC, o_orderkey DESC) k FROM r), k AS (SELECT c_custkey AS gate FROM customer) SELECT k.gate, CASE WHEN passed IS NULL THEN '-' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS verdict, o_orderkey AS time FROM k LEFT JOIN (SELECT * FROM l WHERE k=1) l USING (gate)")
def gt14(t):
    """One gate per customer; a customer without orders has none on record."""
    known = t.customer.select(F.col("c_custkey").alias("gate")).distinct()
    rec = t.orders.select(F.col("o_custkey").alias("gate"), (F.col("o_orderstatus") != "F").alias("passed"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return gt.latest(rec, known, "gate", "at").select("gate", "verdict", F.col("time.o_orderkey").alias("time"))
