"""Memory-store analytics on `embeddings` (ordered by id), `labels` and `documents`."""

from pyspark.sql import Window, functions as F

from ..functions.draws import sql_uniform, uniform
from ..operators import memory as mm, passes, stats as st
from ..operators.ordered import numbered, running
from ..operators.quantiles import quantiles
from ..session import cut_lineage
from .registry import query

R6 = lambda c: F.round(c, 6)
N_BOOT = 10_000

ST = f"""em AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, {sql_uniform("'conf'", 'vec_id')} AS confidence, ({sql_uniform("'err'", 'vec_id')}<0.3+0.05*label)::INT AS error FROM embeddings)"""
NOV = ST + """, cs AS (SELECT q.id, max(list_dot_product(q.v,i.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(i.v,i.v))) AS best FROM em q JOIN em i ON i.id<q.id GROUP BY 1), nv AS (SELECT em.*, 1-coalesce(best,0) AS novelty FROM em LEFT JOIN cs USING (id))"""


def stream(t):
    d = t.packed().select(F.col("unit").alias("id"), F.col("cond").alias("label"), F.col("x").alias("v"))
    return d.withColumns({"confidence": uniform(F.lit("conf"), F.col("id")), "error": (uniform(F.lit("err"), F.col("id")) < 0.3 + 0.05 * F.col("label")).cast("int")})


def scored(t):
    s = stream(t)
    return s.drop("v").join(mm.novelty(s.select("id", "v")), "id")


@query("mm1_novelty", f"WITH {NOV} SELECT id, round(novelty,6) AS novelty FROM nv")
def mm1(t):
    return mm.novelty(stream(t).select("id", "v")).withColumn("novelty", R6(F.col("novelty")))


DEC = NOV + ", sc AS (SELECT *, confidence*error AS surprise, confidence*error+0.5*novelty AS score FROM nv), th AS (SELECT quantile_cont(score,0.8) AS theta FROM sc)"


@query("mm2_write_gate", f"WITH {DEC} SELECT id, round(surprise,6) AS surprise, round(score,6) AS score, score>0.7 OR (error=0 AND novelty>0.6) AS write, CASE WHEN score>0.7 THEN 'surprise' WHEN error=0 AND novelty>0.6 THEN 'novelty' ELSE 'none' END AS trigger FROM sc")
def mm2(t):
    d = mm.write_decision(scored(t), 0.7)
    return d.select("id", R6(F.col("surprise")).alias("surprise"), R6(F.col("score")).alias("score"), "write", "trigger")


@query("mm3_write_threshold", f"WITH {DEC} SELECT round(theta,6) AS theta, round(avg((score>theta)::INT),6) AS write_rate FROM sc, th GROUP BY theta")
def mm3(t):
    # Read by the count, the quantile and the rate: stored, so that all vectors meet once.
    d = cut_lineage(mm.write_decision(scored(t), 0.7).select("score"))
    q = quantiles(d, [], "score", {"theta": 0.8})
    return d.join(F.broadcast(q)).groupBy("theta").agg(R6(F.avg((F.col("score") > F.col("theta")).cast("int"))).alias("write_rate")).select(R6(F.col("theta")).alias("theta"), "write_rate")


@query("mm4_calibration_error", f"WITH {ST}, b AS (SELECT least(floor(confidence*10),9) AS b, count(*) AS n, avg((error=0)::INT) AS acc, avg(confidence) AS c FROM em GROUP BY 1) SELECT round(sum(n*abs(acc-c))/sum(n),6) AS ece FROM b")
def mm4(t):
    d = stream(t).withColumn("correct", 1 - F.col("error"))
    return mm.calibration_error(d, "confidence", "correct").withColumn("ece", R6(F.col("ece")))


@query("mm4_isotonic_calibration")
def mm4b(t):
    """Fitted on the first half of the stream, error measured on all of it."""
    d = stream(t).drop("v").withColumn("correct", 1 - F.col("error"))
    half = d.agg(F.floor(F.max("id") / 2)).first()[0]
    c = mm.calibrate(d.where(F.col("id") <= half), d, "confidence", "correct")
    return mm.calibration_error(c, "calibrated", "correct").withColumn("ece", R6(F.col("ece")))


@query("mm5_replay_sample", f"WITH {ST}, s AS (SELECT id, confidence*error AS s, (SELECT max(id) FROM em)-id AS age FROM em), p AS (SELECT id, pow(s,0.6)*(1+0.1*age/100.0) AS w, -ln(greatest({sql_uniform(chr(39) + 'mm5' + chr(39), 'id')},1e-12))/(pow(s,0.6)*(1+0.1*age/100.0)) AS k FROM s WHERE s>0) SELECT id, round(w,6) AS priority FROM p ORDER BY k, id LIMIT 200")
def mm5(t):
    s = stream(t).select("id", (F.col("confidence") * F.col("error")).alias("surprise"))
    top = s.agg(F.max("id").alias("_x"))
    d = s.join(F.broadcast(top)).withColumn("age", F.col("_x") - F.col("id"))
    return mm.replay_sample(d.drop("_x"), "id", 100.0, 200, "mm5").select("id", R6(F.col("priority")).alias("priority"))


@query("mm6_cosine_clusters", f"""WITH RECURSIVE {ST}, e AS (SELECT q.id AS i, o.id AS j FROM em q JOIN em o ON q.id<>o.id AND list_dot_product(q.v,o.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(o.v,o.v))>0.4),
r(id,root) AS (SELECT id,id FROM em UNION SELECT e.j, r.root FROM r JOIN e ON e.i=r.id WHERE r.root<e.j), l AS (SELECT id, min(root) AS root FROM r GROUP BY 1), f AS (SELECT root, count(*) AS size FROM l GROUP BY 1 HAVING count(*)>=3) SELECT id, root AS cluster, size FROM l JOIN f USING (root)""")
def mm6(t):
    return mm.cosine_clusters(stream(t).select("id", "v"), 0.4, 3)


NEAR = ST + ", np AS (SELECT q.id AS qid, i.id AS iid, list_dot_product(q.v,i.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(i.v,i.v)) AS c FROM em q JOIN em i ON q.id%2=1 AND i.id%2=0), nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, iid) r FROM np) WHERE r=1)"


@query("mm7_rule_upsert", f"WITH {NEAR}, m AS (SELECT iid AS rule, count(*) AS k FROM nb WHERE c>0.45 GROUP BY 1) SELECT id AS rule, 1+coalesce(k,0) AS version, 1+coalesce(k,0) AS support, 'kept' AS origin FROM em LEFT JOIN m ON rule=id WHERE id%2=0 UNION ALL SELECT qid, 1, 1, 'inserted' FROM nb WHERE c<=0.45")
def mm7(t):
    """Candidates merge into the nearest rule above the limit, others become rules."""
    s = stream(t)
    rules, cand = s.where("id % 2 = 0"), s.where("id % 2 = 1")
    near = mm.nearest(cand.select(F.col("id").alias("qid"), F.col("v").alias("qv")), rules.select(F.col("id").alias("iid"), F.col("v").alias("iv")))
    hits = near.where("cosine > 0.45").groupBy(F.col("iid").alias("rule")).agg(F.count(F.lit(1)).alias("k"))
    new = near.where("cosine <= 0.45").select(F.col("qid").alias("rule"), F.lit(1).cast("long").alias("version"), F.lit(1).cast("long").alias("support"), F.lit("inserted").alias("origin"))
    k = 1 + F.coalesce("k", F.lit(0))
    return rules.select(F.col("id").alias("rule")).join(hits, "rule", "full_outer").select("rule", k.alias("version"), k.alias("support"), F.lit("kept").alias("origin")).unionByName(new)


@query("mm7_support_union", f"WITH {NEAR}, m AS (SELECT iid AS rule, qid AS member FROM nb WHERE c>0.45 UNION SELECT qid, qid FROM nb WHERE c<=0.45 UNION SELECT id, id FROM em WHERE id%2=0) SELECT rule, member, count(*) OVER (PARTITION BY rule) AS support, (SELECT max(member) FROM m x WHERE x.rule=m.rule) AS latest FROM m")
def mm7s(t):
    """The union of what supports every rule, one row per member, with its size and newest member."""
    s = stream(t)
    rules, cand = s.where("id % 2 = 0"), s.where("id % 2 = 1")
    near = mm.nearest(cand.select(F.col("id").alias("qid"), F.col("v").alias("qv")), rules.select(F.col("id").alias("iid"), F.col("v").alias("iv")))
    rule = F.when(F.col("cosine") > 0.45, F.col("iid")).otherwise(F.col("qid"))
    members = near.select(rule.alias("rule"), F.col("qid").alias("member")).unionByName(rules.select(F.col("id").alias("rule"), F.col("id").alias("member"))).distinct()
    size = members.groupBy("rule").agg(F.count(F.lit(1)).alias("support"), F.max("member").alias("latest"))
    return members.join(size, "rule")


@query("mm8_conflict_resolution", "WITH e AS (SELECT o_custkey AS rule, count(*) FILTER (WHERE o_orderstatus='F') AS pro, count(*) FILTER (WHERE o_orderstatus<>'F') AS con FROM orders GROUP BY 1) SELECT rule, pro, con, CASE WHEN pro>=2 AND pro>con THEN 'pro' WHEN con>=2 AND con>pro THEN 'con' ELSE 'open' END AS winner, round(CASE WHEN pro>0 AND con>0 THEN 0.7 ELSE 1.0 END*greatest(pro,con)/(pro+con),6) AS confidence FROM e")
def mm8(t):
    e = t.orders.groupBy(F.col("o_custkey").alias("rule")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("pro"), F.count_if(F.col("o_orderstatus") != "F").alias("con"))
    p, c = F.col("pro"), F.col("con")
    win = F.when((p >= 2) & (p > c), "pro").when((c >= 2) & (c > p), "con").otherwise("open")
    return e.select("rule", "pro", "con", win.alias("winner"), R6(F.when((p > 0) & (c > 0), 0.7).otherwise(1.0) * F.greatest(p, c) / (p + c)).alias("confidence"))


@query("mm9_pruned_store", f"WITH {ST} SELECT id FROM em WHERE NOT ((SELECT max(id) FROM em)-id>200 AND confidence*error<0.2) AND NOT (confidence<0.3)")
def mm9(t):
    s = stream(t).select("id", "confidence", (F.col("confidence") * F.col("error")).alias("surprise"))
    d = s.join(F.broadcast(s.agg(F.max("id").alias("_x"))))
    old = (F.col("_x") - F.col("id") > 200) & (F.col("surprise") < 0.2)
    return d.where(~old & ~(F.col("confidence") < 0.3)).select("id")


@query("mm10_retrieval", f"WITH {ST}, p AS (SELECT q.id AS qid, CASE WHEN i.id%2=0 THEN 'rule' ELSE 'episode' END AS kind, i.id AS iid, list_dot_product(q.v,i.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(i.v,i.v)) AS c FROM em q JOIN em i ON i.confidence>=0.2) SELECT qid, kind, iid, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid,kind ORDER BY round(c,9) DESC, iid) AS rank FROM p) WHERE rank<=3")
def mm10(t):
    s = stream(t)
    items = s.where("confidence >= 0.2").select(F.col("id").alias("iid"), F.col("v").alias("iv"), F.when(F.col("id") % 2 == 0, "rule").otherwise("episode").alias("kind"))
    n = mm.nearest(s.select(F.col("id").alias("qid"), F.col("v").alias("qv")), items, 3, "kind")
    return n.select("qid", "kind", "iid", "rank")


@query("mm10_use_counters", f"WITH {ST}, p AS (SELECT q.id AS qid, i.id AS iid, list_dot_product(q.v,i.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(i.v,i.v)) AS c FROM em q JOIN em i ON true), r AS (SELECT iid, row_number() OVER (PARTITION BY qid ORDER BY round(c,9) DESC, iid) AS rank FROM p) SELECT iid, count(*) AS uses FROM r WHERE rank<=3 GROUP BY 1")
def mm10b(t):
    s = stream(t)
    n = mm.nearest(s.select(F.col("id").alias("qid"), F.col("v").alias("qv")), s.select(F.col("id").alias("iid"), F.col("v").alias("iv")), 3)
    return n.groupBy("iid").agg(F.count(F.lit(1)).alias("uses"))


# Hash tables for the given vectors, whose nearest are at a cosine near 0.45; the same planes as text.
TABLES, BITS, DIMS = 18, 4, 64
PLANES = passes.planes(TABLES, BITS, DIMS, "store")
HASHED = (TABLES, BITS, "store", DIMS)
SIG = ST + ", pl(t, b, w) AS (VALUES " + ", ".join(f"({t}, {b}, {[float(x) for x in PLANES[t][b]]}::DOUBLE[])" for t in range(TABLES) for b in range(BITS)) + """),
sgn AS (SELECT id, t, sum(CASE WHEN list_dot_product(v, w)>=0 THEN (1<<b)::BIGINT ELSE 0 END) AS bucket FROM em, pl GROUP BY 1,2),
cd AS (SELECT DISTINCT q.id AS qid, i.id AS iid FROM sgn q JOIN sgn i USING (t, bucket)),
cp AS (SELECT qid, iid, q.confidence AS qc, i.confidence AS ic, list_dot_product(q.v,i.v)/sqrt(list_dot_product(q.v,q.v)*list_dot_product(i.v,i.v)) AS c FROM cd JOIN em q ON q.id=qid JOIN em i ON i.id=iid)"""


@query("mm1_hashed_novelty", f"WITH {SIG} SELECT em.id, round(1-coalesce(max(c),0),6) AS novelty FROM em LEFT JOIN cp ON qid=em.id AND iid<em.id GROUP BY 1")
def mm1h(t):
    """Novelty against the earlier items that share a hash bucket."""
    return mm.novelty(stream(t).select("id", "v"), HASHED).withColumn("novelty", R6(F.col("novelty")))


@query("mm6_hashed_clusters", f"""WITH RECURSIVE {SIG}, e AS (SELECT qid AS i, iid AS j FROM cp WHERE qid<>iid AND c>0.4),
r(id,root) AS (SELECT id,id FROM em UNION SELECT e.j, r.root FROM r JOIN e ON e.i=r.id WHERE r.root<e.j), l AS (SELECT id, min(root) AS root FROM r GROUP BY 1), f AS (SELECT root, count(*) AS size FROM l GROUP BY 1 HAVING count(*)>=3) SELECT id, root AS cluster, size FROM l JOIN f USING (root)""")
def mm6h(t):
    """Clusters over the links that share a hash bucket."""
    return mm.cosine_clusters(stream(t).select("id", "v"), 0.4, 3, HASHED)


@query("mm7_hashed_merge", f"WITH {SIG} SELECT qid, iid AS rule, round(c,6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c,12) DESC, iid) AS r FROM cp WHERE qid%2=1 AND iid%2=0) WHERE r=1")
def mm7h(t):
    """The nearest rule of every candidate among those that share a hash bucket."""
    s = stream(t)
    side = lambda c, a: s.where(c).select(F.col("id").alias(f"{a}id"), F.col("v").alias(f"{a}v"))
    n = mm.nearest(side("id % 2 = 1", "q"), side("id % 2 = 0", "i"), hashed=HASHED)
    return n.select("qid", F.col("iid").alias("rule"), R6(F.col("cosine")).alias("cosine"))


@query("mm10_hashed_retrieval", f"WITH {SIG} SELECT qid, iid, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c,12) DESC, iid) AS rank FROM cp WHERE ic>=0.2) WHERE rank<=3")
def mm10h(t):
    """Three nearest stored items among those that share a hash bucket."""
    s = stream(t)
    items = s.where("confidence >= 0.2").select(F.col("id").alias("iid"), F.col("v").alias("iv"))
    return mm.nearest(s.select(F.col("id").alias("qid"), F.col("v").alias("qv")), items, 3, hashed=HASHED).select("qid", "iid", "rank")


@query("mm11_stream_composition", "WITH k AS (SELECT CASE WHEN toxic=1 THEN 'noise' WHEN quality=0 THEN 'conflict' WHEN quality=1 THEN 'clean' ELSE 'repeat' END AS kind FROM documents LEFT JOIN labels USING (doc_id)) SELECT kind, count(*) AS n, round(count(*)/(SELECT count(*) FROM k)::DOUBLE,6) AS share FROM k GROUP BY 1")
def mm11(t):
    k = F.when(F.col("toxic") == 1, "noise").when(F.col("quality") == 0, "conflict").when(F.col("quality") == 1, "clean").otherwise("repeat")
    g = t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", R6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("mm12_running_accuracy", f"WITH {ST} SELECT id, round(avg((error=0)::INT) OVER (ORDER BY id),6) AS running_accuracy FROM em")
def mm12(t):
    d = running(stream(t).select("id", "error"), [], ["id"], sums={"ok": (1 - F.col("error")), "n": F.lit(1)})
    return d.select("id", R6(F.col("ok") / F.col("n")).alias("running_accuracy"))


@query("mm12_final_metrics", f"WITH {ST}, p AS (SELECT *, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM em) SELECT round(avg((error=0)::INT),6) AS accuracy, round(avg((error=0)::INT) FILTER (WHERE k>0.8*n),6) AS last_fifth, round(avg((error=0)::INT) FILTER (WHERE k>0.5*n)-avg((error=0)::INT) FILTER (WHERE k<=0.5*n),6) AS forgetting, round(avg((error=1 AND confidence>0.5)::INT),6) AS pollution, count(*) AS memory_size FROM p")
def mm12b(t):
    d = numbered(stream(t).select("id", "error", "confidence"), [], ["id"], "k")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    ok = 1 - F.col("error")
    part = lambda c: F.avg(F.when(c, ok))
    late = F.col("k") > 0.5 * F.col("n")
    return d.join(F.broadcast(n)).agg(R6(F.avg(ok)).alias("accuracy"), R6(part(F.col("k") > 0.8 * F.col("n"))).alias("last_fifth"), R6(part(late) - part(~late)).alias("forgetting"),
                                      R6(F.avg(((F.col("error") == 1) & (F.col("confidence") > 0.5)).cast("int"))).alias("pollution"), F.count(F.lit(1)).alias("memory_size"))


@query("mm12_forgetting", f"WITH {ST}, f AS (SELECT *, id=min(id) OVER (PARTITION BY label) AS first FROM em) SELECT label AS task, count(*) FILTER (WHERE NOT first) AS repeats, max((error=0)::INT) FILTER (WHERE first)::INT AS first_right, round(avg((error=0)::INT) FILTER (WHERE NOT first),6) AS repeat_accuracy, round(avg((error=0)::INT) FILTER (WHERE NOT first)-max((error=0)::INT) FILTER (WHERE first),6) AS forgetting FROM f GROUP BY 1")
def mm12c(t):
    """Accuracy on repeats of a task less that on its first showing."""
    d = stream(t).select("id", "label", (1 - F.col("error")).alias("ok"))
    g = d.groupBy("label").agg(F.min_by("ok", "id").alias("first_right"), F.sum("ok").alias("right"), F.count(F.lit(1)).alias("n"))
    rep = F.try_divide(F.col("right") - F.col("first_right"), F.col("n") - 1)
    return g.select(F.col("label").alias("task"), (F.col("n") - 1).alias("repeats"), "first_right", R6(rep).alias("repeat_accuracy"), R6(rep - F.col("first_right")).alias("forgetting"))


@query("mm12_cost", "SELECT role, count(*) AS calls, sum(len(regexp_extract_all(coalesce(text,''), '[^ \\t\\n]+')))::BIGINT AS words, sum(length(coalesce(text,'')))::BIGINT AS chars FROM conversations GROUP BY 1")
def mm12d(t):
    """Calls, words and characters in and out, by role."""
    text = F.coalesce("text", F.lit(""))
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.regexp_count(text, F.lit("[^ \\t\\n]+"))).cast("long").alias("words"), F.sum(F.length(text)).cast("long").alias("chars"))


@query("mm13_paired_systems", f"""WITH {ST}, d AS (SELECT id, confidence*(1-error)-{sql_uniform("'sys2'", 'id')}*0.5 AS diff FROM em),
z AS (SELECT * FROM {st.sql_effects('d', 'id', N_BOOT, 'mm13')})
SELECT round(quantile_cont(dz,0.025),4) AS lo, round(quantile_cont(dz,0.975),4) AS hi FROM z""")
def mm13(t):
    d = stream(t).select("id", (F.col("confidence") * (1 - F.col("error")) - uniform(F.lit("sys2"), F.col("id")) * 0.5).alias("diff"))
    b = st.effect_bootstrap(d, [], "id", N_BOOT, "mm13")
    return b.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))
