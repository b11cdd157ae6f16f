"""Vector retrieval and associative memory on `embeddings`."""

from pyspark.sql import functions as F

from ..functions.draws import normal, sql_normal
from ..operators import retrieval as rt
from ..session import cut_lineage
from .registry import query

R6 = lambda c: F.round(c, 6)
EM = "em AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SG = EM + ", sg AS (SELECT id, label, list_transform(v, lambda x: CASE WHEN x<0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM em)"


def vectors(t):
    return t.packed().select(F.col("unit").alias("id"), F.col("cond").alias("label"), F.col("x").alias("v"))


def signs(t):
    return vectors(t).select("id", "label", F.transform("v", rt.sign).alias("x"))


def sides(d, col):
    return d.select(F.col("id").alias("qid"), F.col(col).alias("qv")), d.select(F.col("id").alias("iid"), F.col(col).alias("iv"))


@query("vr1_softmax_by_key", "WITH s AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey, l_quantity*l_discount AS s FROM lineitem), m AS (SELECT k, max(s) AS m FROM s GROUP BY 1), e AS (SELECT s.*, exp(s-m) AS e FROM s JOIN m USING (k)), t AS (SELECT k, sum(e) AS t FROM e GROUP BY 1) SELECT k, l_orderkey, l_linenumber, l_partkey, round(e/t,6) AS weight FROM e JOIN t USING (k)")
def vr1(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * F.col("l_discount")).alias("s"))
    return rt.softmax(d, "k", "s").select("k", "l_orderkey", "l_linenumber", "l_partkey", R6(F.col("weight")).alias("weight"))


ATT = "sc AS (SELECT q.id AS qid, i.id AS iid, {scale}*list_dot_product(q.{c},i.{c}) AS z, i.{c} AS val FROM {src} q, {src} i), mx AS (SELECT qid, max(z) AS m FROM sc GROUP BY 1), w AS (SELECT qid, exp(z-m) AS e, val FROM sc JOIN mx USING (qid)), tw AS (SELECT qid, sum(e) AS t FROM w GROUP BY 1)"


@query("vr2_softmax_attention", f"WITH {EM}, {ATT.format(scale='(1/8.0::DOUBLE)', c='v', src='em')}, o AS (SELECT qid, k, sum(e*val[k]) AS x FROM w, range(1,65) r(k) GROUP BY 1,2) SELECT qid, (k-1)::INT AS dim, round(x/t,6) AS out FROM o JOIN tw USING (qid)")
def vr2(t):
    # As stored: floats are half as large on the way, and become doubles where they are multiplied.
    q, i = sides(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "v")
    a = rt.attention(q, i, 1 / 8.0)
    return a.select("qid", F.posexplode("out").alias("dim", "out")).withColumn("out", R6(F.col("out")))


@query("vr3_multi_head_projection", f"WITH {EM}, wt AS (SELECT h, o, list({sql_normal(chr(39) + 'W' + chr(39), 'h', 'o', 'i')} ORDER BY i) AS w FROM range(0,2) a(h), range(0,3) b(o), range(0,64) c(i) GROUP BY 1,2) SELECT id, h::INT AS head, o::INT AS dim, round(list_dot_product(v,w),5) AS value FROM em, wt")
def vr3(t):
    """Two heads of three outputs; the weight matrix is a foldable constant."""
    col = lambda h, o: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: normal(F.lit("W"), h, o, i))
    heads = F.array(*[F.array(*[col(F.lit(h), F.lit(o)) for o in range(3)]) for h in range(2)])
    w = t.spark.range(1).select(heads.alias("w"))
    d = vectors(t).join(F.broadcast(w)).select("id", "v", F.posexplode("w").alias("head", "wh"))
    return d.select("id", "head", F.posexplode(rt.project(F.col("v"), F.col("wh"))).alias("dim", "value")).withColumn("value", F.round("value", 5))


def _head_sql(name, out):
    return f"{out} AS (SELECT id, h, list(list_dot_product(v,w) ORDER BY o) AS {out} FROM em, (SELECT h, o, list({sql_normal(chr(39) + name + chr(39), 'h', 'o', 'i')} ORDER BY i) AS w FROM range(0,2) a(h), range(0,3) b(o), range(0,64) c(i) GROUP BY 1,2) GROUP BY 1,2)"


@query("vr3_multi_head_attention", f"""WITH {EM}, {_head_sql('WQ', 'q')}, {_head_sql('WK', 'k')}, {_head_sql('WV', 'u')},
z AS (SELECT q.id, q.h, u.u, list_dot_product(q.q,k.k)*0.01 AS z FROM q JOIN k ON k.h=q.h JOIN u ON u.id=k.id AND u.h=k.h),
m AS (SELECT id, h, max(z) AS m FROM z GROUP BY 1,2), e AS (SELECT id, h, u, exp(z-m) AS e FROM z JOIN m USING (id, h)),
c AS (SELECT id, list(x ORDER BY h, o) AS x FROM (SELECT id, h, o, sum(e*u[o])/sum(e) AS x FROM e, range(1,4) r(o) GROUP BY 1,2,3) GROUP BY 1),
wo AS (SELECT o, list({sql_normal(chr(39) + 'WO' + chr(39), 'o', 'i')} ORDER BY i) AS w FROM range(0,6) b(o), range(0,6) c(i) GROUP BY 1)
SELECT id, o::INT AS dim, round(list_dot_product(x,w),4) AS value FROM c, wo""")
def vr3b(t):
    """Attention of two heads over projected queries, keys and values, joined and projected once more."""
    d = vectors(t)
    at = lambda name, h, outs, ins: F.array(*[F.transform(F.sequence(F.lit(0), F.lit(ins - 1)), lambda i: normal(F.lit(name), *h, F.lit(o), i)) for o in range(outs)])
    names = [(n, h) for h in range(2) for n in ("WQ", "WK", "WV")]
    w = t.spark.range(1).select(*[at(n, [F.lit(h)], 3, 64).alias(f"{n}{h}") for n, h in names], at("WO", [], 6, 6).alias("WO"))
    # Read several times per head: a few numbers per row, stored.
    p = cut_lineage(d.join(F.broadcast(w)).select("id", *[rt.project(F.col("v"), F.col(f"{n}{h}")).alias(f"{n}{h}") for n, h in names]))
    heads = None
    for h in range(2):
        a = rt.attention_low(p.select(F.col("id").alias("qid"), F.col(f"WQ{h}").alias("qv")), p.select(F.col("id").alias("iid"), F.col(f"WK{h}").alias("iv"), F.col(f"WV{h}").alias("val")), 0.01)
        a = a.select("qid", F.col("out").alias(f"o{h}"))
        heads = a if heads is None else heads.join(a, "qid")
    out = heads.join(F.broadcast(w.select("WO"))).select(F.col("qid").alias("id"), F.posexplode(rt.project(F.concat("o0", "o1"), F.col("WO"))).alias("dim", "value"))
    return out.withColumn("value", F.round("value", 4))


def _attend(src, n):
    """One attention step of every row of `src(id, q)` over the sign patterns."""
    return (f"z{n} AS (SELECT a.id, s.x, 8.0::DOUBLE*list_dot_product(a.q,s.x) AS z FROM {src} a, sg s), m{n} AS (SELECT id, max(z) AS m FROM z{n} GROUP BY 1), "
            f"e{n} AS (SELECT id, x, exp(z-m) AS e FROM z{n} JOIN m{n} USING (id)), d{n} AS (SELECT id, k, sum(e*x[k])/sum(e) AS v FROM e{n}, range(1,65) r(k) GROUP BY 1,2), "
            f"a{n} AS (SELECT id, list(v ORDER BY k) AS q FROM d{n} GROUP BY 1)")


@query("vr4_iterated_retrieval", f"WITH {SG}, a0 AS (SELECT id, list_transform(range(0,64), lambda i: CASE WHEN list_contains(hit,i) THEN -x[i+1] ELSE x[i+1] END) AS q FROM (SELECT id, x, list_slice(list_transform(list_sort(list_transform(range(0,64), lambda i: concat(md5(concat_ws('|','vr4',id,i)),'#',i))), lambda s: split_part(s,'#',2)::INT),1,6) AS hit FROM sg)), {_attend('a0', 1)}, {_attend('a1', 2)}, {_attend('a2', 3)} SELECT a3.id AS qid, len(list_filter(range(1,65), lambda k: (CASE WHEN q[k]<0 THEN -1.0 ELSE 1.0 END)<>x[k]))::INT AS n_wrong FROM a3 JOIN sg ON sg.id=a3.id")
def vr4(t):
    """Corrupted patterns completed by three attention steps; errors per pattern."""
    s = signs(t).withColumn("x", F.col("x").cast("array<tinyint>"))
    bad = s.select(F.col("id").alias("qid"), rt.corrupt(F.col("x"), 6, F.lit("vr4"), F.col("id").cast("string")).alias("qv"))
    r = rt.retrieve_iterated(bad, sides(s, "x")[1])
    j = r.join(s.select(F.col("id").alias("qid"), "x"), "qid")
    return j.select("qid", F.size(F.filter(F.zip_with("state", "x", lambda a, b: a != b), lambda e: e)).alias("n_wrong"))


@query("vr5_one_step_retrieval", f"WITH {SG}, {ATT.format(scale='(1/8.0::DOUBLE)', c='x', src='sg')}, o AS (SELECT qid, k, sum(e*val[k])/max(t) AS x FROM w JOIN tw USING (qid), range(1,65) r(k) GROUP BY 1,2) SELECT qid, count(*) FILTER (WHERE (CASE WHEN o.x<0 THEN -1.0 ELSE 1.0 END)<>sg.x[k])::INT AS n_wrong FROM o JOIN sg ON sg.id=qid GROUP BY 1")
def vr5(t):
    s = signs(t)
    q, i = sides(s, "x")
    a = rt.attention(q, i, 1 / 8.0).join(s.select(F.col("id").alias("qid"), "x"), "qid")
    return a.select("qid", F.size(F.filter(F.zip_with(F.transform("out", rt.sign), "x", lambda p, q: p != q), lambda e: e)).alias("n_wrong"))


@query("vr6_hebbian_weights", f"WITH {SG} SELECT (i-1)::INT AS i, (j-1)::INT AS j, round(CASE WHEN i=j THEN 0 ELSE sum(x[i]*x[j])/64.0 END,6) AS w FROM sg, range(1,65) a(i), range(1,65) b(j) GROUP BY i,j")
def vr6(t):
    return rt.hebbian(signs(t), 64).withColumn("w", R6(F.col("w")))


HB = "w AS (SELECT i, list(CASE WHEN i=j THEN 0.0::DOUBLE ELSE s END ORDER BY j) AS r FROM (SELECT i,j,sum(x[i]*x[j])/64.0 AS s FROM sg, range(1,65) a(i), range(1,65) b(j) GROUP BY 1,2) GROUP BY 1), wm AS (SELECT list(r ORDER BY i) AS m FROM w)"
SGN = "list_transform(list_transform(m, lambda r: list_dot_product(r,{s})), lambda z: CASE WHEN z<0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"


@query("vr6_sign_iterations", f"WITH {SG}, {HB}, s1 AS (SELECT id,x,m,{SGN.format(s='x')} AS s FROM sg, wm), s2 AS (SELECT id,x,m,{SGN.format(s='s')} AS s FROM s1) SELECT id, len(list_filter(range(1,65), lambda k: s[k]<>x[k]))::INT AS n_changed FROM s2")
def vr6b(t):
    s = signs(t)
    m = rt.as_matrix(rt.hebbian(s, 64))
    d = s.join(F.broadcast(m)).withColumn("y", rt.settle(F.col("x"), F.col("mat"), 2))
    return d.select("id", F.size(F.filter(F.zip_with("y", "x", lambda a, b: a != b), lambda e: e)).alias("n_changed"))


@query("vr7_retrieval_error_sweep", f"""WITH {SG}, ld AS (SELECT g::INT AS g, id, x FROM sg, range(0,10) q(g) WHERE label<=g), w AS (SELECT g,i,list(CASE WHEN i=j THEN 0.0::DOUBLE ELSE s END ORDER BY j) AS r FROM (SELECT g,i,j,sum(x[i]*x[j])/64.0 AS s FROM ld, range(1,65) a(i), range(1,65) b(j) GROUP BY 1,2,3) GROUP BY 1,2), wm AS (SELECT g, list(r ORDER BY i) AS m FROM w GROUP BY 1),
rk AS (SELECT g,id,x,list_slice(list_transform(list_sort(list_transform(range(0,64), lambda i: concat(md5(concat_ws('|','vr7',id,i)),'#',i))), lambda s: split_part(s,'#',2)::INT),1,6) AS hit FROM ld),
c AS (SELECT g,id,x,list_transform(range(0,64), lambda i: CASE WHEN list_contains(hit,i) THEN -x[i+1] ELSE x[i+1] END) AS s FROM rk), o AS (SELECT g,id,x,{SGN.format(s='s')} AS s FROM c JOIN wm USING (g))
SELECT g AS level, count(*) AS n_stored, round(avg(len(list_filter(range(1,65), lambda k: s[k]<>x[k]))/64.0),6) AS error_rate FROM o GROUP BY 1""")
def vr7(t):
    """Stored set grows label by label; every stored pattern is corrupted and recalled."""
    s = signs(t).withColumn("level", F.explode(F.sequence(F.col("label"), F.lit(9))))
    m = rt.as_matrix(rt.hebbian(s, 64, ["level"]), ["level"])
    d = s.join(m, "level")
    y = rt.settle(rt.corrupt(F.col("x"), 6, F.lit("vr7"), F.col("id").cast("string")), F.col("mat"), 1)
    wrong = F.size(F.filter(F.zip_with(y, "x", lambda a, b: a != b), lambda e: e)) / 64.0
    return d.groupBy("level").agg(F.count(F.lit(1)).alias("n_stored"), R6(F.avg(wrong)).alias("error_rate"))
